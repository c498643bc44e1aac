"""Media columns: bytes kept in baseline JPEG images, and features of images.

``store`` writes a payload into a grey baseline image without loss: the format's unit is the
quantised coefficient, and byte ``b`` is the coefficient ``b - 128``, 64 to a block in zigzag
order, with a quantisation of 1.  A comment segment holds the lengths.  ``read`` parses the
markers of any baseline image (several components and sampling factors, with or without
restart intervals), decodes the Huffman codes of its scan, and reconstructs a thumbnail of
the first component from its DC coefficients alone, one pixel a block.

Huffman decoding runs over all restart intervals of a batch side by side: each step decodes
one code in every interval with numpy.  Images are written with a restart interval of
``RESTART`` blocks for this, so that long images are many short intervals.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import chunks

RESTART = 4
# Payload bytes that a worker encodes or decodes at once; a longer one is alone.
BYTES = 1_500_000
LARGEST_SIDE = 8191  # blocks


class Broken(ValueError):
    """Bytes that are no baseline image."""


# ---- codes -----------------------------------------------------------------------------


def code_lengths() -> tuple[dict[int, int], dict[int, int]]:
    """Code length of each DC and AC symbol that ``store`` uses.

    Coefficients without zeros before them have the short codes, as text has few bytes 128.
    """
    dc = dict.fromkeys(range(12), 4)
    ac = dict.fromkeys((run << 4 | size for run in range(16) for size in range(1, 11)), 9)
    ac.update(dict.fromkeys(range(1, 9), 4))
    ac[0x00], ac[0xF0] = 5, 9
    return dc, ac


def table_segment(lengths: dict[int, int]) -> bytes:
    """The 16 counts and the symbols by code length, as a table segment holds them."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == bits for n in lengths.values()) for bits in range(1, 17)]
    return bytes(counts) + bytes(order)


def canonical(segment: bytes):
    """(symbols, codes, lengths) of a table segment."""
    counts = segment[:16]
    symbols = np.frombuffer(segment[16 : 16 + sum(counts)], np.uint8)
    codes, lengths, code = [], [], 0
    for bits, count in enumerate(counts, 1):
        for _ in range(count):
            codes.append(code)
            lengths.append(bits)
            code += 1
        code <<= 1
    if len(symbols) != len(codes) or any(c >> n for c, n in zip(codes, lengths)):
        raise Broken("Huffman table")
    return symbols, np.array(codes, np.int64), np.array(lengths, np.int64)


def lookup(segment: bytes) -> np.ndarray:
    """For every 16-bit window: code length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, code, n in zip(*(x.tolist() for x in canonical(segment))):
        out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
    return out


def by_symbol(segment: bytes):
    symbols, codes, lengths = canonical(segment)
    code, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code[symbols], length[symbols] = codes, lengths
    return code, length


# ---- writing ---------------------------------------------------------------------------


def scan_bytes(blocks: np.ndarray, segment: np.ndarray, dc_table: bytes, ac_table: bytes):
    """Entropy-coded bytes of all segments, without markers and stuffing.

    ``blocks``: coefficients in zigzag order; ``segment``: its restart interval, rising.
    Returns the bytes and where each segment begins (one more at the end).
    """
    size_of = np.zeros(2048, np.int64)
    for s in range(1, 12):
        size_of[1 << (s - 1) : 1 << s] = s
    n = len(blocks)
    new = np.ones(n, bool)
    new[1:] = segment[1:] != segment[:-1]
    dc = blocks[:, 0].astype(np.int64)
    diff = dc.copy()
    diff[1:] -= np.where(new[1:], 0, dc[:-1])
    at, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    value = blocks[at, k].astype(np.int64)
    same = np.zeros(len(at), bool)
    same[1:] = at[1:] == at[:-1]
    before = np.zeros(len(at), np.int64)
    before[1:] = np.where(same[1:], k[:-1], 0)
    run = k - before - 1
    last = np.zeros(n, np.int64)
    last[at] = k
    open_ = np.flatnonzero(last < 63)
    long = np.repeat(np.arange(len(at)), run // 16)
    nth = np.arange(len(long)) - np.searchsorted(long, long)

    def coded(table, symbol, bits, size):
        code, length = by_symbol(table)
        return code[symbol] << size | np.where(bits < 0, bits + (1 << size) - 1, bits), length[symbol] + size

    size_dc, size_ac = size_of[np.abs(diff)], size_of[np.abs(value)]
    zero = np.zeros(1, np.int64)
    parts = [
        (np.arange(n) * 256, *coded(dc_table, size_dc, diff, size_dc)),
        (at * 256 + 4 * k, *coded(ac_table, (run % 16) << 4 | size_ac, value, size_ac)),
        (at[long] * 256 + 4 * k[long] - 3 + nth, *coded(ac_table, np.full(len(long), 0xF0), zero[[0] * len(long)], zero)),
        (open_ * 256 + 255, *coded(ac_table, np.zeros(len(open_), np.int64), zero[[0] * len(open_)], zero)),
    ]
    place, word, bits = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(place, kind="stable")
    place, word, bits = place[order], word[order], bits[order]
    mine = segment[place // 256] - segment[0]
    ends = np.cumsum(bits)
    first = np.searchsorted(mine, np.arange(int(mine[-1]) + 2))
    begin_bits = np.where(first > 0, ends[first - 1], 0)
    in_bits = np.diff(np.append(begin_bits[:-1], ends[-1]))
    in_bytes = (in_bits + 7) // 8
    starts = np.concatenate(([0], np.cumsum(in_bytes)))
    offset = ends - bits - begin_bits[mine] + 8 * starts[mine]
    word = word << (32 - bits - offset % 8)
    out = np.zeros(int(starts[-1]) + 4)
    for i in range(4):
        out += np.bincount(offset // 8 + i, (word >> (24 - 8 * i)) & 255, minlength=len(out))
    out = out[: starts[-1]].astype(np.uint8)
    out[starts[1:] - 1] |= ((1 << (8 * in_bytes - in_bits)) - 1).astype(np.uint8)
    return out, starts


def store(payloads: list[bytes]) -> list[bytes]:
    """One image per payload; each is padded with zeros to a positive multiple of 64 bytes."""
    dc_table, ac_table = (table_segment(x) for x in code_lengths())
    padded = [p + bytes(-len(p) % 64 if p else 64) for p in payloads]
    blocks_of = np.array([len(p) // 64 for p in padded])
    wide = np.maximum(1, np.ceil(np.sqrt(blocks_of))).astype(np.int64)
    high = -(-blocks_of // wide)
    if (wide > LARGEST_SIDE).any():
        raise ValueError("A payload is too long for one image")
    whole = b"".join(p + b"\x80" * (64 * int(w * h) - len(p)) for p, w, h in zip(padded, wide, high))
    blocks = np.frombuffer(whole, np.uint8).reshape(-1, 64).astype(np.int16) - 128
    area = wide * high
    owner = np.repeat(np.arange(len(padded)), area)
    within = np.arange(len(blocks)) - np.repeat(np.cumsum(area) - area, area)
    intervals = -(-area // RESTART)
    segment = (np.cumsum(intervals) - intervals)[owner] + within // RESTART
    coded, starts = scan_bytes(blocks, segment, dc_table, ac_table)
    # Stuffing after each byte 255, then a restart marker after each interval but the last.
    last = np.cumsum(intervals) - 1
    inner = np.setdiff1d(np.arange(len(starts) - 1), last)
    nth = inner - (np.cumsum(intervals) - intervals)[np.searchsorted(last, inner)]
    stuffed = np.flatnonzero(coded == 255) + 1
    at = np.concatenate([stuffed, np.repeat(starts[inner + 1], 2)])
    put = np.concatenate([np.zeros(len(stuffed), np.uint8), np.column_stack([np.full(len(inner), 255), 0xD0 + nth % 8]).ravel().astype(np.uint8)])
    order = np.argsort(at, kind="stable")
    full = np.insert(coded, at[order], put[order]).tobytes()
    ends = starts[last + 1] + np.searchsorted(at[order], starts[last + 1], "right")
    # A marker of the next image's first interval never lies on an image's end.
    out, begin = [], 0
    for p, q, w, h, end in zip(payloads, padded, wide.tolist(), high.tolist(), ends.tolist()):
        out.append(header(len(p), len(q), w, h, dc_table, ac_table) + full[begin:end] + b"\xff\xd9")
        begin = end
    return out


def marker(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def header(n_bytes: int, payload: int, wide: int, high: int, dc_table: bytes, ac_table: bytes) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            marker(0xFE, struct.pack(">4sQQ", b"LOAD", n_bytes, payload)),
            marker(0xDB, bytes([0]) + bytes([1] * 64)),
            marker(0xC0, struct.pack(">BHHBBBB", 8, 8 * high, 8 * wide, 1, 1, 0x11, 0)),
            marker(0xC4, b"\x00" + dc_table + b"\x10" + ac_table),
            marker(0xDD, struct.pack(">H", RESTART)),
            marker(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


# ---- reading ---------------------------------------------------------------------------


def parse(data: bytes) -> dict:
    """Frame, tables and scan of an image with one baseline scan."""
    if data[:2] != b"\xff\xd8":
        raise Broken("no image")
    at, found = 2, {"quant": {}, "dc": {}, "ac": {}, "restart": 0, "comment": b""}
    while True:
        while data[at : at + 1] == b"\xff" and data[at + 1 : at + 2] == b"\xff":
            at += 1
        if len(data) < at + 4 or data[at] != 0xFF:
            raise Broken("markers")
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise Broken("segment length")
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                found["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(int)
                body = body[1 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                end = 17 + sum(body[1:17])
                found["ac" if body[0] >> 4 else "dc"][body[0] & 15] = bytes(body[1:end])
                body = body[end:]
        elif kind == 0xC0:
            bits, high, wide, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not high or not wide or not n or len(body) != 6 + 3 * n:
                raise Broken("frame")
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * n, 3)]
            found |= {"width": wide, "height": high, "parts": parts}
        elif 0xC1 <= kind <= 0xCF and kind != 0xC8:
            raise Broken("not baseline")
        elif kind == 0xDD:
            found["restart"] = struct.unpack(">H", body[:2])[0]
        elif kind == 0xFE:
            found["comment"] = bytes(body)
        elif kind == 0xDA:
            n = body[0] if body else 0
            if "parts" not in found or n != len(found["parts"]):
                raise Broken("scan")
            found["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)}
            found["data"] = at
            return found


def layout(image: dict):
    """Blocks of a minimum unit, and units across and down."""
    parts = image["parts"]
    if len(parts) == 1:  # one component is never interleaved
        unit, across, down = [0], -(-image["width"] // 8), -(-image["height"] // 8)
    else:
        most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
        if not all(1 <= p[1] <= 4 and 1 <= p[2] <= 4 for p in parts):
            raise Broken("sampling")
        unit = [i for i, p in enumerate(parts) for _ in range(p[1] * p[2])]
        across, down = -(-image["width"] // (8 * most_h)), -(-image["height"] // (8 * most_v))
    return np.array(unit), across, down


def intervals_of(data: bytes, at: int):
    """Entropy-coded bytes of a scan without stuffing, and where each interval ends."""
    raw = np.frombuffer(data, np.uint8)[at:]
    full = np.flatnonzero(raw[:-1] == 255)
    after = raw[full + 1]
    stop = full[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 255)]
    if not len(stop):
        raise Broken("no end")
    end = stop[0]
    full, after = full[full < end], after[full < end]
    restarts = full[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.concatenate([full[after == 0] + 1, restarts, restarts + 1])
    keep = np.ones(end, bool)
    keep[drop] = False
    ends = np.concatenate([restarts, [end]])
    return raw[:end][keep], ends - np.searchsorted(np.sort(drop), ends)


def decode(images: list[dict], datas: list[bytes]) -> list[np.ndarray]:
    """Coefficients in zigzag order of every block of each image, in scan order."""
    tables: dict[bytes, int] = {}
    looks: list[np.ndarray] = []

    def table(segment: bytes | None) -> int:
        if segment is None:
            raise Broken("missing table")
        if segment not in tables:
            tables[segment] = len(looks)
            looks.append(lookup(segment))
        return tables[segment]

    lanes, streams, at_byte, at_block, unit_rows = [], [], 0, 0, []
    spans = []
    for i, (image, data) in enumerate(zip(images, datas)):
        unit, across, down = layout(image)
        stream, ends = intervals_of(data, image["data"])
        units = across * down
        each = image["restart"] or units
        if len(ends) != -(-units // each):
            raise Broken("restart intervals")
        picks = []
        for c in unit.tolist():
            ids = image["scan"].get(image["parts"][c][0])
            if ids is None:
                raise Broken("component")
            picks.append((c, table(image["dc"].get(ids[0])), table(image["ac"].get(ids[1]))))
        begins = np.concatenate(([0], ends[:-1])) + at_byte
        count = np.minimum(each, units - np.arange(len(ends)) * each) * len(unit)
        first = at_block + np.arange(len(ends)) * each * len(unit)
        lanes.append(np.column_stack([begins * 8, (ends + at_byte) * 8, first, count, np.full(len(ends), i)]))
        streams.append(stream)
        unit_rows.append(picks)
        spans.append((at_block, at_block + units * len(unit)))
        at_byte += len(stream)
        at_block += units * len(unit)
    out = np.zeros((at_block, 64), np.int16)
    if not lanes:
        return []
    flat = np.concatenate([*streams, np.zeros(8, np.uint8)]).astype(np.uint64)
    window = flat[:-7] << np.uint64(56)
    for i in range(1, 8):
        window = window | flat[i : len(flat) - 7 + i] << np.uint64(56 - 8 * i)
    look = np.stack(looks)
    most = max(map(len, unit_rows))
    rows = np.zeros((len(unit_rows), most, 3), np.int64)
    length = np.array([len(r) for r in unit_rows])
    for i, r in enumerate(unit_rows):
        rows[i, : len(r)] = r
    lane = np.concatenate(lanes)
    pos, stop, block, left, image = (lane[:, j].copy() for j in range(5))
    k, turn = np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
    before = np.zeros((len(lane), 4), np.int64)
    index = np.arange(len(lane))
    while len(pos):
        now = rows[image, turn]
        bits = window[pos >> 3] << (pos & 7).astype(np.uint64)
        is_dc = k == 0
        entry = look[np.where(is_dc, now[:, 1], now[:, 2]), (bits >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        used, symbol = entry >> 8, entry & 255
        size = symbol & 15
        raw = ((bits << used.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value = np.where(raw >> np.maximum(size - 1, 0), raw, raw - (1 << size) + 1) * (size > 0)
        pos = pos + used + size
        if (used == 0).any() or (pos > stop).any():
            raise Broken("codes")
        # DC: the difference to the component's last block.
        part = now[:, 0]
        mine = before[index, part]
        total = np.where(is_dc, mine + value, mine)
        before[index, part] = total
        end_block = ~is_dc & (symbol == 0)
        skip = ~is_dc & (symbol == 0xF0)
        k = np.where(is_dc, 0, k + (symbol >> 4))
        write = ~(end_block | skip)
        if (k[write] > 63).any():
            raise Broken("block")
        out[block[write], k[write]] = np.where(is_dc, total, value)[write]
        k = k + 1
        done = end_block | (k > 63)
        k[done] = 0
        block = block + done
        left = left - done
        turn = turn + done
        turn[turn == length[image]] = 0
        if done.any() and (left == 0).any():
            stay = left > 0
            pos, stop, block, left, image, k, turn = (x[stay] for x in (pos, stop, block, left, image, k, turn))
            before = before[stay]
            index = np.arange(len(pos))
    return [out[a:b] for a, b in spans]


def thumbnail(image: dict, blocks: np.ndarray) -> np.ndarray:
    """Grey pixels of the first component, one per block, from DC coefficients only."""
    unit, across, down = layout(image)
    _, h, v, q = image["parts"][0]
    if len(image["parts"]) == 1:
        h = v = 1
    first = np.flatnonzero(unit == 0)
    dc = blocks[:, 0].reshape(down, across, len(unit))[:, :, first].reshape(down, across, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h).astype(np.int64)
    if q not in image["quant"]:
        raise Broken("missing table")
    return np.clip(np.floor(dc * image["quant"][q][0] / 8 + 128.5), 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits: whether brightness rises along each row of an 8 x 9 grid of means."""
    rows = np.arange(9) * pixels.shape[0] // 8
    cols = np.arange(10) * pixels.shape[1] // 9
    total = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    top, left = np.minimum(rows[:8], pixels.shape[0] - 1), np.minimum(cols[:9], pixels.shape[1] - 1)
    low, right = np.maximum(rows[1:], top + 1), np.maximum(cols[1:], left + 1)
    area = (low - top)[:, None] * (right - left)[None, :]
    means = (total[low][:, right] - total[top][:, right] - total[low][:, left] + total[top][:, left]) / area
    return np.packbits((means[:, 1:] > means[:, :-1]).ravel()).tobytes().hex()


def payload_of(image: dict, blocks: np.ndarray) -> tuple[int, bytes] | None:
    """Unpadded length and payload of an image that ``store`` wrote; None of another one."""
    note = image["comment"]
    if len(note) != 20 or note[:4] != b"LOAD":
        return None
    _, n_bytes, size = struct.unpack(">4sQQ", note)
    return n_bytes, (blocks.ravel()[:size] + 128).astype(np.uint8).tobytes()


def read(datas: list[bytes | None]) -> list[tuple | None]:
    """(image, blocks) per entry; None for a null and for bytes that are no baseline image."""
    parsed = []
    for data in datas:
        try:
            parsed.append(parse(data) if data is not None else None)
        except (Broken, struct.error, IndexError, ValueError):
            parsed.append(None)
    sound = [i for i, p in enumerate(parsed) if p is not None]
    try:
        found = dict(zip(sound, decode([parsed[i] for i in sound], [datas[i] for i in sound])))
    except Broken:  # one by one, to lose only what is broken
        found = {}
        for i in sound:
            try:
                found[i] = decode([parsed[i]], [datas[i]])[0]
            except Broken:
                pass
    return [(parsed[i], found[i]) if i in found else None for i in range(len(datas))]


# ---- columns ---------------------------------------------------------------------------


def stored(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): each whole text as UTF-8 in an image; null counts as empty.

    Equal texts give equal images; repeated rows are stored each; an empty table gives no
    rows; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            ids = pdf["doc_id"]
            raw = [t.encode("utf-8", "surrogatepass") for t in pdf["text"]]
            for part in chunks(raw, BYTES):
                yield pd.DataFrame({"doc_id": ids.iloc[part].to_numpy(), "media": store([raw[i] for i in part])})

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, media binary")


READ = """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,
media_bytes long, media_sha256 string, width int, height int, feature string"""


def features(media: DataFrame, id_: str = "doc_id", column: str = "media") -> DataFrame:
    """Dimensions, thumbnail hashes and payload digests of a column of images.

    ``feature`` holds the size in pixels, the thumbnail's difference hash and the first
    digits of its SHA-256.  Bytes that are no baseline image have media_bytes and
    media_sha256 only; nulls have nothing; the payload's columns are null for images that
    ``stored`` did not write.
    """

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            datas = [None if x is None else bytes(x) for x in pdf["media"]]
            rows = []
            for part in chunks([x or b"" for x in datas], 2 * BYTES):
                for i, got in zip(part, read([datas[i] for i in part])):
                    rows.append((pdf["doc_id"].iloc[i], *describe(datas[i], got)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(",")])
            whole = ["doc_id", "n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "width", "height"]
            yield out.astype(dict.fromkeys(whole, "Int64"))

    return media.select(F.col(id_).cast("long").alias("doc_id"), F.col(column).alias("media")).mapInPandas(run, READ)


def describe(data: bytes | None, got: tuple | None) -> tuple:
    if data is None:
        return (None,) * 9
    own = (len(data), hashlib.sha256(data).hexdigest())
    if got is None:
        return (None, None, None, None, *own, None, None, None)
    image, blocks = got
    pixels = thumbnail(image, blocks)
    feature = f"{image['width']}x{image['height']}:{difference_hash(pixels)}:{hashlib.sha256(pixels.tobytes()).hexdigest()[:16]}"
    held = payload_of(image, blocks)
    if held is None:
        return (None, None, None, None, *own, image["width"], image["height"], feature)
    n_bytes, payload = held
    sha = hashlib.sha256(payload).hexdigest()
    return (n_bytes, len(payload), sha, zlib.crc32(payload[-64:]), *own, image["width"], image["height"], feature)
