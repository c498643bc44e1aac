import struct

import numpy as np
import pytest

from tests_llm_shared import ODD_ROWS, texts_of
from wattline.llm import media


def payloads():
    rng = np.random.default_rng(1)
    some = [rng.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (1, 63, 64, 65, 500, 5000)]
    zeros = [b"", bytes([128]) * 640, bytes([128]) * 63 + b"a", b"a" + bytes([128]) * 200, bytes([255]) * 300]
    sparse = np.full(2000, 128, np.uint8)
    sparse[rng.integers(0, 2000, 40)] = 7
    return some + zeros + [sparse.tobytes()]


def test_payloads_come_back():
    data = payloads()
    images = media.store(data)
    for p, (image, blocks) in zip(data, media.read(images), strict=True):
        padded = p + bytes(-len(p) % 64 if p else 64)
        assert media.payload_of(image, blocks) == (len(p), padded)
    assert media.store([data[3]]) == [images[3]]


def code_by_code(image, data):
    """Coefficients of one image, a bit at a time."""
    unit, across, down = media.layout(image)
    stream, ends = media.intervals_of(data, image["data"])
    bits = np.unpackbits(stream)
    units = across * down
    each = image["restart"] or units
    out = []
    begin = 0
    for i, end in enumerate(ends):
        at = begin * 8
        before = dict.fromkeys(range(4), 0)

        def code(segment):
            nonlocal at
            table = {(int(n), int(c)): int(s) for s, c, n in zip(*media.canonical(segment))}
            n = c = 0
            while (n, c) not in table:
                c, n, at = c * 2 + int(bits[at]), n + 1, at + 1
            return table[n, c]

        def value(size):
            nonlocal at
            raw = int("".join(map(str, bits[at : at + size])) or "0", 2)
            at += size
            return raw if size and raw >> (size - 1) else raw - (1 << size) + 1 if size else 0

        for _ in range(min(each, units - i * each)):
            for c in unit.tolist():
                dc, ac = image["scan"][image["parts"][c][0]]
                block = [0] * 64
                before[c] += value(code(image["dc"][dc]))
                block[0], k = before[c], 1
                while k < 64:
                    symbol = code(image["ac"][ac])
                    if symbol == 0:
                        break
                    k += symbol >> 4
                    if symbol != 0xF0:
                        block[k] = value(symbol & 15)
                    k += 1
                out.append(block)
        begin = end
    return np.array(out)


def colour_image(restart):
    """Three components, the first one sampled 2 x 2, written unit by unit."""
    rng = np.random.default_rng(8)
    wide, high = 37, 21
    across, down, unit = 3, 2, [0, 0, 0, 0, 1, 2]
    blocks = rng.integers(-9, 10, (across * down * len(unit), 64)) * (rng.random((across * down * len(unit), 64)) < 0.2)
    dc, ac = (media.table_segment(x) for x in media.code_lengths())
    size = lambda v: int(abs(v)).bit_length()

    def put(table, symbol, v, n):
        code, length = media.by_symbol(table)
        word = format(int(code[symbol]), f"0{int(length[symbol])}b")
        return word + (format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else "")

    out, before, bits, done = b"", [0, 0, 0], "", 0

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        raw = int(bits or "0", 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        bits = ""
        return raw

    for i, block in enumerate(blocks.tolist()):
        c = unit[i % len(unit)]
        if restart and i and i % (restart * len(unit)) == 0:
            out += flush() + bytes([0xFF, 0xD0 + done % 8])
            done, before = done + 1, [0, 0, 0]
        diff = block[0] - before[c]
        before[c] = block[0]
        bits += put(dc, size(diff), diff, size(diff))
        run = 0
        last = max([k for k in range(1, 64) if block[k]], default=0)
        for k in range(1, last + 1):
            if block[k] == 0:
                run += 1
                continue
            while run > 15:
                bits += put(ac, 0xF0, 0, 0)
                run -= 16
            bits += put(ac, run << 4 | size(block[k]), block[k], size(block[k]))
            run = 0
        if last < 63:
            bits += put(ac, 0, 0, 0)
    out += flush()
    frame = struct.pack(">BHHB", 8, high, wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    head = [
        b"\xff\xd8", media.marker(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), media.marker(0xDB, b"\0" + bytes(range(3, 67))),
        media.marker(0xC0, frame), media.marker(0xC4, b"\0" + dc), media.marker(0xC4, b"\x10" + ac),
        media.marker(0xDD, struct.pack(">H", restart)) if restart else b"",
        media.marker(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ]
    return b"".join(head) + out + b"\xff\xd9", blocks, (across, down)


@pytest.mark.parametrize("restart", [0, 1, 4])
def test_other_images(restart):
    data, want, (across, down) = colour_image(restart)
    image, blocks = media.read([data])[0]
    assert (image["width"], image["height"]) == (37, 21)
    assert (blocks == want).all() and (code_by_code(image, data) == want).all()
    pixels = media.thumbnail(image, blocks)
    assert pixels.shape == (2 * down, 2 * across)
    # Unit 1, its third block: second row, first column of that unit.
    dc = want[6 + 2, 0]
    assert pixels[1, 2] == np.clip(np.floor(dc * 3 / 8 + 128.5), 0, 255)


def test_broken_bytes_are_null():
    data, _, _ = colour_image(4)
    sound = media.store([b"hello"])[0]
    progressive = data.replace(b"\xff\xc0", b"\xff\xc2", 1)
    bad = [None, b"", b"\xff\xd8", data[:80], data[:-40], sound[:-2], progressive, b"GIF89a" + bytes(50)]
    assert media.read(bad) == [None] * len(bad)
    assert media.payload_of(*media.read([None, sound, b"x"])[1])[0] == 5


def test_columns(odd, spark):
    got = media.features(media.stored(odd)).collect()
    assert sorted(r.n_bytes for r in got) == sorted(len(t.encode()) for _, t in texts_of())
    assert len(got) == len(ODD_ROWS) and all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in got)
    same = {(r.media_sha256, r.feature, r.tail_crc32) for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1
    other = spark.createDataFrame([(1, None), (2, bytearray(b"no image"))], "doc_id long, media binary")
    a, b = sorted(media.features(other).collect())
    assert a.media_bytes is None and b.media_bytes == 8 and b.feature is None


def test_empty_table(none):
    assert media.features(media.stored(none)).count() == 0
