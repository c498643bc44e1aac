"""Ranked lexical search over bit-sliced Bloom signatures.

Index, one pass over all texts: a document's signature is a Bloom filter of its terms and of marks "this
term occurs at least 2, 3, 4, 6, 8, ... times".  Documents whose signatures have the same number of
bits are put in blocks, and a block is stored by bits: one bitmap over its documents for every bit.

Search, per block and item: the bitmaps of a term's bits, taken together, hold all documents with the
term and some without.  Sums of the terms' weights over these bitmaps, level by level of
occurrences, with each document's own length, are an upper bound of its score.

1. The k documents of highest bound per item are scored exactly.  The k-th of those scores is one that the
   k-th best document reaches at least.
2. All documents whose bound reaches that score are scored exactly, from their whole texts.

Of documents with equal texts only the k smallest ids can be among the best, so no more of them get a
signature; the counts that weights depend on are over all rows.  Items come in blocks of a
bounded number of terms, the only data every task receives; texts are joined with the
documents wanted by broadcast up to ``BROADCAST`` of these and by a shuffle beyond.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import chunks
from wattline.llm.hashing import mix
from wattline.sources.sinks import stage

# Terms in UTF-8: digits, letters A to Z lower-cased, everything beyond ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
# Bits per entry (up to twice as many, as sizes are powers of two) and bits set by each.
BITS, PROBES = 8, 3
# Bytes of a block of signatures, and documents it has at most.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 8_192
# Characters of texts indexed at once; terms that a task counts before it gives its counts away,
# and terms whose hashes it remembers.
CHARS, COUNTED = 1_000_000, 200_000
# Terms of items that are searched for in one pass; up to as many distinct ones are sent to the tasks
# that count, beyond that they count all terms.
ITEM_TERMS = 100_000
# Wanted documents up to which they are sent to all tasks that read texts.
BROADCAST = 500_000

_ROW = "doc_id long, ref long, same binary, n long, bits long, signature binary, term binary, df long"


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def levels(most: int) -> np.ndarray:
    """1, 2, 3, 4, 6, 8, 12, 16, ... up to ``most``."""
    out = [1, 2, 3]
    while out[-1] <= most:
        out.append(2 * out[-2])
    return np.array([x for x in out if x <= max(1, most)], np.int64)


def entries(hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A 64-bit number per term and level of occurrences."""
    return mix(hashes + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def places(numbers: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """The bits of each entry, one row per probe."""
    mask = np.asarray(bits, np.uint64) - np.uint64(1)
    step = (numbers >> np.uint64(32)) | np.uint64(1)
    return np.stack([(numbers + np.uint64(i) * step) & mask for i in range(PROBES)]).astype(np.int64)


def hash_of(term: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term)


def signatures(counts: list[Counter], known: dict[bytes, int]) -> list[tuple[int, bytes]]:
    """(bits, signature) of documents given by their terms' counts."""
    sizes = np.array([len(c) for c in counts], np.int64)
    for c in counts:
        for t in c:
            if t not in known:
                known[t] = hash_of(t)
    hashes = np.fromiter((known[t] for c in counts for t in c), np.uint64, int(sizes.sum()))
    tf = np.fromiter((x for c in counts for x in c.values()), np.int64, len(hashes))
    steps = levels(int(tf.max(initial=1)))
    high = np.searchsorted(steps, tf, "right")  # levels that each term reaches
    owner = np.repeat(np.arange(len(counts)), sizes)
    n_entries = np.bincount(owner, high, len(counts)).astype(np.int64)
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, n_entries * BITS))).astype(np.int64))
    at = np.repeat(np.arange(len(tf)), high)
    level = np.arange(len(at)) - np.repeat(np.cumsum(high) - high, high)
    base = np.cumsum(bits) - bits
    whose = owner[at]
    set_bits = np.zeros(int(bits.sum()), np.uint8)
    set_bits[(places(entries(hashes[at], level), bits[whose]) + base[whose]).ravel()] = 1
    packed = np.packbits(set_bits).tobytes()
    return [(b, packed[a // 8 : (a + b) // 8]) for a, b in zip(base.tolist(), bits.tolist())]


def index_rows(docs: DataFrame, asked: frozenset[bytes] | None = None) -> DataFrame:
    """A signature row per document with a term, and counts of documents per term from each task.

    With ``asked`` only these terms are counted.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        df: Counter = Counter()
        empty = {"doc_id": None, "ref": None, "same": None, "n": None, "bits": None, "signature": None}

        def counted():
            out = pd.DataFrame({"term": list(df.keys()), "df": list(df.values())}).assign(**empty)
            return out.astype({c: "Int64" for c in ("doc_id", "ref", "n", "bits")})

        for frame in frames:
            texts = [t or "" for t in frame["text"].tolist()]
            for part in chunks(texts, CHARS):
                counts = [Counter(terms_of(texts[i])) for i in part]
                some = [i for i, c in zip(part, counts) if c]
                counts = [c for c in counts if c]
                if not some:
                    continue
                found = signatures(counts, known)
                for c in counts:
                    df.update(c.keys() if asked is None else asked.intersection(c))
                out = frame[["doc_id", "ref", "same"]].iloc[some].reset_index(drop=True)
                out["n"] = [sum(c.values()) for c in counts]
                out["bits"] = [b for b, _ in found]
                out["signature"] = [s for _, s in found]
                yield out.assign(term=None, df=None).astype({"doc_id": "Int64", "df": "Int64"})
                if len(df) > COUNTED:
                    yield counted()
                    df = Counter()
                if len(known) > COUNTED:
                    known = {}
        if df:
            yield counted()

    return with_ref(docs).withColumn("same", F.unhex(F.sha2("text", 256))).mapInPandas(batches, _ROW)


def with_ref(docs: DataFrame) -> DataFrame:
    """doc_id, text and a number that finds the row again; a chance collision only costs a look."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("ref"))


def blocks_of(rows: DataFrame, k: int) -> DataFrame:
    """Blocks of signatures stored by bits: bits, refs, lengths, slices."""
    same = Window.partitionBy("same").orderBy(F.col("doc_id").asc_nulls_last())
    few = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k)
    # Repeated rows share a reference and need one signature.
    one = Window.partitionBy("same", "doc_id").orderBy("copy")
    few = stage(few.withColumn("again", F.row_number().over(one)).where("again = 1").select("ref", "n", "bits", "signature"))
    counts = few.groupBy("bits").count().collect()  # a row per power of two
    parts = [(r["bits"], -(-r["count"] // docs_of(r["bits"]))) for r in counts]
    plan = rows.sparkSession.createDataFrame(parts, "bits long, parts long")
    dealt = few.join(F.broadcast(plan), "bits").withColumn("part", F.pmod(F.xxhash64("ref"), "parts")).drop("parts")

    def slices(group: pd.DataFrame) -> pd.DataFrame:
        bits = int(group["bits"].iloc[0])
        of_docs = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), bits // 8)
        # Whole bytes of documents, so that every bitmap begins at a byte.
        wide = -(-len(group) // 8) * 8
        by_bit = np.empty((bits, wide // 8), np.uint8)
        for a in range(0, bits // 8, 4_096):
            part = np.unpackbits(of_docs[:, a : a + 4_096], axis=1).T
            by_bit[8 * a : 8 * a + len(part)] = np.packbits(part, axis=1)
        return pd.DataFrame(
            {
                "bits": [bits],
                "refs": [group["ref"].to_numpy(np.int64).tobytes()],
                "lengths": [group["n"].to_numpy(np.int64).tobytes()],
                "slices": [by_bit.tobytes()],
            }
        )

    schema = "bits long, refs binary, lengths binary, slices binary"
    return dealt.groupBy("bits", "part").applyInPandas(slices, schema)


def docs_of(bits: int) -> int:
    """Documents of a block whose signatures have so many bits."""
    return max(8, min(BLOCK_DOCS, 8 * BLOCK_BYTES // bits))


def length_factor(n: int, docs: int, total: int) -> int:
    return 100 - 25 + 25 * n * docs // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Items:
    """Some items: numbers of their terms, how often each occurs, and the terms' weights."""

    def __init__(self, rows: list[tuple[int, list, list]], df: dict[bytes, int], docs: int, total: int):
        self.docs, self.total = docs, total
        # Terms that no document holds add nothing.
        self.terms = sorted({t for _, terms, _ in rows for t in terms if t in df})
        number = {t: i for i, t in enumerate(self.terms)}
        self.weights = [weight(docs, df[t]) for t in self.terms]
        self.items = {}
        for iid, terms, counts in rows:
            known = [(number[t], x) for t, x in zip(terms, counts) if t in number]
            if known:
                self.items[iid] = known

    def score(self, iid: int, counts: dict[int, int], m: int) -> int:
        """Exact score of a document with these occurrences of numbered terms."""
        out = 0
        for t, copies in self.items[iid]:
            tf = counts.get(t)
            if tf:
                out += copies * self.weights[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
        return out


def upper_bounds(block, items: Items, hashes: np.ndarray):
    """For every item: its number and upper bounds of the scores of a block's documents."""
    bits = int(block.bits)
    lengths = np.frombuffer(block.lengths, np.int64)
    slices = np.frombuffer(block.slices, np.uint8).reshape(bits, -1)
    m = np.array([length_factor(n, items.docs, items.total) for n in lengths.tolist()], np.int64)
    steps = levels(int(lengths.max()))
    tops = np.append(steps[1:] - 1, lengths.max())
    terms = np.arange(len(hashes))
    before = np.zeros(len(lengths), np.int64)
    by_level = []
    for level, top in enumerate(tops):
        p = places(entries(hashes[terms], np.full(len(terms), level)), bits)
        held = slices[p[0]]
        for row in p[1:]:
            held = held & slices[row]
        if by_level:
            held &= by_level[-1][1][by_level[-1][0][terms]]
        some = held.any(axis=1)
        terms, held = terms[some], held[some]
        if not len(terms):
            break
        row_of = np.full(len(hashes), -1)
        row_of[terms] = np.arange(len(terms))
        tf = np.minimum(top, lengths)
        worth = 1_000_000_000 * tf // (1000 * tf + 12 * m)
        by_level.append((row_of, held, worth - before))
        before = worth
    for iid, known in items.items.items():
        numbers = np.array([t for t, _ in known])
        weights = np.array([float(items.weights[t] * x) for t, x in known])
        bound = np.zeros(len(lengths))
        for row_of, held, gain in by_level:
            rows = row_of[numbers]
            if (rows < 0).all():
                break
            bitmaps = np.unpackbits(held[rows[rows >= 0]], axis=1, count=len(lengths))
            bound += (weights[rows >= 0] @ bitmaps) * gain
        # Floats may lose the last digits of sums beyond 2^53.
        yield iid, np.where(bound > 0, bound * (1 + 1e-12) + 1, 0)


def candidates(blocks: DataFrame, items: Items, least: dict[int, int] | None, k: int) -> DataFrame:
    """(iid, ref, bound) of documents whose bound reaches ``least`` of the item; without it the k
    highest of each task."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = np.array([hash_of(t) for t in items.terms], np.uint64)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for block in frame.itertuples(index=False):
                refs = np.frombuffer(block.refs, np.int64)
                out = []
                for iid, bound in upper_bounds(block, items, hashes):
                    if least is not None:
                        ok = np.flatnonzero((bound > 0) & (bound >= least[iid]))
                        out.append((iid, refs[ok], bound[ok]))
                        continue
                    ok = np.flatnonzero(bound > 0)
                    ok = ok[np.argsort(-bound[ok], kind="stable")[:k]]
                    old = best.get(iid)
                    r, b = (refs[ok], bound[ok]) if old is None else (np.append(old[0], refs[ok]), np.append(old[1], bound[ok]))
                    top = np.argsort(-b, kind="stable")[:k]
                    best[iid] = (r[top], b[top])
                yield from rows_of(out)
        yield from rows_of([(iid, r, b) for iid, (r, b) in best.items()])

    def rows_of(found):
        if found:
            yield pd.DataFrame(
                {
                    "iid": np.concatenate([np.full(len(r), i) for i, r, _ in found]),
                    "ref": np.concatenate([r for _, r, _ in found]),
                    "bound": np.concatenate([b for _, _, b in found]),
                }
            )

    return blocks.mapInPandas(batches, "iid long, ref long, bound double")


def rescored(docs: DataFrame, wanted: DataFrame, items: Items) -> DataFrame:
    """(iid, doc_id, score) of wanted documents (iid, ref), from their whole texts."""
    by_doc = stage(wanted.groupBy("ref").agg(F.collect_set("iid").alias("iids")))
    few = by_doc.count() <= BROADCAST
    joined = with_ref(docs).join(F.broadcast(by_doc) if few else by_doc, "ref")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {t: i for i, t in enumerate(items.terms)}
        for frame in frames:
            rows = []
            for doc_id, text, iids in zip(frame["doc_id"].tolist(), frame["text"], frame["iids"]):
                terms = terms_of(text)
                counts = Counter(number[t] for t in terms if t in number)
                m = length_factor(len(terms), items.docs, items.total)
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                rows += [(int(i), doc_id, items.score(int(i), counts, m)) for i in iids]
            out = pd.DataFrame(rows, columns=["iid", "doc_id", "score"])
            yield out.astype({"doc_id": "Int64"})[out["score"] > 0]

    return joined.select("doc_id", "text", "iids").mapInPandas(batches, "iid long, doc_id long, score long")


def highest(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("iid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_rows(items: DataFrame) -> DataFrame:
    """iid, item_id, distinct terms and their counts."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts = [Counter(terms_of(t)) for t in frame["text"]]
            out = frame[["item_id"]].astype("Int64")
            out["terms"] = pd.Series([list(c) for c in counts], out.index, dtype=object)
            out["counts"] = pd.Series([list(c.values()) for c in counts], out.index, dtype=object)
            yield out

    found = items.select("item_id", "text").mapInPandas(batches, "item_id long, terms array<binary>, counts array<long>")
    return found.where(F.size("terms") > 0).withColumn("iid", F.monotonically_increasing_id())


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_terms: int = ITEM_TERMS) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank, doc_id, score.

    Scores are those of ``Items.score``; equal scores come by ascending doc_id.

    Null and empty texts, and texts without a term, match nothing and count for nothing; an item without
    a term has no rows.  Documents without an id come last among equals.  Repeated documents are ranked each, repeated items
    answered each.  Empty tables give no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    asked = stage(item_rows(items))
    terms = stage(asked.select(F.explode("terms").alias("term")).distinct())
    few = terms.count() <= ITEM_TERMS
    rows = stage(index_rows(docs, frozenset(bytes(r["term"]) for r in terms.collect()) if few else None))
    signed = rows.where(F.col("signature").isNotNull())
    n_docs, total = signed.agg(F.count(F.lit(1)), F.sum("n")).first()
    blocks = stage(blocks_of(signed.select("doc_id", "ref", "same", "n", "bits", "signature"), k))
    # Only terms that are asked for are added up.
    counts = rows.where(F.col("term").isNotNull()).select("term", "df").join(terms, "term")
    counts = stage(counts.groupBy("term").agg(F.sum("df").alias("df")))

    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-n_terms // item_terms))
    parts = []
    for i in range(passes if n_docs else 0):
        own = asked.where(F.pmod(F.xxhash64("iid"), F.lit(passes)) == i)
        known = own.select(F.explode("terms").alias("term")).distinct().join(counts, "term")
        asked_now = [(r["iid"], list(map(bytes, r["terms"])), r["counts"]) for r in own.collect()]
        some = Items(asked_now, {bytes(r["term"]): r["df"] for r in known.collect()}, n_docs, total)
        if not some.items:
            continue
        bound_order = Window.partitionBy("iid").orderBy(F.desc("bound"), "ref")
        first = candidates(blocks, some, None, k).withColumn("place", F.row_number().over(bound_order)).where(F.col("place") <= k)
        scored = highest(rescored(docs, first.select("iid", "ref"), some), k)
        reached = scored.groupBy("iid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(0).alias("score"))
        least = dict.fromkeys(some.items, 0) | {r["iid"]: r["score"] for r in reached.collect()}
        parts.append(stage(highest(rescored(docs, candidates(blocks, some, least, k), some), k)))
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    return best.join(asked.select("iid", "item_id"), "iid").select("item_id", "rank", "doc_id", "score")
