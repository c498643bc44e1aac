"""Exact deduplication against an indexed history.

Texts are equal when they are identical after every run of white space is replaced by one
space; a null text counts as empty.  The distinct digests of the history are kept in a
minimal perfect hash: as many slots as digests, each with the full digest, the smallest
document id and the number of rows.  Digests of new rows are looked up there, checked byte
by byte and so dropped or not; those that are in no slot are grouped separately.

The index is cut into buckets by digest.  Digests are uniform, so a bucket is bounded by
``PER_BUCKET`` however often one text is repeated: repeats are counted before any shuffle
by digest alone.

Rows that repeat a doc_id with an equal text are listed each; only the first one is kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import SPACE_RUN, buckets_for
from wattline.sources.sinks import passing, shared_dir, stage

# Distinct digests of the history in one bucket of the index.
PER_BUCKET = 50_000
# Bits per key in each level of the hash.
LOAD = 2
# Stands for a missing id, which loses against every other one.
LAST = 2**63 - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def positions(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each digest (four words a row) in a level of ``size`` bits."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = words[:, level % 4] + words[:, (level + 1) % 4] * odd * np.uint64(2 * level + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray) -> list[np.ndarray]:
    """Levels of a minimal perfect hash over distinct digests.

    In each level the digests that have a bit to themselves are placed; the others go on
    to the next one.  A digest's slot is the number of set bits before its own.
    """
    levels, rest = [], words
    while len(rest):
        size = LOAD * len(rest) + 1
        at = positions(rest, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


def slots(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """Slot of each digest, -1 if no level has its bit.  Strangers may get any slot."""
    out = np.full(len(words), -1, np.int64)
    open_, before = np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = positions(words[open_], level, len(bits))
        found = bits[at]
        rank = np.cumsum(bits) - 1
        out[open_[found]] = before + rank[at[found]]
        before += int(rank[-1]) + 1
        open_ = open_[~found]
    return out


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)


INDEX = "bucket int, n long, level_bits array<long>, levels binary, slots binary, winners binary, counts binary"


def _build_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    levels = build(words)
    at = slots(levels, words)
    order = np.argsort(at)
    return pd.DataFrame(
        {
            "bucket": [pdf["bucket"].iloc[0]],
            "n": [len(words)],
            "level_bits": [[len(x) for x in levels]],
            "levels": [np.packbits(np.concatenate(levels)).tobytes()],
            "slots": [words[order].tobytes()],
            "winners": [pdf["winner"].to_numpy("<i8")[order].tobytes()],
            "counts": [pdf["count"].to_numpy("<i8")[order].tobytes()],
        }
    )


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """Index of a history: ``entries`` has distinct digest, winner and count per row."""
    return (
        entries.withColumn("bucket", bucket_of(buckets))
        .groupBy("bucket")
        .applyInPandas(_build_bucket, INDEX)
    )


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")


GROUPS = "digest binary, keep_id long, group_size long, member boolean"


def _lookup_bucket(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    parts = []
    asked = np.full(len(new), -1, np.int64)
    words = _words(new["digest"]) if len(new) else np.empty((0, 4), "<u8")
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["slots"], "<u8").reshape(-1, 4)
        keep = np.frombuffer(row["winners"], "<i8").copy()
        size = np.frombuffer(row["counts"], "<i8").copy()
        ends = np.cumsum(row["level_bits"])
        bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8), count=int(ends[-1]))
        asked = slots(np.split(bits.astype(bool), ends[:-1]), words)
        hit = asked >= 0
        hit[hit] = (held[asked[hit]] == words[hit]).all(axis=1)
        asked[~hit] = -1
        at = asked[hit]
        keep[at] = np.minimum(keep[at], new["winner"].to_numpy()[hit])
        size[at] += new["count"].to_numpy()[hit]
        parts.append((held, keep, size, True))
    away = asked < 0
    parts.append((words[away], new["winner"].to_numpy()[away], new["count"].to_numpy()[away], False))
    return pd.concat(
        pd.DataFrame(
            {
                "digest": [x.tobytes() for x in digests],
                "keep_id": keep.astype("int64"),
                "group_size": size.astype("int64"),
                "member": member,
            }
        )
        for digests, keep, size, member in parts
    )


def entries_of(rows: DataFrame) -> DataFrame:
    """Distinct digests with the smallest id and the number of rows."""
    return rows.groupBy("digest").agg(F.min("id").alias("winner"), F.sum("n").alias("count"))


def exact_groups(rows: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """Groups of equal digests of ``rows`` (digest, id, n, historical).

    Each digest comes once, with ``keep_id``, ``group_size`` and whether the history has
    it.  The history is indexed; the others are looked up.  There are as many buckets as the larger
    side needs, so that neither a large history nor many new texts fill one task.
    """
    history = stage(entries_of(rows.filter("historical")))
    new = stage(entries_of(rows.filter("not historical")))
    buckets = buckets_for(max(history.count(), new.count()), per_bucket)
    index = stage(build_index(history, buckets))
    return new.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_lookup_bucket, GROUPS)


def digest_rows(docs: DataFrame, id_: str, text: str, historical: Column) -> DataFrame:
    """Stored (digest, id, historical, n): one row per digest and id, n rows of the input."""
    rows = docs.select(digest(F.col(text)).alias("digest"), F.col(id_).alias("id"), historical.alias("historical"))
    return stage(rows.groupBy("digest", "id").agg(F.max("historical").alias("historical"), F.count("*").alias("n")))


def even_half(id_: str) -> Column:
    """Half of the ids, which stands for what earlier runs have seen."""
    return F.coalesce(F.pmod(F.xxhash64(id_), F.lit(2)) == 0, F.lit(True))


def decisions(rows: DataFrame, per_bucket: int = PER_BUCKET) -> DataFrame:
    """``rows`` of ``digest_rows`` with the group of each; a missing id sorts last."""
    known = rows.withColumn("id", F.coalesce("id", F.lit(LAST)))
    return known.join(exact_groups(known, per_bucket), "digest")


def exact_dedup(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    historical: Column | None = None,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """One row per document with its decision.

    Columns: doc_id, keep_id, group_size, kept, text_sha256 and member (whether the
    history holds the text).  ``historical`` marks the rows that are indexed, by default
    half of the ids.  A null id sorts after every other one; an empty table gives no rows;
    other columns of ``docs`` are not read.
    """
    rows = digest_rows(docs, id_, text, even_half(id_) if historical is None else historical)
    one = decisions(rows, per_bucket).select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth")
    )
    return one.select(
        F.nullif(F.col("id"), F.lit(LAST)).alias("doc_id"),
        F.nullif(F.col("keep_id"), F.lit(LAST)).alias("keep_id"),
        "group_size",
        ((F.col("id") == F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "member",
    )


def drop_exact_copies(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    historical: Column | None = None,
    per_bucket: int = PER_BUCKET,
) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    spark = docs.sparkSession
    at = shared_dir(spark)
    with passing(spark):
        rows = digest_rows(docs, id_, text, even_half(id_) if historical is None else historical)
        winners = stage(
            decisions(rows, per_bucket)
            .filter("id = keep_id")
            .select(F.col("id").alias("won_id"), F.col("digest").alias("won"), "n"),
            at,
        )
    whole = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_), F.lit(LAST)).alias("own_id"),
        digest(F.col(text)).alias("own"),
    )
    mine = (F.col("own") == F.col("won")) & (F.col("own_id") == F.col("won_id"))
    once = whole.join(winners.filter("n = 1"), mine, "left_semi")
    # Rows that repeat their own id and text; as a rule there are none.
    again = whole.join(winners.filter("n > 1"), mine, "left_semi").dropDuplicates(["own", "own_id"])
    return once.select("row.*").unionByName(again.select("row.*"))
