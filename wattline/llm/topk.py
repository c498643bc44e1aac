"""Exact k highest inner products of query vectors with all vectors.

1. Equal vectors become one class that carries its k + 1 smallest ids: no query can need more
   of them.  The window keeps so many of each task's rows before they are dealt, so a
   vector that a third of all rows hold is a few rows.
2. An SVD of the unit vectors (the eigenvectors of their sum of squares, d x d numbers)
   rotates vectors so that their first components say most of an inner product.
3. Classes are put in blocks by descending length: lengths are binned to powers of 2^(1/16), long
   bins are split, short ones joined.  Every query meets the longest block first, which gives it
   a score that its k-th best candidate reaches at least.
4. By Cauchy-Schwarz a query needs no block whose longest vector cannot reach that
   score.  Queries are put in blocks by how far down they have to go, and blocks of queries
   meet blocks of classes.  Within a pair of blocks classes come by descending length,
   until no query can be reached any more.  Inner products of the first rotated components plus the
   product of the lengths of the rest bound every score from above; only what
   may still reach a query's present k-th best is scored exactly, in whole numbers.

The work grows with queries times vectors less what the bounds save.  Bins are at most
some thousand, whatever the data are; no other table passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.sources.sinks import stage

# Classes and queries of a block, classes of a step within it.
BLOCK, QUERIES, STEP = 8_192, 8_192, 512
# Bins of lengths per doubling.
BINS = 16
# Relative allowance for rounding in bounds, far above what 64-bit floats lose.
SLACK = 1e-9
# Whole numbers up to this are exact in 64-bit floats.
_EXACT = 2.0**53
_HIGHEST = (1 << 63) - 1
_FOUND = "qid long, cid long, missing boolean, first long, score long, own long"


def scaled(vector: str = "embedding", factor: int = 256) -> Column:
    """Components times ``factor``, rounded down, as floats that hold whole numbers.

    Null if the vector is null or holds a component that is null or not finite.
    """
    each = F.transform(vector, lambda x: x.cast("double") * F.lit(float(factor)))
    whole = F.transform(each, lambda y: F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y))
    sound = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return F.when(F.col(vector).isNotNull() & sound, whole)


def length_of(vector: str) -> Column:
    """Euclidean length, scaled by the greatest component so that nothing overflows."""
    top = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x))), F.lit(0.0))
    squares = F.aggregate(
        F.transform(vector, lambda x: F.pow(x / F.nullif(top, F.lit(0.0)), F.lit(2))), F.lit(0.0), lambda a, b: a + b
    )
    return F.coalesce(top * F.sqrt(squares), F.lit(0.0))


def matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def rotation(classes: DataFrame, width: int) -> np.ndarray:
    """Directions by how much of the unit vectors they hold, as columns."""

    def squares(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for frame in frames:
            rows = matrix(frame["vector"].tolist(), width)
            top = np.abs(rows).max(axis=1, initial=0, keepdims=True)
            rows = rows / np.where(top > 0, top, 1)
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            rows /= np.where(size > 0, size, 1)
            total += rows.T @ rows
        yield pd.DataFrame({"i": range(width), "line": list(total)})

    lines = classes.select("vector").mapInPandas(squares, "i int, line array<double>")
    cells = lines.select("i", F.posexplode("line").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((width, width))
    for r in cells.collect():  # as many numbers as the vectors' width squared
        total[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def exact_products(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Whole-number inner products of rows that floats would round, held within 64 bits."""
    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        score = sum(int(u) * int(v) for u, v in zip(x, y))
        out.append(max(-_HIGHEST - 1, min(_HIGHEST, score)))
    return out


def best_of(q: np.ndarray, c: np.ndarray, score: np.ndarray, tie: np.ndarray, keep: int):
    """The ``keep`` highest of each query; equal scores by ``tie``."""
    order = np.lexsort((tie[c], ~score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, q, "left")
    ok = np.arange(len(q)) - first < keep
    return q[ok], c[ok], score[ok]


class Search:
    """Scores of one block of queries with one of classes, by descending length."""

    def __init__(self, queries: np.ndarray, classes: np.ndarray, turn: np.ndarray, reach: np.ndarray, keep: int):
        # An empty width has one component of zeros, so that steps need no special case.
        self.q, self.c, self.keep = queries, classes, keep
        self.q_turned, self.c_turned = queries @ turn, classes @ turn
        self.q_size, self.c_size = np.linalg.norm(queries, axis=1), np.linalg.norm(classes, axis=1)
        width = queries.shape[1]
        self.cuts = sorted({max(1, width // 4), max(1, width // 2)})
        top = np.abs(queries).max(initial=0) * np.abs(classes).max(initial=0) * width
        self.is_exact = top < _EXACT
        self.reach = reach.astype(float)
        self.best = np.full((len(queries), keep), -np.inf)

    def rest(self, turned: np.ndarray, cut: int) -> np.ndarray:
        return np.linalg.norm(turned[:, cut:], axis=1)

    def scores(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if self.is_exact:
            out = np.empty(len(i), np.int64)
            for a in range(0, len(i), 65_536):
                part = slice(a, a + 65_536)
                out[part] = np.einsum("ij,ij->i", self.q[i[part]], self.c[j[part]])
            return out
        return np.array(exact_products(self.q[i], self.c[j]), np.int64)

    def open_pairs(self, queries: np.ndarray, classes: np.ndarray):
        """Pairs that the bounds leave open."""
        i = j = None
        for cut in self.cuts:
            if i is None:
                partial = self.q_turned[queries, :cut] @ self.c_turned[classes, :cut].T
                size = self.q_size[queries, None] * self.c_size[classes]
                rest = self.q_rest[cut][queries, None] * self.c_rest[cut][classes]
                ok = partial + rest + SLACK * size >= self.reach[queries, None] * (1 - SLACK * np.sign(self.reach[queries, None]))
                a, b = np.nonzero(ok)
                i, j, partial, done = queries[a], classes[b], partial[a, b], cut
            elif len(i) < 0.25 * len(queries) * len(classes):
                partial = partial + np.einsum("ij,ij->i", self.q_turned[i, done:cut], self.c_turned[j, done:cut])
                bound = partial + self.q_rest[cut][i] * self.c_rest[cut][j] + SLACK * self.q_size[i] * self.c_size[j]
                ok = bound >= self.reach[i] * (1 - SLACK * np.sign(self.reach[i]))
                i, j, partial, done = i[ok], j[ok], partial[ok], cut
        return i, j

    def run(self, tie: np.ndarray):
        """(query, class, score) of the ``keep`` best of each query that reach its bound."""
        self.q_rest = {cut: self.rest(self.q_turned, cut) for cut in self.cuts}
        self.c_rest = {cut: self.rest(self.c_turned, cut) for cut in self.cuts}
        by_size = np.argsort(-self.c_size, kind="stable")
        q, c, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        for at in range(0, len(by_size), STEP):
            classes = by_size[at : at + STEP]
            longest = self.q_size * self.c_size[classes[0]] * (1 + SLACK)
            queries = np.flatnonzero(longest >= self.reach * (1 - SLACK * np.sign(self.reach)))
            if not len(queries):
                break
            i, j = self.open_pairs(queries, classes)
            score = self.scores(i, j)
            ok = score >= self.reach[i]
            q, c, s = np.concatenate([q, i[ok]]), np.concatenate([c, j[ok]]), np.concatenate([s, score[ok]])
            q, c, s = best_of(q, c, s, tie, self.keep)
            # A query's last kept score is a bound once it has as many as are kept.
            full = np.flatnonzero(np.bincount(q, minlength=len(self.q)) >= self.keep)
            last = np.searchsorted(q, full, "right") - 1
            self.reach[full] = np.maximum(self.reach[full], s[last])
        return q, c, s


def searcher(turn: np.ndarray, width: int, keep: int):
    """Function from rows of queries and classes of a pair of blocks to what was found."""

    def search(queries: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(classes):
            return pd.DataFrame({c: [] for c in ("qid", "cid", "missing", "first", "score", "own")})
        work = Search(
            matrix(queries["vector"].tolist(), width),
            matrix(classes["vector"].tolist(), width),
            turn,
            queries["reach"].to_numpy(float),
            keep,
        )
        missing, first = classes["missing"].to_numpy(bool), classes["first"].to_numpy(np.int64)
        tie = np.empty(len(classes), np.int64)
        tie[np.lexsort((first, missing))] = np.arange(len(classes))
        q, c, score = work.run(tie)
        own = np.array(
            np.einsum("ij,ij->i", work.q, work.q) if (work.q**2).sum(1).max() < _EXACT else exact_products(work.q, work.q)
        ).astype(np.int64)
        return pd.DataFrame(
            {
                "qid": queries["qid"].to_numpy()[q],
                "cid": classes["cid"].to_numpy()[c],
                "missing": missing[c],
                "first": first[c],
                "score": score,
                "own": own[q],
            }
        )

    return search


def blocks_of(counts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """(bin, first block, blocks) for (bin, rows) in their order: large bins split, small ones joined."""
    out, block, filled = [], 0, 0
    for bin_, rows in counts:
        if filled and filled + rows > size:
            block, filled = block + 1, 0
        parts = max(1, -(-rows // size))
        out.append((bin_, block, parts))
        if parts > 1:
            block, filled = block + parts, 0
        else:
            filled += rows
    return out


def in_blocks(df: DataFrame, plan: list[tuple[int, int, int]], spread: Column, name: str) -> DataFrame:
    """``df`` with the block that its ``bin`` and ``spread`` give."""
    table = spark_table(df, plan, "bin long, start long, parts long")
    return df.join(F.broadcast(table), "bin").withColumn(
        name, F.col("start") + F.pmod(F.xxhash64(spread), F.col("parts"))
    ).drop("start", "parts")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERIES
) -> DataFrame:
    """The ``k`` highest inner products of each query with all vectors but itself.

    Both tables hold vec_id and ``vector`` (floats that hold whole numbers, see ``scaled``);
    queries are rows of ``vectors``.  Returns query_id, rank from 1, vec_id, score; equal scores go
    to the smaller id.

    Null vectors take no part.  Vectors without an id are candidates and come last among equals; shorter
    vectors count as filled up with zeros.  Of repeated rows every one is a candidate, but for the
    query's own row, and repeated query rows are answered each.  Scores beyond 64 bits are held at
    the ends of the range.  An empty table gives no rows.
    """
    keep = k + 1
    rows = vectors.where(F.col("vector").isNotNull()).select("vec_id", "vector")
    by_id = Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= keep)
    classes = few.groupBy("vector").agg(
        F.min("vec_id").alias("least"), F.sort_array(F.collect_list(F.struct("place", "vec_id"))).alias("ids")
    )
    size = length_of("vector")
    # A bin holds lengths within a factor of 2^(1/16); those of zero have one of their own.
    bin_ = F.when(size > 0, F.floor(F.log2(size) * BINS)).otherwise(F.lit(-1_000_000)).cast("long")
    classes = stage(
        classes.select(
            F.monotonically_increasing_id().alias("cid"),
            F.col("least").isNull().alias("missing"),
            F.coalesce("least", F.lit(0).cast("long")).alias("first"),
            "ids",
            "vector",
            bin_.alias("bin"),
        )
    )
    asked = queries.where(F.col("vector").isNotNull()).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    asked = stage(asked.withColumns({"qid": F.monotonically_increasing_id(), "size": size}))

    width = max(1, classes.agg(F.max(F.size("vector"))).first()[0] or 0)
    turn = rotation(classes, width)
    counts = [(r["bin"], r["count"]) for r in classes.groupBy("bin").count().orderBy(F.desc("bin")).collect()]
    plan = blocks_of(counts, block)
    shape = "cid", "missing", "first", "vector"
    placed = in_blocks(classes.select(*shape, "bin"), plan, F.col("cid"), "cblock")
    search = searcher(turn, width, keep)

    n_asked = asked.count()
    parts = max(1, -(-n_asked // query_block))
    head = placed.where("cblock = 0").select(*shape, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qblock"))
    first = asked.select(
        "qid", "vector", F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("qblock"), F.lit(float("-inf")).alias("reach")
    )
    found = stage(_pairs(first, head, ["qblock"], search))

    # What the (k + 1)-th class reached, the k-th candidate other than the query reaches.
    sure = found.groupBy("qid").agg(
        F.when(F.count(F.lit(1)) >= keep, F.min("score").cast("double")).otherwise(float("-inf")).alias("reach")
    )
    aim = asked.join(sure, "qid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))
    # Lowest bin whose upper end can still reach it; all of them where the bound is not above 0.
    needs = F.floor(F.log2(F.col("reach") * (1 - SLACK) / F.col("size")) * BINS) - 1
    needs = F.when((F.col("reach") > 0) & (F.col("size") > 0), needs).otherwise(F.lit(-2_000_000)).cast("long")
    starts = {b: first_block + parts_ for b, first_block, parts_ in plan}
    bins = sorted(starts)
    # The lowest bin at or above what a query needs says how many blocks it meets.
    edges = [F.lit(b).cast("long") for b in bins] or [F.lit(0).cast("long")]
    at_or_above = F.array_min(F.filter(F.array(*edges), lambda b: b >= F.col("needs")))
    deep = stage(
        aim.withColumn("needs", needs)
        .withColumn("bin", at_or_above)
        .where(F.col("bin").isNotNull())
        .select("qid", "vector", "reach", "bin")
    )
    depth = [(r["bin"], r["count"]) for r in deep.groupBy("bin").count().orderBy("bin").collect()]
    deep_plan = blocks_of(depth, query_block)
    # Blocks of queries come by descending depth, so classes of a bin meet a beginning of them.
    depths = spark_table(deep, [(b, starts[b]) for b, _, _ in deep_plan], "bin long, depth long")
    going = in_blocks(deep, deep_plan, F.col("qid"), "qblock").join(F.broadcast(depths), "bin")
    upto = [(b, max((at + n for low, at, n in deep_plan if low <= b), default=0)) for b in bins]
    meeting = spark_table(deep, upto, "bin long, upto long")
    below = placed.join(F.broadcast(meeting), "bin").where("cblock > 0 and upto > 0")
    below = below.select(*shape, "cblock", F.explode(F.expr("sequence(0L, upto - 1)")).alias("qblock"))
    going = going.where("depth > 1").select(
        "qid", "vector", "reach", "qblock", F.explode(F.expr("sequence(1L, depth - 1)")).alias("cblock")
    )
    rest = stage(_pairs(going, below, ["cblock", "qblock"], search))

    order = Window.partitionBy("qid").orderBy(F.desc("score"), "missing", "first")
    best = found.unionByName(rest).withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    named = best.select("qid", "cid", "score", "own").join(classes.select("cid", "ids"), "cid")
    each = named.select("qid", "score", "own", F.explode("ids.vec_id").alias("vec_id")).join(
        asked.select("qid", F.col("vec_id").alias("query_id"), "copies"), "qid"
    )
    is_own = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.lit(False))
    own_first = Window.partitionBy("qid", "is_own").orderBy("vec_id")
    others = (
        each.withColumn("is_own", is_own)
        .withColumn("place", F.row_number().over(own_first))
        .where(~F.col("is_own") | (F.col("place") > 1))
    )
    final = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return (
        others.withColumn("rank", F.row_number().over(final))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", F.explode(F.expr("sequence(1L, copies)")))
        .drop("col")
    )


def spark_table(like: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small table in the session of another."""
    return like.sparkSession.createDataFrame(rows, schema)


def _pairs(queries: DataFrame, classes: DataFrame, keys: list[str], search) -> DataFrame:
    both = queries.groupBy(*keys).cogroup(classes.groupBy(*keys))
    return both.applyInPandas(search, _FOUND)
