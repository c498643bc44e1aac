"""Gradient-boosted trees grown leaf by leaf over binned features.

Features are cut into quantile bins once.  A tree grows best first: of all leaves the one whose best split
lowers the squared error most is split, until there are ``num_leaves``.  The rows stay where they are;
each pass over them

* walks every row down the tree so far and sums gradients and counts per (leaf, feature, bin),
* adds these histograms up over all tasks, a group per leaf, with the sibling's as the
  parent's less this one, so that only the smaller child of a split is counted,
* finds the best split of each leaf where its histogram is.

A pass serves all leaves that best-first growth would split next as far as is known, so a tree
takes about as many passes as it is deep, not one per leaf; the tree is the same.  It also serves
many models at once: all folds of a backtest (a row counts for every fold that trains on
it), or all steps of a direct forecast.

Gradients are whole numbers of a small unit, so sums are exact and a fit does not depend on how
the table is laid out.  Only splits pass the driver.  Rows are rewritten, with predictions so far, every
``RESTAGE`` rounds; trees in between are walked on the way.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import remove, shared_dir, stage
from .base import PREDICTION, Fitted, Forecaster

# Rounds after which predictions so far are stored with the rows.
RESTAGE = 10
# Rows whose gradients are summed as floats before they are added up as whole numbers.
CHUNK = 16_384
# Bits of a gradient, at most: sums over a chunk are then exact in 64-bit floats.
BITS = 38
# Trees up to this many bytes are sent to all tasks when predicting.
BROADCAST_BYTES = 64 << 20

_ROWS = "first int, upto int, y double, key long, bins binary, so_far binary"
_SPLITS = "model int, node int, parent int, n long, total long, gain double, feature int, bin int, n_left long, total_left long"


class Tree:
    """One tree over bins as arrays; leaves have feature -1."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value = [-1], [0], [0], [0], [0.0]

    def split(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        """Turn a leaf into a branch; rows of at most ``bin_`` go left."""
        new = len(self.feature)
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, bin_, new, new + 1
        for _ in range(2):
            for part, nothing in zip((self.feature, self.bin, self.left, self.right, self.value), (-1, 0, 0, 0, 0.0)):
                part.append(nothing)
        return new, new + 1

    def depth(self) -> int:
        out, deep = [0], [0] * len(self.feature)
        for node, feature in enumerate(self.feature):
            if feature >= 0:
                deep[self.left[node]] = deep[self.right[node]] = deep[node] + 1
                out.append(deep[node] + 1)
        return max(out)

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of each row of a matrix of bins."""
        feature, bin_ = np.array(self.feature), np.array(self.bin)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(self.depth()):
            f = feature[node]
            down = np.where(bins[rows, np.maximum(f, 0)] <= bin_[node], left[node], right[node])
            node = np.where(f < 0, node, down)
        return node


class Growth:
    """A tree that is growing, and what is known of its possible nodes."""

    def __init__(self):
        self.known: dict[int, object] = {}  # node -> its best split
        self.children: dict[int, tuple[int, int]] = {}
        self.path = {0: 1}  # place of a node in a full binary tree, which settles ties
        self.made = 1

    def wanted(self, num_leaves: int, least_gain: float) -> tuple[list[int], list[int]]:
        """Nodes that best-first growth splits as far as is known, and those without children yet."""
        heap = [(-self.known[0].gain, self.path[0], 0)]
        heapify(heap)
        split, fresh = [], []
        while heap and len(split) + 1 < num_leaves:
            gain, _, node = heappop(heap)
            if not -gain > least_gain:
                break
            split.append(node)
            if node not in self.children:
                fresh.append(node)
                continue
            for child in self.children[node]:
                heappush(heap, (-self.known[child].gain, self.path[child], child))
        return split, fresh

    def open(self, node: int) -> tuple[int, int]:
        """Numbers for the children of a node."""
        left, right = self.made, self.made + 1
        self.made += 2
        self.children[node] = (left, right)
        self.path[left], self.path[right] = 2 * self.path[node], 2 * self.path[node] + 1
        return left, right

    def tree(self, splits: Sequence[int] | None, value) -> Tree:
        """The tree of some split nodes (all that have children, if None), numbered as known here or anew.

        With ``splits`` the nodes are numbered anew and leaves get ``value(node's split record)``.
        """
        out = Tree()
        if splits is None:
            for part, nothing in zip((out.feature, out.bin, out.left, out.right, out.value), (-1, 0, 0, 0, 0.0)):
                part.extend([nothing] * (self.made - 1))
            for node, (left, right) in self.children.items():
                best = self.known[node]
                out.feature[node], out.bin[node], out.left[node], out.right[node] = best.feature, best.bin, left, right
            return out
        chosen, todo = set(splits), [(0, 0)]
        while todo:
            node, place = todo.pop()
            best = self.known[node]
            if node in chosen:
                places = out.split(place, best.feature, best.bin)
                todo += zip(self.children[node], places)
            else:
                out.value[place] = value(best)
        return out


def sampled(key: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows a round uses, by a hash of the rows' own numbers."""
    z = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)).astype(float) / float(1 << 53) < share


def best_split(n: np.ndarray, total: np.ndarray, begin: np.ndarray, unit: float, least_rows: int, reg: float):
    """(gain, feature place, bin, rows left, total left) of histograms; each feature's bins from ``begin`` on."""
    sizes = np.diff([*begin, len(n)])
    upto_n, upto_t = np.cumsum(n), np.cumsum(total)
    before = begin - 1
    n_left = upto_n - np.repeat(np.where(before >= 0, upto_n[before], 0), sizes)
    t_left = upto_t - np.repeat(np.where(before >= 0, upto_t[before], 0), sizes)
    n_all, t_all = n_left[sizes[0] - 1], t_left[sizes[0] - 1]
    n_right, t_right = n_all - n_left, t_all - t_left
    ok = (n_left >= max(1, least_rows)) & (n_right >= max(1, least_rows))
    part = lambda t, m: (t * unit) ** 2 / np.maximum(m + reg, 1e-300)
    gain = np.where(ok, part(t_left, n_left) + part(t_right, n_right) - part(t_all, n_all), -np.inf)
    at = int(gain.argmax())
    if not np.isfinite(gain[at]):
        return 0.0, -1, 0, 0, 0
    f = int(np.searchsorted(begin, at, "right")) - 1
    return float(gain[at]), f, int(at - begin[f]), int(n_left[at]), int(t_left[at])


class Trainer:
    """Boosting of several models over rows that each belong to a range of them."""

    def __init__(self, model: LeafwiseTrees, spark, rows: DataFrame, features: int, n_models: int, nested: bool):
        self.model, self.spark, self.n_models, self.nested = model, spark, n_models, nested
        self.rows, self.features = rows, features
        self.paths: list[str] = []

    def kept(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark)
        self.paths.append(path)
        return stage(df, path)

    def clean(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []

    def bin_edges(self) -> list[np.ndarray]:
        """Upper ends of all bins but the last, per feature, from rows that all models train on."""
        n = self.model.max_bin - 1
        shares = [(i + 1) / (n + 1) for i in range(n)]
        common = self.rows.where(F.col("first") == 0) if self.nested else self.rows
        found = common.agg(
            *[F.percentile_approx(F.nullif(f"f{i}", F.lit(float("nan"))), shares, 10_000).alias(f"f{i}") for i in range(self.features)]
        ).first()
        return [np.unique(np.array(found[f"f{i}"] or [], float)) for i in range(self.features)]

    def start(self) -> None:
        """Bins, first predictions and the unit of gradients."""
        r = self.rows.agg(F.max(F.abs("y")), F.count(F.lit(1))).first()
        largest, count = r[0] or 0.0, max(1, r[1])
        bits = min(BITS, 62 - math.ceil(math.log2(count)) - 1)
        # No gradient exceeds four times the largest value unless boosting diverges.
        scale = 2.0 ** math.ceil(math.log2(4 * largest)) if largest else 1.0
        self.unit = scale / 2.0**bits
        sums = (
            self.rows.groupBy("first", "upto")
            .agg(F.sum(F.rint(F.col("y") / self.unit).cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        n, total = [0] * self.n_models, [0] * self.n_models
        for r in sums:
            for m in range(r["first"], r["upto"] + 1):
                n[m] += r["n"]
                total[m] += r["total"]
        self.init = [total[m] * self.unit / n[m] if n[m] else None for m in range(self.n_models)]
        self.edges = edges = self.bin_edges()
        # One bin more than edges, and one for rows without a value.
        self.n_bins = np.array([len(e) + 2 for e in edges], np.int64)
        init = np.array([0.0 if x is None else x for x in self.init])
        names = [f"f{i}" for i in range(self.features)]

        def binned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                bins = np.zeros((len(frame), len(names)), np.uint8)
                for i, name in enumerate(names):
                    x = frame[name].to_numpy(float)
                    known = ~np.isnan(x)
                    bins[known, i] = 1 + np.searchsorted(edges[i], x[known], "left")
                out = frame[["first", "upto", "y", "key"]].copy()
                out["bins"] = [row.tobytes() for row in bins]
                out["so_far"] = [init[a : b + 1].tobytes() for a, b in zip(out["first"], out["upto"])]
                yield out

        self.data = self.kept(self.rows.mapInPandas(binned, _ROWS).sortWithinPartitions("first"))

    def batches(self):
        """Function from frames to (model, bins, prediction so far, y, key), in chunks."""
        pending = self.pending

        def chunks_of(frames):
            for frame in frames:
                first, upto = frame["first"].to_numpy(), frame["upto"].to_numpy()
                edge = np.flatnonzero((np.diff(first) != 0) | (np.diff(upto) != 0)) + 1
                for a, b in zip([0, *edge], [*edge, len(frame)]):
                    for c in range(a, b, CHUNK):
                        part = frame.iloc[c : min(b, c + CHUNK)]
                        if not len(part):
                            continue
                        bins = np.frombuffer(b"".join(part["bins"]), np.uint8).reshape(len(part), -1)
                        so_far = np.frombuffer(b"".join(part["so_far"]), float).reshape(len(part), -1).copy()
                        for k, m in enumerate(range(first[a], upto[a] + 1)):
                            for trees in pending:
                                tree = trees[m]
                                if tree is not None:
                                    so_far[:, k] += np.array(tree.value)[tree.leaf_of(bins)]
                        yield first[a], upto[a], bins, so_far, part

        return chunks_of

    def histograms(self, growing: dict[int, tuple[Tree, dict[int, tuple[int, int]]]], turn: int, chosen: list[int]) -> DataFrame:
        """(model, parent, node, other, sums) of each task, for nodes that ``growing`` lists per model."""
        chunks_of, unit, model = self.batches(), self.unit, self.model
        # Tasks get the numbers, not the model: its class would take the session's side along.
        share, again, seed = model.subsample, model.subsample_freq, model.random_state
        begin, size = self.layout(chosen)
        bins_of = self.n_bins[chosen].tolist()

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {m: np.zeros((2, len(wanted), size), np.int64) for m, (_, wanted) in growing.items()}
            slots = {}
            for m, (tree, wanted) in growing.items():
                slots[m] = np.full(len(tree.feature), -1)
                slots[m][list(wanted)] = np.arange(len(wanted))
            any_rows = False
            for first, upto, bins, so_far, part in chunks_of(frames):
                y = part["y"].to_numpy(float)
                used = None
                if again > 0 and share < 1:
                    used = sampled(part["key"].to_numpy(), seed, turn // again, share)
                for k, m in enumerate(range(first, upto + 1)):
                    if m not in growing:
                        continue
                    tree, wanted = growing[m]
                    slot = slots[m][tree.leaf_of(bins)]
                    ok = slot >= 0 if used is None else (slot >= 0) & used
                    if not ok.any():
                        continue
                    any_rows = True
                    slot, own = slot[ok], bins[ok]
                    gradient = np.rint((y[ok] - so_far[ok, k]) / unit)
                    for f, at, wide in zip(chosen, begin.tolist(), bins_of):
                        cell = slot * wide + own[:, f]
                        cells = len(wanted) * wide
                        sums[m][0, :, at : at + wide] += np.bincount(cell, minlength=cells).reshape(-1, wide)
                        total = np.bincount(cell, gradient, minlength=cells)
                        sums[m][1, :, at : at + wide] += total.astype(np.int64).reshape(-1, wide)
            if any_rows:
                for m, (_, wanted) in growing.items():
                    rows = [(m, p, node, other, sums[m][:, i].tobytes()) for i, (node, (p, other)) in enumerate(wanted.items())]
                    yield pd.DataFrame(rows, columns=["model", "parent", "node", "other", "sums"])

        return self.data.mapInPandas(count, "model int, parent int, node int, other int, sums binary")

    def layout(self, chosen: list[int]) -> tuple[np.ndarray, int]:
        """Where each feature's bins begin in a histogram, and its length."""
        sizes = self.n_bins[chosen]
        return np.cumsum(sizes) - sizes, int(sizes.sum())

    def splits(self, parts: DataFrame, parents: DataFrame | None, chosen: list[int]) -> DataFrame:
        """Histograms of nodes and their siblings, each with its best split."""
        unit, least, reg = self.unit, self.model.min_child_samples, self.model.reg_lambda
        begin, size = self.layout(chosen)
        first = int(self.n_bins[chosen[0]])
        shape = (2, size)
        columns = [c.split()[0] for c in _SPLITS.split(", ")] + ["sums"]

        def record(m, node, parent, sums):
            gain, f, b, n_left, t_left = best_split(sums[0], sums[1], begin, unit, least, reg)
            feature = chosen[f] if f >= 0 else -1
            return m, node, parent, sums[0, :first].sum(), sums[1, :first].sum(), gain, feature, b, n_left, t_left, sums.tobytes()

        def added(frame):
            return sum(np.frombuffer(s, np.int64).reshape(shape) for s in frame["sums"])

        def roots(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([record(int(frame["model"].iloc[0]), 0, -1, added(frame))], columns=columns)

        def children(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            if not len(frame):
                return pd.DataFrame([], columns=columns)
            m, parent, node, other = (int(frame[c].iloc[0]) for c in ("model", "parent", "node", "other"))
            own = added(frame)
            rest = np.frombuffer(above["sums"].iloc[0], np.int64).reshape(shape) - own
            return pd.DataFrame([record(m, node, parent, own), record(m, other, parent, rest)], columns=columns)

        schema = _SPLITS + ", sums binary"
        if parents is None:
            return parts.groupBy("model").applyInPandas(roots, schema)
        above = parents.select("model", F.col("node").alias("parent"), "sums")
        return parts.groupBy("model", "parent").cogroup(above.groupBy("model", "parent")).applyInPandas(children, schema)

    def round(self, turn: int) -> list[Tree | None]:
        """One tree per model."""
        model = self.model
        chosen = list(range(self.features))
        if model.colsample_bytree < 1:
            some = max(1, round(model.colsample_bytree * self.features))
            chosen = sorted(random.Random(f"{model.random_state}/{turn}").sample(chosen, some))
        grown = {m: Growth() for m in range(self.n_models) if self.init[m] is not None}
        ask = {m: (Tree(), {0: (-1, -1)}) for m in grown}
        path, tables = len(self.paths), []
        while ask:
            parents = None
            if tables:
                pairs = [m << 32 | p for m, (_, wanted) in ask.items() for p, _ in wanted.values()]
                # One scan over the passes' tables, however many there are.
                stored = self.spark.read.schema(tables[0].schema).parquet(*self.paths[path:])
                parents = stored.where((F.col("model").cast("long") * (1 << 32) + F.col("node")).isin(pairs))
            tables.append(self.kept(self.splits(self.histograms(ask, turn, chosen), parents, chosen)))
            for r in tables[-1].drop("sums").collect():
                grown[r["model"]].known[r["node"]] = r
            ask = {}
            for m, g in grown.items():
                if 0 not in g.known:
                    continue  # no row was sampled
                _, fresh = g.wanted(model.num_leaves, model.min_split_gain)
                wanted = {}
                for node in fresh:
                    best = g.known[node]
                    left, right = g.open(node)
                    small, other = (left, right) if 2 * best.n_left <= best.n else (right, left)
                    wanted[small] = (node, other)
                if wanted:
                    ask[m] = (g.tree(None, None), wanted)
        for old in self.paths[path:]:
            remove(self.spark, old)
        del self.paths[path:]

        def value(best):
            return model.learning_rate * best.total * self.unit / (best.n + model.reg_lambda) if best.n else 0.0

        out: list[Tree | None] = [None] * self.n_models
        for m, g in grown.items():
            if 0 in g.known:
                out[m] = g.tree(g.wanted(model.num_leaves, model.min_split_gain)[0], value)
        return out

    def restage(self) -> None:
        """Store predictions so far."""
        chunks_of = self.batches()

        def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for _, _, _, so_far, part in chunks_of(frames):
                out = part.copy()
                out["so_far"] = [row.tobytes() for row in so_far]
                yield out

        old = list(self.paths)
        self.data = self.kept(self.data.mapInPandas(added, _ROWS))
        for path in old:
            remove(self.spark, path)
        self.paths = self.paths[len(old) :]
        self.pending = []

    def train(self) -> list[list[Tree]]:
        """The trees of each model."""
        model = self.model
        self.pending: list[list[Tree | None]] = []
        self.start()
        out: list[list[Tree]] = [[] for _ in range(self.n_models)]
        always_same = model.colsample_bytree >= 1 and not (model.subsample_freq > 0 and model.subsample < 1)
        for turn in range(model.n_estimators if any(x is not None for x in self.init) else 0):
            trees = self.round(turn)
            self.pending.append(trees)
            for m, tree in enumerate(trees):
                if tree is not None:
                    out[m].append(tree)
            if always_same and all(t is None or len(t.feature) == 1 for t in trees):
                break  # nothing is left to split, and no later round differs
            if len(self.pending) >= RESTAGE and turn + 1 < model.n_estimators:
                self.restage()
        self.clean()
        return out


def tree_table(spark, keys: list[tuple], key_schema: str, trainer: Trainer, trees: list[list[Tree]]) -> DataFrame:
    """A row per model: its keys, the first prediction, and its trees as arrays."""
    rows = []
    for key, init, own in zip(keys, trainer.init, trees):
        as_arrays = []
        for t in own:
            # Rows without a value have bin 0, below every threshold.
            limits = [
                float("-inf") if b == 0 or f < 0 else float(trainer.edges[f][b - 1]) if b <= len(trainer.edges[f]) else float("inf")
                for f, b in zip(t.feature, t.bin)
            ]
            as_arrays.append((t.depth(), t.feature, limits, t.left, t.right, t.value))
        rows.append((*key, init, as_arrays))
    tree = "depth: int, feature: array<int>, threshold: array<double>, left: array<int>, right: array<int>, value: array<double>"
    schema = (key_schema + ", " if key_schema else "") + f"init double, trees array<struct<{tree}>>"
    return spark.createDataFrame(rows, schema)


def score(features: Sequence[str], init: Column, trees: Column) -> Column:
    """The sum of the leaves that a row reaches in an array of trees."""
    row = F.array(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features])

    def reached(tree: Column, x: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            feature = F.get(tree["feature"], node)
            low = F.coalesce(F.get(x, feature) <= F.get(tree["threshold"], node), F.lit(True))
            child = F.when(low, F.get(tree["left"], node)).otherwise(F.get(tree["right"], node))
            return F.when(feature < 0, node).otherwise(child)

        steps = F.when(tree["depth"] > 0, F.sequence(F.lit(1), tree["depth"])).otherwise(F.array().cast("array<int>"))
        return F.get(tree["value"], F.aggregate(steps, F.lit(0), down))

    # The row's values are bound once, not built anew at every step down a tree.
    total = lambda x: F.aggregate(trees, init, lambda so_far, tree: so_far + reached(tree, x))
    return F.get(F.transform(F.array(row), total), F.lit(0))


class LeafwiseTrees(Forecaster):
    """Boosted regression trees with the usual parameter names, grown best leaf first.

    The first prediction is the mean.  ``subsample`` counts when ``subsample_freq`` > 0 and draws
    rows anew so often, ``colsample_bytree`` draws features per tree; both by hashes of
    ``random_state``, whatever the layout.  Null and NaN features go left at
    every split.  ``group_cols`` asks for a model per group, all trained together; the groups'
    keys and trees pass the driver, so they are meant for steps of a forecast.  ``n_jobs`` and ``verbose`` are
    accepted and ignored.  Without training rows predictions are null.
    """

    kind = "lightgbm"

    def __init__(
        self,
        n_estimators: int = 100,
        learning_rate: float = 0.1,
        num_leaves: int = 31,
        min_child_samples: int = 20,
        subsample: float = 1.0,
        colsample_bytree: float = 1.0,
        random_state: int = 42,
        subsample_freq: int = 0,
        max_bin: int = 255,
        min_split_gain: float = 0.0,
        reg_lambda: float = 0.0,
        group_cols: Sequence[str] = (),
        n_jobs: int = -1,
        verbose: int = -1,
    ):
        if not 2 <= max_bin <= 255:
            raise ValueError(f"max_bin must be from 2 to 255, not {max_bin}")
        self.n_estimators = n_estimators
        self.learning_rate = learning_rate
        self.num_leaves = num_leaves
        self.min_child_samples = min_child_samples
        self.subsample = subsample
        self.colsample_bytree = colsample_bytree
        self.random_state = random_state
        self.subsample_freq = subsample_freq
        self.max_bin = max_bin
        self.min_split_gain = min_split_gain
        self.reg_lambda = reg_lambda
        self.group_cols = tuple(group_cols)
        self.n_jobs = n_jobs
        self.verbose = verbose

    def _train(self, df: DataFrame, features, target, first, upto, keys, key_schema, nested=False) -> DataFrame:
        """Trees of as many models as there are ``keys``; rows belong to models ``first`` to ``upto``.

        Rows of ``nested`` models count for all later ones too; bins then come from the first model's.
        """
        spark = df.sparkSession
        x = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]
        y = F.col(target).cast("double")
        rows = df.select(
            first.cast("int").alias("first"),
            upto.cast("int").alias("upto"),
            y.alias("y"),
            F.xxhash64(*dict.fromkeys([*features, target, *[c for c in ("site_id", "timestamp") if c in df.columns]])).alias("key"),
            *x,
        ).where(F.col("first").isNotNull() & (F.col("first") <= F.col("upto")) & y.isNotNull() & ~F.isnan(y))
        path = shared_dir(spark)
        trainer = Trainer(self, spark, stage(rows, path), len(features), len(keys), nested)
        trees = trainer.train()
        remove(spark, path)
        return tree_table(spark, keys, key_schema, trainer, trees)

    def fit(self, train: DataFrame, features: Sequence[str], target: str = "value") -> Fitted:
        features = list(features)
        if not self.group_cols:
            table = self._train(train, features, target, F.lit(0), F.lit(0), [()], "")
            return Fitted(self, features, target, {"trees": table})
        groups = list(self.group_cols)
        kinds = {f.name: f.dataType.simpleString() for f in train.schema.fields}
        known = train.where(F.expr(" and ".join(f"`{c}` is not null" for c in groups)))
        keys = [tuple(r) for r in known.select(*groups).distinct().orderBy(*groups).collect()]
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in groups)
        numbers = train.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(keys)], schema + ", __model int")
        marked = train.join(F.broadcast(numbers), groups)
        table = self._train(marked, features, target, F.col("__model"), F.col("__model"), keys, schema)
        return Fitted(self, features, target, {"trees": table})

    def apply(self, fitted: Fitted, df: DataFrame) -> DataFrame:
        table = fitted.tables["trees"]
        df = df.drop(PREDICTION)
        if not self.group_cols:
            one = table.select(F.struct("init", "trees").alias("model")).scalar()
            with_trees = df.withColumn("__model", one)
            return with_trees.withColumn(
                PREDICTION, score(fitted.features, F.col("__model.init"), F.col("__model.trees"))
            ).drop("__model")
        return self._by_key(df, table, list(self.group_cols), fitted.features, "left")

    def _by_key(self, df: DataFrame, table: DataFrame, keys: list[str], features, how: str) -> DataFrame:
        """Every row's prediction by the model of its keys."""
        models = table.select(*keys, F.col("init").alias("__init"), F.col("trees").alias("__trees"))
        size = models.agg(F.sum(F.size(F.flatten("__trees.value")))).first()[0] or 0
        models = F.broadcast(models) if 40 * size <= BROADCAST_BYTES else models
        joined = df.join(models, keys, how)
        scored = joined.withColumn(PREDICTION, score(features, F.col("__init"), F.col("__trees")))
        return scored.drop("__init", "__trees")

    def predict_folds(self, marked: DataFrame, features: Sequence[str], target: str, timestamp_col: str) -> DataFrame:
        """All folds in one run: a row counts for every fold that trains on it."""
        features = list(features)
        marked = stage(marked)
        found = marked.select(F.max("n_folds")).first()[0] or 0
        keys = [(i,) for i in range(found)]
        table = self._train(marked, features, target, F.col("train_from"), F.col("n_folds") - 1, keys, "fold int", nested=True)
        trained = table.where(F.col("init").isNotNull())
        test = marked.where(F.col("test_fold").isNotNull()).withColumn("fold", F.col("test_fold"))
        return self._by_key(test.drop(PREDICTION), trained, ["fold"], features, "inner")
