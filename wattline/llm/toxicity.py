"""Toxicity of texts: gradient-boosted trees over dense features, calibrated.

Features of a text are densities of lexicon words, second-person words close to lexicon
words, shares of capitals and punctuation, and rates of words that hide letters behind
signs, digits or spaces.  The lexicon is a fixed list of seeds and, above all, what the
labels show: words and beginnings of words that are much more frequent among documents
labelled toxic.  Learned entries carry the log odds of that.

So that trees are not fitted to features that have seen the same labels, the learning
documents are cut into ``FOLDS`` parts, and the features of a part come from the lexicon
of the others.  Boosted trees give raw scores, and isotonic regression on documents of a
part that the trees have not seen turns them into probabilities.

Learning uses at most about ``TRAIN_ROWS`` labelled documents; every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import chunks, held_out, pieces
from wattline.llm.quality import training_sample
from wattline.llm.textstats import DIGIT, LETTER, MARK, SIGN, SPACE, UPPER, Texts, span_hashes, sums
from wattline.sources.sinks import stage

TRAIN_ROWS, FOLDS = 12_000, 4
# Entries of the learned lexicon, documents of the rarer label an entry needs, log odds.
ENTRIES, SUPPORT, ODDS = 20_000, 3, 1.5
# Lengths of word beginnings that may become entries, besides whole words.
BEGINNINGS = (4, 5, 6)
TREES, DEPTH = 20, 3
THRESHOLD = 0.5
CHARS = 600_000

# Words that address the reader, and seeds that need no labels.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch sie usted ustedes ti tus".split()
SEEDS = "idiot moron stupid loser trash scum dumb pathetic worthless disgusting hate kill shut filthy vermin".split()

NAMES = [
    "strong_rate", "middle_rate", "weak_rate", "strong_count", "highest", "odds_rate", "seed_rate",
    "you_rate", "you_near", "capitals", "shouted", "marks", "signs", "exclaimed", "questions",
    "digits", "hidden", "spaced", "long_runs", "length",
]
# Log odds from which an entry counts as strong, and as middle.
STRONG, MIDDLE = 4.0, 2.5
NEAR = 3


def entry_hashes(t: Texts):
    """Begin, end and owner of each bare word, and hashes of it and of its beginnings.

    The first row of hashes is of whole words; a beginning that is the whole word has 0.
    """
    begin, end = t.runs((t.kind & LETTER) > 0)
    rows = [span_hashes(t.lower, begin, end) | np.uint64(1)]
    for n in BEGINNINGS:
        part = np.zeros(len(begin), np.uint64)
        long = np.flatnonzero(end - begin > n)
        part[long] = (span_hashes(t.lower, begin[long], begin[long] + n) + np.uint64(2 * n)) & ~np.uint64(1)
        rows.append(part)
    return begin, end, t.owner(begin), np.stack(rows)


def hashes_of(words: list[str]) -> np.ndarray:
    t = Texts(words)
    begin, end = t.runs((t.kind & LETTER) > 0)
    return np.sort(span_hashes(t.lower, begin, end) | np.uint64(1))


def _count_entries(batches: Iterator[pd.DataFrame]):
    """Documents of each part and label that hold an entry, added up as far as a task goes."""
    held: list[pd.DataFrame] = []

    def merged():
        return pd.concat(held).groupby(["entry", "part", "label"], as_index=False)["n"].sum()

    for pdf in batches:
        for some in chunks(pdf["text"].tolist(), CHARS):
            here = pdf.iloc[some]
            t = Texts(here["text"].tolist())
            _, _, owner, rows = entry_hashes(t)
            pairs = np.unique(np.column_stack([np.tile(owner, len(rows)).astype(np.uint64), rows.ravel()]), axis=0)
            pairs = pairs[pairs[:, 1] != 0]
            whose = pairs[:, 0].astype(np.int64)
            held.append(
                pd.DataFrame(
                    {
                        "entry": pairs[:, 1].view(np.int64),
                        "part": here["part"].to_numpy()[whose],
                        "label": here["label"].to_numpy()[whose],
                        "n": 1,
                    }
                )
            )
        held = [merged()]
        if len(held[0]) > 500_000:
            yield held.pop()
    if held:
        yield merged()


def log_odds(toxic, clean, n_toxic, n_clean):
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def learn_lexicon(sample: DataFrame):
    """Sorted entries and their log odds: over all parts, and without each of them.

    ``sample``: text, label, part.  At most ``ENTRIES`` entries, those with the strongest
    evidence, come to the driver.
    """
    totals = sample.groupBy("part", "label").count().collect()
    n = np.zeros((2, FOLDS))
    for r in totals:
        n[r["label"], r["part"]] += r["count"]
    counts = sample.select("text", "label", "part").mapInPandas(_count_entries, "entry long, part int, label int, n long")
    of = lambda label, part: F.sum(F.when((F.col("label") == label) & (F.col("part") == part), F.col("n")).otherwise(0))
    names = [(label, part) for label in (0, 1) for part in range(FOLDS)]
    table = counts.groupBy("entry").agg(*[of(*x).alias(f"n{x[0]}_{x[1]}") for x in names])
    total = lambda label: reduce(lambda a, b: a + b, [F.col(f"n{label}_{p}") for p in range(FOLDS)])
    odds = F.log((total(1) + 0.5) / (n[1].sum() + 1)) - F.log((total(0) + 0.5) / (n[0].sum() + 1))
    best = (
        table.withColumn("odds", odds)
        .filter((total(1) >= SUPPORT) & (F.col("odds") >= ODDS))
        .orderBy((F.col("odds") * F.sqrt(total(1))).desc(), "entry")
        .limit(ENTRIES)
        .toPandas()
    )
    best = best.assign(key=best["entry"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    a, b = (best[[f"n{label}_{p}" for p in range(FOLDS)]].to_numpy(float) for label in (1, 0))
    weights = [log_odds(a.sum(axis=1), b.sum(axis=1), n[1].sum(), n[0].sum())]
    for part in range(FOLDS):
        rest = np.arange(FOLDS) != part
        w = log_odds(a[:, rest].sum(axis=1), b[:, rest].sum(axis=1), n[1, rest].sum(), n[0, rest].sum())
        weights.append(np.where(a[:, rest].sum(axis=1) >= min(2, SUPPORT), w, 0))
    return best["key"].to_numpy(np.uint64), np.stack(weights)


def sums_of(texts: list[str], parts: np.ndarray, lexicon) -> np.ndarray:
    """Counts behind the features; those of a text's pieces can be added (but for maxima)."""
    keys, weights = lexicon
    t = Texts(texts)
    n = t.n
    begin, end, owner, rows = entry_hashes(t)
    high = np.zeros(len(begin))
    if len(keys):
        which = parts[owner] + 1
        for row in rows:
            at = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
            found = np.where((keys[at] == row) & (row != 0), weights[which, at], 0)
            high = np.maximum(high, found)
    count = lambda mask, by=owner: np.bincount(by[mask], minlength=n)
    strong, middle = high >= STRONG, (high >= MIDDLE) & (high < STRONG)
    weak = (high > 0) & (high < MIDDLE)
    you = np.isin(rows[0], hashes_of(SECOND_PERSON))
    seed = np.isin(rows[0], hashes_of(SEEDS))
    # Second-person words with a strong word or a seed within NEAR words.
    target = np.concatenate(([0], np.cumsum(strong | seed)))
    i = np.arange(len(begin))
    near = target[np.minimum(i + NEAR + 1, len(i))] > target[np.maximum(i - NEAR, 0)]
    most = np.zeros(n)
    np.maximum.at(most, owner, high)
    ends = np.append(t.starts[1:], len(t.codes)) - 1
    of = lambda mask: sums(mask, t.starts, ends)
    caps = sums((t.kind & UPPER) > 0, begin, end)
    # Words in the wide sense: signs or digits between letters hide them; single letters in
    # a row are a spaced word; a letter three times in a row is a drawn one.
    wb, we = t.runs((t.kind & SPACE) == 0)
    wide = t.owner(wb)
    letter, sign = (t.kind & LETTER) > 0, (t.kind & (SIGN | DIGIT)) > 0
    inner = np.zeros(len(t.codes), bool)
    inner[1:-1] = letter[:-2] & sign[1:-1] & letter[2:]
    hidden = sums(inner, wb, we) > 0
    single = (we - wb == 1) & letter[wb] if len(wb) else np.zeros(0, bool)
    spaced = single.copy()
    spaced[2:] &= single[1:-1] & single[:-2]
    spaced[:2] = False
    same = t.lower[1:] == t.lower[:-1]
    drawn = np.zeros(len(t.codes), bool)
    drawn[2:] = same[1:] & same[:-1] & letter[2:]
    return np.column_stack(
        [
            np.bincount(owner, minlength=n), count(strong), count(middle), count(weak), most,
            np.bincount(owner, high, minlength=n), count(seed), count(you), count(you & near),
            of((t.kind & UPPER) > 0), of(letter), count((caps == end - begin) & (end - begin > 2)),
            of((t.kind & MARK) > 0), of((t.kind & SIGN) > 0), of(t.codes == ord("!")), of(t.codes == ord("?")),
            of((t.kind & DIGIT) > 0), np.bincount(wide[hidden], minlength=n), np.bincount(wide[spaced], minlength=n),
            of(drawn), np.bincount(wide, minlength=n), ends - t.starts,
        ]
    ).astype(float)


def features_of(s: np.ndarray) -> np.ndarray:
    """The features ``NAMES`` from the counts of whole texts."""
    (words, strong, middle, weak, most, odds, seed, you, near, upper, letters, shouted, marks, signs, exclaimed,
     questions, digits, hidden, spaced, drawn, wide, length) = s.T
    w, v, c, k = np.maximum(words, 1), np.maximum(wide, 1), np.maximum(length, 1), np.maximum(letters, 1)
    return np.column_stack(
        [
            strong / w, middle / w, weak / w, np.minimum(strong, 20), most, odds / w, seed / w,
            you / w, near / w, upper / k, shouted / w, marks / c, signs / c, exclaimed / c, questions / c,
            digits / c, hidden / v, spaced / v, drawn / c, np.log1p(length),
        ]
    )


def text_features(texts: list[str], parts: np.ndarray, lexicon) -> np.ndarray:
    """Features of whole texts; long ones are counted piece by piece and added up."""
    cut = [pieces(x, CHARS) for x in texts]
    whose = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    flat = [p for c in cut for p in c]
    total = np.zeros((len(texts), 22))
    for some in chunks(flat, CHARS):
        got = sums_of([flat[i] for i in some], parts[whose[some]], lexicon)
        at = whose[some]
        highest = total[:, 4].copy()
        np.maximum.at(highest, at, got[:, 4])
        np.add.at(total, at, got)
        total[:, 4] = highest
    return features_of(total)


def with_features(docs: DataFrame, lexicon, part: Column) -> DataFrame:
    """``docs`` (with text) plus an array ``features``; ``part`` -1 takes the whole lexicon."""

    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, parts in batches:
            rows = text_features(texts.fillna("").tolist(), parts.to_numpy(np.int64), lexicon)
            yield pd.Series(list(rows))

    return docs.withColumn("features", dense(F.col("text"), part.cast("int")))


def vectors(df: DataFrame) -> DataFrame:
    wide = df.select("*", *[F.col("features")[i].alias(f"f_{n}") for i, n in enumerate(NAMES)])
    return VectorAssembler(inputCols=[f"f_{n}" for n in NAMES], outputCol="dense").transform(wide)


def margin(df: DataFrame, trees) -> DataFrame:
    """``df`` with the raw score of the trees for label 1."""
    return trees.transform(vectors(df)).withColumn("raw", vector_to_array("rawPrediction")[1])


class Model:
    """Lexicon, trees and calibration steps; without both labels, a constant."""

    def __init__(self, lexicon, trees, steps, constant):
        self.lexicon, self.trees, self.steps, self.constant = lexicon, trees, steps, constant


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Lexicon, trees and calibration from a bounded sample of labelled documents.

    The labelled documents are halved, each label by itself.  Trees of either half score the other one,
    and the calibration is learned from these scores of documents that their trees have not seen; then
    trees are grown on all.  With fewer than two documents of a label the score is the
    share of toxic ones, 0 without any label.
    """
    sample = training_sample(docs.select("doc_id", "text"), labels, "toxic", rows)
    halves = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(5)), "id")
    sample = stage(
        sample.withColumns(
            {
                "part": F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int"),
                "half": (F.row_number().over(halves) % 2).cast("int"),
            }
        )
    )
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(seen.get(0, 0), seen.get(1, 0)) < 2:
        return Model(None, None, None, seen.get(1, 0) / max(1, sum(seen.values())))
    lexicon = learn_lexicon(sample)
    known = stage(with_features(sample, lexicon, F.col("part")).select("id", "label", "half", "features"))
    ready = vectors(known).select(F.col("label").cast("double").alias("label"), "dense", "half")
    grower = GBTClassifier(
        featuresCol="dense", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=1, minInstancesPerNode=4
    )
    scored = [
        margin(known.filter(F.col("half") == half), grower.fit(ready.filter(F.col("half") != half))).select(
            "raw", F.col("label").cast("double").alias("label")
        )
        for half in (0, 1)
    ]
    steps = calibration(scored[0].unionByName(scored[1]))
    return Model(lexicon, grower.fit(ready), steps, None)


def calibration(scored: DataFrame) -> tuple[list[float], list[float]]:
    """Raw scores and probabilities of the isotonic curve, between which it is linear."""
    model = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored)
    x, y = list(model.boundaries.toArray()), list(model.predictions.toArray())
    return [float(v) for v in x], [float(min(1.0, max(0.0, v))) for v in y]


def calibrated(raw: Column, steps: tuple[list[float], list[float]]) -> Column:
    """The curve at ``raw``, kept off 0 and 1 and rising a little so that order stays."""
    x, y = steps
    xs, ys = F.array(*map(F.lit, x)), F.array(*map(F.lit, y))
    after = F.size(F.filter(xs, lambda v: v <= raw))
    low, high = F.greatest(F.lit(1), after), F.least(F.lit(len(x)), after + 1)
    x0, x1 = F.element_at(xs, low), F.element_at(xs, high)
    y0, y1 = F.element_at(ys, low), F.element_at(ys, high)
    share = F.when(x1 > x0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - x0) / (x1 - x0)))).otherwise(0.0)
    curve = y0 + share * (y1 - y0)
    return 0.98 * curve + 0.02 / (1 + F.exp(-raw))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and score."""
    if model.trees is None:
        return docs.select("doc_id", F.lit(model.constant).alias("score"))
    dense = with_features(docs.select("doc_id", "text"), model.lexicon, F.lit(-1)).select("doc_id", "features")
    return margin(dense, model.trees).select("doc_id", calibrated(F.col("raw"), model.steps).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts are empty, and empty ones have the score of a text without words.  Repeated
    rows are scored each.  With fewer than two labelled documents of a kind every score is the share of toxic
    ones among them, so 1 or 0 with one kind only, and 0 without labels.  An empty table gives no rows;
    columns other than doc_id and text are not read.
    """
    model = train(docs, labels, rows)
    return score(docs, model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
