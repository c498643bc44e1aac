"""Document quality from line labels of a linear-chain conditional random field.

Every line of a document is good or bad.  A line's score depends on its own features and on
those of the line before and the line after; transitions tie neighbouring labels together.
Forward and backward passes give each line's probability to be good.  The mean of these
weighted by line length, with its odds brought in line with the labels' odds, is the
document's score.

The field is fitted by gradient steps on the conditional likelihood of a sample of labelled
documents, at most ``TRAIN_ROWS`` of them, whose label all their lines share.  For fitting
only, their whole texts are cut into chains of ``CHAIN`` lines; of more than ``CHAIN`` lines
a document on average, chains from all places are chosen by a hash.  Calibration and scoring
cover whole texts, spread over the cluster, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import chunks, give_back, held_out, lean
from wattline.llm.hashing import mix
from wattline.llm.textstats import DIGIT, LETTER, MARK, SIGN, SPACE, UPPER, Texts, span_hashes, sums
from wattline.llm.tokens import forget
from wattline.sources.sinks import stage

TRAIN_ROWS, CHAIN, ROUNDS = 6_000, 32, 150
CHARS = 300_000
THRESHOLD = 0.3
PENALTY = 1e-3

OWN = ["capitals", "signs", "digits", "marks", "repeats", "bars", "word_length", "length", "wordless"]


def line_features(texts: list[str]):
    """Features per line, its length, and the first line of each text (one more at the end)."""
    t = Texts(texts)
    ends = np.flatnonzero(t.codes == 10)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    first = np.searchsorted(begins, np.append(t.starts, len(t.codes)))
    length = ends - begins
    n = np.maximum(length, 1)
    of = lambda flag: sums((t.kind & flag) > 0, begins, ends)
    letters = of(LETTER)
    wb, we = t.runs((t.kind & SPACE) == 0)
    hashes = span_hashes(t.lower, wb, we)
    line = np.searchsorted(begins, wb, "right") - 1
    words = np.bincount(line, minlength=len(ends))
    again = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[1:][again], minlength=len(ends))
    w = np.maximum(words, 1)
    bare = n - of(SPACE)
    own = np.column_stack(
        [
            of(UPPER) / np.maximum(letters, 1),
            np.minimum(1, 4 * of(SIGN) / np.maximum(bare, 1)),
            of(DIGIT) / np.maximum(bare, 1),
            np.minimum(1, 4 * of(MARK) / np.maximum(bare, 1)),
            repeats / w,
            np.minimum(1, 2 * sums(t.codes == ord("|"), begins, ends) / w),
            np.minimum(1, bare / w / 20),
            np.minimum(1, np.log1p(length) / 8),
            letters == 0,
        ]
    ).astype(float)
    head = np.zeros(len(ends), bool)
    head[first[:-1]] = True
    tail = np.zeros(len(ends), bool)
    tail[first[1:] - 1] = True
    before = np.where(head[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(tail[:, None], 0, np.roll(own, -1, axis=0))
    return np.hstack([np.ones((len(ends), 1)), own, before, after]), length, first


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray):
    """Per line the probability to be good, per chain step the joint one of label pairs.

    ``score``: how much better good fits a line than bad; chains are the stretches between
    entries of ``first``; ``trans``: weight of each label pair.  All chains move together,
    the longest ones alone at the end.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    start, count = first[:-1][order], count[order]
    most = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(most), "left")  # chains longer than a place
    half = np.column_stack([-score / 2, score / 2])
    emit = np.exp(half - half.max(axis=1, keepdims=True))
    step = np.exp(trans - trans.max())
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    for i in range(most):
        at = start[: active[i]] + i
        a = emit[at] if i == 0 else (ahead[at - 1] @ step) * emit[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for i in range(most - 2, -1, -1):
        at = start[: active[i + 1]] + i
        b = (emit[at + 1] * back[at + 1]) @ step.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    good = both[:, 1] / both.sum(axis=1)
    links = np.ones(len(score), bool)
    links[first[:-1]] = False
    at = np.flatnonzero(links)
    pair = ahead[at - 1][:, :, None] * step * (emit[at] * back[at])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return good, pair, at


def fit(features: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = ROUNDS):
    """Weights and label pair weights that make the labels of all lines likely (Adam steps)."""
    weight, trans = np.zeros(features.shape[1]), np.zeros((2, 2))
    line_label = np.repeat(label, np.diff(first)).astype(float)
    seen = np.zeros((2, 2))
    links = np.ones(len(features), bool)
    links[first[:-1]] = False
    at = np.flatnonzero(links)
    np.add.at(seen, (line_label[at - 1].astype(int), line_label[at].astype(int)), 1)
    n = max(1, len(features))
    m = v = np.zeros(len(weight) + 4)
    for i in range(1, rounds + 1):
        good, pair, _ = marginals(features @ weight, first, trans)
        grad = np.concatenate([features.T @ (line_label - good) / n, ((seen - pair.sum(axis=0)) / n).ravel()])
        grad -= PENALTY * np.concatenate([weight, trans.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.2 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        weight, trans = weight + move[:-4], trans + move[-4:].reshape(2, 2)
    return weight, trans


def document_means(features, length, first, weight, trans) -> np.ndarray:
    """Mean probability of each text's lines to be good, weighted by length plus one."""
    good, _, _ = marginals(features @ weight, first, trans)
    if not len(good):
        return good
    return np.add.reduceat(good * (length + 1), first[:-1]) / np.add.reduceat(length + 1, first[:-1])


def odds(mean: np.ndarray) -> np.ndarray:
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def calibrate(mean: np.ndarray, label: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn the odds of the mean into odds of label 1 (Newton steps)."""
    x = np.column_stack([odds(mean), np.ones(len(mean))])
    line = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        grad = x.T @ (label - p) - 0.1 * (line - [1.0, 0.0])
        line = line + np.linalg.solve((x.T * (p * (1 - p))) @ x + 0.1 * np.eye(2), grad)
    return float(max(line[0], 1e-3)), float(line[1])


def document_scores(texts: list[str], model) -> np.ndarray:
    weight, trans, slope, offset = model
    mean = document_means(*line_features(texts), weight, trans)
    return 1 / (1 + np.exp(-np.clip(slope * odds(mean) + offset, -700, 700)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_: str = "doc_id") -> DataFrame:
    """At most about ``rows`` labelled documents with text and ``label``, chosen by a hash of the id.

    Rows set aside for tests, without an id or without a label are left out; several labels
    of one document count as their largest.
    """
    known = (
        labels.filter(~held_out(id_, 5, 0) & F.col(label).isNotNull())
        .groupBy(F.col(id_).alias("label_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    total = known.count()
    share = min(1.0, rows / max(1, total))
    chosen = known.filter(F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.join(chosen, F.col(id_) == F.col("label_id")).select(
        F.col("label_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "label"
    )


def chains_of(docs: DataFrame, share: float) -> DataFrame:
    """(id, label, place, lines, features) of a ``share`` of the chains of whole texts, chosen by a hash."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for part in chunks(pdf["text"].tolist(), CHARS):
                here = pdf.iloc[part]
                features, _, first = line_features(here["text"].tolist())
                begin = [np.arange(a, b, CHAIN) for a, b in zip(first, first[1:])]
                whose = np.repeat(np.arange(len(part)), [len(x) for x in begin])
                begin = np.concatenate(begin)
                place = begin - first[whose]
                ids = here["id"].to_numpy(np.int64)[whose]
                keep = np.flatnonzero(mix(mix(ids.view(np.uint64)) + place.astype(np.uint64)) < share * 2.0**64)
                cut = [slice(begin[i], min(first[whose[i] + 1], begin[i] + CHAIN)) for i in keep]
                yield pd.DataFrame(
                    {
                        "id": ids[keep],
                        "label": here["label"].to_numpy()[whose[keep]],
                        "place": place[keep],
                        "lines": [x.stop - x.start for x in cut],
                        "features": [features[x].astype("<f4").tobytes() for x in cut],
                    }
                )

    return docs.mapInPandas(lean(run), "id long, label int, place long, lines int, features binary")


def means_of(docs: DataFrame, weight, trans) -> DataFrame:
    """(label, mean) of whole texts."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for part in chunks(pdf["text"].tolist(), CHARS):
                here = pdf.iloc[part]
                mean = document_means(*line_features(here["text"].tolist()), weight, trans)
                yield pd.DataFrame({"label": here["label"].to_numpy(), "mean": mean})

    return docs.mapInPandas(lean(run), "label int, mean double")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS):
    """The field and its calibration from a bounded sample of labelled documents."""
    docs = docs.select("doc_id", "text")
    sample = stage(training_sample(docs, labels, "quality", rows))
    lines = sample.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1)).first()[0]
    share = min(1.0, rows * CHAIN / max(1, lines or 0))
    pdf = chains_of(sample, share).toPandas().sort_values(["id", "place", "lines", "features"], ignore_index=True)
    width = 1 + 3 * len(OWN)
    if not len(pdf):
        return np.zeros(width), np.zeros((2, 2)), 1.0, 0.0
    features = np.frombuffer(b"".join(pdf["features"]), "<f4").reshape(-1, width).astype(float)
    first = np.concatenate(([0], np.cumsum(pdf["lines"])))
    weight, trans = fit(features, first, pdf["label"].to_numpy())
    means = means_of(sample, weight, trans).toPandas().sort_values(["mean", "label"], ignore_index=True)
    return weight, trans, *calibrate(means["mean"].to_numpy(), means["label"].to_numpy())


def score(docs: DataFrame, model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: the quality of each text; null counts as empty.

    Only the text is sent to Python, and it comes back with its row.
    """

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            texts = texts.fillna("").tolist()
            out = [document_scores([texts[i] for i in part], model) for part in chunks(texts, CHARS)]
            yield pd.Series(np.concatenate(out) if out else [], dtype=float)
        give_back()

    return docs.withColumn(name, quality(F.col(text)))


def predicted(score: str | Column = "score", threshold: float = THRESHOLD) -> Column:
    score = F.col(score) if isinstance(score, str) else score
    return (score >= threshold).cast("int")


def classify(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Empty and null texts have one empty line and its score.  Repeated rows are scored each.
    Without labelled rows every score is a half.  An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    model = train(docs, labels, rows)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", predicted().alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that are predicted to be good, with all their columns."""
    model = train(docs, labels, rows)
    whole = docs.select(F.struct("*").alias("row"), F.col("text").alias("own_text"))
    return score(whole, model, "own_text").filter(predicted() == 1).select("row.*")
