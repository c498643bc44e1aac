import itertools

import numpy as np
import pytest

from tests_llm_shared import ODD_ROWS, frame
from wattline.llm import quality


def every_path(score, trans):
    """Probability of good per line, by going through all label sequences."""
    total, good = 0.0, np.zeros(len(score))
    for path in itertools.product([0, 1], repeat=len(score)):
        weight = sum(score[i] / 2 if y else -score[i] / 2 for i, y in enumerate(path))
        weight += sum(trans[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(weight)
        good += np.exp(weight) * np.array(path)
    return good / total


def test_marginals_against_every_path():
    rng = np.random.default_rng(1)
    first = np.array([0, 1, 6, 8, 8 + 9])
    score, trans = rng.normal(0, 2, first[-1]), rng.normal(0, 1, (2, 2))
    good, pair, _ = quality.marginals(score, first, trans)
    want = np.concatenate([every_path(score[a:b], trans) for a, b in zip(first, first[1:])])
    assert np.allclose(good, want)
    assert np.allclose(pair.sum(axis=(1, 2)), 1)


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(2)
    features, first, label = rng.normal(size=(12, 3)), np.array([0, 5, 12]), np.array([1, 0])
    weight, trans = quality.fit(features, first, label, rounds=400)

    def likelihood(w, t):
        out = 0.0
        for (a, b), y in zip(zip(first, first[1:]), label):
            score = features[a:b] @ w
            paths = [
                sum(score[i] / 2 if z else -score[i] / 2 for i, z in enumerate(p)) + sum(t[x, z] for x, z in zip(p, p[1:]))
                for p in itertools.product([0, 1], repeat=b - a)
            ]
            own = score.sum() / 2 * (1 if y else -1) + t[y, y] * (b - a - 1)
            out += own - np.log(np.exp(paths).sum())
        return out / 12 - quality.PENALTY / 2 * ((w**2).sum() + (t**2).sum())

    best = likelihood(weight, trans)
    for i in range(3):
        for step in (-0.05, 0.05):
            moved = weight.copy()
            moved[i] += step
            assert likelihood(moved, trans) <= best + 1e-4


def junk(rng, kind):
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(30)]
    if kind == 0:
        return " ".join(w + "%%%" for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join([words[0]] * 60)


def test_learns_lines_and_leaves_others_alone(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(300):
        lines = [" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(12)) + "." for _ in range(3)]
        bad = i % 4 == 0
        if bad:
            lines = lines[:1] + [junk(rng, i % 3) for _ in range(3)]
        rows.append((i, "\n".join(lines), "en", "a", 0))
        if i % 2 == 0 or bad:
            labels.append((i, int(not bad), 0))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows), labels).collect()}
    assert np.mean([got[i].predicted == int(i % 4 != 0) for i in range(300) if got[i].held_out]) > 0.97
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())
    kept = quality.keep_good(frame(spark, rows), labels)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


@pytest.mark.parametrize("rows", [quality.TRAIN_ROWS, 60])
def test_learns_from_lines_at_the_end_of_long_texts(spark, rows):
    rng = np.random.default_rng(4)
    line = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(6)) + "."
    texts, labels = [], []
    for i in range(200):
        bad = i % 2 == 0
        texts.append((i, "\n".join([line() for _ in range(35)] + [junk(rng, i % 3) if bad else line() for _ in range(50)]), "en", "a", 0))
        labels.append((i, int(not bad), 0))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, texts), labels, rows).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.held_out]) > 0.95


def test_chains_cover_whole_texts(spark):
    texts = ["\n".join(f"line {j}" for j in range(n)) for n in (1, 32, 33, 200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, label int")
    got = quality.chains_of(docs, 1.0).groupBy("id").sum("lines").collect()
    assert {r[0]: r[1] for r in got} == {0: 1, 1: 32, 2: 33, 3: 200}
    places = [r.place for r in quality.chains_of(docs, 0.4).collect()]
    assert 0 < len(places) < 11 and max(places) >= quality.CHAIN


def test_odd_rows(odd, labels, none):
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (3, 4)}
    assert len(empty) == 1
    assert quality.keep_good(odd, labels).columns == odd.columns
    assert quality.classify(none, labels).count() == 0
    nothing = quality.classify(odd, labels.limit(0)).collect()
    assert {r.score for r in nothing} == {0.5}


def test_batches_do_not_change_scores():
    rng = np.random.default_rng(5)
    texts = ["\n".join("Ab cd! " * rng.integers(0, 5) for _ in range(rng.integers(1, 6))) for _ in range(20)]
    model = (rng.normal(size=1 + 3 * len(quality.OWN)), rng.normal(size=(2, 2)), 1.0, 0.0)
    alone = np.concatenate([quality.document_scores([t], model) for t in texts])
    assert quality.document_scores(texts, model) == pytest.approx(alone)
