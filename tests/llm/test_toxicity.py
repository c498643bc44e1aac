import zlib

import numpy as np
import pytest

from tests_llm_shared import ODD_ROWS, frame
from wattline.llm import toxicity


def corpus(seed, n):
    """Documents of made-up words; toxic ones hold words that begin with a few stems."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join(rng.choice(list("abcdefghij"), k))
    rows = []
    for i in range(n):
        words = [word(rng.integers(2, 9)) for _ in range(rng.integers(10, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(1 + len(words) // 12):
                words[rng.integers(len(words))] = ["zorgan", "quilux"][rng.integers(2)] + word(rng.integers(0, 5))
        rows.append((i, " ".join(words).capitalize() + ".", "en", "a", int(toxic)))
    return rows


def test_held_out_documents(spark):
    rows = corpus(1, 900)
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows], "doc_id long, quality int, toxic int")
    got = toxicity.classify(frame(spark, rows), labels).toPandas().merge(
        labels.toPandas(), on="doc_id"
    )
    held = got[got["held_out"]]
    assert ((held["predicted"] == held["toxic"]).mean()) > 0.95
    assert held[held["toxic"] == 0]["predicted"].mean() < 0.02
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    # Labels of the documents that are set aside change nothing.
    import zlib

    other = spark.createDataFrame(
        [(r[0], 1, 1 - r[4] if zlib.crc32(str(r[0]).encode()) % 5 == 0 else r[4]) for r in rows],
        "doc_id long, quality int, toxic int",
    )
    again = toxicity.classify(frame(spark, rows), other).toPandas()
    assert dict(zip(again["doc_id"], again["score"])) == pytest.approx(dict(zip(got["doc_id"], got["score"])))


def test_odd_rows(odd, labels, none):
    got = toxicity.classify(odd, labels).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4)}) == 1
    assert toxicity.classify(none, labels).count() == 0
    assert {r.score for r in toxicity.classify(odd, labels.filter("toxic = 0")).collect()} == {0.0}


def plain(text):
    """A few of the features, character by character."""
    import re

    words = re.findall(r"[^\W\d_]+", text)
    wide = text.split()
    return {
        "you_rate": sum(w.lower() in toxicity.SECOND_PERSON for w in words) / max(1, len(words)),
        "seed_rate": sum(w.lower() in toxicity.SEEDS for w in words) / max(1, len(words)),
        "capitals": sum(c.isupper() for c in text) / max(1, sum(c.isalpha() for c in text)),
        "shouted": sum(w.isupper() and len(w) > 2 for w in words) / max(1, len(words)),
        "exclaimed": text.count("!") / max(1, len(text)),
        "hidden": sum(bool(re.search(r"[^\W\d_][\d@$*#%][^\W\d_]", w)) for w in wide) / max(1, len(wide)),
        "length": np.log1p(len(text)),
    }


TEXTS = ["You IDIOT! go away, moron", "", "st*pid l0ser i d i o t", "Nice day, isn't it?", "sooo bad!!! ÄÖÜ groß", "x" * 50]


def test_features_against_plain_ones():
    none = (np.empty(0, np.uint64), np.zeros((toxicity.FOLDS + 1, 0)))
    got = toxicity.text_features(TEXTS, np.full(len(TEXTS), -1), none)
    for text, row in zip(TEXTS, got, strict=True):
        for name, value in plain(text).items():
            assert row[toxicity.NAMES.index(name)] == pytest.approx(value), (text, name)


def test_pieces_of_long_texts_add_up(monkeypatch):
    keys = toxicity.hashes_of(["zorgan", "away"])
    lexicon = (keys, np.tile([5.0, 3.0], (toxicity.FOLDS + 1, 1)))
    text = " ".join(["zorgan you walk AWAY from this!"] * 40)
    whole = toxicity.text_features([text], np.array([-1]), lexicon)
    monkeypatch.setattr(toxicity, "CHARS", 100)
    cut = toxicity.text_features([text], np.array([-1]), lexicon)
    near = toxicity.NAMES.index("you_near")  # neighbours are looked for within a piece
    keep = np.arange(len(toxicity.NAMES)) != near
    assert cut[0, keep] == pytest.approx(whole[0, keep])


def test_calibration_rises(spark):
    scored = spark.createDataFrame([(float(x), float(x + (x % 3) > 9)) for x in range(20)], "raw double, label double")
    steps = toxicity.calibration(scored)
    grid = spark.range(-50, 250).selectExpr("id / 10.0 as raw").selectExpr("cast(raw as double) raw")
    got = [r.s for r in grid.select(toxicity.calibrated(grid["raw"], steps).alias("s")).collect()]
    assert got == sorted(got) and 0 <= got[0] < 0.05 and 0.95 < got[-1] <= 1


@pytest.mark.parametrize("toxic, clean, want", [(0, 0, 0.0), (3, 0, 1.0), (0, 3, 0.0), (1, 4, 0.2), (2, 2, None), (2, 6, None), (9, 3, None)])
def test_few_labels(spark, toxic, clean, want):
    """Every document gets a score, however few labels there are and wherever they lie."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5][: toxic + clean]
    bad = set(ids[:toxic])
    rows = [(i, "you stupid idiot, go away" if i in bad else f"a calm text about boats {i}", "en", "a", 1) for i in ids]
    docs = frame(spark, [*rows, (1_000, None, None, None, 0), (1_001, "", "en", "a", 0)])
    labels = spark.createDataFrame([(i, 1, int(i in bad)) for i in ids], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + 2
    assert all(r.score is not None and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    if want is not None:
        assert {r.score for r in got} == {want}
