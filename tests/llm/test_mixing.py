from collections import defaultdict

import numpy as np
import pytest

from tests_llm_shared import frame, texts_of, ODD_ROWS
from wattline.llm import mixing


def words(text):
    return len((text or "").encode().split())


def targets(totals, weights, share, cap):
    """Targets by giving out small amounts round after round."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left = dict.fromkeys(order, 0.0), share * sum(totals.values())
    while left > 1e-9:
        open_ = [s for s in order if out[s] < cap * totals[s] - 1e-9]
        if not open_:
            break
        part, all_ = left, sum(w[s] for s in open_)
        for s in open_:
            more = min(part * w[s] / all_, cap * totals[s] - out[s])
            out[s] += more
            left -= more
    return out


def documents(seed, n, sources):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = int(rng.lognormal(4, 1))
        source = sources[0] if rng.random() < 0.35 else sources[rng.integers(len(sources))]
        rows.append((i, "w " * size, "en", source, 0))
    return rows


def test_targets_and_rounding(spark):
    rows = documents(1, 900, ["b", "a", "é", "Z", None])
    got = mixing.taken(mixing.mix(frame(spark, rows))).toPandas()
    size = {r[0]: words(r[1]) for r in rows}
    source = {r[0]: r[3] for r in rows}
    totals = defaultdict(int)
    for i, s in source.items():
        totals[s] += size[i]
    want = targets(totals, mixing.WEIGHTS, mixing.SHARE, mixing.CAP)
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    took = defaultdict(int)
    for r in got.itertuples():
        assert (r.size, r.source_size) == (size[r.doc_id], totals[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken % max(r.size, 1) == 0
        took[source[r.doc_id]] += r.taken
    for s in totals:
        assert took[s] == pytest.approx(want[s], rel=0.002), s


def test_rates_are_the_exponential_tilt(spark):
    sizes = spark.createDataFrame([(0, s, 1) for s in range(1, 200)], "place int, size long, n long")
    total = sum(range(1, 200))
    per = spark.createDataFrame([(0, "a", total, 1.4 * total, 100.0)], "place int, source string, source_size long, target double, scale double")
    m = mixing.solve(sizes, per, 2.0).first().multiplier
    s = np.arange(1, 200)
    assert (2 / (1 + np.exp(-m * s / 100)) * s).sum() == pytest.approx(1.4 * total, rel=1e-8)


def test_odd_rows_and_repeats(odd, spark):
    got = mixing.taken(mixing.mix(odd)).toPandas()
    assert len(got) == len(ODD_ROWS)
    assert sorted(got["size"]) == sorted(words(t) for _, t in texts_of())
    assert (got["taken"] <= 2 * got["size"]).all()
    repeated = mixing.repeat(odd)
    assert repeated.columns == odd.columns
    assert sum(words(r.text) for r in repeated.collect()) == got["taken"].sum()


def test_reruns_agree(spark):
    df = frame(spark, documents(3, 200, ["a", "b"]))
    runs = [sorted(map(tuple, mixing.taken(mixing.mix(d)).collect())) for d in (df, df.repartition(7))]
    assert runs[0] == runs[1]


def test_empty_table(none):
    assert mixing.taken(mixing.mix(none)).count() == 0
    assert mixing.repeat(none).count() == 0


def test_shares_beyond_a_cap_go_to_the_others():
    got = mixing.targets_of(np.array([10.0, 100.0, 1000.0]), np.array([3.0, 1.0, 2.0]), 1.5, 2.0)
    assert got.tolist() == pytest.approx([20, 200, 1445])


def test_small_tables_are_sent_without_python_workers(spark):
    sizes = spark.range(4).selectExpr("nullif(id % 2, 1) AS source", "id + 1 AS size", "1L AS n")
    per_source = mixing.source_targets(sizes.withColumn("source", sizes.source.cast("string")), (3, 1, 2), 1.5, 2.0)
    assert [f.simpleString() for f in per_source.schema] == [
        "place:int", "source:string", "source_size:bigint", "target:double", "scale:double"
    ]
    assert "ExistingRDD" not in per_source._jdf.queryExecution().executedPlan().toString()
    assert [(r.place, r.source, r.source_size) for r in per_source.collect()] == [(0, "0", 4), (1, None, 6)]
