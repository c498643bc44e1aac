import numpy as np
import pytest

from wattline.llm import topk


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, place string")
    return df.select("vec_id", topk.scaled("embedding").alias("vector"), "score", "place")


def brute(rows, k=5):
    """(query_id, rank, vec_id, score) by scoring everything in whole numbers."""
    sound = []
    for vec_id, v, *_ in rows:
        if v is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        sound.append((vec_id, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]))
    out = []
    for i, (q, a) in enumerate(sound):
        if q is None or q % 50:
            continue
        scores = [(-min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(a, b)))), c is None, c or 0, c)
                  for j, (c, b) in enumerate(sound) if j != i]
        out += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def found(df, **kinds):
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), **kinds)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("kind", ["unit", "long", "copies", "flat"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(1500, 12)) @ np.diag(2.0 ** -np.arange(12))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "long":
        x *= np.exp(rng.normal(size=(1500, 1)) * 2)
    if kind == "copies":
        x[200:700] = x[3]  # a third of all rows
        x[700:900] = -x[3]
    if kind == "flat":
        x = rng.integers(0, 2, (1500, 12)) / 2  # many equal scores
        x[50] = x[51] = 0
    rows = [(int(i), v, "s", "p") for i, v in enumerate(x.astype(float).tolist())]
    assert found(vectors(spark, rows), block=128, query_block=16) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (50, [1.0, 2.0], "a", "b"),
        (50, [1.0, 2.0], "a", "b"),  # a repeated row
        (100, [1.0], None, None),
        (150, None, None, None),
        (200, [1.0, None], None, None),
        (250, [nan, 1.0], None, None),
        (300, [inf, 1.0], None, None),
        (350, [], None, None),
        (400, [0.0, -0.0], None, None),
        (None, [1.0, 2.0], None, None),
        (None, [3.0, 2.0], None, None),
        (7, [-0.001, 0.001], None, None),
        (450, [3e38, -3e38], None, None),
        (8, [3e38, 3e38], None, None),
        (500, [1e7, 1.5], None, None),
    ]
    assert found(vectors(spark, rows)) == brute(rows)
    few = rows[:1] + rows[3:4]
    assert found(vectors(spark, few)) == []


def test_empty_table(spark):
    assert found(vectors(spark, [])) == []


def test_scaled_keeps_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1e30, 0.0],)], "e array<float>")
    got = df.select(topk.scaled("e").alias("v")).first().v
    assert got == [128.0, -1.0, float(np.float32(1e30)) * 256, 0.0]


def test_bounds_leave_little_to_score():
    """With short rests most pairs are closed before they are scored."""
    rng = np.random.default_rng(0)
    c = np.floor(rng.normal(size=(4000, 32)) @ np.diag(1.5 ** -np.arange(32)) * 256)
    q = c[:50]
    turn = np.linalg.eigh(c.T @ c)[1][:, ::-1]
    reach = np.sort(q @ c.T, axis=1)[:, -6]
    work = topk.Search(q, c, turn, reach, 6)
    scored = []
    plain = work.scores
    work.scores = lambda i, j: scored.append(len(i)) or plain(i, j)
    work.run(np.arange(len(c)))
    assert sum(scored) < 0.05 * len(q) * len(c)


def test_blocks():
    assert topk.blocks_of([(9, 3), (8, 4), (7, 25), (5, 2), (1, 9)], 10) == [(9, 0, 1), (8, 0, 1), (7, 1, 3), (5, 4, 1), (1, 5, 1)]
    assert topk.blocks_of([], 10) == []
