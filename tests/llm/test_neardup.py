import os
import random
from collections import defaultdict

import numpy as np
import pytest

from tests_llm_shared import frame, texts_of
from wattline.llm import exact, mixing, neardup
from wattline.llm.components import components
from wattline.sources.sinks import stage


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def plain(rows, width, percent=80):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        words = t.encode().lower().split()
        runs = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}
        sets[2**63 - 1 if i is None else i].append(runs)
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            for a in sets[x]:
                for b in sets[y]:
                    if x < y and a and b and 100 * len(a & b) >= percent * len(a | b):
                        p, q = find(parent, x), find(parent, y)
                        parent[max(p, q)] = min(p, q)
    none = lambda i: None if i == 2**63 - 1 else i
    return sorted(((none(i), len(s), none(find(parent, i))) for i in sets for s in sets[i]), key=repr)


def got(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=repr)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(odd, width):
    assert got(neardup.near_duplicates(odd, width=width)) == plain(texts_of(), width)


def test_empty_table(none):
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.drop_near_copies(none).count() == 0


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed, copies, length):
    """A family of copies with more and more edits, copies of copies, and strangers."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    base = [f"b{i}" for i in range(length)]
    rows = []
    for _ in range(copies):
        rows.append(edited(rng, base, rng.randrange(0, length // 8)))
        if rng.random() < 0.3:
            rows.append(edited(rng, rows[rng.randrange(len(rows))], 2))
    for _ in range(30):
        rows.append(common + [f"s{rng.randrange(400)}" for _ in range(rng.randrange(0, 20))])
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("longest", [3, 64])
@pytest.mark.parametrize("length", [30, 90, 200])
def test_families_against_all_pairs(spark, monkeypatch, longest, length):
    monkeypatch.setattr(neardup, "LIST", longest)
    rows = corpus(length + longest, 50, length)
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    assert got(neardup.near_duplicates(df, width=2)) == plain(rows, 2)


def nested(seed, pairs, length):
    """Pairs of a text and its first or last 80 to 85 hundredths."""
    rng = random.Random(seed)
    rows = []
    for i in range(pairs):
        words = [f"n{i}x{j}" for j in range(length)]
        part = -(-length * (800 + i % 50) // 1000)
        rows += [words, words[:part] if rng.random() < 0.5 else words[-part:]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("width", [1, 2])
def test_beginnings_and_ends_against_all_pairs(spark, width):
    rows = nested(width, 60, 1000)
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    want = plain(rows, width)
    assert len({c for _, _, c in want}) < 70
    assert got(neardup.near_duplicates(df, width=width)) == want


def test_estimates_use_the_sketch_of_the_union(spark):
    rng = np.random.default_rng(4)
    sets, pairs = [], []
    for i in range(300):
        whole = np.unique(rng.integers(-(2**63), 2**63 - 1, 1000))
        sets += [(2 * i, whole[:64].tolist()), (2 * i + 1, np.sort(rng.permutation(whole)[:800])[:64].tolist())]
        pairs.append((2 * i, 2 * i + 1))
    left = neardup.alike(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(sets, "id long, sketch array<long>"), 80, 64
    )
    assert left.count() == len(pairs)


def test_one_document_of_each_group_stays(spark):
    rows = corpus(7, 30, 60)
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    kept = neardup.drop_near_copies(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in plain(rows, 5)}
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(9, 9)]
    parent = {x: x for pair in links for x in pair}
    for a, b in links:
        p, q = find(parent, a), find(parent, b)
        parent[max(p, q)] = min(p, q)
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {x: find(parent, x) for a, b in links if a != b for x in (a, b)}


def test_bitmap_has_every_id(spark):
    size, bits = neardup.bits_of(spark.range(0, 5000, 7))
    at = spark.range(5000).select("id", neardup.slot(size, "id").alias("at")).toPandas()
    inside = neardup.has(bits, at["at"].to_numpy())
    assert inside[at["id"] % 7 == 0].all() and inside.mean() < 0.3


def test_sets_have_one_value_per_distinct_run():
    one, two, three = neardup.shingle_sets(["a b a b c", "A\tB  a", "z"], 2)
    assert (len(one), len(two), len(three)) == (3, 2, 1)
    assert len(np.intersect1d(one, two)) == 2


def test_packed_values_come_back():
    values = np.sort(np.array([0, 1, 2**40 - 1, 2**40 - 7, 12345678901], np.int64))
    assert neardup.unpacked(neardup.packed(values)).tolist() == values.tolist()
    assert neardup.unpacked(neardup.packed(-values - 1)).tolist() == sorted(2**40 - 1 - values)
    assert len(neardup.unpacked(b"")) == 0


def test_pairs_at_the_similarity_share_a_band():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(400):
        whole = np.unique(rng.integers(-(2**63), 2**63 - 1, 100))
        sets += [whole, np.sort(rng.permutation(whole)[:80])]
    found = neardup.bands(sets, neardup.bands_for(80))
    again = found[0::2] == found[1::2]
    assert again.any(axis=1).all() and abs(again.mean() - 0.8**neardup.ROWS) < 0.02
    assert not neardup.bands([sets[0][:0]], 3).any()


def test_a_run_that_many_texts_hold_makes_no_long_list(spark):
    """Every text has some rare runs in common with 60 others, and nothing else."""
    rng = random.Random(11)
    rows = [(i, " ".join([f"g{i // 60}"] * 3 + [f"r{rng.randrange(10**9)}" for _ in range(60)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string")
    found = neardup.sketches(df, 2, neardup.K, 80)
    assert neardup.listed(found).count() < len(rows)


def test_sets_outside_are_listed_under_their_first_values(spark):
    """Crowds that share most values with a hub, as in lists of a common passage, and near copies among them."""
    rng = np.random.default_rng(13)
    passage, sets, component = rng.integers(0, 2**40, 60), [], []
    for group in range(150):
        own = rng.integers(0, 2**40, 40)
        for _ in range(2):
            few = rng.permutation(40)[: rng.integers(28, 41)]
            sets.append(np.unique(np.concatenate((passage if group % 3 else passage[:20], own[few]))))
            component.append(len(sets))
    for _ in range(200):
        sets.append(np.unique(np.concatenate((passage, rng.integers(0, 2**40, 5)))))
        component.append(0)
    rows = [(i, neardup.packed(x)) for i, x in enumerate(sets)]
    sets_df = spark.createDataFrame(rows, "id long, values binary")
    members = spark.createDataFrame([(i, c, c > 0) for i, c in enumerate(component)], "id long, component long, outside boolean")
    pairs = neardup.rare_first(members, sets_df, 80)
    links = {(r.a, r.b) for r in neardup.judged_sets(pairs, sets_df, 80).collect()}
    want = set()
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(np.intersect1d(x, sets[j]))
            if component[i] != component[j] and 100 * shared >= 80 * (len(x) + len(sets[j]) - shared):
                want.add((j, i))
    assert links == want and 100 < len(want)
    # The passage comes last, so the crowd's pairs are few, and a set makes a fifth of its size in rows.
    front = neardup.fronts(sets_df.join(members, "id"), 80, neardup.frequent(sets_df))
    assert pairs.count() < 1000 and front.count() <= sum(len(x) // 5 + 1 for x in sets)


def test_a_task_that_stores_rows_has_one_python_worker(spark, monkeypatch):
    plans = []

    def noted(df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, path)

    monkeypatch.setattr(neardup, "stage", noted)
    sets = spark.createDataFrame([(1, [1, 2]), (2, [1, 3])], "id long, sketch array<long>")
    neardup.alike(spark.createDataFrame([(1, 2)], "a long, b long"), sets, 80, 64).count()
    assert [p.count("MapInPandas") for p in plans] == [1]


@pytest.mark.parametrize("run", [neardup.drop_near_copies, mixing.repeat, exact.drop_exact_copies])
def test_stages_of_the_pipeline_leave_one_table(spark, monkeypatch, tmp_path, run):
    df = frame(spark, [(i, t, None, None, None) for i, t in corpus(7, 10, 20)])
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    rows = run(df)
    assert len(set(os.listdir(base)) - before) == 1 and rows.count() > 0
