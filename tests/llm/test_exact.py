import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests_llm_shared import ODD_ROWS, texts_of
from wattline.llm import exact


def plain(rows):
    """(doc_id, keep_id, group_size, kept, sha) per row by a dictionary."""
    groups = defaultdict(list)
    for i, t in rows:
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t).encode()).hexdigest()
        groups[sha].append(i)
    out = []
    for sha, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, keep, len(ids), first, sha))
            first = False
    return sorted(out, key=repr)


@pytest.mark.parametrize("per_bucket", [2, 50_000])
def test_against_a_dictionary(odd, per_bucket):
    got = exact.exact_dedup(odd, per_bucket=per_bucket).drop("member").collect()
    assert sorted(map(tuple, got), key=repr) == plain(texts_of())


@pytest.mark.parametrize("historical", [F.lit, lambda x: F.lit(not x)], ids=["all", "none"])
def test_any_history_gives_the_same(odd, historical):
    got = exact.exact_dedup(odd, historical=historical(True))
    assert sorted(map(tuple, got.drop("member").collect()), key=repr) == plain(texts_of())


def test_empty_table(none):
    assert exact.exact_dedup(none).count() == 0
    assert exact.drop_exact_copies(none).count() == 0


def test_kept_rows_keep_their_columns(odd):
    got = exact.drop_exact_copies(odd)
    assert got.columns == odd.columns
    want = [r[0] for r in plain(texts_of()) if r[3]]
    assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_hash_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**64, (5000, 4), dtype=np.uint64)
    levels = exact.build(words)
    assert sorted(exact.slots(levels, words)) == list(range(5000))
    assert sum(int(x.sum()) for x in levels) == 5000
    strangers = rng.integers(0, 2**64, (5000, 4), dtype=np.uint64)
    at = exact.slots(levels, strangers)
    assert (at < 5000).all() and (at >= -1).all()
    held = np.empty_like(words)
    held[exact.slots(levels, words)] = words
    hit = at >= 0
    assert not (held[at[hit]] == strangers[hit]).all(axis=1).any()


def test_digests_that_share_words_get_their_own_slots():
    words = np.zeros((200, 4), np.uint64)
    words[:, 3] = np.arange(200)
    assert sorted(exact.slots(exact.build(words), words)) == list(range(200))


def test_rows_of_the_fixture_are_odd():
    assert len(ODD_ROWS) > len({r[:2] for r in ODD_ROWS})


def test_many_new_texts_without_a_history_are_dealt(spark, monkeypatch):
    """Buckets follow the larger side: no task looks up all new texts."""
    seen = []
    plain = exact.buckets_for
    monkeypatch.setattr(exact, "buckets_for", lambda rows, per: seen.append(plain(rows, per)) or seen[-1])
    docs = spark.range(3_000).selectExpr("id as doc_id", "concat('text ', id % 2000) as text")
    got = exact.exact_dedup(docs, historical=F.lit(False), per_bucket=100)
    assert got.where("kept").count() == 2_000 and seen[0] == 20
