import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from tests_llm_shared import frame, texts_of

from wattline.llm import bitsliced


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=20):
    """Scores of every document for every item by the formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in counted:
            score = 0
            m = 75 + 25 * sum(c.values()) * n_docs // total if total else 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, "?", "?") for r in rows], "item_id long, text string, score string, rank string")


def found(docs, items, **kinds):
    return sorted(map(tuple, bitsliced.search(docs, items, **kinds).collect()), key=repr)


ITEMS = [
    (1, "the quick BROWN fox"),
    (2, "Lazy lazy dog, near the bridge"),
    (2, "Lazy lazy dog, near the bridge"),  # a repeated item
    (3, None),
    (4, ""),
    (5, "..."),
    (6, "no such words anywhere"),
    (None, "umlauten äöüß café"),
    (7, "lorem ipsum \U0001f600"),
    (8, "x" * 30_000),
]


def test_odd_rows(spark, odd):
    assert found(odd, items_of(spark, ITEMS)) == brute([(i, t) for i, t in texts_of()], ITEMS)


@pytest.mark.parametrize("kinds", [{}, {"k": 3, "item_terms": 40}])
def test_skewed_corpus(spark, kinds, monkeypatch):
    """Many copies, ties, common and rare words, few and many occurrences, several passes."""
    monkeypatch.setattr(bitsliced, "BLOCK_DOCS", 64)
    if kinds:  # more terms than are sent to the tasks
        monkeypatch.setattr(bitsliced, "ITEM_TERMS", 50)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]

    def text(n):
        return " ".join(words[min(299, int(rng.expovariate(0.03)))] for _ in range(n))

    same = text(80)
    rows = [(i, same if i % 3 == 0 else text(rng.choice([0, 1, 5, 60, 400])), "a", "b", 0) for i in range(900)]
    items = [(i, text(rng.choice([1, 2, 8, 40]))) for i in range(30)] + [(77, same)]
    want = brute([(r[0], r[1]) for r in rows], items, kinds.get("k", 20))
    assert found(frame(spark, rows), items_of(spark, items), **kinds) == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs, items) == want


def test_empty_tables(spark, odd, none):
    assert found(none, items_of(spark, ITEMS)) == []
    assert found(odd, items_of(spark, [])) == []
    assert found(none, items_of(spark, [])) == []


def test_bounds_are_close_from_above(spark):
    """No score is above its bound, and few documents without a term look as if they held it."""
    rng = random.Random(1)
    docs = [Counter(f"t{int(rng.expovariate(0.01))}" .encode() for _ in range(rng.randint(1, 300))) for _ in range(640)]
    rows = bitsliced.signatures(docs, {})
    total = sum(sum(c.values()) for c in docs)
    df = Counter(t for c in docs for t in c)
    items = bitsliced.Items([(0, [b"t3", b"t50"], [1, 2]), (1, [b"t400"], [1])], df, len(docs), total)
    hashes = np.array([bitsliced.hash_of(t) for t in items.terms], np.uint64)
    loose = checked = 0
    for bits in {b for b, _ in rows}:
        own = [c for c, (b, _) in zip(docs, rows) if b == bits]
        of_docs = np.frombuffer(b"".join(s for b, s in rows if b == bits), np.uint8).reshape(len(own), -1)
        by_bit = np.packbits(np.pad(np.unpackbits(of_docs, axis=1).T, ((0, 0), (0, -len(own) % 8))), axis=1)
        lengths = np.array([sum(c.values()) for c in own])

        class block:
            pass

        block.bits, block.slices, block.lengths = bits, by_bit.tobytes(), lengths.tobytes()
        for iid, bound in bitsliced.upper_bounds(block, items, hashes):
            for c, b, n in zip(own, bound, lengths.tolist()):
                numbered = {items.terms.index(t): x for t, x in c.items() if t in items.terms}
                score = items.score(iid, numbered, bitsliced.length_factor(n, len(docs), total))
                assert b >= score
                checked += 1
                loose += b > 0 and score == 0
    assert checked > 1000 and loose < 0.05 * checked
