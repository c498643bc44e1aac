import hashlib
import random
from zlib import crc32

import numpy as np
import pytest
from tests_llm_shared import frame, texts_of

from wattline.llm import periodic


def plain_runs(words, least=12):
    """All runs by trying every period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                stretch = words[i : j + q]
                if not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_lyndon(s):
    """Longest Lyndon word at each place: the longest beginning that is below all its ends."""
    out = []
    for i in range(len(s)):
        out.append(max(k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[i + d : i + k] for d in range(1, k))))
    return out


def test_lyndon_arrays():
    rng = random.Random(5)
    for _ in range(300):
        s = [rng.randint(1, rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 30))]
        s = [sorted(set(s)).index(x) + 1 for x in s]
        got = periodic.lyndon_lengths(np.array([0, *s, 0]))[1:-1]
        assert got.tolist() == plain_lyndon(s), s


def sequences():
    rng = random.Random(9)
    for k in range(250):
        s = []
        while len(s) < rng.randint(0, 90):
            part = [rng.randint(0, rng.choice([1, 2, 30])) for _ in range(rng.randint(1, 9))]
            s += part * rng.randint(1, 6)
        yield s
    fib = ([0], [0, 1])
    for _ in range(8):
        fib = (fib[1], fib[1] + fib[0])
    yield fib[1]
    yield [7] * 200
    yield [7] * 100 + [8] + [7] * 100


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_against_every_period(least):
    """Also with ``least`` so small that windows are single words or two."""
    many = list(sequences())
    found = periodic.runs_of_sequences([np.array(s, np.int64) for s in many], least)
    for s, runs in zip(many, found):
        assert sorted(map(tuple, runs.tolist()), key=lambda r: (r[0], r[2])) == plain_runs(s, least), s


def plain_rows(rows):
    out = []
    for doc_id, text in rows:
        words = text.encode().split()
        n = len(words)
        h = crc32(str(doc_id).encode()) if doc_id is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        drop = {i for s, m, q in runs for i in range(s + q, s + m)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out.append(
            (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
             hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        )
    return sorted(out, key=repr)


def digests(docs):
    got = periodic.digests(periodic.periodic_runs(docs, periodic.repeated_tail)).collect()
    return sorted(map(tuple, got), key=repr)


def test_odd_rows(odd):
    got = digests(odd.where("doc_id is null or doc_id <> 9"))
    assert got == plain_rows([r for r in texts_of() if r[0] != 9])


def test_documents_against_plain_code(spark):
    """The query's rows on real documents with planted repetition, many of them of one word's period."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    rng = random.Random(2)
    more = [(1000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))), "x", "y", 1) for i in range(200)]
    own = frame(spark, more)
    assert digests(own) == plain_rows([(r[0], r[1]) for r in more])
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = digests(docs)
    assert got == plain_rows(rows)
    assert sum(r[1] > 0 for r in got) > 5


def test_empty_table(none):
    assert digests(none) == []


def test_collapsed_text(spark):
    text = "so it goes " + "on and  on\n" * 8 + "and ends"
    row = periodic.periodic_runs(frame(spark, [(1, text, "en", "a", 1)])).first()
    assert row.runs[0].asDict() == {"start": 3, "length": 24, "period": 3}
    assert row.collapsed == "so it goes on and on and ends"
