import numpy as np

from tests_llm_shared import ODD_ROWS, frame
from wattline.llm import licenses


def plain_align(text, template):
    """Best local alignment score, with the whole table."""
    score = np.zeros((len(text) + 1, len(template) + 1), int)
    for i in range(1, len(text) + 1):
        for j in range(1, len(template) + 1):
            same = licenses.MATCH if text[i - 1] == template[j - 1] else licenses.MISMATCH
            score[i, j] = max(0, score[i - 1, j - 1] + same, score[i - 1, j] + licenses.GAP, score[i, j - 1] + licenses.GAP)
    return score.max()


def test_alignment_against_the_whole_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        template = rng.integers(0, 9, rng.integers(3, 15)).astype(np.uint64)
        text = rng.integers(0, 9, rng.integers(1, 25)).astype(np.uint64)
        score, matched, a, b, c, d = licenses.align(text, template, 0, band=40)
        assert score == plain_align(text, template)
        if score:
            assert plain_align(text[a:b], template[c:d]) == score and matched <= min(b - a, d - c)


def test_winnowing_keeps_one_in_every_window():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 50, 400).astype(np.uint64)
    owner = np.sort(rng.integers(0, 30, 400))
    kept = set(licenses.winnow(hashes, owner, 4).tolist())
    for i in range(400):
        window = [j for j in range(i, min(i + 4, 400)) if owner[j] == owner[i]]
        if len(window) == 4 or (i == 0 or owner[i - 1] != owner[i]):
            assert kept & set(window)


def test_every_notice_is_found_with_its_span(spark):
    filler = "Some ordinary words of a document that go on and on"
    rows, want = [], set()
    for i, (name, notice) in enumerate(licenses.TEMPLATES.items()):
        text = f"{filler}.\n{notice.upper()}\n{filler} {notice}"
        rows.append((i, text, "en", "a", 0))
        core = notice.rstrip(".)")
        for begin in (len(filler) + 2, len(text) - len(notice)):
            want.add((i, name, begin, begin + len(core)))
    got = licenses.scan(frame(spark, rows)).collect()
    found = {(r.doc_id, r.template, r.span_start, r.span_end) for r in got}
    assert want <= found
    # The long header contains the short one; nothing else is found on the side.
    assert {(a, b) for a, b, _, _ in found - want} <= {(1, "Apache-2.0")}
    assert all(r.coverage == 1 for r in got)


def test_changed_words_lower_the_coverage(spark):
    text = "this work is now licensed under the gnu general public licence version 3"
    got = licenses.scan(frame(spark, [(1, text, "en", "a", 0)])).collect()
    assert [(r.template, r.matched) for r in got] == [("GPL-3.0", 11)]
    assert got[0].span_start == 0 and got[0].span_end == len(text)


def plain_ends(text, template, need):
    """(score, matched words, begin) of the best alignment that ends at each word, with the whole table."""
    cells, best = {}, {}
    for j, word in enumerate(template):
        for i, other in enumerate(text):
            score, matched, begin = cells.get((i - 1, j - 1), (0, 0, i))
            same = word == other
            ways = [(score + (licenses.MATCH if same else licenses.MISMATCH), matched + same, begin)]
            for score, matched, begin in filter(None, (cells.get((i, j - 1)), cells.get((i - 1, j)))):
                ways.append((score + licenses.GAP, matched, begin))
            if max(ways)[0] > 0:
                cells[i, j] = max(ways)
                if cells[i, j][1] >= need:
                    best[i] = max(best.get(i, (0, 0, 0)), cells[i, j])
    return best


def plain_best(text, template, need):
    """(begin, end, matched words, score) of the best alignment in a text, the first of equals, or None."""
    best = plain_ends(text, template, need)
    if not best:
        return None
    end = min(best, key=lambda i: (-best[i][0], -best[i][1], i))
    score, matched, begin = best[end]
    return begin, end + 1, matched, score


def loose_texts(seed, count):
    """Texts of notices with words changed, left out and put in, close together."""
    rng = np.random.default_rng(seed)
    notices = [n.split() for n in licenses.TEMPLATES.values()]
    common = "the of a this work is license under and all rights are other words".split()
    for _ in range(count):
        words = []
        for _ in range(rng.integers(1, 5)):
            for w in notices[rng.integers(len(notices))]:
                dice = rng.random()
                words += [] if dice < 0.06 else [rng.choice(common)] if dice < 0.12 else [w]
                if rng.random() < 0.08:
                    words.append(rng.choice(common))
            words += rng.choice(common, rng.integers(0, 5)).tolist()
        yield " ".join(words)


def found_in(texts):
    return licenses.matches(texts, *licenses.compiled(licenses.TEMPLATES, licenses.COVERAGE))


def hashes_of(text):
    hashes, _, begin, end = licenses.words_of([text])
    return hashes.tolist(), begin.tolist(), end.tolist()


def test_best_match_against_unrestricted_alignment():
    texts = list(loose_texts(3, 60))
    got = {}
    for doc, name, begin, end, _, matched, score in found_in(texts):
        got[doc, name] = max(got.get((doc, name), (0, 0, 0)), (score, matched, -begin, -end))
    want = {}
    for i, text in enumerate(texts):
        words, begin, end = hashes_of(text)
        for name, notice in licenses.TEMPLATES.items():
            template = hashes_of(notice)[0]
            best = plain_best(words, template, licenses.COVERAGE * len(template) - 1e-9)
            if best:
                want[i, name] = (best[3], best[2], -begin[best[0]], -end[best[1] - 1])
    assert len(want) > 80 and got == want


def test_loose_forms_of_short_notices(spark):
    texts = [
        ("MIT", "It is released under an MIT License"),
        ("MIT", "Released under the terms of the MIT License"),
        ("rights-reserved", "All rights are reserved"),
        ("CC-BY-NC-4.0", "Licensed under CC xx NC 4.0."),
    ]
    got = licenses.scan(frame(spark, [(i, t, "en", "a", 0) for i, (_, t) in enumerate(texts)])).collect()
    assert sorted((r.doc_id, r.template) for r in got) == [(i, n) for i, (n, _) in enumerate(texts)]


def plain_matches(text, template, need, at=0):
    """The best match and those before and after it, as long as there are any."""
    best = plain_best(text, template, need)
    if best is None:
        return []
    begin, end, matched, score = best
    return (
        [(at + begin, at + end, matched, score)]
        + plain_matches(text[:begin], template, need, at)
        + plain_matches(text[end:], template, need, at + end)
    )


def test_all_matches_against_unrestricted_alignment():
    rng = np.random.default_rng(6)
    texts = list(loose_texts(4, 40))
    for notice in licenses.TEMPLATES.values():
        stack = [w for _ in range(5) for w in notice.split() if rng.random() > 0.04]
        texts += [" ".join(stack), f"{notice} " * 3]
    want = []
    for i, text in enumerate(texts):
        words, begin, end = hashes_of(text)
        for name, notice in licenses.TEMPLATES.items():
            template = hashes_of(notice)[0]
            for a, b, matched, score in plain_matches(words, template, licenses.COVERAGE * len(template) - 1e-9):
                want.append((i, name, begin[a], end[b - 1], matched / len(template), matched, score))
    assert len(want) > 150 and sorted(found_in(texts)) == sorted(want)


def test_notices_one_after_the_other(spark):
    texts = ["Released under the MIT License. " * 2, "All rights reserved. " * 4, "Licensed under CC BY-NC 4.0.\n" * 2]
    got = licenses.scan(frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])).collect()
    assert [sum(r.doc_id == i for r in got) for i in range(3)] == [2, 4, 2]
    assert len({(r.doc_id, r.span_start) for r in got}) == 8


def test_odd_rows(odd, none):
    assert licenses.scan(odd).count() == 0
    assert licenses.scan(none).count() == 0
    two = odd.filter("doc_id = 2").selectExpr("doc_id", "'All rights reserved.' as text")
    assert licenses.scan(two).count() == sum(r[0] == 2 for r in ODD_ROWS)
