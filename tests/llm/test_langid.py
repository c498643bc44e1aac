import numpy as np

from tests_llm_shared import ODD_ROWS, frame
from wattline.llm import langid

STEMS = {"xx": ["zug", "bahn", "hof", "keit"], "yy": ["tion", "eau", "que", "ment"], "zz": ["ado", "illo", "cion", "era"]}


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = list(STEMS)[i % 3]
        word = lambda: "".join(rng.choice(STEMS[lang], rng.integers(1, 4)))
        rows.append((i, " ".join(word() for _ in range(rng.integers(3, 60))), lang, "a", 0))
    return rows


def test_held_out_documents(spark):
    rows = corpus(1, 300)
    got = {r.doc_id: r for r in langid.languages(frame(spark, rows)).collect()}
    held = [r for r in rows if got[r[0]].held_out]
    assert len(held) > 40
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.97
    # The languages of the documents that are set aside change nothing.
    other = [(*r[:2], "qq" if got[r[0]].held_out else r[2], *r[3:]) for r in rows]
    again = {r.doc_id: r for r in langid.languages(frame(spark, other)).collect()}
    assert again == got


def test_odd_rows(odd, none):
    got = langid.languages(odd).collect()
    assert len(got) == len(ODD_ROWS)
    learned = {r[2] for r in ODD_ROWS if r[2]}
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 7)), r
        assert r.lang_pred in learned | {"und"}
    assert langid.languages(none).count() == 0
    unknown = odd.drop("lang").selectExpr("*", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.languages(unknown).collect()} == {"und"}


def test_narrow_margins_are_rejected():
    assert langid.choose(np.array([100.0, 300.0])) [0] == 0
    best, sure, narrow = langid.choose(np.array([500.0, 500.0, 900.0]))
    assert best == 0 and narrow and 0.4 < sure < 0.6
    assert not langid.choose(np.array([500.0, 700.0]))[2]
