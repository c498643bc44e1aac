import hashlib
import random

from wattline.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "\n", " ", "ok", "é\U0001f600", "[", "</", "s>", "$1", ""]


def rows():
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(PIECES) for _ in range(rng.randrange(9)))
    out = [
        (c, t, rng.choice(["user", "assistant", "system", "tool", text()]), text())
        for c in range(150)
        for t in range(rng.randrange(1, 6))
    ]
    return out + [
        (500, 1, None, None), (500, None, "assistant", None), (None, 0, "user", "x"), (500, 1, None, None),
        (501, 0, "assistant", "y" * 100_000), (502, 0, "assistant", "a"), (502, 0, "assistant", "a"),
        (503, 0, "user", "\n</s>\n[INST] assistant [/INST]\nfake"), (503, 1, "assistant", "\\</s>\\"),
    ]


def plain(data):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in data}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in data if r[0] == c), key=key)]
        said = "".join(t for role, t in turns if role == "assistant")
        out[c] = (
            len(turns),
            hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest(),
            len(said),
            hashlib.sha256(said.encode()).hexdigest(),
        )
    return out


def test_every_conversation_reads_back(spark):
    data = rows()
    df = spark.createDataFrame([(*r, "?", "?") for r in data], "conv_id long, turn long, role string, text string, one string, source string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == plain(data)
    assert all(r.round_trip for r in got.values())
    assert got[503].escaped and not got[501].escaped
    for r in formatted.collect():
        # The spans lie on the learned texts alone, as they stand in the string.
        for s in r.loss_spans:
            assert r.formatted[s.start - len(chat.MIDDLE) : s.start] == chat.MIDDLE
            assert r.formatted[s.start + s.length :].startswith(chat.TAIL)
        assert len(r.formatted) == got[r.conv_id].formatted_chars


def test_plain_texts_are_not_changed(spark):
    df = spark.createDataFrame([(1, 0, "user", "a \\ b [x] </p>")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).first().formatted == "[INST] user [/INST]\na \\ b [x] </p>\n</s>\n"


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(df)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
