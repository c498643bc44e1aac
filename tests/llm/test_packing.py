import sys
import zlib

import numpy as np
import pandas as pd
import pytest

from tests_llm_shared import texts_of
from wattline.llm import packing
from wattline.llm.tokens import Encoder, file_of

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(file_of(packing.TOKENIZER))


TEXTS = [t for _, t in texts_of()] + [
    "Don't I'LL we've '' 'sam it's!'s", "Straße ÀÉÎ ñandú œuvre ’quoted’", "a b c d\x85e", "x\x1cy \x1f z",
    "<|startoftext|>hi<|endoftext|> <|", "１２3 ²½ 日本語 ελληνικά Σίσυφος ΣΑΣ", "éà İstanbul", "a1b22c333", "\t\r\x0b",
]


def test_ids_are_the_tokenizers(tokenizer):
    own = Encoder(packing.TOKENIZER)
    for _ in range(2):  # the second time from memory
        for text, raw in zip(TEXTS, own.encode(TEXTS), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_forgetting_changes_nothing(monkeypatch, tokenizer):
    monkeypatch.setattr("wattline.llm.tokens.REMEMBERED", 3)
    own = Encoder(packing.TOKENIZER)
    for text in TEXTS:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_remembered_pieces_are_small_and_those_seen_once_go_first(monkeypatch):
    monkeypatch.setattr("wattline.llm.tokens.REMEMBERED", 1_500_000)
    own = Encoder(packing.TOKENIZER)
    often = " ".join(f"often{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    letters = str.maketrans("0123456789", "abcdefghij")
    for turn in range(4):
        once = " ".join(str(10**6 * (turn + 1) + i) for i in range(5_000)).translate(letters)
        own.encode([often + " " + once])
        parts = own.parts
        assert parts.texts.nbytes + parts.ids.nbytes < 60 * len(parts.texts)
    assert {"oftenaa", "oftenvd"} <= set(parts.texts.to_pylist()) and len(parts.texts) < 11_000


def test_the_tokenizer_gets_each_piece_of_a_batch_once(monkeypatch):
    own = Encoder(packing.TOKENIZER)
    given = []
    tokenizer = own.parts.tokenizer

    class Counting:
        def encode(self, text, **options):
            given.extend(text.split())
            return tokenizer.encode(text, **options)

    own.parts.tokenizer = Counting()
    own.encode(["Good, better, good. ", " GOOD 'good' better"] * 50)
    own.encode(["better good"])
    assert sorted(given) == sorted({"good", "better", ",", ".", "'"})


@pytest.mark.parametrize("options", [{}, {"length": 64, "sequences": 3}, {"length": 32, "sequences": 2, "documents": 3, "cost": 700.0, "rule": "dot"}])
def test_pieces_and_sequences(odd, tokenizer, options):
    length = options.get("length", 2048)
    cost = options.get("cost", length**2)
    cut = min(length, int(cost**0.5))
    got = packing.pack(odd, **options).toPandas()
    want = []
    for i, t in texts_of():
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for n, at in enumerate(range(0, len(ids), cut)):
            part = ids[at : at + cut]
            want.append((i, n, at, len(part), zlib.crc32(part.tobytes())))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = [tuple(None if x != x else int(x) for x in r) for r in got[columns].to_numpy(float).tolist()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1].tolist()]
        assert s["length"].sum() <= length
        assert len(s) <= (options.get("documents") or length)
        assert (s["length"] ** 2).sum() <= cost


def test_empty_table(none):
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 200, 500))[::-1]
    bins = packing.best_fit(lengths, 256, 6, 45_000, (1, 1, 1), rule)
    assert np.bincount(bins, lengths).max() <= 256 and np.bincount(bins).max() <= 6
    assert np.bincount(bins, lengths.astype(float) ** 2).max() <= 45_000


def test_best_fit_takes_the_fullest_sequence_that_fits():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1]
    left, want = [], []
    for n in lengths:
        fits = [i for i, r in enumerate(left) if r >= n]
        at = min(fits, key=lambda i: left[i]) if fits else len(left)
        if not fits:
            left.append(100)
        left[at] -= n
        want.append(at)
    assert len(left) == packing.best_fit(lengths, 100, 100, 1e9, (1, 0, 0), "norm").max() + 1


def test_a_piece_beyond_the_capacities_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit(np.array([10]), 100, 10, 50, (1, 1, 1), "norm")


class Captured:
    """Stands for a table; hands out the function that tasks would run."""

    def mapInPandas(self, run, schema):  # noqa: N802
        return run


def test_waiting_workers_hold_no_encoder(monkeypatch, tokenizer):
    calls = []
    monkeypatch.setattr("wattline.llm.common.give_back", lambda: calls.append(1))
    rows = pd.DataFrame({"doc_id": [1, 2], "text": ["a b", ""]})
    found = {}
    for keep in (True, False):
        task = packing.cut(Captured(), packing.TOKENIZER, 64, keep)
        found[keep] = pd.concat(task(iter([rows])))
        assert ("_wattline_worker" in sys.modules) == keep
    assert found[True].equals(found[False]) and len(calls) == 2
