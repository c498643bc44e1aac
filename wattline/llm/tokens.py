"""Token ids by a public tokenizer, with word pieces that recur encoded once per worker.

The vocabulary's tokenizer lower-cases, cuts a text into pieces (letters, single digits, runs
of signs) and encodes each piece by itself.  Texts in plain Latin letters are cut here, many at a
time as Arrow arrays: into words, the distinct words into pieces, and only pieces that a worker
does not remember go through the tokenizer.  Other texts are cut at white space, and their words
go through the tokenizer as it is.
"""

from __future__ import annotations

import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wattline.llm.common import give_back

# Bytes that words which need the whole tokenizer may take in a worker's memory, with ``ENTRY`` bytes
# for each besides its text and ids.  Long ones are not remembered.
REMEMBERED, ENTRY, LONG = 48_000_000, 200, 64
# Remembered pieces take a sixth of that: they are packed closely, and each batch indexes them anew.
SHARE = 6
# Pieces that the tokenizer gets at once.
AT_ONCE = 1_000


class Memory:
    """Ids by text in two generations: what is used stays, what is not goes with the older one."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def turn(self) -> None:
        """Forget the older generation once the younger one has its half of the bytes."""
        if 2 * self.size > REMEMBERED:
            self.young, self.old, self.size = {}, self.young, 0

    def put(self, text: str, ids: bytes) -> None:
        self.young[text] = ids
        self.size += len(text) + len(ids) + ENTRY

    def get(self, text: str) -> bytes | None:
        found = self.young.get(text)
        if found is None:
            found = self.old.get(text)
            if found is not None:
                self.put(text, found)
        return found


class Pieces:
    """Ids of pieces, remembered in Arrow arrays, which take little more than the letters and ids."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        """All but the empty piece, which has no ids."""
        self.texts = pa.array([""], pa.string())
        self.ids = pa.array([[]], pa.list_(pa.uint32()))
        self.again = np.ones(1, bool)

    def turn(self) -> None:
        """Forget what was not seen again since the last turn, or all if that is too little, once the bytes are taken.

        Most pieces are seen once in a whole table.
        """
        if SHARE * (self.texts.nbytes + self.ids.nbytes) > REMEMBERED:
            self.again[0] = True
            kept = pa.array(self.again)
            self.texts, self.ids = self.texts.filter(kept), self.ids.filter(kept)
            self.again = np.zeros(len(self.texts), bool)
            if 2 * SHARE * (self.texts.nbytes + self.ids.nbytes) > REMEMBERED:
                self.forget()

    def of(self, pieces: pa.StringArray) -> pa.ListArray:
        """Ids of distinct pieces that are as the split pattern leaves them."""
        self.turn()
        at = pc.index_in(pieces, self.texts).fill_null(-1).to_numpy().copy()
        is_new = at < 0
        self.again[at[~is_new]] = True
        new = pieces.filter(pa.array(is_new))
        if len(new):
            at[is_new] = np.arange(len(self.texts), len(self.texts) + len(new))
            found = [self._encoded(new.slice(i, AT_ONCE)) for i in range(0, len(new), AT_ONCE)]
            self.texts, self.ids = pa.concat_arrays([self.texts, new]), pa.concat_arrays([self.ids, *found])
            self.again = np.concatenate((self.again, np.zeros(len(new), bool)))
        return self.ids.take(pa.array(at))

    def _encoded(self, pieces: pa.StringArray) -> pa.ListArray:
        found = self.tokenizer.encode(" ".join(pieces.to_pylist()), add_special_tokens=False)
        ends = np.searchsorted(np.array(found.word_ids), np.arange(len(pieces) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.ids, pa.uint32()))


def joined(lists: pa.ListArray, at: pa.Array, ends: pa.Array) -> pa.ListArray:
    """The lists numbered ``at``, those between two ``ends`` joined to one."""
    found = lists.take(at)
    return pa.ListArray.from_arrays(found.offsets.take(ends), found.values)


# The split pattern of the vocabulary, for lower-case plain Latin text.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"
# Texts and words that this pattern is right for: no other letters or digits, nothing to
# compose, no special tokens.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
SPECIAL = "<|"
# Python splits at these, the tokenizer does not.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def file_of(name: str) -> str:
    """Path of a tokenizer file: a path, or the name of one of the public ones."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers in bytes."""

    def __init__(self, name: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        path = file_of(name)
        self.full = Tokenizer.from_file(path)
        split = Tokenizer(self.full.model)  # the vocabulary is held once
        split.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        self.parts, self.others = Pieces(split), Memory()

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def plain(self, texts: list[str]) -> list[bytes]:
        """Texts that ``PLAIN`` holds for."""
        words = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.string())))
        word = words.values.dictionary_encode()
        more = pc.invert(pc.utf8_is_alpha(word.dictionary))  # than one piece
        cut = pc.replace_substring_regex(word.dictionary.filter(more), PARTS, r"\0 ")
        pieces = pc.ascii_split_whitespace(pc.replace_with_mask(word.dictionary, more, cut))
        piece = pieces.values.dictionary_encode()
        of_words = joined(self.parts.of(piece.dictionary), piece.indices, pieces.offsets)
        ids = joined(of_words, word.indices, words.offsets)
        raw, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy().tolist()
        return [raw[i:j].tobytes() for i, j in zip(ends, ends[1:])]

    def word(self, word: str) -> bytes:
        found = self.others.get(word)
        if found is None:
            found = self.whole(word)
            if len(word) <= LONG:
                self.others.turn()
                self.others.put(word, found)
        return found

    def mixed(self, text: str) -> bytes:
        """A text that is not plain, word by word."""
        if any(c in text for c in ODD):
            return self.whole(text)
        return b"".join(map(self.word, text.split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [PLAIN.fullmatch(t) is not None and SPECIAL not in t for t in texts]
        ids = iter(self.plain([t for t, is_plain in zip(texts, plain) if is_plain]))
        return [next(ids) if is_plain else self.mixed(t) for t, is_plain in zip(texts, plain)]


def encoder(name: str) -> Encoder:
    """The encoder of this Python worker, kept between its tasks."""
    kept = sys.modules.setdefault("_wattline_worker", types.ModuleType("_wattline_worker"))
    key = "encoder " + name
    if key not in vars(kept):
        vars(kept)[key] = Encoder(name)
        give_back()  # loading takes as much again
    return vars(kept)[key]


def forget() -> None:
    """Let go of this worker's encoders; other operators' tasks call it, as they may need the memory."""
    sys.modules.pop("_wattline_worker", None)
