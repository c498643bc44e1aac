"""License texts in documents: stretches that share enough words, then local alignment.

Templates are short license notices.  Every word of a template scores in a document, every
other word costs, as in the alignment: where this running score stays above zero is a
stretch.  An alignment's own score is never above it, so each lies within one stretch, and
stretches that hold fewer of the template's words than the wanted coverage have none.

The rest is aligned with the template word by word, without a band, all stretches of a
template at once; the alignment gives the matched part of the template and its span in the
document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import chunks
from wattline.llm.textstats import DIGIT, LETTER, Texts, span_hashes

# Words by which ``align`` may leave its diagonal, on either side.
BAND = 8
MATCH, MISMATCH, GAP = 2, -1, -1
# Share of a template's words that must be matched.
COVERAGE = 0.8
CHARS = 1_000_000

# Short forms in which licenses are named or granted.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved.",
}


def words_of(texts: list[str]):
    """Hash, text number, begin and end (within its text) of each word: letters and digits."""
    t = Texts(texts)
    begin, end = t.runs((t.kind & (LETTER | DIGIT)) > 0)
    owner = t.owner(begin)
    return span_hashes(t.lower, begin, end), owner, begin - t.starts[owner], end - t.starts[owner]


def winnow(hashes: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Indices of the smallest hash (the last one of equals) in every window of a text.

    Texts with fewer hashes than ``window`` keep their smallest.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    keep = np.zeros(n, bool)
    best = np.arange(n)
    for i in range(1, window):
        other = np.minimum(np.arange(n) + i, n - 1)
        better = (owner[other] == owner) & (hashes[other] <= hashes[best])
        best = np.where(better, other, best)
    ends = np.minimum(np.arange(n) + window - 1, n - 1)
    whole = (owner[ends] == owner) & (np.arange(n) + window <= n)
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    keep[best[whole | first]] = True
    return np.flatnonzero(keep)


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND):
    """Best local alignment with places (i, j) of text and template, |i - j - shift| <= band.

    Returns score, matched words, and [begin, end) in the text and in the template; of equal
    scores the first one.  Rows run along the template, a band of the text at a time.
    """
    wide = 2 * band + 1
    score = np.zeros(wide + 2, np.int64)
    come = [None] * (wide + 2)
    best = (0, 0, 0, 0, 0, 0)
    for j in range(len(template)):
        now, here = np.zeros(wide + 2, np.int64), [None] * (wide + 2)
        for d in range(1, wide + 1):
            i = j + shift + d - 1 - band
            if not 0 <= i < len(text):
                continue
            same = text[i] == template[j]
            # Along the band: the diagonal keeps d, a gap in the text moves it by one.
            diagonal = score[d] + (MATCH if same else MISMATCH)
            up, side = score[d + 1] + GAP, now[d - 1] + GAP
            top = max(diagonal, up, side, 0)
            if top == 0:
                continue
            if top == diagonal:
                begin_i, begin_j, matched = come[d] if score[d] > 0 else (i, j, 0)
                here[d] = (begin_i, begin_j, matched + int(same))
            elif top == up:
                here[d] = come[d + 1]
            else:
                here[d] = here[d - 1]
            now[d] = top
            if top > best[0]:
                begin_i, begin_j, matched = here[d]
                best = (int(top), matched, begin_i, i + 1, begin_j, j + 1)
        score, come = now, here
    return best


# A cell of the alignment is one number: score, matched words and the place it began.
ONE, WORD = 1 << 46, 1 << 30
PLACE = WORD - 1


class Template:
    """A template's words as codes of ``vocabulary``, and how many must be matched."""

    def __init__(self, name: str, words: np.ndarray, vocabulary: np.ndarray, coverage: float):
        self.name = name
        self.codes = np.searchsorted(vocabulary, words)
        self.count = np.bincount(self.codes, minlength=len(vocabulary) + 1)
        self.need = max(1, int(np.ceil(coverage * len(words) - 1e-9)))


def compiled(templates: dict[str, str], coverage: float):
    """The sorted hashes of all words of the templates, and a ``Template`` each."""
    hashes, owner, *_ = words_of(list(templates.values()))
    vocabulary = np.unique(hashes)
    found = [Template(name, hashes[owner == i], vocabulary, coverage) for i, name in enumerate(templates)]
    return vocabulary, [t for t in found if len(t.codes)]


def stretches(codes: np.ndarray, owner: np.ndarray, template: Template):
    """Begins and ends of the stretches of words that can hold a match, each within one text."""
    hit = template.count[codes] > 0
    if hit.sum() < template.need:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # One place more before each text and at the end, with a drop below all that was before.
    at = np.arange(len(codes)) + owner + 1
    step = np.full(len(codes) + int(owner[-1]) + 2, -MATCH * len(codes) - 1, np.int64)
    step[at] = np.where(hit, MATCH, -1)
    total = np.cumsum(step)
    above = (total > np.minimum.accumulate(total))[at]
    new = np.ones(len(codes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | ~above[:-1]
    begin = np.flatnonzero(above & new)
    last = np.ones(len(codes), bool)
    last[:-1] = new[1:] | ~above[1:]
    return enough(codes, begin, np.flatnonzero(above & last) + 1, template)


def enough(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, template: Template):
    """Of the stretches those that share the needed number of words with the template."""
    before = np.concatenate(([0], np.cumsum(template.count[codes] > 0)))
    some = before[end] - before[begin] >= template.need
    begin, end = begin[some], end[some]
    if not len(begin):
        return begin, end
    at, which = spread(begin, end)
    pairs, n = np.unique(which * len(template.count) + codes[at], return_counts=True)
    shared = np.minimum(n, template.count[pairs % len(template.count)])
    some = np.bincount(pairs // len(template.count), shared, len(begin)) >= template.need
    return begin[some], end[some]


def spread(begin: np.ndarray, end: np.ndarray):
    """All places in the stretches, and the number of the stretch of each."""
    size = end - begin
    which = np.repeat(np.arange(len(begin)), size)
    return np.arange(len(which)) + np.repeat(begin - (np.cumsum(size) - size), size), which


def best_ends(text: np.ndarray, template: Template) -> np.ndarray:
    """The best cell that ends at each word and matches enough words, 0 where there is none.

    Rows run along the template, all of the text at a time.  Of equal scores the one with
    more matched words is best, then the one that begins last.
    """
    n = len(text)
    fresh = np.arange(n)
    row, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    gap = -GAP * ONE
    for code in template.codes:
        come = fresh.copy()
        come[1:] = np.where(row[:-1] > 0, row[:-1], come[1:])
        row = np.maximum(come + np.where(text == code, MATCH * ONE + WORD, MISMATCH * ONE), row - gap)
        row[row < ONE] = 0
        # Words of the text left out: 1, then 2, 4, ... more, up to what a score can pay for.
        step = 1
        while step <= MATCH * len(template.codes):
            row[step:] = np.maximum(row[step:], row[:-step] - step * gap)
            step *= 2
        row[row < ONE] = 0
        best = np.maximum(best, np.where((row & (ONE - 1)) // WORD >= template.need, row, 0))
    return best


def best_matches(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, template: Template):
    """(begin, end, matched words, score) of matches in the stretches, none of which overlap.

    Each round takes the best matches of each stretch; what lies before, between and after
    them is a stretch of the next round.
    """
    out = []
    while len(begin):
        at, which = spread(begin, end)
        # Between stretches so many words that no score survives them.
        place = np.arange(len(at)) + which * (MATCH * len(template.codes) + 1)
        text = np.full(place[-1] + 1, -1, np.int64)
        text[place] = codes[at]
        best = best_ends(text, template)[place]
        value = best // WORD  # score and matched words
        top = np.maximum.reduceat(value, np.searchsorted(which, np.arange(len(begin))))
        next_begin, next_end, last = [], [], -1
        for i in np.flatnonzero((value > 0) & (value == top[which])).tolist():
            first = int(np.searchsorted(place, best[i] & PLACE))
            mine = which[i]
            if last < 0 or which[last] != mine:
                if last >= 0:
                    next_begin.append(int(at[last]) + 1)
                    next_end.append(int(end[which[last]]))
                free = int(begin[mine])
            else:
                free = int(at[last]) + 1
            if at[first] < free:
                continue
            out.append((int(at[first]), int(at[i]) + 1, int((best[i] & (ONE - 1)) // WORD), int(best[i] // ONE)))
            next_begin.append(free)
            next_end.append(int(at[first]))
            last = i
        if last >= 0:
            next_begin.append(int(at[last]) + 1)
            next_end.append(int(end[which[last]]))
        begin, end = enough(codes, np.array(next_begin, np.int64), np.array(next_end, np.int64), template)
    return out


FOUND = "doc_id long, template string, span_start long, span_end long, coverage double, matched long, score long"


def matches(texts: list[str], vocabulary: np.ndarray, templates: list[Template]):
    """(text number, template, begin, end, coverage, matched words, score) of each match.

    Matches of one template never overlap.
    """
    hashes, owner, begin, end = words_of(texts)
    if not len(hashes) or not len(vocabulary):
        return []
    codes = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    codes[vocabulary[codes] != hashes] = len(vocabulary)
    out = []
    for template in templates:
        some = stretches(codes, owner, template)
        if len(some[0]):
            for a, b, matched, score in best_matches(codes, *some, template):
                coverage = matched / len(template.codes)
                out.append((int(owner[a]), template.name, int(begin[a]), int(end[b - 1]), coverage, matched, score))
    return out


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    id_: str = "doc_id",
    text: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per license notice found.

    A notice is a span whose best local alignment with a template matches ``coverage`` of the
    template's words.  Columns: doc_id, template, span_start and span_end (characters of the
    text), coverage (matched share of the template's words), matched (their number) and
    score.  Matches of different templates may overlap.  Null and empty texts have none,
    repeated rows have each their own, an empty table gives no rows; other columns are not
    read.  ``templates`` is a parameter of the job and must fit into memory many times over.
    """

    def find(batches: Iterator[pd.DataFrame]):
        vocabulary, known = compiled(templates, coverage)
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            rows = []
            for part in chunks(texts, CHARS):
                rows += [(ids[part[m[0]]], *m[1:]) for m in matches([texts[i] for i in part], vocabulary, known)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(find, FOUND)
