"""Packing documents into sequences by vector best fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths).  Pieces come in order of falling length; each goes to the open sequence
that can take it under every capacity and that a rule prefers:

``norm``  the smallest weighted norm of what would be left of the capacities (best fit),
``dot``   the largest weighted product of the piece's needs with what is left.

Pieces are dealt by hash into groups that hold about ``SEQUENCES`` sequences' worth of
tokens, so a group is bounded at any size of the corpus.  Sequences that stay badly filled
are dissolved, and their pieces are packed again, in groups of the same size.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import chunks, give_back, lean
from wattline.llm.tokens import encoder, forget
from wattline.sources.sinks import stage

LENGTH = 2048
SEQUENCES = 1024
# A sequence below this fill is packed again, so many rounds in all.
FILL, ROUNDS = 0.97, 2
WEIGHTS = (1.0, 0.01, 0.01)
TOKENIZER = "word_bpe_49k.json"
# Characters that a worker encodes at once; fewer where it has little memory.
CHARS, FEW_CHARS = 4_000_000, 500_000


def cut(docs: DataFrame, tokenizer: str, length: int, keep: bool = True) -> DataFrame:
    """Pieces of (doc_id, text): piece, start, length, ids_crc32.

    Workers keep their encoders for their next tasks and take large portions, or neither.
    """
    portion = CHARS if keep else FEW_CHARS

    def run(batches: Iterator[pd.DataFrame]):
        ids_of = encoder(tokenizer).encode
        for pdf in batches:
            ids, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            rows = []
            for part in chunks(texts, portion):
                for i, raw in zip(part, ids_of([texts[i] for i in part])):
                    raw += bytes(4)
                    for piece, at in enumerate(range(0, len(raw), 4 * length)):
                        here = raw[at : at + 4 * length]
                        rows.append((ids[i], piece, at // 4, len(here) // 4, zlib.crc32(here)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        if not keep:
            del ids_of
            forget()

    return docs.mapInPandas(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(
    lengths: np.ndarray,
    tokens: int,
    documents: int,
    cost: float,
    weights: tuple[float, float, float],
    rule: str,
) -> np.ndarray:
    """Sequence number of each piece; ``lengths`` must fall."""
    out = np.empty(len(lengths), np.int64)
    smallest = int(lengths[-1]) if len(lengths) else 0
    full = np.array([tokens, documents, cost], float)
    weight = np.sqrt(np.array(weights)) / full
    left = np.empty((3, len(lengths)))
    number = np.empty(len(lengths), np.int64)
    open_ = made = 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        rest = left[:, :open_] - need[:, None]
        fits = (rest >= 0).all(axis=0)
        if open_ and fits.any():
            if rule == "norm":
                score = ((rest * weight[:, None]) ** 2).sum(axis=0)
                score[~fits] = np.inf
                at = int(score.argmin())
            else:
                score = (need * weight**2) @ left[:, :open_]
                score[~fits] = -np.inf
                at = int(score.argmax())
            left[:, at] = rest[:, at]
        else:
            if (need > full).any():
                raise ValueError(f"A piece of {n} tokens exceeds the capacities of a sequence")
            at = open_
            left[:, at] = full - need
            number[at] = made
            made += 1
            open_ += 1
        out[i] = number[at]
        if left[0, at] < smallest or left[1, at] < 1:
            # Nothing fits any more: the last open sequence takes the place.
            open_ -= 1
            left[:, at], number[at] = left[:, open_], number[open_]
    return out


def _packer(tokens, documents, cost, weights, rule):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(
            ["length", "doc_id", "piece", "nth"], ascending=[False, True, True, True], kind="stable", ignore_index=True
        )
        lengths = pdf["length"].to_numpy()
        bins = best_fit(lengths, tokens, documents, cost, weights, rule)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
        offset = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf = pdf.assign(bin=bins, fill=np.bincount(bins, lengths)[bins] / tokens)
        pdf.loc[order, "offset"] = offset
        give_back()
        return pdf.astype({"offset": "int64"})

    return run


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, nth long"


def pack(
    docs: DataFrame,
    id_: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    length: int = LENGTH,
    documents: int | None = None,
    cost: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    sequences: int = SEQUENCES,
    keep: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and a 0; only longer ones than ``length`` (or than a piece that
    costs ``cost`` alone) are cut.  Null texts
    are empty and give the 0 alone.  Without ``documents`` and ``cost`` the capacities are
    as many pieces and as much cost as a sequence of ``length`` tokens can have at all.
    Without ``keep`` each task loads its encoder, and workers that wait hold none.
    Rows that repeat a document are packed as often as they come.  An empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    same = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # Equal rows are counted and dealt one by one, so that they spread over the groups.
    cost = cost or float(length) ** 2
    left = stage(cut(rows, tokenizer, min(length, math.isqrt(int(cost))), keep).groupBy(*same).agg(F.count("*").alias("n")))
    left = left.select(*same, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("nth"))
    run = _packer(length, documents or length, cost, weights, rule)
    done = None
    for turn in range(ROUNDS):
        total = left.agg(F.sum("length")).first()[0] or 0
        groups = max(1, -(-total // (length * sequences)))
        packed = stage(
            left.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "nth", F.lit(turn)), F.lit(groups)))
            .groupBy("group")
            .applyInPandas(run, PIECE + ", group long, bin long, fill double, offset long")
        )
        last = turn == ROUNDS - 1
        kept = packed if last else packed.filter(F.col("fill") >= FILL)
        kept = kept.select(
            *same,
            # Rounds, groups and sequences of a group have their own digits.
            ((F.col("group") * 2**24 + F.col("bin")) * ROUNDS + turn).alias("sequence_id"),
            "offset",
        )
        done = kept if done is None else done.unionByName(kept)
        left = packed.filter(F.col("fill") < FILL).select(*same, "nth")
    return done
