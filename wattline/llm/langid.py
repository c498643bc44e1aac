"""Language identification by compression.

Each language has a zstandard raw-content dictionary: text of that language, at most
``DICTIONARY`` bytes.  A text is compressed with every dictionary, and the language whose
dictionary makes it smallest wins.  ``rejected`` marks texts whose smallest and second
smallest sizes are too close to tell.

Texts are compared by their letters only: lower case, every run of other characters as one
space.  Dictionaries come from slices of a bounded, hashed sample of documents; every text
is compressed whole, where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import held_out

UNKNOWN = "und"
# Bytes of a dictionary and of one document's slice in it, documents sampled per language.
DICTIONARY, SLICE, DOCUMENTS = 200_000, 1_500, 200
# A language is one row of a configuration; each costs a compression per text.
MAX_LANGUAGES = 200
# Level for all texts, and for those that it leaves too close to tell.
LEVEL, CLOSER_LEVEL = 3, 19
# Share of the second smallest size by which the smallest must be smaller.
MARGIN = 0.005
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def dictionaries(docs: DataFrame, per_language: int = DOCUMENTS, size: int = DICTIONARY) -> dict[str, bytes]:
    """Dictionary content per language, the most frequent first, learned from ``docs`` (doc_id, text, lang).

    Rows set aside for tests, without an id, language or text are left out.  About
    ``per_language`` documents of each language are taken by a hash of their ids.
    """
    known = docs.filter(~held_out("doc_id", 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    shares = {r["lang"]: min(1.0, per_language / r["count"]) for r in counts}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    # A slice begins somewhere in the text, so that openings do not dominate.
    start = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.greatest(F.lit(1), F.length("text") - SLICE)) + 1
    sample = known.filter(place < share).select(
        "lang", "doc_id", F.substring("text", start.cast("int"), F.lit(SLICE)).alias("text")
    )
    pdf = sample.toPandas().sort_values(["lang", "doc_id", "text"])
    out = {}
    often = sorted(counts, key=lambda r: (-r["count"], r["lang"]))
    for lang in [r["lang"] for r in often]:
        part = pdf[pdf["lang"] == lang]
        content = " ".join(letters(t) for t in part["text"]).encode("utf-8", "surrogatepass")
        out[lang] = content[-size:]
    return out


class Compressors:
    """Sizes of a text under each dictionary."""

    def __init__(self, contents: dict[str, bytes], level: int):
        import zstandard

        self.languages = np.array(list(contents), object)
        self.each = []
        for content in contents.values():
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=level)
            self.each.append(
                zstandard.ZstdCompressor(
                    level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )

    def sizes(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        return [len(c.compress(raw)) for c in self.each]


def choose(sizes: np.ndarray):
    """Index of the smallest size, confidence, and whether the margin is too narrow.

    Ties go to the language that comes first, the most frequent one.  The confidence is the smallest size's weight
    among all, each weighted by how far it is behind.
    """
    best = int(sizes.argmin())
    behind = (sizes - sizes[best]) / max(1.0, 0.01 * sizes[best])
    rest = np.delete(sizes, best)
    narrow = bool(len(rest)) and rest.min() - sizes[best] < MARGIN * rest.min()
    return best, 1 / np.exp(-behind).sum(), narrow


def identify(docs: DataFrame, contents: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything
    if no language was learned.  Repeated rows get equal results; an empty table gives no
    rows.
    """
    schema = "lang_pred string, score double, rejected boolean"

    @F.pandas_udf(schema)
    def by_size(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with_each, closer = Compressors(contents, LEVEL), None
        for texts in batches:
            rows = []
            for t in texts:
                own = letters(t) if t is not None else ""
                if not own or not len(with_each.languages):
                    rows.append((UNKNOWN, 0.0, True))
                    continue
                at, sure, narrow = choose(np.array(with_each.sizes(own), float))
                if narrow:
                    closer = closer or Compressors(contents, CLOSER_LEVEL)
                    at, sure, narrow = choose(np.array(closer.sizes(own), float))
                rows.append((with_each.languages[at], float(sure), narrow))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("found", by_size(F.col(text)))


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    contents = dictionaries(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), contents).select(
        "doc_id", held_out("doc_id", 4, 2).alias("held_out"), "found.lang_pred", "found.score", "found.rejected"
    )
