"""What several corpus operators share."""

from __future__ import annotations

import ctypes
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space that separates words, as a character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_RUN = rf"[{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(spark: SparkSession, rows: list[tuple], **kinds) -> DataFrame:
    """A small table of the driver's rows, with Arrow types by column.

    Spark gets it as Arrow data; rows alone would be unpacked in Python workers of their own.
    """
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds.values(), strict=True)]
    return spark.createDataFrame(pa.table(arrays, names=list(kinds)))


def crc_of(column: str) -> Column:
    """crc32 of an integer's decimal text, the rule that sets rows aside for tests."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether a row is set aside; rows without an id are never learned from."""
    return F.coalesce(crc_of(column) % folds == fold, F.lit(True))


def buckets_for(rows: int, rows_per_bucket: int) -> int:
    """Hash buckets so that each holds about ``rows_per_bucket`` distinct keys."""
    return max(1, -(-rows // rows_per_bucket))


def give_back() -> None:
    """Return to the system what this process's allocators keep of freed memory."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def lean(run):
    """``run`` for ``mapInPandas``; a worker that waits for its next task keeps no freed memory.

    An executor keeps as many workers as it ever needed at once and uses them in turn.
    """

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def chunks(texts, size: int):
    """Consecutive lists of indices whose texts have about ``size`` characters together."""
    part, total = [], 0
    for i, text in enumerate(texts):
        if part and total + len(text) > size:
            yield part
            part, total = [], 0
        part.append(i)
        total += len(text)
    if part:
        yield part


def pieces(text: str, size: int) -> list[str]:
    """A text cut at white space into pieces of ``size`` characters or a little more."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    space = re.compile(r"\s")
    while len(text) - start > size:
        found = space.search(text, start + size)
        if found is None:
            break
        out.append(text[start : found.end()])
        start = found.end()
    out.append(text[start:])
    return out
