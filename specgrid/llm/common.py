"""What the corpus operators share: the scratch folder, tables written to cut lineage, and word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specgrid.sources.scratch import saved, scratch

__all__ = ["ALNUM_AZ", "LOWER_AZ", "PART_ROWS", "SMALL_ROWS", "SPACE", "SPACED_WORD", "crc_mod", "parts", "saved", "scratch", "shielded", "small", "table", "utf8"]

#: Bytes that separate words on white space: space and \t \n \v \f \r.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z, everything else as it is.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The same, and all ASCII but letters and digits to a space.
ALNUM_AZ = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: str | Column = "text") -> Column:
    """The text's UTF-8 bytes, which Arrow hands to Python without decoding."""
    return (F.col(text) if isinstance(text, str) else text).cast("binary")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")) % n


#: Rows that a task turns into Python objects at once.
PART_ROWS = 256


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of PART_ROWS rows: what a task holds as Python objects stays small, whatever the length of texts."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), PART_ROWS):
            yield batch.slice(at, PART_ROWS)
        # a worker that waits for its next task shouldn't keep the memory of its last
        del batch
        pa.default_memory_pool().release_unused()


#: Rows of a few numbers that are broadcast at most.
SMALL_ROWS = 1_000_000


def small(rows: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it is counted to be small enough; beyond that Spark shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= most else rows


#: Columns that operators look at; all others of a table of documents are carried along.
LOOKED_AT = ("doc_id", "text", "lang", "source", "n_chars")


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with further columns of docs, its first argument, packed into one struct with field names of its own.

    So no name of theirs can meet one that the operator uses inside. They come back in their places with their names,
    but for those that are named like a column the operator adds, which are replaced.
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        # names of columns are arguments too
        looked_at = {*LOOKED_AT, *(x for x in (*args, *how.values()) if isinstance(x, str))}
        extra = {c: f"f{i}" for i, c in enumerate(docs.columns) if c not in looked_at}
        if not extra:
            return operator(docs, *args, **how)
        core = [c for c in docs.columns if c in looked_at]
        got = operator(docs.select(*core, F.struct(*(F.col(f"`{c}`").alias(f) for c, f in extra.items())).alias("carried_along")), *args, **how)
        added = [c for c in got.columns if c not in core and c != "carried_along"]
        own = [F.col(f"carried_along.{extra[c]}").alias(c) if c in extra else F.col(c) for c in docs.columns if c not in added]
        return got.select(*own, *added)

    return run
