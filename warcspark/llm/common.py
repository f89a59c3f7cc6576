"""What the operators share: text rules, the shared folder, hashing of rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import forget, scratch

#: Words of the contracts: runs of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder below this application's part of the shared folder, removed as Python ends."""
    return scratch(spark, name)


def drop_staged(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that no plan reads any more."""
    forget(spark, path)


_pools: list[dict[str, None]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are staged inside are deleted at its end, but for those given to the function it yields."""
    pool: dict[str, None] = {}
    _pools.append(pool)

    def keep(df: DataFrame) -> DataFrame:
        pool.pop(df._staged, None)
        return df

    try:
        yield keep
    finally:
        _pools.remove(pool)
        for path in pool:
            forget(spark, path)


def staged(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df into the shared folder and reads it back, which cuts its lineage.

    The files outlive any executor, so a lost one costs its own tasks only.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    if _pools:
        _pools[-1][path] = None
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], base: str = "_") -> str:
    """A prefix that no column begins with, whatever its case."""
    while any(c.lower().startswith(base) for c in columns):
        base += "_"
    return base


def column(name: str) -> Column:
    """The column of just this name, with dots and other odd letters."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_beside(docs: DataFrame, keep: tuple[str, ...], outputs: list[str]) -> list[str]:
    """Columns to keep beside outputs, which replace those of their name."""
    gone = {o.lower() for o in outputs}
    return [c for c in keep if c.lower() not in gone]


def mapped(docs: DataFrame, kept: list[str], text: str, run: Callable, new: dict[str, T.DataType]) -> DataFrame:
    """docs' columns to keep and new ones, from a function of batches of those and the text, which stands last. Within, names
    are plain, as columns may have any."""
    d = docs.select(*[column(c).alias(f"k{i}") for i, c in enumerate(kept)], F.col(text).cast("string").alias("text"))
    schema = T.StructType([*d.schema.fields[:-1], *(T.StructField(f"n{i}", t) for i, t in enumerate(new.values()))])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, made in run(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], schema.names)

    return d.mapInArrow(named, schema).toDF(*kept, *new)


def comparable(docs: DataFrame, name: str) -> Column:
    """The column, or where its type can't be compared or hashed (maps, variants) its JSON text."""
    kind = docs.schema[name].dataType.simpleString()
    return F.to_json(F.struct(column(name))) if "map<" in kind or "variant" in kind else column(name)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null. Native."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids take remainder 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def hash_unit(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) * F.lit(2.0**-53)


#: Rows of texts, and bytes of them, that a task turns into Python objects at once (one text may be longer).
SLICE, SLICE_BYTES = 512, 16 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, whose last column is a text, in slices, so that a task holds few texts as Python objects."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            part = b.slice(start, rows)
            text = part.column(part.num_columns - 1)
            if text.nbytes <= most:
                yield part
                continue
            at, held = 0, 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(text), 0).to_pylist()):
                if i > at and held + n > most:
                    yield part.slice(at, i - at)
                    at, held = i, 0
                held += n
            yield part.slice(at)


def coded_terms(texts: pa.Array, breaks: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the code of each term of the texts, in order, and the terms that the codes stand for.

    Terms stand between runs of `breaks`; A to Z are lower-cased, nulls have no terms.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), breaks)
    terms, rows = lists.flatten(), pc.list_parent_indices(lists)
    full = pc.greater(pc.binary_length(terms), 0)
    coded = terms.filter(full).dictionary_encode()
    return rows.filter(full).to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


_caches: dict[str, Callable[[], object]] = {}


def release() -> None:
    """Gives freed memory of this process back to the machine, where its allocator can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def claim_cache(name: str, clear: Callable[[], object]) -> None:
    """Called as a task begins to use the cache `name`: worker processes serve one operator after the other,
    and what others remember there goes."""
    gone = [n for n in _caches if n != name]
    for n in gone:
        _caches.pop(n)()
    _caches[name] = clear
    if gone:
        release()
