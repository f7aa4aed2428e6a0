"""Helpers shared by the operators of this subpackage.

Conventions of every operator here: a null text is the empty text; only the columns that an
operator names are read, so extra columns never clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.session import application_scratch

#: Chunks of this many bytes are worked on at once in numpy, so that temporaries stay small.
CHUNK_BYTES = 1 << 20


def stage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the application's scratch folder in the shared checkpoint folder and return
    a scan of it (cuts the lineage)."""
    spark = df.sparkSession
    path = application_scratch(spark).new_path("llm")
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and the whole text (null: empty), with further columns by name."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_hash(docs: DataFrame) -> Column:
    """Hash of the text (null: empty); with doc_id it is the key by which a row is judged."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def without_rows(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are those of ``bad`` (doc_id, text_hash);
    null ids match each other."""
    gone = bad.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["_gone_id"])
                     & (text_hash(docs) == gone["_gone_text"]), "left_anti")


def keep_rows(docs: DataFrame, good: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` whose text (null: empty) is ``good``, with all columns; texts stay in
    their tasks, nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(good(pc.fill_null(batch.column(at), ""))))

    return docs.mapInArrow(run, docs.schema)


def cut_points(df: DataFrame, column: str, parts: int, error: float) -> list[int]:
    """At most ``parts - 1`` ascending values that cut the integer ``column`` into parts of
    about equal size."""
    if parts < 2:
        return []
    found = df.approxQuantile(column, [i / parts for i in range(1, parts)], error)
    return sorted({min(int(x), (1 << 63) - 1) for x in found})


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with one result batch per non-empty input batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column without nulls, and n + 1 offsets into them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)
    at = at[column.offset:column.offset + len(column) + 1].astype(np.int64)
    all_bytes = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return all_bytes[at[0]:at[-1]], at - at[0]


def groups_of_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (a longer row is a range of its own)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over a uint64 array."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 1024)
        factors = np.full(size, _BASE, np.uint64)
        factors[0] = 1
        _POWERS = np.multiply.accumulate(factors)
    return _POWERS[:n]


def hash_tokens(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token; ``symbols`` are the tokens' bytes back to back."""
    if not len(lengths):
        return np.empty(0, np.uint64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    weight = _powers(int(lengths.max()))
    sums = np.add.reduceat(_BYTE_KEYS[symbols] * weight[place], starts)
    return mix(sums + lengths.astype(np.uint64))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[0::2], edge[1::2]


def segments(kind: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of one non-zero kind that cross no cut."""
    if not len(kind):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.empty(len(kind), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[cuts[cuts < len(kind)]] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(kind)))
    some = kind[starts] > 0
    return starts[some], lengths[some]
