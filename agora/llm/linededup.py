"""Line dedup (operator 6): levelled sorted runs of line hashes.

``SortedRuns`` holds what has been seen so far as levels of runs; a run is a Parquet table in
the shared folder, hash-partitioned and sorted by key.  ``add`` takes a new batch of (key, doc)
pairs, merge-anti-joins it with the runs to find the keys that are new, and writes the batch as
a run of its own at level 0.  When a level holds ``FANOUT`` runs they are merged into one run of
the next level, so the number of runs grows with the logarithm of the number of batches.

``drop_repeated_lines`` feeds the documents in batches of *descending* doc_id, so the batch in
which a key is new names its keeper: the largest doc_id that holds it.  After the last batch the
runs are merged once more into the number of documents per key.

Defined results: null or empty text is one empty line; a null doc_id counts as one document,
smaller than all others; rows that repeat a doc_id are the same document (all of them keep the
lines that this document keeps), whatever their texts.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.common import cut_points, map_batches, stage, texts

#: White space stripped from a line for its key.
STRIP = " \t\n\r\x0b\x0c"
FANOUT = 3
KEY = ["hi", "lo"]
_NO_DOC = -(1 << 63)


def line_key(line: str, min_chars: int) -> bytes | None:
    """16-byte hash of the stripped, ASCII-lower-cased line; None if it is too short."""
    line = line.strip(STRIP)
    if len(line) < min_chars:
        return None
    return hashlib.blake2b(line.encode().lower(), digest_size=16).digest()


class SortedRuns:
    """Levelled sorted runs of (hi, lo, n_docs, keeper); see the module docstring."""

    def __init__(self, fanout: int = FANOUT):
        self.levels: list[list[DataFrame]] = []
        self.fanout = fanout

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        # only the run in which a key was new has a keeper
        return union.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    @staticmethod
    def _write(run: DataFrame) -> DataFrame:
        return stage(run.repartition(*KEY).sortWithinPartitions(*KEY))

    def add(self, batch: DataFrame) -> None:
        """``batch``: distinct (hi, lo, doc) of documents smaller than all before."""
        rows = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))
        if self.runs():
            rows = rows.persist()
            seen = self.runs()[0].select(*KEY)
            for run in self.runs()[1:]:
                seen = seen.unionByName(run.select(*KEY))
            new = rows.join(seen, KEY, "left_anti")
            old = rows.join(seen.distinct(), KEY, "left_semi").withColumn("keeper", F.lit(None).cast("bigint"))
            run = self._write(new.unionByName(old))
            rows.unpersist()
        else:
            run = self._write(rows)
        self._put(run, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(self._write(self.merged(full)), level + 1)

    def counts(self) -> DataFrame | None:
        """(hi, lo, n_docs, keeper) of all batches, or None before the first."""
        return self.merged(self.runs()) if self.runs() else None


def _row_key() -> list[Column]:
    return [F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), F.xxhash64("text").alias("text_hash")]


@F.pandas_udf(T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                            T.StructField("kept", T.StringType())]))
def _cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Texts without the lines numbered in ``gone``."""
    rows = []
    for whole, numbers in zip(text, gone):
        if numbers is None:
            rows.append((whole.count("\n") + 1, 0, whole))
        else:
            lines, out = whole.split("\n"), set(numbers.tolist())
            rows.append((len(lines), len(out), "\n".join([x for i, x in enumerate(lines) if i not in out])))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, text_hash, hi, lo, line_nos) for each row and each key of it."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, text_hash, hi, lo, numbers = [], [], [], [], []
        for d, h, text in zip(*(c.to_pylist() for c in batch.columns)):
            found: dict[bytes, list[int]] = {}
            for i, line in enumerate(text.split("\n")):
                key = line_key(line, min_chars)
                if key is not None:
                    found.setdefault(key, []).append(i)
            doc += [d] * len(found)
            text_hash += [h] * len(found)
            hi += [int.from_bytes(k[:8], "big", signed=True) for k in found]
            lo += [int.from_bytes(k[8:], "big", signed=True) for k in found]
            numbers += found.values()
        return pa.RecordBatch.from_pydict({
            "doc": pa.array(doc, pa.int64()), "text_hash": pa.array(text_hash, pa.int64()),
            "hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64()),
            "line_nos": pa.array(numbers, pa.list_(pa.int32()))})

    return map_batches(texts(docs).select(*_row_key(), "text"), run,
                       "doc bigint, text_hash bigint, hi bigint, lo bigint, line_nos array<int>")


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3,
                        batches: int = 4, carry: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` (the text that stays) for every row of ``docs``; with
    ``carry`` instead the columns of ``docs``, with what stays as ``text`` (null stays null) and
    its length as ``n_chars`` if there is such a column.

    ``batches``: so many doc_id ranges of about equal size are added one after the other.
    """
    lines = stage(line_hashes(docs, min_chars))
    edges = [None, *cut_points(lines, "doc", batches, 0.01), None]
    pairs = lines.select(*KEY, "doc").distinct()
    runs = SortedRuns()
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        part = pairs
        if low is not None:
            part = part.where(F.col("doc") >= low)
        if high is not None:
            part = part.where(F.col("doc") < high)
        runs.add(part)
    # written, so that its join with the lines is one that AQE can split at a very common line
    repeated = stage(runs.counts().where(F.col("n_docs") >= min_docs).select(*KEY, "keeper"))
    dropped = (lines.join(repeated, KEY).where(F.col("doc") != F.col("keeper"))
               .select("doc", "text_hash", F.explode("line_nos").alias("line_no")).distinct()
               .groupBy("doc", "text_hash").agg(F.collect_list("line_no").alias("gone")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).select(
        "row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.coalesce("row.text", F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", "text", *_row_key())
    done = rows.join(dropped, ["doc", "text_hash"], "left").select("row", "doc_id", _cut("text", "gone").alias("cut"))
    if not carry:
        return done.select("doc_id", "cut.*")
    kept = F.when(F.col("row.text").isNotNull(), F.col("cut.kept"))
    new = {"text": kept, "n_chars": F.length(kept).cast("bigint")}
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
