"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4).

A text's fingerprint has bit i set if more than half of its shingle hashes have it.  Equal
fingerprints are first reduced to one row with its smallest doc_id.  ``covering_masks(bits, r)``
gives each bit a non-zero vector over GF(2)^(r+1) and one mask per non-zero vector v: the bits
whose vector has an odd product with v.  r differing bits give r equations in r + 1 unknowns,
so some v is orthogonal to all of them and its mask leaves them out: every pair within the
radius agrees on all bits of at least one mask, i.e. collides in at least one table.

A table's bucket holds distinct fingerprints that agree on the mask, so at most
2**(bits outside it) of them.  A bucket of more than ``BUCKET`` rows is split by masks over its
own free bits (again covering, so no pair is lost), which bounds every bucket at the second
level by 2**15 rows.  Inside a bucket a breadth-first search compares each reached fingerprint
with those not reached yet and emits one edge per newly reached fingerprint: a spanning forest
and not all pairs.  Components are then found over smallest doc_ids.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
rows with a null doc_id link like any other, and their component is NULL if it has no id; repeated rows
share one component.  Words are split at ASCII white space; only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import map_batches, stage, text_hash, texts
from agora.llm.components import connected_components

BUCKET = 2048
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of one text."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(shingle)))]
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        part = np.array(hashes[i:i + step], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def covering_masks(free: int, radius: int) -> list[int]:
    """Masks within the bits of ``free``; see the module docstring."""
    places = [i for i in range(64) if free >> i & 1]
    vectors = {p: k % ((1 << radius + 1) - 1) + 1 for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (vectors[p] & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` (the fingerprint as a signed 64-bit integer) for every row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(_signed(fps))],
                                          ["doc_id", "text_hash", "fp"])

    return map_batches(texts(docs, text_hash(docs).alias("text_hash")), run, "doc_id bigint, text_hash bigint, fp bigint")


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that span the components of ``fps`` within the radius."""
    rest, a, b = np.arange(len(fps)), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
            if near.any():
                a += [at] * int(near.sum())
                b += rest[near].tolist()
                queue += rest[near].tolist()
                rest = rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def _buckets(batches: Iterator[pa.RecordBatch], radius: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (key columns, fp); emit edges, and the rows of buckets over the limit."""
    def out(name: str, tables: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array([name] * len(x)), "t": pa.array(tables, pa.int32()),
                                           "x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    left_over: list[np.ndarray] = []  # the rows of the last key so far, up to the limit
    over = False  # whether that key has passed the limit
    last = None

    def close() -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(left_over)
        a, b = _forest(rows["fp"].astype(np.uint64), radius)
        if len(a):
            yield out("edge", np.zeros(len(a)), rows["fp"][a].view(np.int64), rows["fp"][b].view(np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        rows = np.rec.fromarrays([cols[0], cols[1], cols[2].view(np.uint64)], names="t,key,fp")
        edge = np.flatnonzero((np.diff(rows["t"]) != 0) | (np.diff(rows["key"]) != 0)) + 1
        bounds = np.concatenate(([0], edge, [len(rows)]))
        # every pair of neighbours in short runs at once
        small_a, small_b = [], []
        sizes = np.diff(bounds)
        for i in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
            run = rows[bounds[i]:bounds[i + 1]]
            key = (run["t"][0], run["key"][0])
            if key != last:
                if left_over and not over:
                    yield from close()
                left_over, over, last = [], False, key
            if over:
                yield out("row", run["t"], run["key"], run["fp"].view(np.int64))
                continue
            left_over.append(run)
            if sum(map(len, left_over)) > limit:
                whole, left_over, over = np.concatenate(left_over), [], True
                yield out("row", whole["t"], whole["key"], whole["fp"].view(np.int64))
            elif 0 < i < len(sizes) - 1:  # the run ends inside this batch
                a, b = _forest(run["fp"], radius)
                small_a.append(run["fp"][a])
                small_b.append(run["fp"][b])
                left_over = []
        if small_a and (n := sum(map(len, small_a))):
            yield out("edge", np.zeros(n), np.concatenate(small_a).view(np.int64), np.concatenate(small_b).view(np.int64))
    if left_over and not over:
        yield from close()


def _collide(rows: DataFrame, radius: int, limit: int) -> DataFrame:
    """``rows``: (t, key, fp); (kind, t, x, y) as in ``_buckets``."""
    return (rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
            .mapInArrow(lambda b: _buckets(b, radius, limit), "kind string, t int, x bigint, y bigint"))


def _masked(masks: list[int]) -> np.ndarray:
    return np.array(masks, np.uint64)


def near_pairs(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (x, y) between distinct fingerprints of ``fps`` (fp) that span every component of
    the graph 'at most ``radius`` bits differ'."""
    masks = covering_masks((1 << 64) - 1, radius)
    first = _collide(fps.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(int(_signed(_masked([m]))[0]))).alias("key"))
        for i, m in enumerate(masks)])).alias("k"), "fp").select("k.t", "k.key", "fp"), radius, bucket)
    first = stage(first)
    again = first.where("kind = 'row'").select("t", F.col("x").alias("key"), F.col("y").alias("fp"))
    inner = [covering_masks(~m & ((1 << 64) - 1), radius) for m in masks]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, _, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for j in range(len(masks)):
                kept = np.array([masks[i] | inner[i][j] for i in t], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t * len(masks) + j, pa.int32()), pa.array((fp.view(np.uint64) & kept).view(np.int64)),
                     batch.column(2)], ["t", "key", "fp"])

    # free bits at the second level: at most 2 ** 15 rows a bucket, so the limit is never passed
    second = _collide(again.mapInArrow(split, "t int, key bigint, fp bigint"), radius, 1 << 20)
    return first.where("kind = 'edge'").select("x", "y").unionByName(
        second.where("kind = 'edge'").select("x", "y")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` (the smallest doc_id
    reachable over links of at most ``radius`` differing bits; NULL if no row reached has an id)
    for every row."""
    rows = stage(fingerprints(docs, shingle).drop("text_hash"))
    groups = _components(rows, radius)
    return rows.join(groups.select("fp", F.col("first").alias("component_id")), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """``fp, first`` of ``rows`` (doc_id, fp): the smallest doc_id of each fingerprint's component.
    Fingerprints are linked, not ids, so a row without an id links others all the same."""
    least = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_pairs(least, radius).select(F.col("x").alias("a"), F.col("y").alias("b")))
    groups = stage(least.join(linked, least["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")))
    first = groups.groupBy("component").agg(F.min("least").alias("first"))
    return groups.join(first, "component").select("fp", "first")


def near_copies(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, text_hash`` of the rows that are near duplicates of one with a smaller doc_id.
    Texts are linked, not ids: other texts of the same doc_id neither link nor go."""
    rows = stage(fingerprints(docs, shingle).where(F.col("doc_id").isNotNull()))
    return (rows.join(_components(rows, radius), "fp")
            .where(F.col("doc_id") != F.col("first")).select("doc_id", "text_hash"))
