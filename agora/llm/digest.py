"""Improbable-feature digests of documents and their likeness (operator 1).

1. *Rarity.*  Every byte of a text ends one window of ``WINDOW`` bytes (the text is preceded by
   zero bytes). A first pass counts, over all windows of all documents, the Shannon entropies in
   ``BINS`` steps; the rarer an entropy, the better its rank.
2. *Selection.*  Among any ``WINDOW`` neighbouring windows the leftmost of best rank gets a
   point; windows with ``POINTS`` points or more are features, and all windows of a text of at
   most ``WINDOW`` bytes are (repeats within a text count once).
3. *Bloom filters.*  A feature sets ``HASHES`` bits of a ``BITS``-bit filter; after ``FILL``
   features the next filter of the chain begins. The fingerprint is the chain in base64.
4. *Likeness.*  Two filters' common bits, less those expected by chance, over the same for the
   mean of their sizes; each filter takes its best partner in the other chain, and the two
   chains' means, weighted by bits, give a number from 0 to 1.

Equal texts have equal fingerprints and likeness 1. The empty text has the empty fingerprint,
like only to itself. Null is the empty text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import cut_points, groups_of_rows, mix, texts, utf8

WINDOW, POINTS, BINS = 64, 16, 1001
BITS, HASHES, FILL = 2048, 5, 160
PIECE = 1 << 17  # bytes worked on at once, to stay in the cache
ROWS_PER_PART, MAX_PARTS = 4096, 20_000
_NO_DOC = -(1 << 63)

_COUNTS = np.arange(WINDOW + 1, dtype=np.float64)
_ENTROPY_PART = np.round(_COUNTS * np.log2(np.maximum(_COUNTS, 1)) * 65536).astype(np.int64)
_STEP = np.diff(_ENTROPY_PART)


def entropy_bins(data: np.ndarray) -> np.ndarray:
    """Bin of the entropy of each window of ``data`` (len - WINDOW + 1 of them), in 0..BINS-1.

    sum(c log c) changes from one window to the next by what the leaving and the entering byte
    contribute, which only depends on how often each occurs among its 63 neighbours."""
    n = len(data)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for gap in range(1, WINDOW):
        same = (data[:-gap] == data[gap:]).view(np.uint8)
        after[:-gap] += same
        before[gap:] += same
    first = _ENTROPY_PART[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = _STEP[before[WINDOW:]] - _STEP[after[:n - WINDOW]]
    total = np.concatenate(([first], first + np.cumsum(change)))
    most = _ENTROPY_PART[WINDOW]
    return ((most - total) * (BINS - 1) // most).astype(np.int64)


def _padded(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with WINDOW - 1 zero bytes before each; where each padded text starts; sizes."""
    sizes = np.diff(at)
    starts = np.concatenate(([0], np.cumsum(sizes + WINDOW - 1)))
    out = np.zeros(int(starts[-1]) + WINDOW - 1, np.uint8)
    shift = np.repeat(starts[:-1] + WINDOW - 1 - at[:-1], sizes)
    out[np.arange(len(data)) + shift] = data
    return out, starts[:-1], sizes


def _windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    padded, starts, sizes = _padded(data, at)
    bins = np.empty(len(padded) - WINDOW + 1, np.int64)
    for a in range(0, len(bins), PIECE):
        b = min(a + PIECE, len(bins))
        bins[a:b] = entropy_bins(padded[a:b + WINDOW - 1])
    valid = np.zeros(len(bins) + 1, np.int8)
    some = sizes > 0
    valid[starts[some]] += 1
    valid[(starts + sizes)[some]] -= 1
    return padded, starts, sizes, bins, np.cumsum(valid[:-1]).astype(bool)


def entropy_counts(docs: DataFrame) -> np.ndarray:
    """How many windows of all documents have each entropy."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, b in groups_of_rows(at):
                _, _, _, bins, valid = _windows(data[at[a]:at[b]], at[a:b + 1] - at[a])
                total += np.bincount(bins[valid], minlength=BINS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bin", "n"])

    counts = texts(docs).select("text").mapInArrow(run, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    out = np.zeros(BINS, np.int64)
    for row in counts.collect():  # at most BINS rows
        out[row["bin"]] = row["n"]
    return out


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy bin: 0 is the rarest; ties go to the lower entropy."""
    ranks = np.empty(BINS, np.int64)
    ranks[np.lexsort((np.arange(BINS), counts))] = np.arange(BINS)
    return ranks


def digests(data: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> list[np.ndarray]:
    """For each text ``data[at[i]:at[i + 1]]`` its chain of filters (k x BITS / 8 bytes)."""
    chains: list[np.ndarray] = []
    for a, b in groups_of_rows(at):
        padded, starts, sizes, bins, valid = _windows(data[at[a]:at[b]], at[a:b + 1] - at[a])
        n = len(bins)
        keys = np.where(valid, ranks[bins], BINS) << 40 | np.arange(n)
        edge = np.full(WINDOW - 1, np.int64(BINS) << 40 | ((1 << 40) - 1))
        best = np.concatenate((edge, keys, edge))
        width = 1
        while width < WINDOW:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = best[best < np.int64(BINS) << 40] & ((1 << 40) - 1)
        short = np.zeros(n + 1, np.int8)  # all windows of a short text are features
        few = (sizes > 0) & (sizes <= WINDOW)
        short[starts[few]] = 1
        short[(starts + sizes)[few]] = -1
        chosen = np.flatnonzero((np.bincount(best, minlength=n) >= POINTS) | (np.cumsum(short[:-1]) > 0))
        doc = np.searchsorted(starts + sizes, chosen, "right")
        words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[chosen]).view("<u8")
        hashes = np.zeros(len(chosen), np.uint64)
        for k in range(words.shape[1]):
            hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + words[:, k] + np.uint64(k + 1))
        # the first of equal features of a text
        order = np.lexsort((chosen, hashes, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        kept = np.sort(order[new])
        doc, hashes = doc[kept], hashes[kept]
        count = np.bincount(doc, minlength=b - a)
        place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
        filters = -(-count // FILL)
        first = np.cumsum(filters) - filters
        bits = np.zeros((int(filters.sum()), BITS), bool)
        which = first[doc] + place // FILL
        for k in range(HASHES):
            bits[which, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        chains += [packed[f:f + c] for f, c in zip(first.tolist(), filters.tolist())]
    return chains


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Likeness of two chains of filters, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    wide_a, wide_b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    size_a, size_b = np.bitwise_count(wide_a).sum(1, dtype=np.float64), np.bitwise_count(wide_b).sum(1, dtype=np.float64)
    best_a, best_b = np.zeros(len(a)), np.zeros(len(b))
    step = max(1, (1 << 21) // wide_b.size)
    for i in range(0, len(a), step):
        common = np.bitwise_count(wide_a[i:i + step, None] & wide_b[None]).sum(2, dtype=np.float64)
        chance = size_a[i:i + step, None] * size_b / BITS
        room = (size_a[i:i + step, None] + size_b) / 2 - chance
        overlap = np.clip((common - chance) / np.maximum(room, 1e-9), 0, 1)
        best_a[i:i + step] = overlap.max(1)
        best_b = np.maximum(best_b, overlap.max(0))
    return float((best_a @ size_a + best_b @ size_b) / (size_a.sum() + size_b.sum()))


def as_text(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter is replaced by as much of the start of the next text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _in_order(docs: DataFrame) -> DataFrame:
    """(part, look, key, doc_id, text) in ascending doc_id order within parts of consecutive ids.
    The rows of the first id of a part also come last (look = 1) in the part before, so that
    every text is followed by the next one; after the last part comes the first."""
    base = texts(docs).select(F.coalesce("doc_id", F.lit(_NO_DOC)).alias("key"), "doc_id", "text")
    parts = min(MAX_PARTS, base.count() // ROWS_PER_PART + 1)
    edges = np.array(cut_points(base, "key", parts, 0.0005), np.int64)

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, key.to_numpy(np.int64), "right").astype(np.int32))

    numbered = base.select("key", part_of("key").alias("part"))
    heads = sorted((r["part"], r["head"]) for r in numbered.groupBy("part").agg(F.min("key").alias("head")).collect())
    if not heads:
        return base.select(F.lit(0).alias("part"), F.lit(0).alias("look"), "key", "doc_id", "text")
    # one row a part, at most MAX_PARTS
    before = docs.sparkSession.createDataFrame(
        [(h, heads[i - 1][0]) for i, (_, h) in enumerate(heads)], "key bigint, before int")
    rows = base.withColumn("part", part_of("key")).join(F.broadcast(before), "key", "left")
    here = F.struct(F.col("part"), F.lit(0).alias("look"))
    ahead = F.struct(F.col("before").alias("part"), F.lit(1).alias("look"))
    places = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, ahead))
    return (rows.select(F.explode(places).alias("place"), "key", "doc_id", "text")
            .select("place.part", "place.look", "key", "doc_id", "text")
            .repartition("part").sortWithinPartitions("part", "look", "key", "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``n_chars``, the ``edited`` text (see ``edited``;
    rows with one doc_id follow each other by text), ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (likeness to the edited and the next text)."""
    ranks = ranks_of(entropy_counts(docs))

    def chains_of(strings: list[str]) -> list[np.ndarray]:
        raw = [s.encode() for s in strings]
        at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        return digests(np.frombuffer(b"".join(raw), np.uint8), at, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int, int | None, str, np.ndarray] | None = None  # a text whose next one is to come
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part, look, _, doc_id, text = (c.to_pylist() for c in batch.slice(a, 1024).columns)
                chains = chains_of(text)
                done, new_texts = [], []
                for row in zip(part, look, doc_id, text, chains):
                    if waiting is not None and waiting[0] == row[0]:
                        done.append((waiting[1], waiting[2], waiting[3], row[4]))
                        new_texts.append(edited(waiting[2], row[3]))
                    waiting = None if row[1] else (row[0], *row[2:])
                if done:
                    new_chains = chains_of(new_texts)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([d[0] for d in done], pa.int64()),
                        "n_chars": pa.array([len(d[1]) for d in done], pa.int64()),
                        "edited": pa.array(new_texts, pa.string()),
                        "fingerprint": [as_text(d[2]) for d in done],
                        "edited_fingerprint": [as_text(c) for c in new_chains],
                        "near_edited": [likeness(d[2], c) for d, c in zip(done, new_chains)],
                        "near_next": [likeness(d[2], d[3]) for d in done]})

    return _in_order(docs).mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
