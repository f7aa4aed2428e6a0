"""Token-id files with canonical length-limited Huffman codes (operator 9).

The file format, as Parquet tables below one folder:

* ``blocks``: one row per block of whole documents in ascending doc_id order: ``part`` and
  ``block`` (its place), ``doc_ids`` and ``sizes`` (ids per document), ``n_ids``, ``payload``
  (the codes back to back, most significant bit first) and ``checkpoints`` (the bit offset of
  every ``STRIDE``-th id as little-endian unsigned 64-bit integers);
* ``index``: ``part``, ``block``, ``start`` (ids before the block) and ``n_ids``;
* ``lengths``: ``id`` and ``length`` of its code. Canonical codes follow from the lengths.

Code lengths come from the counts of all ids (package-merge, at most ``LIMIT`` bits, or two more
than the alphabet needs if that is larger). Blocks are decoded independently of each other, and
within a block all stretches between checkpoints advance together, one table look-up a step.

Defined results: null and empty texts hold only the end id; a null doc_id sorts first; rows that
repeat a doc_id are ordered by their ids; an empty table gives files without blocks. A document
of more than ``BLOCK_IDS`` ids is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import cut_points, groups_of_rows, runs_of, segments, stage, texts, utf8
from agora.session import application_scratch

LIMIT = 16
STRIDE = 256
BLOCK_IDS = 1 << 18
CACHE_ENTRIES = 400_000
STEP_WORDS = 512
ROWS_PER_PART = 4096
MAX_PARTS = 20_000
_NO_DOC = -(1 << 63)


# ------------------------------------------------------------------------ ids

#: The text steps for which :class:`LibraryEncoder` holds (fixed values of the tokenizer's file).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Lead bytes from here on belong to characters that are not Latin or may combine with others.
_BEYOND_LATIN = 0xC9
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x0A]] = True
#: ASCII marks but for the apostrophe (it opens endings such as 's) and those of special tokens.
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
STEP_BYTES = 8 << 20


def _steps_hold(spec: dict) -> bool:
    """Whether a tokenizer lower-cases, drops white space and takes words and marks apart as
    ``PRETOKENS`` does, with no steps behind it."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in normal.get("normalizers", [])]
    spaces = [n for n in normal.get("normalizers", []) if n["type"] == "Replace"]
    parts = pre.get("pretokenizers", [])
    return (kinds == NORMALIZERS and spaces[0]["pattern"] == {"Regex": r"\s+"} and spaces[0]["content"] == " "
            and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": PRETOKENS}
            and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
            and spec.get("post_processor") is None and bool(spec["model"].get("end_of_word_suffix"))
            and all(" " not in t["content"] and "\n" not in t["content"] and t["content"].startswith("<|") and not t["normalized"]
                    and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec.get("added_tokens", [])))


class LibraryEncoder:
    """The tokenizers library behind a bounded cache of pieces of text.

    Texts are cut, as byte arrays, at spaces and line feeds and before the marks that end a word:
    no token crosses these places, so a text's ids are those of its pieces in turn.
    Latin texts are lower-cased before, as the tokenizer does it anyway, so that pieces recur.
    Only the distinct pieces of a stretch of text are looked up; their ids are then gathered for
    all pieces at once. Raises for a tokenizer with other steps than :func:`_steps_hold` knows."""

    def __init__(self, spec: str):
        self.spec = spec
        self.name = hashlib.sha256(spec.encode()).hexdigest()
        self.library = None

    @staticmethod
    def load(path: str) -> LibraryEncoder:
        with open(path, encoding="utf-8") as f:
            encoder = LibraryEncoder(f.read())
        if not _steps_hold(json.loads(encoder.spec)):
            raise ValueError(f"{path}: not a tokenizer that lower-cases and drops white space")
        return encoder

    def __reduce__(self):
        return _encoder, (self.name, self.spec)

    def _open(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(self.spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.width = "<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.library.get_vocab()
        suffix = json.loads(self.spec)["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # the cache: pieces, their ids back to back, how many each has, and when it was last used
        self.names = pa.array([], pa.large_binary())
        self.flat, self.sizes, self.used = np.empty(0, self.width), np.empty(0, np.int64), np.empty(0, np.int64)
        self.now = 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only: encoded many at once, cut at the tokens that end a word."""
        flat, sizes = [np.empty(0, self.width)], [np.empty(0, np.int64)]
        for a in range(0, len(words), STEP_WORDS):
            part = words[a:a + STEP_WORDS]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            some = (ids, np.diff(ends, prepend=0)) if len(ends) == len(part) else self._pieces(part)
            flat.append(some[0])
            sizes.append(some[1])
        return np.concatenate(flat), np.concatenate(sizes)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), self.width, int(sizes.sum())), sizes

    def _learn(self, missing: pa.Array) -> np.ndarray:
        """Put new pieces into the cache; their places there."""
        pieces = missing.cast(pa.large_string())
        plain = pc.and_(pc.utf8_is_alpha(pieces), pc.less(pc.utf8_length(pieces), 1 << 16)).to_numpy(zero_copy_only=False)
        data, offsets = utf8(pieces)
        if len(data):
            beyond = np.flatnonzero(data >= _BEYOND_LATIN)
            plain[np.searchsorted(offsets, beyond, "right") - 1] = False
        parts = [(self._words, pieces.filter(pa.array(plain))), (self._pieces, pieces.filter(pa.array(~plain)))]
        new = [encode(part.to_pylist()) for encode, part in parts]
        places = np.empty(len(missing), np.int64)
        places[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = len(self.names) + np.arange(len(missing))
        self.names = pa.concat_arrays([self.names, *[part.cast(pa.large_binary()) for _, part in parts]])
        self.flat = np.concatenate([self.flat, *[flat for flat, _ in new]])
        self.sizes = np.concatenate([self.sizes, *[sizes for _, sizes in new]])
        self.used = np.concatenate([self.used, np.full(len(missing), self.now)])
        return places

    def _forget(self) -> None:
        """Keep the half of the cache that was used last."""
        kept = np.sort(np.argsort(self.used, kind="stable")[-(CACHE_ENTRIES // 2):])
        flags = np.zeros(len(self.used), bool)
        flags[kept] = True
        self.flat = self.flat[np.repeat(flags, self.sizes)]
        self.names, self.sizes, self.used = self.names.take(pa.array(kept)), self.sizes[kept], self.used[kept]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Places of distinct pieces in the cache, which learns those it lacks."""
        self.now += 1
        if len(self.names) > CACHE_ENTRIES:
            self._forget()
        found = pc.index_in(pieces, self.names)
        places = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            places[places < 0] = self._learn(pieces.filter(found.is_null()))
        self.used[places] = self.now
        return places

    def _stretch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of ``data``, back to back, and how many each row has."""
        gap = _GAP[data]
        last = np.concatenate((gap[1:], [True]))
        last[offsets[1:][np.diff(offsets) > 0] - 1] = True  # the end of a row is like a gap
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        begin, end = runs_of(_MARK[data])
        apart = (begin > 0) & letter[begin - 1] & last[end - 1]
        edges = np.zeros(len(data) + 1, np.int8)
        edges[begin[apart]], edges[end[apart]] = 1, -1
        kind = np.where(gap, 0, 1 + np.cumsum(edges[:-1], dtype=np.int8))
        starts, lengths = segments(kind, offsets[1:-1])
        ends = np.concatenate(([0], np.cumsum(lengths)))
        names = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(data[~gap])])
        coded = names.dictionary_encode()
        place = self._places(coded.dictionary)[coded.indices.to_numpy()]
        first = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[place]
        done = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(first[place] - done[:-1], sizes) + np.arange(done[-1])]
        return ids, np.diff(done[np.searchsorted(starts, offsets)])

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of one long text, in stretches that end at gaps."""
        gaps, ids, a = np.flatnonzero(_GAP[data]), [], 0
        while a < len(data):
            at = np.searchsorted(gaps, a + STEP_BYTES)
            b = int(gaps[at]) + 1 if at < len(gaps) else len(data)
            ids.append(self._stretch(data[a:b], np.array([0, b - a]))[0])
            a = b
        return np.concatenate(ids)

    def encode_column(self, column: pa.Array, end: int) -> Iterator[pa.Array]:
        """Ids of each text and the end id, as little-endian integers of type ``width``: binary
        arrays that follow each other."""
        if self.library is None:
            self._open()
        data, offsets = utf8(column)
        unit = np.dtype(self.width).itemsize
        for a, b in groups_of_rows(offsets, STEP_BYTES):
            rows, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            full = at[:-1][np.diff(at) > 0]
            plain = np.zeros(b - a, bool)
            if len(full):
                special = np.zeros(len(rows), bool)
                special[:-1] = (rows[:-1] == 0x3C) & (rows[1:] == 0x7C)
                odd = special | (rows >= _BEYOND_LATIN)
                plain[np.diff(at) > 0] = ~np.logical_or.reduceat(odd, full)
            rows = np.where(np.repeat(plain, np.diff(at)), _LOWER[rows], rows)
            if len(rows) > 2 * STEP_BYTES:  # one long row
                ids = self._long(rows)
                sizes = np.array([len(ids)])
            else:
                ids, sizes = self._stretch(rows, at) if len(rows) else (np.empty(0, self.width), np.zeros(b - a, np.int64))
            ends = np.cumsum(sizes + 1)
            out = np.empty(int(ends[-1]), self.width)
            here = np.ones(len(out), bool)
            here[ends - 1] = False
            out[here], out[ends - 1] = ids, end
            yield pa.Array.from_buffers(pa.binary(), b - a, [
                None, pa.py_buffer(np.concatenate(([0], ends * unit)).astype(np.int32)), pa.py_buffer(out)])

    def encode_texts(self, column: list[str], end: int) -> list[bytes]:
        """:meth:`encode_column` for lists."""
        return [x for part in self.encode_column(pa.array(column, pa.string()), end) for x in part.to_pylist()]


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(name: str, spec: str) -> LibraryEncoder:
    """One encoder a worker process and file: its cache outlives the task."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = LibraryEncoder(spec)
    return _ENCODERS[name]


# ---------------------------------------------------------------------- codes

def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge (0: the id never occurs)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = max(limit, (n - 1).bit_length() + 2)
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, leaf_flags = np.empty(0), []
    for _ in range(limit):
        both = np.concatenate((leaves, packages))
        by = np.argsort(both, kind="stable")
        leaf_flags.append(by < n)
        merged = both[by]
        packages = merged[0:len(merged) // 2 * 2:2] + merged[1:len(merged) // 2 * 2:2]
    take = 2 * n - 2
    for flags in reversed(leaf_flags):
        chosen = int(flags[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    longest = int(lengths.max(initial=1))
    # a code's value at the longest length is the room taken by all codes before it
    room = (np.uint64(1) << (longest - lengths[order]).astype(np.uint64))
    before = np.concatenate(([0], np.cumsum(room)[:-1])).astype(np.uint64)
    codes[order] = before >> (longest - lengths[order]).astype(np.uint64)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload, and the bit offset of every ``STRIDE``-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = total // 32 + 2
    # a code of at most 32 bits lies in one or two 32-bit words
    value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), words)
    out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return out.astype(">u4").tobytes()[:-(-total // 8)], at[::STRIDE].astype("<u8")


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length by the next ``longest`` bits."""
    longest = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    room = 1 << (longest - lengths[order].astype(np.int64))
    ids = np.zeros(1 << longest, np.uint32)
    sizes = np.ones(1 << longest, np.int64)
    filled = int(room.sum())
    ids[:filled] = np.repeat(order, room)
    sizes[:filled] = np.repeat(lengths[order].astype(np.int64), room)
    return ids, sizes, longest


def unpack(payload: bytes, checkpoints: np.ndarray, n_ids: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block; all stretches between checkpoints advance together."""
    ids, sizes, longest = table
    raw = np.frombuffer(payload + b"\0" * 12, np.uint8)
    # the 64 bits from every byte on, so that any bit offset is one shift away
    at = checkpoints.astype(np.int64)
    out = np.empty((len(at), STRIDE), np.uint32)
    windows = np.lib.stride_tricks.sliding_window_view(raw, 8)
    steps = min(STRIDE, n_ids)
    for k in range(steps):
        live = len(at) if k < n_ids - (len(at) - 1) * STRIDE else len(at) - 1
        bits = np.ascontiguousarray(windows[at[:live] >> 3]).view(">u8").ravel().astype(np.uint64)
        code = (bits << (at[:live] & 7).astype(np.uint64)) >> np.uint64(64 - longest)
        out[:live, k] = ids[code]
        at[:live] += sizes[code]
    return out.ravel()[:n_ids]


# ---------------------------------------------------------------------- files

def _in_order(docs: DataFrame, encoder: LibraryEncoder, end: int) -> DataFrame:
    """Blocks of raw ids (part, block, doc_ids, sizes, n_ids, ids) in ascending doc_id order."""
    base = texts(docs).select(F.coalesce("doc_id", F.lit(_NO_DOC)).alias("key"), "doc_id", "text")
    parts = min(MAX_PARTS, base.count() // ROWS_PER_PART + 1)
    cuts = np.array(cut_points(base, "key", parts, 0.0005), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, a = pa.array(np.searchsorted(cuts, batch.column(0).to_numpy(), "right"), pa.int32()), 0
            for ids in encoder.encode_column(batch.column(2), end):
                rows = batch.slice(a, len(ids))
                yield pa.RecordBatch.from_arrays([part.slice(a, len(ids)), rows.column(0), rows.column(1), ids],
                                                 ["part", "key", "doc_id", "ids"])
                a += len(ids)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = None, 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []
        unit = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())),
                 pa.array([[len(x) // unit for x in ids]], pa.list_(pa.int64())), pa.array([size], pa.int64()),
                 pa.array([unit], pa.int32()), pa.array([b"".join(ids)], pa.binary())],
                ["part", "block", "doc_ids", "sizes", "n_ids", "unit", "ids"])

        for batch in batches:
            for p, d, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                unit = unit or _unit(encoder)
                if ids and (p != part or size + len(x) // unit > BLOCK_IDS):
                    yield flush()
                    number = number + 1 if p == part else 0
                    doc_ids, ids, size = [], [], 0
                part = p
                doc_ids.append(d)
                ids.append(x)
                size += len(x) // unit
        if ids:
            yield flush()

    encoded = base.mapInArrow(run, "part int, key bigint, doc_id bigint, ids binary")
    return (encoded.repartition("part").sortWithinPartitions("part", "key", "ids")
            .mapInArrow(blocks, "part int, block int, doc_ids array<bigint>, sizes array<bigint>, n_ids bigint, unit int, ids binary"))


def _unit(encoder: LibraryEncoder) -> int:
    if encoder.library is None:
        encoder._open()
    return int(encoder.width[-1])


def _count_ids(blocks: DataFrame) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for unit, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                some = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{unit}"))
                if len(some) > len(total):
                    some[:len(total)] += total
                    total = some
                else:
                    total[:len(some)] += some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = blocks.select("unit", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counts.collect()}  # at most one row for each id of the vocabulary


def write_ids(docs: DataFrame, encoder: LibraryEncoder, folder: str, end: int = 1) -> None:
    """Encode ``docs`` (doc_id, text), append ``end`` to each, and write the files."""
    raw = stage(_in_order(docs, encoder, end), compression="zstd")
    counts = _count_ids(raw)
    total = np.zeros(max(counts, default=0) + 1, np.int64)
    total[list(counts)] = list(counts.values())
    lengths = code_lengths(total)
    codes = canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = np.frombuffer(row.column(6)[0].as_buffer(), f"<u{row.column(5)[0].as_py()}")
                payload, marks = pack(ids, lengths, codes)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:5], pa.array([payload], pa.binary()), pa.array([marks.tobytes()], pa.binary())],
                    ["part", "block", "doc_ids", "sizes", "n_ids", "payload", "checkpoints"])

    raw.mapInArrow(run, "part int, block int, doc_ids array<bigint>, sizes array<bigint>, n_ids bigint, payload binary, checkpoints binary"
                   ).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    spark = docs.sparkSession
    written = spark.read.parquet(f"{folder}/blocks").select("part", "block", "n_ids")
    # one total for each part (at most MAX_PARTS), then running sums inside the parts
    totals = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = [0, *np.cumsum([n for _, n in totals]).tolist()]
    firsts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before)], "part int, first bigint")
    inside = F.expr("coalesce(sum(n_ids) over (partition by part order by block rows between unbounded preceding and 1 preceding), 0)")
    (written.join(firsts, "part").select("part", "block", (F.col("first") + inside).alias("start"), "n_ids")
     .write.parquet(f"{folder}/index"))
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{folder}/lengths")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Decode the files below ``folder``: ``doc_id, start, n_tokens, ids`` (binary,
    little-endian unsigned 32-bit) for each document."""
    rows = spark.read.parquet(f"{folder}/lengths").collect()  # at most one row for each id
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for r in rows:
        lengths[r["id"]] = r["length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, doc_ids, sizes, n_ids = (batch.column(c)[i].as_py() for c in range(5))
                payload, marks = batch.column(5)[i].as_py(), np.frombuffer(batch.column(6)[i].as_buffer(), "<u8")
                ids = unpack(payload, marks, n_ids, table).astype("<u4").tobytes()
                ends = np.cumsum(sizes).tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(sizes), pa.int32()), pa.array([block] * len(sizes), pa.int32()),
                     pa.array(doc_ids, pa.int64()), pa.array(begins, pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array([ids[4 * a:4 * b] for a, b in zip(begins, ends)], pa.binary())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "doc_ids", "sizes", "n_ids", "payload", "checkpoints")
    index = spark.read.parquet(f"{folder}/index").select("part", "block", "start")
    documents = blocks.mapInArrow(run, "part int, block int, doc_id bigint, inside bigint, n_tokens bigint, ids binary")
    return documents.join(index, ["part", "block"]).select(
        "doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids")


def new_folder(spark: SparkSession) -> str:
    """A folder of this application's own for files that only it needs."""
    return application_scratch(spark).new_path("ids")
