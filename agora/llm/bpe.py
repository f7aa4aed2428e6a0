"""Byte-level BPE encoding and decoding with a segment tree over pair ranks (operator 5).

A pretoken is a row of symbols.  The leaves of a segment tree hold, for each adjacent pair, its
merge rank with its position below it; the smallest value, at the root, is therefore the
leftmost pair of lowest rank.  Merging it changes three leaves (the pair, its right neighbour,
its left neighbour), each updated on its path to the root, until the root holds no pair.

``merge_rows`` does this for many pretokens of similar length at once: all trees are one matrix
and every step merges the root's pair of each row that still has one.  ``merge_one`` is the same
for a single, long pretoken.  A bounded two-generation cache keeps the ids of frequent pieces.

Defined results: null is the empty text, which has no tokens; the special tokens' strings in a
text are encoded as those tokens, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from agora.llm.common import texts

#: White space as the tokenizer's pattern has it (fixed by Unicode's White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
#: The byte-level pretoken pattern (fixed values).
_PRETOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|["
             + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+")
_ODD_SPACE = re.compile(r"[^\S \n]")
_NONE = np.int64(1) << 62
CACHE_ENTRIES = 150_000
STEP_CHARS = 1 << 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte: itself if it is printable Latin-1,
    else the next code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairEncoder:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, spec: dict):
        self.name = hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()
        model = spec["model"]
        if model.get("end_of_word_suffix") or model.get("byte_fallback") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only plain byte-level BPE files are supported")
        vocab: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.byte_ids = np.zeros(256, np.int64)
        for char, b in symbols.items():
            self.byte_ids[b] = vocab[char]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self._ready()

    def _ready(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pattern = regex.compile(_PRETOKEN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __reduce__(self):
        # one encoder a worker process and file: its cache outlives the task
        state = {k: v for k, v in self.__dict__.items() if k not in ("young", "old", "pattern", "specials")}
        return _encoder, (self.name, state)

    @staticmethod
    def load(path: str) -> BytePairEncoder:
        with open(path, encoding="utf-8") as f:
            return BytePairEncoder(json.load(f))

    # ------------------------------------------------------------------ merges

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs; ``_NONE`` for pairs without a merge (or a symbol < 0)."""
        key = left << 32 | right
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[place] == key) & (left >= 0) & (right >= 0), self.pair_ranks[place], _NONE)

    def merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Merge each row of ``symbols`` (n x width, width a power of two, padded with -1);
        symbols that were merged into their left neighbour become -1."""
        n, width = symbols.shape
        place = np.arange(width)
        following = np.broadcast_to(np.minimum(place + 1, width), (n, width)).copy()
        leading = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE)
        ranks = self._ranks(symbols[:, :-1], symbols[:, 1:])
        tree[:, width:-1] = np.where(ranks < _NONE, ranks << 20 | place[:-1], _NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = tree[row, 1]
            at = root & ((1 << 20) - 1)
            gone = following[row, at]
            after = following[row, gone]
            before = leading[row, at]
            symbols[row, at] = self.merged[root >> 20]
            symbols[row, gone] = -1
            following[row, at] = after
            inner = after < width
            leading[row[inner], after[inner]] = at[inner]
            right = np.where(inner, symbols[row, np.minimum(after, width - 1)], -1)
            left = np.where(before >= 0, symbols[row, np.maximum(before, 0)], -1)
            own = symbols[row, at]
            rank_right, rank_left = self._ranks(own, right), self._ranks(left, own)
            tree[row, width + gone] = _NONE
            tree[row, width + at] = np.where(rank_right < _NONE, rank_right << 20 | at, _NONE)
            has = before >= 0
            tree[row[has], width + before[has]] = np.where(rank_left < _NONE, rank_left << 20 | before, _NONE)[has]
            node = np.concatenate((width + gone, width + at, width + before[has])) >> 1
            of = np.concatenate((row, row, row[has]))
            while node[0]:
                tree[of, node] = np.minimum(tree[of, 2 * node], tree[of, 2 * node + 1])
                node >>= 1
            row = row[tree[row, 1] < _NONE]
        return symbols

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The same for one row of any length, in logarithmic time a merge."""
        n = len(symbols)
        width = 1 << max(n - 1, 1).bit_length()
        none = 1 << 100
        ranks = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist())) if n > 64 else None

        def value(a: int, b: int, at: int) -> int:
            key = a << 32 | b
            if ranks is not None:
                rank = ranks.get(key)
            else:
                place = int(np.searchsorted(self.pair_keys, key))
                rank = int(self.pair_ranks[place]) if place < len(self.pair_keys) and self.pair_keys[place] == key else None
            return none if rank is None else rank << 40 | at

        tree = [none] * (2 * width)
        for i in range(n - 1):
            tree[width + i] = value(symbols[i], symbols[i + 1], i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(leaf: int, new: int) -> None:
            node = width + leaf
            tree[node] = new
            node >>= 1
            while node:
                tree[node] = min(tree[2 * node], tree[2 * node + 1])
                node >>= 1

        following, leading = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        while tree[1] < none:
            at, rank = tree[1] & ((1 << 40) - 1), tree[1] >> 40
            gone = following[at]
            after, before = following[gone], leading[at]
            symbols[at] = int(self.merged[rank])
            alive[gone] = False
            following[at] = after
            put(gone, none)
            if after < n:
                leading[after] = at
                put(at, value(symbols[at], symbols[after], at))
            else:
                put(at, none)
            if before >= 0:
                put(before, value(symbols[before], symbols[at], before))
        return [s for s, a in zip(symbols, alive) if a]

    def encode_pretokens(self, pretokens: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of each distinct pretoken."""
        pretokens = list(pretokens)
        raw = [t.encode() for t in pretokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        widths = 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64)
        out: dict[str, bytes] = {}
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            if width > 256:
                for i in rows.tolist():
                    ids = self.merge_one(self.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist())
                    out[pretokens[i]] = np.array(ids, "<u4").tobytes()
                continue
            step = max(1, (1 << 17) // width)
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                of = part.tolist()
                symbols = np.full((len(part), width), -1, np.int64)
                symbols[np.arange(width) < sizes[part][:, None]] = self.byte_ids[
                    np.frombuffer(b"".join([raw[i] for i in of]), np.uint8)]
                symbols = self.merge_rows(symbols)
                live = symbols >= 0
                flat = symbols[live].astype("<u4").tobytes()
                ends = np.cumsum(live.sum(1)) * 4
                out.update(zip([pretokens[i] for i in of],
                               [flat[x:y] for x, y in zip([0, *ends[:-1].tolist()], ends.tolist())]))
        return out

    # -------------------------------------------------------------------- text

    def _pieces(self, text: str) -> list[str]:
        """Cut a text into pieces that are encoded independently of each other.

        A pretoken that holds a space before a non-space starts with that space, and a single
        line feed between non-spaces is a pretoken, so texts without other white space are cut
        before every space and line feed.  A piece's first character says how it was cut:
        a line feed is part of it, '\\r' (text start) and '\\t' (a pretoken) are not, and any
        other piece is preceded by a space."""
        if (text and not text[0].isspace() and not text[-1].isspace() and "  " not in text and "\n\n" not in text
                and " \n" not in text and "\n " not in text and not _ODD_SPACE.search(text)):
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\r" + pieces[0]
            return pieces
        return ["\t" + p for p in self.pattern.findall(text)]

    def _pretokens(self, piece: str) -> list[str]:
        if piece.isalpha():  # one run of letters, the commonest case
            return [" " + piece]
        if piece[0] == "\t":
            return [piece[1:]]
        if piece[0] == "\r":
            return self.pattern.findall(piece[1:])
        return self.pattern.findall(piece if piece[0] == "\n" else " " + piece)

    def _learn(self, missing: set[str]) -> None:
        pretokens = {p: self._pretokens(p) for p in missing}
        ids = self.encode_pretokens({t for parts in pretokens.values() for t in parts})
        if len(self.young) + len(missing) > CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        for piece, parts in pretokens.items():
            self.young[piece] = ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts))

    def encode_texts(self, column: list[str]) -> list[bytes]:
        """Ids of each text (little-endian unsigned 32-bit)."""
        parts: list[list[str | bytes]] = []
        for text in column:
            found = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
            parts.append([np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._pieces(p) for k, p in enumerate(found)])
        missing = set().union(*(p for row in parts for p in row if isinstance(p, list))).difference(self.young)
        for piece in [p for p in missing if p in self.old]:
            self.young[piece] = self.old[piece]
            missing.discard(piece)
        if missing:
            before = self.young
            self._learn(missing)
            if self.young is not before:  # the generations moved on: this call's pieces stay at hand
                for row in parts:
                    for p in row:
                        if isinstance(p, list):
                            for piece in p:
                                if piece not in self.young:
                                    self.young[piece] = self.old[piece]
        get = self.young.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in row) for row in parts]

    def decode_ids(self, ids: bytes) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_ENCODERS: dict[str, BytePairEncoder] = {}


def _encoder(name: str, state: dict) -> BytePairEncoder:
    if name not in _ENCODERS:
        made = BytePairEncoder.__new__(BytePairEncoder)
        made.__dict__.update(state)
        made._ready()
        _ENCODERS.clear()  # one file at a time keeps memory bounded
        _ENCODERS[name] = made
    return _ENCODERS[name]


def _steps(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    first, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, bpe: BytePairEncoder) -> DataFrame:
    """``doc_id, ids`` (binary: little-endian unsigned 32-bit ids) for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _steps(pc.binary_length(batch.column(1)).to_pylist(), STEP_CHARS):
                column = batch.column(1)[a:b].to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(bpe.encode_texts(column), pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids binary")


def decode(tokens: DataFrame, bpe: BytePairEncoder) -> DataFrame:
    """``doc_id, ids, text`` for every row of ``tokens`` (doc_id, ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _steps(pc.binary_length(batch.column(1)).to_pylist(), 4 * STEP_CHARS):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b],
                     pa.array([bpe.decode_ids(x.as_buffer()) for x in batch.column(1)[a:b]], pa.string())], ["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, text string")


def round_trip(docs: DataFrame, bpe: BytePairEncoder) -> DataFrame:
    """``doc_id, ids, text``: what :func:`decode` gives for what :func:`encode` gives, in one pass
    and one Python worker a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _steps(pc.binary_length(batch.column(1)).to_pylist(), STEP_CHARS):
                ids = bpe.encode_texts(batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(ids, pa.binary()),
                     pa.array([bpe.decode_ids(x) for x in ids], pa.string())], ["doc_id", "ids", "text"])

    return texts(docs).mapInArrow(run, "doc_id bigint, ids binary, text string")
