"""Removal of repeated substrings by two-stage suffix sorting (operator 7).

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts somewhere else.

1. *Anchors.*  Each window of ``LENGTH`` bytes names the leftmost smallest hash among its
   ``GRAM``-byte grams. Equal windows name equal anchors at equal offsets, so two equal windows
   always share an anchor. An anchor's context are the bytes of all windows it can be named by.
2. *Grouping.*  Anchors are shuffled by their hash, equal contexts already merged within a task.
   A context that occurs twice is repeated as a whole. If an anchor has different contexts, one
   of each kind goes to the next step; anchors that occur once are dropped.
3. *Suffix sorting.*  The contexts of whole groups are joined to one text. Only suffixes smaller
   than their successors are sorted directly; the others are induced from them by scanning the
   buckets of first bytes from left to right. The common prefixes of neighbours then show which
   windows occur at two different places.
4. *Cutting.*  The repeated stretches of each document are united and cut out.

A group of more than ``HOT`` contexts (a passage inside very many different surroundings) is
not sorted in one task: its windows are counted by 128-bit hashes over all tasks instead.

Hashes of 64 bits for grams and contexts together decide equality in step 2. Rows are told apart
by (doc_id, hash of the text); repeated rows are different documents with equal text. Null and
empty texts have no bytes; a null doc_id is a document like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import groups_of_rows, mix, runs_of, stage, texts, utf8

LENGTH, GRAM = 200, 32
BACK = LENGTH - GRAM  # bytes of a context before its anchor
PART = 144
PART_BACK = (0, 56, 112)  # where the parts start, before the anchor: BACK / 3 apart
HOT = 20_000
HOLD = 100_000
SORT_BYTES = 1 << 20
PIECE = 1 << 18
_NO_DOC = -(1 << 63)
_BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25


def _windows(data: np.ndarray, widest: int, seed: int = 0) -> dict[int, np.ndarray]:
    """Polynomial hashes of all windows of 1, 2, 4 .. ``widest`` bytes (where they fit)."""
    out = {1: _BYTE_KEYS[data] ^ np.uint64(seed)}
    width, base = 1, (_BASE + 2 * seed) % (1 << 64) | 1
    while width < widest and len(out[width]) > width:
        h = out[width]
        out[2 * width] = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    return out


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts ``data[at[i]:at[i + 1]]``: row, context start and end (in the text), anchor
    hash, context hash and part hashes (21 bits each, 0 if the part leaves the text)."""
    columns: list[tuple[np.ndarray, ...]] = []
    for a, b in groups_of_rows(at, PIECE):
        piece, cuts = data[at[a]:at[b]], at[a:b + 1] - at[a]
        if len(piece) < LENGTH:
            continue
        h = _windows(piece, 256)
        gram = mix(h[GRAM])
        # the upper half of the hash with the place below it: the smallest is the leftmost smallest
        best = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        span, width = BACK + 1, 1
        while 2 * width <= span:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        if span > width:
            best = np.minimum(best[:len(best) - (span - width)], best[span - width:])
        # windows inside one text
        room = np.zeros(len(piece) + 1, np.int8)
        long = np.diff(cuts) >= LENGTH
        room[cuts[:-1][long]] += 1
        room[(cuts[1:] - LENGTH + 1)[long]] -= 1
        inside = np.cumsum(room[:len(best)]) > 0
        named = best[inside] & np.uint64(0xFFFFFFFF)
        place = named[np.concatenate(([True], named[1:] != named[:-1]))].astype(np.int64) if len(named) else np.empty(0, np.int64)
        row = np.searchsorted(cuts, place, "right") - 1
        start, end = np.maximum(cuts[row], place - BACK), np.minimum(cuts[row + 1], place + LENGTH)
        size = end - start
        # two overlapping windows and the shape stand for the whole context
        context = np.empty(len(place), np.uint64)
        for width in (128, 256):
            which = (size >= 256) == (width == 256)
            if which.any():
                x = h[width]
                context[which] = mix(x[start[which]] * np.uint64(3) + mix(x[end[which] - width]))
        context = mix(context + (size * 1000 + place - start).astype(np.uint64))
        # every window that names this anchor covers one of three overlapping parts of PART bytes
        parts = np.zeros(len(place), np.uint64)
        for k, back in enumerate(PART_BACK):
            first = place - back
            fits = (first >= cuts[row]) & (first + PART <= cuts[row + 1])
            x = h[128]
            part = mix(x[first[fits]] * np.uint64(7) + mix(x[first[fits] + PART - 128])) >> np.uint64(44)
            parts[fits] |= (part | np.uint64(1 << 20)) << np.uint64(21 * k)
        begin = cuts[row]
        columns.append((row + a, start - begin, end - begin, gram[place], context, parts))
    if not columns:
        return tuple(np.empty(0, t) for t in (np.int64,) * 3 + (np.uint64,) * 3)
    return tuple(np.concatenate(c) for c in zip(*columns))


_FOUND = "kind int, gram bigint, context bigint, parts bigint, doc bigint, text_hash bigint, start int, end int"
_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_SPAN, _ONE, _MANY = 0, 1, 2  # a repeated stretch; a context seen once; a context seen more often


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = [np.int32, np.int64, np.int64, np.int64, np.int64, np.int64, np.int32, np.int32]
    return pa.RecordBatch.from_arrays(
        [pa.array(c.view(np.int64).astype(k, copy=False) if c.dtype == np.uint64 else c.astype(k, copy=False))
         for c, k in zip(columns, kinds)], _NAMES)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per input batch: one row for each distinct (gram, context), and the stretches of contexts
    that occur several times in the batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, text_hash = (batch.column(i).to_numpy() for i in (1, 2))
        row, start, end, gram, context, parts = anchors(*utf8(batch.column(3)))
        if not len(row):
            continue
        order = np.lexsort((context, gram))
        row, start, end, gram, context, parts = (c[order] for c in (row, start, end, gram, context, parts))
        first = np.ones(len(row), bool)
        first[1:] = (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(row)))
        many = np.repeat(size > 1, size)
        kind = np.where(size > 1, _MANY, _ONE)
        yield _batch(kind, gram[first], context[first], parts[first], doc[row[first]], text_hash[row[first]], start[first], end[first])
        if many.any():
            spans = many & (end - start >= LENGTH)
            yield _united(doc[row[spans]], text_hash[row[spans]], start[spans], end[spans])


def _united(doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Stretches of the same text that touch become one."""
    order = np.lexsort((end, start, text_hash, doc))
    doc, text_hash, start, end = doc[order], text_hash[order], start[order], end[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (text_hash[1:] == text_hash[:-1]) & (start[1:] <= end[:-1])
    # contexts of one text start and end in the same order, so a gap to the one before is a new run
    begin = np.flatnonzero(~same)
    last = np.append(begin[1:], len(doc)) - 1
    zero = np.zeros(len(begin), np.int64)
    # spread by document in the shuffle by gram
    spread = mix(doc[begin].astype(np.uint64) ^ text_hash[begin].view(np.uint64))
    return _batch(zero + _SPAN, spread, zero, zero, doc[begin], text_hash[begin], start[begin], end[last])


def _contexts_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (gram, context): the first row of each context, whether the context
    occurs more than once, and the rows of those that do."""
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 1] != rows[:-1, 1]) | (rows[1:, 2] != rows[:-1, 2])
    which = np.cumsum(new) - 1
    many = (np.bincount(which) > 1) | (np.bincount(which, rows[:, 0] == _MANY) > 0)
    first = rows[new].copy()
    first[:, 0] = np.where(many, _MANY, _ONE)
    return first, many, rows[many[which]]


def _stretches(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(rows):
        yield _batch(np.zeros(len(rows), np.int64) + _SPAN, *rows[:, 1:].T)


def _alike(first: np.ndarray) -> np.ndarray:
    """Those contexts that share a part with another context of their group."""
    group = np.cumsum(np.concatenate(([True], first[1:, 1] != first[:-1, 1])))
    keep = np.zeros(len(first), bool)
    for k in range(len(PART_BACK)):
        part = first[:, 3] >> 21 * k & ((1 << 21) - 1)
        at = np.flatnonzero(part)
        key = group[at] << 21 | part[at]
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(at), bool)
        equal = key[order][1:] == key[order][:-1]
        same[1:] |= equal
        same[:-1] |= equal
        keep[at[order[same]]] = True
    return first[keep]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, context): emit repeated stretches and, of groups with several
    contexts, one row of each context that shares a part with another one. A group of more than
    ``HOLD`` contexts is not held back for that: all its contexts are given out."""
    held = np.empty((0, 8), np.int64)
    given_out: int | None = None  # the group whose contexts are given out as they come

    def finish(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows):
            first, _, repeated = _contexts_of(rows)
            yield from _stretches(repeated)
            found = _alike(first)
            if len(found):
                yield _batch(*found.T)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
        yield from _stretches(rows[rows[:, 0] == _SPAN])
        rows = np.vstack([held, rows[rows[:, 0] != _SPAN]])
        if not len(rows):
            continue
        last = int(np.argmax(rows[:, 1] == rows[-1, 1]))
        if given_out is not None:
            begin = int(np.argmax(np.append(rows[:, 1] != given_out, True)))
            first, _, repeated = _contexts_of(rows[:begin])
            yield from _stretches(repeated)
            if begin == len(rows):  # its last context may go on
                if len(first) > 1:
                    yield _batch(*first[:-1].T)
                held = first[-1:]
                continue
            yield _batch(*first.T)
            given_out = None
            yield from finish(rows[begin:last])
        else:
            yield from finish(rows[:last])
        held, _, repeated = _contexts_of(rows[last:])
        yield from _stretches(repeated)
        if len(held) > HOLD:
            given_out = int(held[0, 1])
            yield _batch(*held[:-1].T)
            held = held[-1:]
    if given_out is not None:
        yield _batch(*held.T)
    else:
        yield from finish(held)


def _eights(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight bytes from each place as a big-endian number, 0 after the first 0, and whether
    none of them is 0; eight more places of 0 follow the text."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    eight, alive = np.zeros(n + 8, np.uint64), np.ones(n + 8, bool)
    for k in range(8):
        byte = padded[k:k + n + 8]
        alive &= byte > 0
        eight = eight << np.uint64(8) | np.where(alive, byte, 0).astype(np.uint64)
    return eight, alive


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one to their right."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    if not len(change):
        return np.zeros(n, bool)
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    return (text < text[np.minimum(run_end + 1, n - 1)]) & (text > 0)


def _sort_directly(text: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` in the order of their suffixes, at least to ``depth`` bytes: eight bytes a
    round among the tied ones; ties that go on for 128 or 32 equal bytes skip those."""
    n = len(text)
    eight, alive = _eights(text)
    skips = {w: h for w, h in _windows(text, 128).items() if w in (32, 128)}
    places = places[np.argsort(eight[places], kind="stable")]
    first = np.ones(len(places), bool)
    first[1:] = eight[places[1:]] != eight[places[:-1]]
    group = np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))
    done = np.full(len(places), 8)
    open_ = alive[places]
    while True:
        tied = np.flatnonzero(open_ & (done <= depth) & ~(first & np.append(first[1:], True)))
        if not len(tied):
            return places
        own = group[tied]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        size = np.diff(np.append(heads, len(tied)))
        ahead = places[tied] + done[tied]
        skipped = np.zeros(len(heads), bool)
        for width, hashes in sorted(skips.items(), reverse=True):
            fits = ahead < len(hashes)
            value = hashes[np.minimum(ahead, len(hashes) - 1)]
            same = fits & (value == np.repeat(value[heads], size))
            whole = np.logical_and.reduceat(same, heads) & ~skipped
            done[tied[np.repeat(whole, size)]] += width
            skipped |= whole
        rest = np.repeat(~skipped, size)
        tied, own, ahead = tied[rest], own[rest], np.minimum(ahead[rest], n)
        if not len(tied):
            continue
        key = eight[ahead]
        by_key = np.argsort(key)
        rank = np.empty(len(tied), np.int64)
        rank[by_key] = np.cumsum(np.concatenate(([0], key[by_key][1:] != key[by_key][:-1])))
        order = np.argsort(own << 32 | rank)
        places[tied], rank = places[tied][order], rank[order]
        open_[tied] = alive[ahead][order]
        again = np.ones(len(tied), bool)
        again[1:] = (rank[1:] != rank[:-1]) | (own[1:] != own[:-1])
        first[tied] = again
        group[tied] = np.maximum.accumulate(np.where(again, tied, 0))
        done[tied] += 8


def suffix_order(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Two-stage order of the suffixes of ``text`` (bytes from 1 on; 0 ends a part) that start
    at a non-zero byte, by their bytes up to the next 0 or up to ``depth`` of them. ``wanted``
    limits the places; with a place that is larger than its successor it must hold that one."""
    n = len(text)
    smaller = _smaller(text)
    larger = (text > 0) & ~smaller
    if wanted is not None:
        smaller, larger = smaller & wanted, larger & wanted
    # stage 1: sort the smaller ones directly
    direct = _sort_directly(text, np.flatnonzero(smaller), depth)
    # stage 2: scan the buckets from left to right; a suffix puts the one to its left, if that is
    # larger than it, at the front of its bucket's free room
    prior_larger = np.concatenate(([False], larger[:-1]))  # the suffix one to the left is induced
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    edges = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    out: list[np.ndarray] = []

    def scan(rows: np.ndarray, byte: int) -> np.ndarray:
        """Put left neighbours into later buckets; return those of the same bucket."""
        left = rows[prior_larger[rows]] - 1
        to = text[left]
        same = left[to == byte]
        other = left[to != byte]
        if len(other):
            order = np.argsort(text[other], kind="stable")
            other = other[order]
            bounds = np.flatnonzero(np.diff(text[other])) + 1
            for part in np.split(other, bounds):
                waiting[text[part[0]]].append(part)
        return same

    scan(np.flatnonzero(text == 0), 0)
    if n and larger[n - 1]:  # the end of the text is its smallest suffix
        waiting[text[n - 1]].insert(0, np.array([n - 1]))
    for byte in range(1, 256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        waiting[byte] = []
        while len(wave):  # runs of one byte grow from right to left
            out.append(wave)
            wave = scan(wave, byte)
        own = direct[edges[byte]:edges[byte + 1]]
        if len(own):
            out.append(own)
            scan(own, byte)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to a 0 or ``cap``."""
    eight, alive = _eights(text)
    n = len(text)
    out = np.zeros(len(order), np.int64)
    one, other, going = order[1:], order[:-1], np.arange(1, len(order))
    done = 0
    while len(going) and done < cap:
        x, y = eight[np.minimum(one + done, n)], eight[np.minimum(other + done, n)]
        whole = (x == y) & alive[np.minimum(one + done, n)]
        ended = ~whole
        if ended.any():
            # equal leading bytes: those before the first different one, or before the common 0
            differ, value = (x ^ y)[ended], x[ended]
            shared = np.zeros(len(differ), np.int64)
            for k in range(1, 8):
                low = np.uint64(8 * (8 - k))
                shared += ((differ >> low) == 0) & (((value >> low) & np.uint64(255)) > 0)
            out[going[ended]] = done + shared
        one, other, going = one[whole], other[whole], going[whole]
        done += 8
    out[going] = cap
    return np.minimum(out, cap)


def repeated_windows(contexts: list[bytes], doc: np.ndarray, text_hash: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, first byte, end) of stretches within the contexts whose windows of ``LENGTH``
    bytes all occur at two places or more; place = (doc, text_hash, start + offset)."""
    sizes = np.array([len(c) for c in contexts])
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.frombuffer(b"".join(c.translate(_SHIFT) + b"\0" for c in contexts), np.uint8)
    # the places where a window starts, and on from the last one to the next directly sorted place
    last = begin + sizes - LENGTH
    stops = np.flatnonzero(_smaller(text) | (text == 0))
    edge = np.zeros(len(text) + 1, np.int8)
    edge[begin] += 1
    edge[stops[np.searchsorted(stops, last)] + 1] -= 1
    order = suffix_order(text, LENGTH, np.cumsum(edge[:-1]) > 0)
    at = np.searchsorted(begin, order, "right") - 1
    room = order <= last[at]
    order, at = order[room], at[room]
    if not len(order):
        return []
    prefix = common_prefixes(text, order, LENGTH)
    bounds = np.flatnonzero(np.concatenate(([True], prefix[1:] < LENGTH)))  # neighbours with equal windows
    # different places within a cluster; copies of one place in two contexts are no repeat
    source = mix(mix(doc.astype(np.uint64) + mix(text_hash.view(np.uint64)))[at] + (start[at] + order - begin[at]).astype(np.uint64))
    differs = np.minimum.reduceat(source, bounds) != np.maximum.reduceat(source, bounds)
    flagged = np.zeros(len(text) + LENGTH, bool)
    flagged[order[np.repeat(differs, np.diff(np.append(bounds, len(order))))]] = True
    s, e = runs_of(flagged)
    which = np.searchsorted(begin, s, "right") - 1
    return list(zip(which.tolist(), (s - begin[which]).tolist(), (e - begin[which] - 1 + LENGTH).tolist()))


#: Bytes shifted by one, so that 0 can end a part; UTF-8 never has the byte 255.
_SHIFT = bytes([*range(1, 256), 255])
_CUT = "gram bigint, doc bigint, text_hash bigint, start int, kind int, context binary, window_hi bigint, window_lo bigint"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted contexts out of the texts; of hot anchors, hash their windows."""
    for batch in batches:
        _, doc, text_hash, text, wanted = batch.columns
        out: dict[str, list] = {c.split()[0]: [] for c in _CUT.split(", ")}
        for d, t, x, items in zip(doc.to_pylist(), text_hash.to_pylist(), text, wanted.to_pylist()):
            raw = x.as_py().encode()
            for w in items:
                piece = raw[w["start"]:w["end"]]
                if not w["hot"]:
                    row = [(w["gram"], d, t, w["start"], w["kind"], piece, None, None)]
                else:
                    hi, lo = (_hash200(np.frombuffer(piece, np.uint8), seed) for seed in (1, 2))
                    row = [(w["gram"], d, t, w["start"] + i, w["kind"], None, a, b) for i, (a, b) in enumerate(zip(hi, lo))]
                for r in row:
                    for column, value in zip(out.values(), r):
                        column.append(value)
        if out["doc"]:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out.values(), kinds)], list(out))


def _hash200(data: np.ndarray, seed: int) -> list[int]:
    if len(data) < LENGTH:
        return []
    h = _windows(data, 128, seed)[128]
    n = len(data) - LENGTH + 1
    return mix(h[:n] * np.uint64(5) + mix(h[LENGTH - 128:LENGTH - 128 + n])).view(np.int64).tolist()


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gram: suffix-sort whole groups, about ``SORT_BYTES`` at a time."""
    rows: list[tuple] = []
    size, last = 0, None

    def work() -> Iterator[pa.RecordBatch]:
        doc, text_hash, start = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        own = [r[4] == _ONE for r in rows]
        found = [x for x in repeated_windows([r[5] for r in rows], doc, text_hash, start) if own[x[0]]]
        if found:
            which = np.array([x[0] for x in found])
            yield pa.RecordBatch.from_pydict({
                "doc": doc[which], "text_hash": text_hash[which],
                "start": pa.array(start[which] + [x[1] for x in found], pa.int32()),
                "end": pa.array(start[which] + [x[2] for x in found], pa.int32())})

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[0] != last and size > SORT_BYTES:
                yield from work()
                rows, size = [], 0
            last = r[0]
            rows.append(r)
            size += len(r[5])
    if rows:
        yield from work()


def repeated_spans(docs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` as (doc_id, doc, text_hash, text), and their repeated stretches
    (doc, text_hash, start, end) in bytes; stretches may overlap."""
    base = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(_NO_DOC)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    found = base.mapInArrow(_occurrences, _FOUND)
    grouped = stage(found.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(_grouped, _FOUND))
    spans = grouped.where(F.col("kind") == _SPAN).select("doc", "text_hash", "start", "end")
    mixed = grouped.where(F.col("kind") != _SPAN)
    # at most (rows / hot) anchors
    over = mixed.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(True).alias("over"))
    wanted = (mixed.join(over, "gram", "left")
              .groupBy("doc", "text_hash").agg(F.collect_list(F.struct(
                  "gram", "kind", "start", "end", F.coalesce("over", F.lit(False)).alias("hot"))).alias("wanted")))
    cut = (base.join(wanted, ["doc", "text_hash"])
           .select("doc_id", "doc", "text_hash", "text", "wanted").mapInArrow(_contexts, _CUT))
    any_hot = not over.isEmpty()
    if any_hot:
        cut = stage(cut)
    sorted_ = (cut.where(F.col("context").isNotNull()).select("gram", "doc", "text_hash", "start", "kind", "context")
               .repartition("gram").sortWithinPartitions("gram")
               .mapInArrow(_sorted_groups, "doc bigint, text_hash bigint, start int, end int"))
    spans = spans.unionByName(sorted_)
    if any_hot:
        windows = cut.where(F.col("context").isNull()).select("window_hi", "window_lo", "doc", "text_hash", "start").distinct()
        twice = windows.groupBy("window_hi", "window_lo").count().where("count > 1").select("window_hi", "window_lo")
        spans = spans.unionByName(windows.join(twice, ["window_hi", "window_lo"]).select(
            "doc", "text_hash", "start", (F.col("start") + LENGTH).cast("int").alias("end")))
    return base, spans


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (the bytes that stay; a cut may split a character)."""
    base, spans = repeated_spans(docs, hot)
    by_row = spans.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, parts, reached, removed, count = text.encode(), [], 0, 0, 0
                for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                    if s > reached or not count:
                        parts.append(raw[reached:s])
                        count += 1
                        reached = max(reached, s)
                    removed += max(0, e - reached)
                    reached = max(reached, e)
                parts.append(raw[reached:])
                n_bytes.append(len(raw))
                n_removed.append(removed)
                n_spans.append(count)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return (base.join(by_row, ["doc", "text_hash"], "left").select("doc_id", "text", "spans")
            .mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))
