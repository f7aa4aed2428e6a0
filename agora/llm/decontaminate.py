"""Benchmark decontamination by suffix arrays over training shards (operator 2).

The benchmark's words get ids; every other word is 0 and ends a suffix, because no benchmark
suffix can match across it.  A task cuts its documents into shards of about ``SHARD_BYTES`` of
text (a longer document is a shard of its own), builds the word suffix array of each shard by
prefix doubling, and binary-searches every suffix of every benchmark item in it, one word
deeper at a time.  Equal windows are searched once, whatever the number of items that hold them:
the interval at the window's depth holds all occurrences of the window, and a window knows the set
of its items, which is stored once for all windows that share it.  The longest match at a place is
found the other way, in the suffix array of the distinct items; of each stretch of hits the matches
that no other one contains are kept.

The benchmark is cut by running byte totals into blocks of at most ``BLOCK_BYTES`` of text (an
item longer than that is a block of its own).  One block at a time is brought to the driver, sent
to the tasks and its hits written; with several blocks the hits of a document are merged
afterwards.  Words are found by 64-bit hashes; the bytes of every hit word are compared afterwards,
and a word that only shares a hash is taken out and its shard searched again.

Defined results: null and empty texts have no words and no hits; items without words match
nothing; items without an id match nothing or, with ``unnamed``, hit but are not listed; rows that repeat an item_id are one item; repeated documents are
judged alike, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.common import groups_of_rows, hash_tokens, keep_rows, segments, stage, text_hash, texts, utf8

SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20
#: What an item weighs besides its text, so that empty ones are bounded as well.
ROW_BYTES = 64

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[128:] = np.arange(128, 256)
for _low, _high in ((48, 58), (97, 123)):
    _SYMBOL[_low:_high] = np.arange(_low, _high)
_SYMBOL[65:91] = np.arange(97, 123)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``data[at[i]:at[i + 1]]``, word counts by text, and the
    lower-cased words' lengths and bytes back to back."""
    hashes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    sizes, symbols = [np.empty(0, np.int64)], [np.empty(0, np.uint8)]
    for a, b in groups_of_rows(at):
        cuts = at[a:b + 1] - at[a]
        symbol = _SYMBOL[data[at[a]:at[b]]]
        starts, lengths = segments((symbol > 0).view(np.int8), cuts[:-1])
        symbols.append(symbol[symbol > 0])
        sizes.append(lengths)
        hashes.append(hash_tokens(symbols[-1], lengths))
        counts.append(np.diff(np.searchsorted(starts, cuts)))
    return tuple(np.concatenate(x) for x in (hashes, counts, sizes, symbols))


def _bytes_of(words: np.ndarray, begin: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined bytes of the given words, which begin at ``begin`` (one more at the end)."""
    size = begin[words + 1] - begin[words]
    first = begin[words] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(words) else size
    return size, symbols[np.repeat(first, size) + np.arange(int(size.sum()))]


def _begins(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def _same_bytes(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the words of two lists, given by lengths and bytes, are equal one by one."""
    same = a[0] == b[0]
    if same.all() and len(same):
        differs = np.concatenate(([0], np.cumsum(a[1] != b[1])))
        ends = np.cumsum(a[0])
        same = differs[ends] == differs[ends - a[0]]
    elif len(same):
        ends, others = _begins(a[0]), _begins(b[0])
        for i in np.flatnonzero(same).tolist():
            same[i] = (a[1][ends[i]:ends[i + 1]] == b[1][others[i]:others[i + 1]]).all()
    return same


@dataclass(frozen=True)
class Benchmark:
    """A block of benchmark items: the distinct items as word ids (item i is
    ``ids[at[i]:at[i + 1] - 1]``, a 0 follows), their suffix array, and their distinct windows
    (rows of word ids, 0 beyond an item that is shorter) with the sets of items that hold them."""

    vocabulary: np.ndarray
    #: lengths and bytes of the vocabulary's words
    spelled: tuple[np.ndarray, np.ndarray]
    ids: np.ndarray
    at: np.ndarray
    order: np.ndarray
    #: smallest id of the equal items, if any has one
    item_id: np.ndarray
    named: np.ndarray
    windows: np.ndarray
    width: np.ndarray
    #: number of each window's set, and the sets as arrays of item ids
    set_of: np.ndarray
    sets: list[np.ndarray]
    window: int

    @staticmethod
    def of(rows: list[tuple[int | None, str]], window: int) -> Benchmark:
        raw = [(text or "").encode() for _, text in rows]
        at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        hashes, counts, lengths, symbols = word_hashes(np.frombuffer(b"".join(raw), np.uint8), at)
        vocabulary, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        spelled = _bytes_of(first, _begins(lengths), symbols)
        again = _bytes_of(word, _begins(spelled[0]), spelled[1])
        if not (np.array_equal(again[0], lengths) and np.array_equal(again[1], symbols)):
            raise RuntimeError("two words of the benchmark share a hash")
        ends = _begins(counts)
        holders: dict[bytes, list[int | None]] = {}
        for i, (item_id, _) in enumerate(rows):
            if counts[i]:
                holders.setdefault((word[ends[i]:ends[i + 1]] + 1).astype(np.int32).tobytes(), []).append(item_id)
        items = [np.frombuffer(x, np.int32) for x in holders]
        ids = np.concatenate([np.append(x, np.int32(0)) for x in items] or [np.empty(0, np.int32)])
        at = _begins(np.array([len(x) + 1 for x in items], np.int64))
        known = [sorted({i for i in x if i is not None}) for x in holders.values()]
        # the windows of all items, each once, and which items hold it
        size = np.diff(at) - 1
        width = np.minimum(size, window)
        item = np.repeat(np.arange(len(items)), size - width + 1)
        place = np.arange(len(item)) - np.repeat(_begins(size - width + 1)[:-1], size - width + 1)
        cells = np.arange(window)[None, :]
        start = (at[:-1][item] + place)[:, None]
        padded = np.concatenate((ids, np.zeros(window, np.int32)))
        grid = np.where(cells < width[item][:, None], padded[start + cells], 0).astype(np.int32)
        windows, which = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.empty(0, np.int64))
        pairs = np.unique(np.stack([which.ravel(), item], 1), axis=0)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1))
        numbers: dict[bytes, int] = {}
        set_of = np.array([numbers.setdefault(pairs[a:b, 1].tobytes(), len(numbers)) for a, b in zip(cuts[:-1], cuts[1:])], np.int64)
        sets = [np.unique(np.concatenate([np.array(known[i], np.int64) for i in np.frombuffer(x, np.int64)])) for x in numbers]
        return Benchmark(vocabulary, spelled, ids, at, suffix_array(ids, int(size.max(initial=0)) + 1) if len(ids) else np.empty(0, np.int64),
                         np.array([x[0] if x else 0 for x in known], np.int64), np.array([bool(x) for x in known], bool),
                         windows, (windows > 0).sum(1), set_of, sets, window)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids of ``hashes``, 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place + 1, 0).astype(np.int32)


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes that begin with a non-zero id, sorted by their ids up to the first
    0 or ``depth`` ids; prefix doubling from packed words of several ids."""
    bits = max(int(ids.max(initial=1)).bit_length(), 1)
    per = max(1, 63 // bits)
    padded = np.concatenate((ids, np.zeros(per, ids.dtype))).astype(np.int64)
    key, alive = padded[:len(ids)].copy(), ids > 0
    for j in range(1, per):
        ahead = padded[j:j + len(ids)]
        alive = alive & (ahead > 0)
        key = key << bits | np.where(alive, ahead, 0)
    start = np.flatnonzero(ids > 0)
    sa = start[np.argsort(key[start], kind="stable")]
    ranks = np.zeros(len(ids) + 1, np.int64)
    first = np.ones(len(sa), bool)
    first[1:] = key[sa[1:]] != key[sa[:-1]]
    group = np.maximum.accumulate(np.where(first, np.arange(len(sa)), 0))
    ranks[sa] = group + 1
    open_ = alive[sa]  # suffixes that go on after the words compared so far
    done = per
    while done < depth:
        tied = np.flatnonzero(open_ & ~(first & np.append(first[1:], True)))
        if not len(tied):
            break
        # tied rows of one group are neighbours: an open group is open as a whole
        ahead = ranks[np.minimum(sa[tied] + done, len(ids))]
        order = np.lexsort((ahead, group[tied]))
        sa[tied], ahead = sa[tied][order], ahead[order]
        again = np.ones(len(tied), bool)
        again[1:] = (ahead[1:] != ahead[:-1]) | (group[tied][1:] != group[tied][:-1])
        first[tied] = again
        group[tied] = np.maximum.accumulate(np.where(again, tied, 0))
        open_[tied] = ahead > 0
        ranks[sa[tied]] = group[tied] + 1
        done *= 2
    return sa


def _bound(words: np.ndarray, sa: np.ndarray, low: np.ndarray, high: np.ndarray, ahead: int,
           target: np.ndarray, right: bool) -> np.ndarray:
    """Binary search in each [low, high) for ``target`` among the words ``ahead`` of the suffixes."""
    low, high = low.copy(), high.copy()
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            return low
        middle = (low[going] + high[going]) // 2
        word = words[sa[middle] + ahead]
        less = word <= target[going] if right else word < target[going]
        low[going] = np.where(less, middle + 1, low[going])
        high[going] = np.where(less, high[going], middle)


def occurrences(words: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """All (window, place in ``words``) where a distinct window occurs; a place has at most one
    window of each width. ``words`` ends with a 0 and holds a 0 after each document."""
    sa = suffix_array(words, bench.window)
    live = np.arange(len(bench.windows))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(sa), np.int64)
    out = [(live[:0], low[:0], high[:0])]
    for ahead in range(bench.window):
        target = bench.windows[live, ahead]
        low, high = (_bound(words, sa, low, high, ahead, target, False),
                     _bound(words, sa, low, high, ahead, target, True))
        found = low < high
        ended = found & (bench.width[live] == ahead + 1)
        out.append((live[ended], low[ended], high[ended]))
        going = found & ~ended
        live, low, high = live[going], low[going], high[going]
    live, low, high = (np.concatenate(x) for x in zip(*out))
    count = high - low
    entry = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else low, count)
    return np.repeat(live, count), sa[entry + np.arange(len(entry))]


def longest_matches(words: np.ndarray, places: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """Length of the longest match with any item at each place, and where in ``bench.ids`` it is."""
    low, high = np.zeros(len(places), np.int64), np.full(len(places), len(bench.order), np.int64)
    length, where = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    going, ahead = np.arange(len(places)), 0
    while len(going):
        target = words[places[going] + ahead]
        left = _bound(bench.ids, bench.order, low[going], high[going], ahead, target, False)
        right = _bound(bench.ids, bench.order, low[going], high[going], ahead, target, True)
        found = (left < right) & (target > 0)
        going, ahead = going[found], ahead + 1
        low[going], high[going] = left[found], right[found]
        length[going], where[going] = ahead, bench.order[low[going]]
    return length, where


def _kept_matches(words: np.ndarray, starts: np.ndarray, covered_to: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the matches at ``starts`` (ascending) those that no match before them contains: places,
    lengths and where in ``bench.ids``. ``covered_to``: end of the stretch of hits at each start."""
    first = np.ones(len(starts), bool)
    first[1:] = covered_to[1:] != covered_to[:-1]
    length, where = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    length[first], where[first] = longest_matches(words, starts[first], bench)
    # a stretch that its first match covers holds no other one
    stretch = np.cumsum(first) - 1
    open_ = (starts + length < covered_to)[first][stretch] & ~first
    length[open_], where[open_] = longest_matches(words, starts[open_], bench)
    ends = np.where(length > 0, starts + length, 0)
    before = np.concatenate(([0], np.maximum.accumulate(ends)[:-1])) if len(ends) else ends
    kept = (length > 0) & (ends > before)
    return starts[kept], length[kept], where[kept]


def _verified(words: np.ndarray, covered: np.ndarray, spot: np.ndarray, begin: np.ndarray, symbols: np.ndarray, bench: Benchmark) -> np.ndarray:
    """Places of covered words whose bytes are not those of the benchmark's word of their hash.
    ``spot``: the place of each document word."""
    hit = np.flatnonzero(covered[spot])
    same = _same_bytes(_bytes_of(hit, begin, symbols), _bytes_of(words[spot[hit]].astype(np.int64) - 1, _begins(bench.spelled[0]), bench.spelled[1]))
    return spot[hit[~same]]


def scan(column: pa.Array, bench: Benchmark) -> Iterator[tuple[int, int, dict[str, list]]]:
    """For each shard of a column: its first and last row and, by row, the results."""
    data, at = utf8(column)
    for a, b in groups_of_rows(at, SHARD_BYTES):
        hashes, counts, lengths, symbols = word_hashes(data[at[a]:at[b]], at[a:b + 1] - at[a])
        # a 0 after each document: a match never crosses from one to the next
        begin = _begins(counts + 1)
        words = np.zeros(begin[-1] + bench.window + 1, np.int32)
        spot = np.arange(len(hashes)) + np.repeat(np.arange(b - a), counts)
        words[spot] = bench.known(hashes)
        while True:
            window, where = occurrences(words, bench)
            edge = np.bincount(where, minlength=len(words)) - np.bincount(where + bench.width[window], minlength=len(words))
            covered = np.cumsum(edge) > 0
            wrong = _verified(words, covered, spot, _begins(lengths), symbols, bench)
            if not len(wrong):
                break
            words[wrong] = 0
        hit = np.add.reduceat(covered[:begin[-1]], begin[:-1], dtype=np.int64)
        runs = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8)))))
        # items: the sets of each document's windows, each set once
        items: list[list[int]] = [[] for _ in range(b - a)]
        owner = np.searchsorted(begin, where, "right") - 1
        pairs = np.unique(np.stack([owner, bench.set_of[window]], 1), axis=0)
        for d, k in pairs.tolist():
            items[d].append(k)
        items = [np.unique(np.concatenate([bench.sets[k] for k in x])).tolist() if x else x for x in items]
        # matches: longest at each place, none inside another
        starts = np.unique(where)
        ends = runs[1::2][np.searchsorted(runs[0::2], starts, "right") - 1] if len(starts) else starts
        w, length, source = _kept_matches(words, starts, ends, bench)
        i = np.searchsorted(bench.at, source, "right") - 1
        doc = np.searchsorted(begin, w, "right") - 1
        matches: list[list[dict]] = [[] for _ in range(b - a)]
        ids = np.where(bench.named[i], bench.item_id[i].astype(object), None) if len(i) else i
        for d, k, q, x, n in zip(doc.tolist(), ids.tolist(), (source - bench.at[i]).tolist(), (w - begin[doc]).tolist(), length.tolist()):
            matches[d].append({"item_id": k, "item_word": q, "doc_word": x, "n_words": n})
        owner = np.searchsorted(begin, runs[0::2], "right") - 1
        hits: list[list[int]] = [[] for _ in range(b - a)]
        for d, s, e in zip(owner.tolist(), (runs[0::2] - begin[owner]).tolist(), (runs[1::2] - begin[owner]).tolist()):
            hits[d] += (s, e)
        yield a, b, {"n_words": counts.tolist(), "n_hit": hit.tolist(), "items": items, "matches": matches, "hits": hits}


_MATCH = "array<struct<item_id: bigint, item_word: bigint, doc_word: bigint, n_words: bigint>>"
_MATCH_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "item_word", "doc_word", "n_words")]))


def _scanned(docs: DataFrame, keys: list[str], bench: Benchmark) -> DataFrame:
    """Per row the bigint columns ``keys`` and what ``scan`` finds in ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, got in scan(batch.column(0), bench):
                yield pa.RecordBatch.from_arrays(
                    [*(c[a:b] for c in batch.columns[1:]), pa.array(got["n_words"], pa.int64()), pa.array(got["n_hit"], pa.int64()),
                     pa.array(got["items"], pa.list_(pa.int64())), pa.array(got["matches"], _MATCH_ARROW),
                     pa.array(got["hits"], pa.list_(pa.int64()))],
                    [*keys, "n_words", "n_hit", "items", "matches", "hits"])

    return docs.select("text", *keys).mapInArrow(
        run, "".join(f"{k} bigint, " for k in keys) + f"n_words bigint, n_hit bigint, items array<bigint>, matches {_MATCH}, hits array<bigint>")


@F.pandas_udf(T.LongType())
def _covered(hits: pd.Series) -> pd.Series:
    """Words in the union of the [start, end) pairs of several blocks."""
    def one(pairs: list[int]) -> int:
        total, reached = 0, 0
        for s, e in sorted(zip(pairs[0::2], pairs[1::2])):
            total += max(0, e - max(s, reached))
            reached = max(reached, e)
        return total
    return hits.map(lambda x: one(list(x)))


def _blocks(items: DataFrame, size: int, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """The rows of ``items`` (item_id, text), ``size`` bytes in all, in blocks by running totals."""
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            numbers = []
            for length in batch.column(2).to_pylist():
                if total and total + length + ROW_BYTES > block_bytes:
                    block, total = block + 1, 0
                total += length + ROW_BYTES
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([part] * len(numbers), pa.int64()),
                                              pa.array(numbers, pa.int64())], ["item_id", "text", "part", "block"])

    if size <= block_bytes:
        yield [tuple(r) for r in items.collect()]
        return
    sized = items.select("item_id", "text", F.octet_length("text").alias("size")).coalesce(max(1, size // (4 * block_bytes)))
    staged = stage(sized.mapInArrow(numbered, "item_id bigint, text string, part bigint, block bigint"))
    for part, blocks in sorted(map(tuple, staged.groupBy("part").agg(F.max("block") + 1).collect())):
        for block in range(blocks):
            rows = staged.where((F.col("part") == part) & (F.col("block") == block))
            yield [tuple(r) for r in rows.select("item_id", "text").collect()]


def _items(benchmark: DataFrame, unnamed: bool) -> tuple[DataFrame, int]:
    """The items that count, and what they weigh."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull())
    if not unnamed:
        items = items.where(F.col("item_id").isNotNull())
    return items, items.agg(F.sum(F.octet_length("text") + ROW_BYTES)).first()[0] or 0


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  block_bytes: int = BLOCK_BYTES, unnamed: bool = False) -> DataFrame:
    """For every row of ``docs``: ``doc_id``, ``text_hash``, ``n_words``, ``n_hit`` (words inside an occurrence
    of a window), ``items`` (sorted ids of the items found) and ``matches`` (the longest
    verbatim matches that lie in no other: first word in the document, length in words, and one item
    that holds it, of equal ones the smallest id, with its first word there).
    With ``unnamed``, items without an id count too, but for ``items``."""
    items, size = _items(benchmark, unnamed)
    base = texts(docs, text_hash(docs).alias("text_hash"))
    if size <= block_bytes:
        (block,) = _blocks(items, size, block_bytes)
        return _scanned(base, ["doc_id", "text_hash"], Benchmark.of(block, window)).drop("hits")
    rows = stage(base.withColumn("row_id", F.monotonically_increasing_id()))
    found = None
    for block in _blocks(items, size, block_bytes):  # the first has every row, the others those they hit
        part = _scanned(rows, ["row_id"], Benchmark.of(block, window))
        found = stage(part) if found is None else found.unionByName(stage(part.where("n_hit > 0")))
    merged = found.groupBy("row_id").agg(
        F.max("n_words").alias("n_words"), _flat("items"), _flat("matches"), _flat("hits"))
    return rows.select("row_id", "doc_id", "text_hash").join(merged, "row_id").select(
        "doc_id", "text_hash", "n_words", _covered("hits").alias("n_hit"),
        F.array_sort(F.array_distinct("items")).alias("items"), "matches")


def _flat(name: str):
    return F.flatten(F.collect_list(name)).alias(name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, unnamed: bool = False,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark (all columns)."""
    items, size = _items(benchmark, unnamed)
    for i, block in enumerate(_blocks(items, size, block_bytes)):
        bench = Benchmark.of(block, window)

        def clean(column: pa.Array, bench: Benchmark = bench) -> np.ndarray:
            return np.array([n for _, _, got in scan(column, bench) for n in got["n_hit"]]) == 0

        docs = keep_rows(stage(docs) if i else docs, clean)
    return docs
