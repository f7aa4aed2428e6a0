import collections
import re

import random
import time

import numpy as np
import pyarrow as pa

from agora.llm import decontaminate as module
from agora.llm.decontaminate import Benchmark, _blocks, decontaminate, find_overlaps, scan, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window=10):
    found = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        if w and i is not None:
            for k in range(len(w) - n + 1):
                found[tuple(w[k:k + n])].add(i)
    out = []
    for d, t in rows:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in found:
                    got |= found[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        out.append((-1 if d is None else d, len(w), len(hit), sorted(got)))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in df.collect())


def items_for(corpus):
    texts = [t for _, t in corpus]
    long = [t for t in texts if len(words(t)) > 40]
    return [(1, " ".join(words(long[0])[3:30])), (2, long[1].upper()[:200]), (3, words(long[2])[0]), (4, ""), (5, None),
            (None, long[3]), (6, "no such words anywhere in it"), (7, " ".join(words(long[0])[5:25])),
            (8, " ".join(words(long[4])[:9])), (8, " ".join(words(long[5])[2:16])), (12, words(long[2])[0] + " " + words(long[2])[1])]


def test_suffix_array_order():
    rng = np.random.default_rng(0)
    for _ in range(100):
        ids = rng.integers(0, rng.integers(2, 5), rng.integers(1, 200)).astype(np.int32)
        ids = np.append(ids, 0).astype(np.int32)

        def part(i):
            end = i + int(np.argmax(ids[i:] == 0))
            return ids[i:end][:12].tolist()

        order = suffix_array(ids, 12)
        assert [part(i) for i in order] == sorted(part(i) for i in np.flatnonzero(ids))


def test_against_brute_force(spark, corpus, corpus_df):
    items = items_for(corpus)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(corpus, items)
    assert any(r[2] for r in want)
    assert rows_of(find_overlaps(corpus_df, bench)) == want
    assert rows_of(find_overlaps(corpus_df, bench, block_bytes=100)) == want  # several blocks
    clean = {r["doc_id"] for r in decontaminate(corpus_df, bench).collect()}
    assert clean == {r[0] for r in want if not r[2]}


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l y a b")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, "q A b c d e f g h i j k l z")], "item_id bigint, text string")
    (row,) = find_overlaps(docs, bench).collect()
    assert [m.asDict() for m in row["matches"]] == [{"item_id": 9, "item_word": 1, "doc_word": 1, "n_words": 12}]
    assert row["n_hit"] == 12


def test_edges(spark, edge_df, empty_df):
    from tests.llm.conftest import EDGE_ROWS

    items = [(1, "long line again and again long line"), (2, "w" * 60_000), (3, "text without an id"), (4, None)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    assert rows_of(find_overlaps(edge_df, bench)) == brute(EDGE_ROWS, items)
    assert find_overlaps(empty_df, bench).count() == 0
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in find_overlaps(edge_df, none).collect()} == {0}
    assert decontaminate(edge_df, bench).columns == edge_df.columns


def test_items_without_an_id_hit(spark, corpus, corpus_df):
    items = items_for(corpus)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [(*r[:3], [i for i in r[3] if i != 99]) for r in brute(corpus, [(99 if i is None else i, t) for i, t in items])]
    assert want != brute(corpus, items)
    assert rows_of(find_overlaps(corpus_df, bench, unnamed=True)) == want
    assert rows_of(find_overlaps(corpus_df, bench, block_bytes=100, unnamed=True)) == want
    clean = {r["doc_id"] for r in decontaminate(corpus_df, bench, unnamed=True).collect()}
    assert clean == {r[0] for r in want if not r[2]}


def test_blocks_are_bounded(spark):
    items = [(i, "w" * (1 + i * 37 % 90)) for i in range(200)] + [(None, "long " * 100)]
    df = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    got = list(_blocks(df, sum(len(t) + module.ROW_BYTES for _, t in items), 300))
    assert all(sum(len(t) + module.ROW_BYTES for _, t in b) <= 300 or len(b) == 1 for b in got)
    assert sorted((r for b in got for r in b), key=str) == sorted(items, key=str)


def scanned(rows, items, **change):
    """What ``scan`` finds, without Spark."""
    (found,) = [got for _, _, got in scan(pa.array([t for _, t in rows]), Benchmark.of(items, 10))] if rows else [None]
    return [(d, n, h, list(i)) for (d, _), n, h, i in zip(rows, found["n_words"], found["n_hit"], found["items"])], found["matches"]


def test_equal_items_and_copies_make_no_pairs():
    passage = " ".join(f"w{i}" for i in range(60))
    docs = [(i, f"start{i} {passage} end") for i in range(1000)]
    items = [(i, passage) for i in range(2000)] + [(5000 + i, f"q{i} " + passage[:100]) for i in range(2000)]
    begin = time.process_time()
    got, matches = scanned(docs, items)
    assert time.process_time() - begin < 20
    assert all(r[1:3] == (62, 60) and r[3] == [*range(2000), *range(5000, 7000)] for r in got)
    assert all(m == [{"item_id": 0, "item_word": 0, "doc_word": 1, "n_words": 60}] for m in matches)


def test_random_words_against_brute_force():
    for seed in range(25):
        rng = random.Random(seed)
        letters = "abcd"[:rng.randint(2, 4)]
        items = [(i, " ".join(rng.choices(letters, k=rng.choice([1, 2, 5, 9, 10, 11, 14, 30])))) for i in range(rng.randint(1, 8))]
        docs = [(i, " ".join(rng.choices(letters, k=rng.randint(0, 200)))) for i in range(6)] + [(7, items[0][1] + " " + items[-1][1])]
        got, matches = scanned(docs, items)
        assert got == brute(docs, items)
        for (_, text), found in zip(docs, matches):
            w, ends = words(text), 0
            for m in found:  # verbatim, cannot be longer, inside no other
                item = words(dict(items)[m["item_id"]])
                piece = w[m["doc_word"]:m["doc_word"] + m["n_words"]]
                assert piece == item[m["item_word"]:m["item_word"] + m["n_words"]] and m["doc_word"] + m["n_words"] > ends
                ends = m["doc_word"] + m["n_words"]
                more = " ".join(w[m["doc_word"]:ends + 1]) + " "
                assert ends == len(w) or not any(f" {more}" in f" {t} " for _, t in items)


def test_words_that_share_a_hash_do_not_hit(monkeypatch):
    real = module.hash_tokens
    items = [(1, "alpha beta gamma delta"), (2, "one two three four five six seven eight nine ten eleven")]
    for bits in range(6, 12):
        monkeypatch.setattr(module, "hash_tokens", lambda s, n, bits=bits: real(s, n) % np.uint64(1 << bits))
        rng = random.Random(bits)
        docs = [(i, " ".join(rng.choice(["beta", "gamma", "alpha", "delta", f"x{rng.randint(0, 99)}"]) for _ in range(400)) + " " + items[i % 2][1])
                for i in range(20)]
        try:
            got, _ = scanned(docs, items)
        except RuntimeError:  # two words of the benchmark itself share one
            continue
        assert got == brute(docs, items)


def test_items_of_no_words_are_bounded_too(spark):
    df = spark.createDataFrame([(i, "") for i in range(1000)], "item_id bigint, text string")
    assert max(len(b) for b in _blocks(df, 1000 * module.ROW_BYTES, 6400)) <= 101
