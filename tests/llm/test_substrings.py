import collections
import random

import numpy as np

from agora.llm import substrings
from agora.llm.substrings import common_prefixes, remove_repeats, suffix_order


def test_two_stage_order_and_common_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        text = bytes(rng.choice([0, 1, 2, 3, 4][:rng.randint(2, 5)]) for _ in range(rng.randint(1, 150))) + b"\0"
        data = np.frombuffer(text, np.uint8)
        order = suffix_order(data, 200)
        part = lambda i: text[i:text.index(0, i)]
        assert [part(i) for i in order] == sorted(part(i) for i in range(len(text)) if text[i])
        prefix = common_prefixes(data, order, 200)
        for k in range(1, len(order)):
            a, b = part(order[k - 1]), part(order[k])
            same = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefix[k] == min(same, 200)


def brute(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(r[i:i + 200] for r in raw for i in range(len(r) - 199))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, np.frombuffer(r, np.uint8)[~gone].tobytes()))
    return out


def rows_of(df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
                  for r in df.collect())


def test_against_brute_force(corpus, corpus_df):
    assert rows_of(remove_repeats(corpus_df)) == sorted((d, *x) for (d, _), x in zip(corpus, brute(corpus)))


def test_hot_groups_give_the_same(corpus_df):
    assert rows_of(remove_repeats(corpus_df, hot=2)) == rows_of(remove_repeats(corpus_df))


def test_edges(edge_df, empty_df):
    from tests.llm.conftest import EDGE_ROWS

    rows = [(d, t) for d, t in EDGE_ROWS if d != 6]  # 60,000 equal bytes: too slow by brute force
    got = [r for r in rows_of(remove_repeats(edge_df)) if r[0] != 6]
    assert got == sorted((-1 if d is None else d, *x) for (d, _), x in zip(rows, brute(rows)))
    long = [r for r in rows_of(remove_repeats(edge_df)) if r[0] == 6]
    assert long == [(6, 60_000, 60_000, 1, b"")]
    assert remove_repeats(empty_df).count() == 0


def test_small_batches_of_groups(spark, corpus, monkeypatch):
    """Groups that cross Arrow batches are carried over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(2)
        assert rows_of(remove_repeats(df)) == sorted((d, *x) for (d, _), x in zip(corpus, brute(corpus)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert substrings.BACK + substrings.GRAM == substrings.LENGTH


def test_groups_across_batches_and_over_the_hold(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = np.stack([rng.choice([1, 2], 400, p=[0.9, 0.1]), rng.integers(0, 9, 400), rng.integers(0, 60, 400),
                     rng.integers(0, 5, 400) | 1 << 20, np.arange(400), np.zeros(400), np.zeros(400), np.full(400, 250)], 1).astype(np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1]))]

    def run(step, hold):
        monkeypatch.setattr(substrings, "HOLD", hold)
        out = list(substrings._grouped(substrings._batch(*rows[i:i + step].T) for i in range(0, len(rows), step)))
        table = pa.Table.from_batches(out).to_pydict()
        got = list(zip(*table.values()))
        return {r[4] for r in got if r[0] == 0}, {r[1:3] for r in got if r[0] != 0}

    spans, contexts = run(400, 1000)
    count = collections.Counter((r[1], r[2]) for r in rows.tolist())
    many = {(r[1], r[2]) for r in rows.tolist() if r[0] == 2}
    assert spans == {r[4] for r in rows.tolist() if count[r[1], r[2]] > 1 or (r[1], r[2]) in many}
    for step in (1, 7, 100):
        assert run(step, 1000) == (spans, contexts)
        more = run(step, 10)
        assert more[0] == spans and contexts <= more[1] <= set(count)
