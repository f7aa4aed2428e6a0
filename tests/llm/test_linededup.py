import collections

from agora.llm.linededup import SortedRuns, drop_repeated_lines

SPACE = " \t\n\r\x0b\x0c"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def brute(rows):
    docs = collections.defaultdict(set)
    number = lambda d: -1 if d is None else d
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs[key(line)].add(number(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(docs[key(x)]) < 3 or max(docs[key(x)]) == number(d)]
        out.append((number(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def rows_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect())


def test_against_brute_force(corpus, corpus_df):
    want = brute(corpus)
    assert sum(r[2] for r in want) > 20
    assert rows_of(drop_repeated_lines(corpus_df)) == want
    assert rows_of(drop_repeated_lines(corpus_df, batches=9)) == want
    assert rows_of(drop_repeated_lines(corpus_df, batches=1)) == want


def test_runs_are_compacted_and_keep_counts(spark):
    runs = SortedRuns(fanout=2)
    seen = collections.Counter()
    keeper = {}
    for b in range(7):
        pairs = [(k, 0, 100 - b) for k in range(0, 30) if k % (b + 1) == 0]
        for k, _, d in pairs:
            seen[k] += 1
            keeper.setdefault(k, d)
        runs.add(spark.createDataFrame(pairs, "hi bigint, lo bigint, doc bigint"))
        assert len(runs.runs()) <= 3
    assert {(r["hi"], r["n_docs"], r["keeper"]) for r in runs.counts().collect()} == {(k, n, keeper[k]) for k, n in seen.items()}


def test_edges(edge_df, empty_df):
    from tests.llm.conftest import EDGE_ROWS

    assert rows_of(drop_repeated_lines(edge_df)) == brute(EDGE_ROWS)
    assert drop_repeated_lines(empty_df).count() == 0


def test_carry_keeps_the_columns(edge_df):
    out = drop_repeated_lines(edge_df, carry=True)
    assert out.columns == edge_df.columns
    rows = {(r["doc_id"], r["text"]): r for r in out.collect()}
    assert rows[(1, None)]["n_chars"] is None and rows[(2, "")]["n_chars"] == 0
    assert rows[(8, "end")]["hi"] == "other"
