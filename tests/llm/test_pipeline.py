import hashlib

import corpus_pipeline
import pytest

from agora.llm.common import read_table, stage
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_linededup import brute as lines
from tests.llm.test_simhash import groups, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = read_table(spark, SF, "documents"), []
    for _, step in corpus_pipeline.STAGES:
        before, docs = docs, stage(step(spark, docs, SF))
        out.append((before, docs))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_rejects_junk_only(spark, steps):
    before, after = (texts(x) for x in steps[0])
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    assert all(after[d] == before[d] for d in after)
    gone = set(before) - set(after)
    assert gone and sum(labels.get(d, 0) for d in gone) <= 2
    assert sum(labels[d] == 0 for d in after if d in labels) <= 3


def test_lines(steps):
    before, after = (texts(x) for x in steps[1])
    assert {d: t for d, _, _, t in lines(before.items())} == after
    assert all(r["n_chars"] == len(r["text"]) for r in steps[1][1].collect())


def test_near_copies(steps):
    before, after = (texts(x) for x in steps[2])
    fps = {d: plain_fingerprint(t) for d, t in before.items()}
    ids = list(fps)
    low = groups([(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 3], ids)
    assert set(after) == set(low.values())


def test_leaks(spark, steps):
    before, after = (texts(x) for x in steps[3])
    items = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    assert set(after) == {r[0] for r in leaks(before.items(), items) if not r[2]}


def test_tokens_are_kept(steps):
    for r in steps[-1][1].collect():
        assert len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"]


def test_run_equals_the_stages(spark, steps):
    want = sorted(map(tuple, steps[-1][1].collect()))
    assert want and sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_edges(spark, edge_df, empty_df):
    for df in (edge_df, empty_df):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, df, SF)
            assert out.count() <= df.count(), name
    kept = corpus_pipeline.drop_near_copies(spark, edge_df, SF)
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 4").count() == 2


def test_rows_are_judged_not_ids(spark, tmp_path):
    prose = texts(read_table(spark, SF, "documents"))
    labels = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    good = [prose[d] for d in sorted(prose) if labels.get(d) == 1 and len(prose[d]) > 400][:6]
    junk = [prose[d] for d in sorted(prose) if labels.get(d) == 0][:2]
    rows = [(d, t) for d, t in prose.items() if d in labels]
    mixed = [(None, good[0]), (None, good[1]), (None, junk[0]), (10 ** 9, good[2]), (10 ** 9, junk[1])]
    docs = spark.createDataFrame(rows + mixed, "doc_id bigint, text string")

    def left(df):
        return {(r["doc_id"], r["text"]) for r in df.where("doc_id is null or doc_id >= 1000000000").collect()}

    assert left(corpus_pipeline.keep_good(spark, docs, SF)) == {(None, good[0]), (None, good[1]), (10 ** 9, good[2])}

    spark.createDataFrame([(1, good[3])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    mixed = [(None, good[0]), (None, good[1]), (None, "x " + good[3]), (10 ** 9, good[2]), (10 ** 9, good[3] + " x")]
    docs = spark.createDataFrame(mixed, "doc_id bigint, text string")
    assert left(corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))) == {(None, good[0]), (None, good[1]), (10 ** 9, good[2])}

    mixed = [(5, good[0]), (10 ** 9, good[0]), (10 ** 9, good[1]), (10 ** 9 + 1, good[1]), (10 ** 9 + 1, good[2]), (None, good[0])]
    docs = spark.createDataFrame(mixed, "doc_id bigint, text string")
    assert left(corpus_pipeline.drop_near_copies(spark, docs, SF)) == {
        (None, good[0]), (10 ** 9, good[1]), (10 ** 9 + 1, good[2])}
