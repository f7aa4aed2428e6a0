import hashlib
import random

import pytest
from pyspark.sql import functions as F

from agora.llm.fim import CODE_POINT, UnitCutter, draw, fill_in_middle, restored, transform
from tests.llm.conftest import EDGE_ROWS


def plain_version(doc_id, text):
    text = text or ""
    n = len(text)
    hexes = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexes[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def hard_texts():
    rng = random.Random(3)
    odd = ["<", ">", "S", "P", "M", "\n", " ", "é", "é", "\U0001F600", " ", "a"]
    return [(i, "".join(rng.choice(odd) for _ in range(rng.randint(0, 40)))) for i in range(400)]


def test_rows_equal_a_plain_version(spark, corpus, edge_df):
    rows = [*corpus, *hard_texts(), *EDGE_ROWS]
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    got = got.withColumn("back", restored()).collect()
    key = lambda row: tuple(map(repr, row))
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got], key=key) == sorted(
        [(i, *plain_version(i, t)) for i, t in rows], key=key)
    assert sorted((repr(r.doc_id), r.back) for r in got) == sorted((repr(i), t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(edge_df).count() == len(EDGE_ROWS)


def test_empty_table(empty_df):
    assert fill_in_middle(empty_df).select("*", restored()).collect() == []


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 1000])
def test_windows_change_nothing(size):
    text = "".join(random.Random(size).choice("a\né\U0001F600") for _ in range(size))
    for doc_id in range(30):
        assert transform(text, doc_id, UnitCutter(window=64)) == plain_version(doc_id, text)


def test_other_units():
    words = r"\s*+\S++\s*+"
    cutter, narrow = UnitCutter(words), UnitCutter(words, window=16)
    text = " one two  three\nfour five six seven "
    assert cutter.cuts(text, lambda n: (2, 5)) == (7, len(" one two  "), len(" one two  three\nfour five "))
    assert narrow.count("ab cd ef gh ij kl mn")[0] == 7
    with pytest.raises(ValueError):
        UnitCutter("[a-z]").cuts("ab1", lambda n: (0, n))
    assert cutter.cuts("", lambda n: (0, n)) == (0, 0, 0)


def test_very_long_text_in_bounded_memory():
    import tracemalloc

    text = "né " * 7_000_000
    h1, h2, *_ = draw(8)
    tracemalloc.start()
    n, first, second = UnitCutter(CODE_POINT).cuts(text, lambda n: sorted((h1 % (n + 1), h2 % (n + 1))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, first, second) == (len(text), *sorted((h1 % (n + 1), h2 % (n + 1)))) and peak < 100_000_000


def test_query_hashes(spark, tmp_path):
    from agora.llm.queries import op12_fim

    spark.createDataFrame(hard_texts(), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_fim(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = {i: (hashlib.sha256(plain_version(i, t)[4].encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in hard_texts()}
    assert {r.doc_id: (r.output_sha256, r.restored_sha256) for r in got.collect()} == want
    assert got.where(F.col("form") == "plain").count() > 0
