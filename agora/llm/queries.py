"""The registered queries of this subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm import bpe, decontaminate, digest, fim, html, huffman, phrases, pii, substrings, warc
from agora.llm.common import read_table
from agora.llm.linededup import drop_repeated_lines
from agora.llm.oracle import ORACLE_SQL as ORACLE_SQL
from agora.llm.quality import fit_quality, fold
from agora.llm.simhash import near_duplicates


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = digest.fingerprints(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"),
                                        unnamed=True)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"),
                        "spans", "n_added")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame, encoder: bpe.BytePairEncoder, keep_ids: bool = False) -> DataFrame:
    """Number and hash of each document's ids, and the hash of the text decoded from them; with
    ``keep_ids`` the ids as well."""
    tokens = bpe.round_trip(docs, encoder)
    return tokens.select("doc_id", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
                         F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"), *["ids"] * keep_ids)


def op5_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    encoder = bpe.BytePairEncoder.load(tokenizer_path(tokenizer))
    return bpe_digests(read_table(spark, sf_dir, "documents"), encoder)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = fit_quality(docs, labels, train=fold(F.col("doc_id")) != 0)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))  # a row without id is in no fold
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_huffman(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    folder = huffman.new_folder(spark)
    encoder = huffman.LibraryEncoder.load(tokenizer_path(tokenizer))
    huffman.write_ids(read_table(spark, sf_dir, "documents"), encoder, folder, end=1)
    return huffman.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read_table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    warc.write_warc(read_table(spark, sf_dir, "pages"), folder)
    found = warc.read_warc(spark, folder, payload=False).where("gap is null")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_digest, op2_decontaminate, op3_pii, op4_simhash, op5_bpe, op6_line_dedup,
                                   op7_substrings, op8_quality, op9_huffman, op10_html, op11_phrases, op12_fim, op13_warc)}
