import heapq
import zlib

import numpy as np
import pytest

from agora.llm import huffman
from agora.llm.huffman import LibraryEncoder, canonical_codes, code_lengths, decode_table, pack, read_ids, unpack, write_ids
from agora.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("word_bpe_49k.json")


def huffman_bits(counts):
    heap, total = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    return total


@pytest.mark.parametrize("kinds, n", [(1, 1), (1, 600), (2, 5), (5, 100), (300, 5000), (40_000, 60_000)])
def test_codes_round_trip(kinds, n):
    ids = (np.random.default_rng(kinds).zipf(1.3, n) % kinds).astype(np.uint32)
    counts = np.bincount(ids, minlength=kinds)
    lengths = code_lengths(counts)
    assert (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
    assert ((lengths > 0) == (counts > 0)).all()
    if kinds == 300:  # the limit does not bind here
        assert int(counts @ lengths) == huffman_bits(counts)
    payload, marks = pack(ids, lengths, canonical_codes(lengths))
    assert len(payload) == -(-int(counts @ lengths) // 8) and len(marks) == -(-n // huffman.STRIDE)
    assert (unpack(payload, marks, n, decode_table(lengths)) == ids).all()


def test_length_limit_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    lengths = code_lengths(counts, limit=6)
    assert lengths.max() == 6 and (0.5 ** lengths.astype(float)).sum() == 1
    best = min(int(counts @ np.array(sorted(x, reverse=True))) for x in _kraft(10, 6))
    assert int(counts @ lengths) == best


def _kraft(n, limit):
    """All non-decreasing length lists of a complete code."""
    def go(left, least, room):
        if left == 0:
            if room == 0:
                yield []
            return
        for size in range(least, limit + 1):
            cost = 1 << limit - size
            if cost * left >= room >= cost:
                for rest in go(left - 1, size, room - cost):
                    yield [size, *rest]
    yield from go(n, 1, 1 << limit)


def expected(rows):
    library, start, out = tokenizers.Tokenizer.from_file(PATH), 0, []
    coded = [((-1 if d is None else d), library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows]
    for d, ids in sorted(coded, key=lambda x: (x[0], np.array(x[1], "<u2").tobytes())):
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"])))
                  for r in df.collect())


def test_files(spark, corpus, corpus_df, monkeypatch):
    monkeypatch.setattr(huffman, "ROWS_PER_PART", 10)
    monkeypatch.setattr(huffman, "BLOCK_IDS", 300)
    folder = huffman.new_folder(spark)
    write_ids(corpus_df, LibraryEncoder.load(PATH), folder)
    assert rows_of(read_ids(spark, folder)) == expected(corpus)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.count() > 10 and spark.read.parquet(f"{folder}/index").count() == blocks.count()


def test_edges(spark, edge_df, empty_df):
    from tests.llm.conftest import EDGE_ROWS

    for df, rows in ((edge_df, EDGE_ROWS), (empty_df, [])):
        folder = huffman.new_folder(spark)
        write_ids(df, LibraryEncoder.load(PATH), folder)
        assert rows_of(read_ids(spark, folder)) == sorted(expected(rows))


def test_pieces_and_cache(monkeypatch):
    texts = ["", " ", "İx Σας ΣΑΣ", "a<|endoftext|>b", "é ́x\n̈y", "tab\tnb\xa0sp\x1cx", "don't 12 it's!", "\u2028z", " z",
             "Word, word. WORD!? .,; Größe, ÉTÉ. naïve;x İstanbul. ŉa, ªº. ẞ ΑΣ. ǅx, a1, x.y z...", "ab" * 300 + ",",
             "A, b. c,\nd.\n", "One, Two, three. é, <|ENDOFTEXT|> x, ...", "1, 2. ., a"] * 3
    library = tokenizers.Tokenizer.from_file(PATH)
    monkeypatch.setattr(huffman, "CACHE_ENTRIES", 4)
    encoder = LibraryEncoder.load(PATH)
    for text in texts:
        (got,) = encoder.encode_texts([text], 1)
        assert np.frombuffer(got, "<u2").tolist() == library.encode(text, add_special_tokens=False).ids + [1], text


def test_pieces_of_random_texts_and_long_rows(monkeypatch):
    import random

    rng = random.Random(6)
    odd = [" ", " ", "\n", ".", ",", ", ", ". ", "a", "Word", "it's", "\u00e9", "\u0130", "J", "\u030c", "\u03a3", "\t", "\xa0", "1", "<|", "<|endoftext|>",
           "<|ENDOFTEXT|>", "\u65e5", "\u2028", "\u00b7", "!?", "\u0345", "%%%", "\u00d7", "'", "|", ">", "\u00df", "-", "é"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    library = tokenizers.Tokenizer.from_file(PATH)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for step in (huffman.STEP_BYTES, 64, 7):
        monkeypatch.setattr(huffman, "STEP_BYTES", step)
        got = [np.frombuffer(x, "<u2").tolist() for x in LibraryEncoder.load(PATH).encode_texts(texts, 1)]
        assert got == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_tokenizers_are_refused(name, tmp_path):
    import json

    with pytest.raises(ValueError, match="lower-cases"):
        LibraryEncoder.load(tokenizer_path(name))
    spec = json.load(open(PATH))
    spec["normalizer"]["normalizers"].pop()  # keeps case
    with open(f"{tmp_path}/cased.json", "w") as f:
        json.dump(spec, f)
    with pytest.raises(ValueError, match="lower-cases"):
        LibraryEncoder.load(f"{tmp_path}/cased.json")


def test_the_cache_forgets_old_pieces_and_gives_the_same_ids(monkeypatch):
    """Pieces are learned as arrays, many to a call of the library; forgotten ones are learned again."""
    monkeypatch.setattr(huffman, "CACHE_ENTRIES", 8)
    encoder, calls = LibraryEncoder.load(PATH), []
    encoder._open()
    words = encoder._words
    encoder._words = lambda part: calls.append(list(part)) or words(part)
    texts = [" ".join(f"{a}{b}word" for a in "bcdf" for b in "aeio"), "Bawo, bawo! naïve it's <|x", "", "的 caWORD ɐ́ 42nd", "bawo fuword"]
    for text in [*texts, *texts]:
        got = np.frombuffer(encoder.encode_texts([text], 1)[0], encoder.width)
        assert got.tolist() == [*encoder.library.encode(text, add_special_tokens=False).ids, 1]
        assert len(encoder.names) == len(encoder.sizes) == len(encoder.used) <= 8 + 16 and len(encoder.flat) == encoder.sizes.sum()
    assert max(map(len, calls)) == 16 and not hasattr(encoder, "young")
    assert sum(part.count("baword") for part in calls) == 2  # forgotten in between
