import hashlib
import random

import numpy as np
import pytest

from agora.llm import bpe
from agora.llm.queries import bpe_digests, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("byte_bpe_50k.json")

ODD = ["", " ", "a", "  a  b\n\nc \n d", "\n", "x\ty\r\nz", "a<|endoftext|>b <|endoftext|>", "don't we'll I'M 1234 ½ ²",
       "日本語 テキスト　全角", "é" * 700, "ab" * 600 + " " + "!" * 500, "a\u0085b\xa0c d​z\x1cq", "😀👍🏽 ok",
       "word \n next", "trail ", "\nlead", "a\n\n\nb", "\t\tx", "a\x00b", "İstanbul ǅ ﬁ", "'s 't x", "x\x1d y \x1f\nq"]


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(PATH)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def encoder():
    return bpe.BytePairEncoder.load(PATH)


def test_equal_to_the_library(library, encoder, corpus):
    rng = random.Random(1)
    odd = ODD + ["".join(rng.choice("ab c\n\t'sé 1!<|endoftext|> ") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts = odd + [t for _, t in corpus]
    for text, got in zip(texts, encoder.encode_texts(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert encoder.decode_ids(got) == library.decode(ids, skip_special_tokens=False)


def test_one_row_and_many_rows_merge_alike(encoder):
    rng = random.Random(2)
    for _ in range(60):
        raw = bytes(rng.choice(b"the and of ing tion ee") for _ in range(rng.randint(1, 120)))
        start = encoder.byte_ids[np.frombuffer(raw, np.uint8)]
        rows = np.full((2, 128), -1, np.int64)
        rows[0, :len(raw)] = start
        merged = encoder.merge_rows(rows)
        assert merged[0][merged[0] >= 0].tolist() == encoder.merge_one(start.tolist())
        assert (merged[1] < 0).all()


def test_cache_generations_change_nothing(encoder, corpus, monkeypatch):
    texts = [t for _, t in corpus]
    want = encoder.encode_texts(texts)
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 50)
    encoder.young, encoder.old = {}, {}
    got = [x for i in range(0, len(texts), 3) for x in encoder.encode_texts(texts[i:i + 3])]
    assert got == want and len(encoder.young) < 2000


def test_query_and_edges(library, encoder, edge_df, empty_df):
    from tests.llm.conftest import EDGE_ROWS

    def digest(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
                 for r in bpe_digests(edge_df, encoder).collect())
    assert got == sorted((-1 if d is None else d, *digest(t)) for d, t in EDGE_ROWS)
    assert bpe_digests(empty_df, encoder).count() == 0
    apart = bpe.decode(bpe.encode(edge_df, encoder), encoder)
    assert apart.exceptAll(bpe.round_trip(edge_df, encoder)).count() == 0 and apart.count() == 13
