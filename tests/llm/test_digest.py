import base64
import hashlib
import math
import random
from collections import Counter

import numpy as np

from agora.llm import digest
from agora.llm.digest import digests, edited, entropy_bins, fingerprints, likeness, ranks_of


def chains(texts, ranks):
    raw = [t.encode() for t in texts]
    at = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    return digests(np.frombuffer(b"".join(raw), np.uint8), at, ranks)


def test_sliding_entropy():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.integers(0, k, 300) for k in (1, 2, 5, 40, 256)]).astype(np.uint8)
    for i, got in enumerate(entropy_bins(data)):
        share = np.bincount(data[i:i + 64]) / 64
        share = share[share > 0]
        assert abs(got - -(share * np.log2(share)).sum() / 6 * 1000) <= 1


def test_fingerprints_do_not_depend_on_neighbours(corpus):
    ranks = ranks_of(np.arange(digest.BINS)[::-1])
    texts = [t for _, t in corpus]
    together = chains(texts, ranks)
    for text, chain in zip(texts, together):
        assert np.array_equal(chains([text], ranks)[0], chain)
        assert likeness(chain, chain) == 1.0


def test_likeness_orders_by_overlap():
    rng = random.Random(3)
    ranks = ranks_of(np.arange(digest.BINS)[::-1])
    make = lambda n: "".join(rng.choice("abcdefghijklmnop  ") for _ in range(n))
    a, b = make(60_000), make(60_000)
    chain = chains([a, a[:45_000] + b[:15_000], a[:15_000] + b[:45_000], b], ranks)
    assert len(chain[0]) > 3
    near = [likeness(chain[0], c) for c in chain]
    assert near[0] == 1 and near[1] > 0.6 and near[1] > near[2] + 0.2 > near[3] + 0.2 and near[3] < 0.15
    assert likeness(chain[0], chain[1]) == likeness(chain[1], chain[0])


def check(df, rows):
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    texts = [t or "" for _, t in order]
    want = []
    for i, (d, _) in enumerate(order):
        new = edited(texts[i], texts[(i + 1) % len(texts)])
        want.append((-1 if d is None else d, len(texts[i]), hashlib.sha256(new.encode()).hexdigest()))
    got = fingerprints(df).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest())
                  for r in got) == sorted(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    return got


def test_query(corpus, corpus_df, monkeypatch):
    monkeypatch.setattr(digest, "ROWS_PER_PART", 7)
    got = check(corpus_df, corpus)
    by_text = {}
    for r, text in ((r, dict(corpus)[r["doc_id"]]) for r in got):
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got if r["n_chars"] > 200]
    assert np.mean([r["near_edited"] for r in long]) > 0.5 > 0.2 > np.median([r["near_next"] for r in long])


def test_edges(edge_df, empty_df):
    from tests.llm.conftest import EDGE_ROWS

    got = check(edge_df, EDGE_ROWS)
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert fingerprints(empty_df).count() == 0


# ---------------------------------------------------------------- the whole operator, plainly

MASK = (1 << 64) - 1


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_windows(text):
    data = bytes(63) + text.encode()
    return [data[i:i + 64] for i in range(len(data) - 63)]


def plain_bin(window):
    part = lambda c: round(c * math.log2(c) * 65536)
    return (part(64) - sum(part(c) for c in Counter(window).values())) * 1000 // part(64)


def plain_chain(text, rank):
    """Filters as whole numbers, bit 0 first, by the definition in the module's docstring."""
    windows = plain_windows(text)
    keys = [(rank[plain_bin(w)], i) for i, w in enumerate(windows)]
    points = Counter(min(keys[max(p, 0):p + 64])[1] for p in range(-63, len(keys)) if keys)
    chosen = [w for i, w in enumerate(windows) if points[i] >= 16 or len(windows) <= 64]
    features = list(dict.fromkeys(chosen))
    chain = []
    for a in range(0, len(features), 160):
        bits = 0
        for window in features[a:a + 160]:
            h = 0
            for k in range(8):
                word = int.from_bytes(window[8 * k:8 * k + 8], "little")
                h = plain_mix(h * 0x9E3779B97F4A7C15 + word + k + 1 & MASK)
            for k in range(5):
                bits |= 1 << (h >> 11 * k & 2047)
        chain.append(bits)
    return chain


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0

    def overlap(x, y):
        p, q, common = x.bit_count(), y.bit_count(), (x & y).bit_count()
        chance = p * q / 2048
        return min(max((common - chance) / max((p + q) / 2 - chance, 1e-9), 0), 1)

    total = sum(max(overlap(x, y) for y in b) * x.bit_count() for x in a) + sum(max(overlap(y, x) for x in a) * y.bit_count() for y in b)
    return total / sum(x.bit_count() for x in a + b)


def plain_text(chain):
    return base64.b64encode(b"".join(bytes(sum((bits >> 8 * i + j & 1) << 7 - j for j in range(8)) for i in range(256)) for bits in chain)).decode()


def test_against_brute_force(spark, corpus):
    rng = random.Random(8)
    rows = [(i, t[:1500]) for i, t in corpus[:30]] + [(10_001, None), (10_002, "x"), (10_003, "ab" * 32), (10_004, "é" * 33), (10_005, "a" * 300)]
    rows += [(20_000, "".join(rng.choice("abcdefgh ijklm,nop") for _ in range(9000))), (20_001, rows[3][1]), (20_002, rows[3][1][:900] + "and other words")]
    order = sorted(rows)
    texts = [t or "" for _, t in order]
    counts = Counter(plain_bin(w) for t in texts for w in plain_windows(t))
    rank = {b: i for i, b in enumerate(sorted(range(1001), key=lambda b: (counts[b], b)))}
    chain = {t: plain_chain(t, rank) for t in texts}
    got = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    assert len(got) == len(rows) and max(map(len, chain.values())) > 1
    for i, (d, _) in enumerate(order):
        following = texts[(i + 1) % len(texts)]
        new = texts[i][:len(texts[i]) - len(texts[i]) // 4] + following[:len(texts[i]) // 4]
        new_chain, r = plain_chain(new, rank), got[d]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_text(chain[texts[i]]), plain_text(new_chain)), d
        assert abs(r["near_edited"] - plain_likeness(chain[texts[i]], new_chain)) < 1e-12
        assert abs(r["near_next"] - plain_likeness(chain[texts[i]], chain[following])) < 1e-12
