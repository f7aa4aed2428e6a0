import random

import numpy as np
import pytest
import xxhash

from agora.llm.components import connected_components
from agora.llm.simhash import covering_masks, fingerprint, near_duplicates, near_pairs


def groups(edges, nodes):
    low = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(corpus):
    for _, text in corpus:
        assert fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("free", [(1 << 64) - 1, 0x0F0F_FFFF_1234_5678])
def test_masks_cover_every_pair_within_the_radius(free):
    masks = covering_masks(free, 3)
    places = [i for i in range(64) if free >> i & 1]
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << p for p in rng.sample(places, rng.randint(0, 3)))
        assert any(m & flips == 0 for m in masks)


def test_against_brute_force(corpus, corpus_df):
    rng = random.Random(9)
    got = {r["doc_id"]: r for r in near_duplicates(corpus_df).collect()}
    fps = {d: plain_fingerprint(t) for d, t in corpus}
    ids = list(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if (fps[a] ^ fps[b]).bit_count() <= 3]
    low = groups(edges, ids)
    assert {d: (r["fingerprint"], r["component_id"]) for d, r in got.items()} == {d: (f"{fps[d]:016x}", low[d]) for d in ids}
    assert rng


def test_crowded_buckets_are_split_without_loss(spark):
    """Many fingerprints near one centre, with a bucket limit that forces the second level."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 6))) for _ in range(400)}
    fps |= {rng.getrandbits(64) for _ in range(200)}
    signed = [int(np.array(f, np.uint64).view(np.int64)) for f in fps]
    pairs = near_pairs(spark.createDataFrame([(f,) for f in signed], "fp bigint"), 3, bucket=8).collect()
    edges = [(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert all(((r["x"] ^ r["y"]) & (1 << 64) - 1).bit_count() <= 3 for r in pairs)
    assert groups([(r["x"], r["y"]) for r in pairs], signed) == groups(edges, signed)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(300, 380)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, 5: 5, **{i: 5 for i in range(300, 380)}}


def test_edges(edge_df, empty_df):
    rows = near_duplicates(edge_df).collect()
    assert len(rows) == 13
    zero = {r["doc_id"]: r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert zero == {1: 1, 2: 1, 3: 1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in rows if r["doc_id"] == 4} == {4}
    assert near_duplicates(empty_df).count() == 0


def test_a_row_without_an_id_links_others(spark):
    from agora.llm.simhash import _components

    rows = [(1, 0b0), (None, 0b111), (3, 0b111111), (None, 1 << 40 | 0xFFFFFF00), (9, -1)]
    got = {r["fp"]: r["first"] for r in _components(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), 3).collect()}
    assert got == {0: 1, 0b111: 1, 0b111111: 1, 1 << 40 | 0xFFFFFF00: None, -1: 9}
