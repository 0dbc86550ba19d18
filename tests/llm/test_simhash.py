import random
import re

import numpy as np
import xxhash

from chronomesh.llm import simhash
from chronomesh.llm.components import connected_components

SCHEMA = "doc_id long, text string, fingerprint string"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(codes, radius):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_fingerprints():
    texts = ["The Cat sat on THE mat x", "", None, "one", "a b", "É été\tÀ la\x0bplage\x1fy", "ab " * 999]
    made = simhash.fingerprints([None if t is None else t.encode() for t in texts])
    assert made.tolist() == [brute_fingerprint(t) for t in texts]


def test_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(12)]))
    groups = rng.integers(0, 3, len(codes))
    index = simhash.GrayIndex(groups, codes)
    found = {(int(index.codes[i]), int(index.codes[j])) for a, b in index.pairs(2, block=37) for i, j in zip(a, b)}
    expect = {frozenset((int(x), int(y))) for i, x in enumerate(codes) for j, y in enumerate(codes) if i < j and groups[i] == groups[j] and bin(int(x) ^ int(y)).count("1") <= 2}
    assert {frozenset(p) for p in found} == expect and len(found) == len(expect)


def test_near_duplicates(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 60]))) for _ in range(60)]
    texts += [t.replace("Beta", "gamma", 1) for t in texts] + texts[:20] + [None, "", "long " * 50_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    codes = [brute_fingerprint(t) for t in texts]
    for radius, limit in ((2, 200_000), (2, 3), (8, 200_000), (8, 5)):
        got = simhash.near_duplicates(spark.createDataFrame(rows[::-1], SCHEMA), radius=radius, limit=limit).collect()
        expect = {i: (f"{codes[i]:016x}", r) for i, r in enumerate(brute_components(codes, radius))}
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == expect and len(got) == len(rows)


def test_edge_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", ""), (5, "a b c d", ""), (5, "a b c d", ""), (7, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (5, 0), (5, 0), (7, 7)]


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (None, 3), (100, 101)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
