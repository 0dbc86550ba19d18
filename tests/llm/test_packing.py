import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronomesh.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    made = Tokenizer.from_file(PATH)
    return lambda text: [*made.encode(text or "", add_special_tokens=False).ids, 1]


def test_pack_lengths():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([1, 2, rng.randint(1, 50), rng.randint(1, 6000)]) for _ in range(rng.randint(0, 60))]
        pieces = {}
        for sequence in packing.pack_lengths(lengths):
            size = sum(m for _, _, m in sequence)
            assert size <= 2048 and size & (size - 1) == 0
            for d, s, m in sequence:
                pieces.setdefault(d, []).append((s, m))
        for d, n in enumerate(lengths):
            at = 0
            for s, m in sorted(pieces[d]):
                assert s == at and m > 0
                at += m
            assert at == n


def test_step_groups_are_balanced():
    sizes = [2048] * 20 + [1024] * 9 + [512] * 3 + [64]
    groups = packing.step_groups(sizes, 8 * 2048)
    used = [sum(s for s, g in zip(sizes, groups) if g == k) for k in range(max(groups) + 1)]
    assert all(u == 8 * 2048 for u in used[:-1])


def test_pack(spark, reference):
    rng = random.Random(3)
    texts = [None, "", "naïve 日本語 text\r\n\t x", "<|endoftext|> plain", "a " * 30_000] + [" ".join(rng.choices(["the", "Wörter", "12", "!?"], k=rng.randint(1, 900))) for _ in range(50)]
    rows = [(None if i == 7 else i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = packing.pack(df, PATH, chunk_tokens=5000).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        ids = reference(texts[7 if r.doc_id is None else r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rows_[0].tier and at & (at - 1) == 0
    assert sum(r.length for r in got) == sum(len(reference(t)) for _, t, _ in rows)
    assert packing.pack(df.limit(0), PATH).count() == 0
