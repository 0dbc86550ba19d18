import hashlib
import random
import zlib

import corpus_pipeline
from chronomesh.llm import mixing, packing, secrets
from tests.llm.test_nearcopies import brute_roots
from tests.llm.test_secrets import brute as brute_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(5)
    parts = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ein", "ich"]}
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(30, 90)))
        rows.append([i, text, lang, f"s{i % 5}", len(text)])
    rows += [[200 + i, rows[i][1], rows[i][2], "s9", rows[i][4]] for i in range(0, 60, 3)]
    rows += [[300, None, "en", "s1", 0], [301, "", None, None, 0], [302, "12 34 --", "en", "s1", 8], [303, " ".join(rows[7][1].split()[::-1]) + " password=hunter2222 end", "de", "s1", 900], [None, rows[9][1] + " ending thering", None, "s2", 5], [5, rows[5][1], rows[5][2], "s0", rows[5][4]]]
    return [tuple(r) for r in rows]


def test_stages_against_plain_versions(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "sf/documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "sf/documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path / "sf"))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([tuple(r) for r in docs.collect()])
        if name != "pack":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, near, secret, mixed, packed = kept
    key = lambda r: (-(10**9) if r[0] is None else r[0], r[1] or "")
    assert sorted(language, key=key) == sorted((r for r in corpus() if r[0] not in (300, 301, 302)), key=key)

    ordered = sorted(language, key=key)
    root = brute_roots([r[1] for r in ordered])
    assert sorted(near, key=key) == sorted({ordered[i] for i in root}, key=key)

    spans = lambda t: [(s, e) for s, _, e in brute_spans(t)]
    expect = [(r[0], c := secrets.covered(r[1], spans(r[1]), "[SECRET]"), r[2], r[3], len(c) if spans(r[1]) else r[4]) for r in near]
    assert sorted(secret, key=key) == sorted(expect, key=key)
    assert any("[SECRET] end" in r[1] for r in secret)

    plan = {r.doc_id: r.probability for r in mixing.mixture(spark.createDataFrame(secret, SCHEMA)).collect()}
    drawn = lambda i: int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
    assert sorted(mixed, key=key) == sorted((r for r in secret if drawn(r[0]) < plan[r[0]]), key=key)

    encode, pieces = packing.encoder(corpus_pipeline.VOCABULARY), {}
    for doc, start, length, crc, total, *_ in packed:
        pieces.setdefault(doc, []).append((start, length, crc))
        text = next(r[1] for r in mixed if r[0] == doc)
        ids = [*encode.encode_ordinary(text), 1]
        assert total == len(ids) and crc == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + length]))
    assert set(pieces) == {r[0] for r in mixed}


def test_run_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
