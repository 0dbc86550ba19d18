import hashlib
import random
from collections import Counter

import pytest

from chronomesh.llm import orderminhash as omh

MASK = (1 << 64) - 1


def hashes(spark, sql, rows, schema):
    return {tuple(r)[:-1]: r[-1] & MASK for r in spark.createDataFrame(rows, schema).selectExpr("*", f"{sql} as h").collect()}


def brute(spark, texts):
    """The definition in plain steps: number k-mers, deal to buckets, take two least, order by place, hash."""
    out = []
    for text in texts:
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
        grams = [(i, w[i - 1] if i else "^", i == 0, w[i] if i < len(w) else "$", i == len(w)) for i in range(len(w) + 1)]
        pair = hashes(spark, "xxhash64(a, b, c, d)", [g[1:] for g in grams], "a string, b boolean, c string, d boolean")
        seen, numbered = Counter(), []
        for i, *g in grams:
            h = pair[tuple(g)] >> 24
            numbered.append((i, h, seen[h]))
            seen[h] += 1
        second = hashes(spark, "xxhash64(h0, n)", [(h, n) for _, h, n in numbered], "h0 long, n int")
        buckets = {}
        for i, h, n in numbered:
            v = second[h, n] >> 24
            signed = v - (1 << 40) if v >> 39 else v
            buckets.setdefault(v >> 34, []).append((signed, i, v))
        least, tuples = {b: sorted(x)[:2] for b, x in buckets.items()}, {}
        ring = sorted(buckets, key=lambda b: b - 64 if b >= 32 else b)  # a bucket of one takes the next filled one's least
        for at, b in enumerate(ring):
            two = least[b] + (least[ring[(at + 1) % len(ring)]][:1] if len(least[b]) == 1 and len(numbered) > 1 else [])
            tuples[b] = [v for _, _, v in sorted(two, key=lambda y: y[1])]
        ends = hashes(spark, "case when y is null then xxhash64(x) else xxhash64(x, y) end", [(t[0], t[1] if len(t) > 1 else None) for t in tuples.values()], "x long, y long")
        out.append({((b << 58) | (ends[t[0], t[1] if len(t) > 1 else None] >> 6)) >> 32 for b, t in tuples.items()})
    return out


def test_fingerprint_follows_definition(spark):
    rng = random.Random(1)
    texts = ["", "  ", "one", "a b a b a b", " x\ty\x0bz\n", "é à é"] + [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 300))) for _ in range(4)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", omh.fingerprint("t").alias("f")).collect()
    expect = brute(spark, texts)
    for r in got:
        assert set(r.f) == expect[r.i] and len(r.f) == len(expect[r.i])


@pytest.mark.parametrize("ids", [[5], [], list(range(-3, 40)), [-(2**63), 2**63 - 1, 0, 1 << 16, (1 << 16) - 1, 1 << 32, -1, -(1 << 32), 1 << 48, 77]])
def test_successors(spark, ids):
    got = {r.id: r.next_id for r in omh.successors(spark.createDataFrame([(i,) for i in ids], "id long")).collect()}
    order = sorted(ids)
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_edit_sensitivity(spark):
    rng = random.Random(2)
    texts = [None, "", "ab", "überß 𝄞𝄞𝄞", "w " * 40_000] + [" ".join("".join(rng.choices("abcdef", k=3)) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts.append(texts[20])
    rows = [(None if i == 0 else 7 * i - 90, t, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows[::-1], "doc_id long, text string, edited string").repartition(3)
    got = {r.doc_id: r for r in omh.edit_sensitivity(df).collect()}
    assert len(got) == len(rows) and omh.edit_sensitivity(df.limit(0)).count() == 0
    for i, (key, text, _) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        assert got[key].n_chars == len(text)
        assert got[key].edited_sha256 == hashlib.sha256((text[: len(text) - q] + after[:q]).encode()).hexdigest()
        assert 0 <= got[key].near_next <= 1 and 0 <= got[key].near_edited <= 1
        if len(text) > 200 and i != 4:
            assert got[key].near_edited > got[key].near_next + 0.1
    assert got[rows[-1][0]].fingerprint == got[rows[20][0]].fingerprint
    twice = spark.createDataFrame([(1, "a b c d", ""), (1, "a b c d", ""), (2, None, "")], "doc_id long, text string, edited string")
    assert sorted(r.doc_id for r in omh.edit_sensitivity(twice).collect()) == [1, 1, 2]


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    halves = words[200:] + words[:200]
    rows = [(0, " ".join(words)), (1, " ".join(words[:390] + ["x"] * 10)), (2, " ".join(halves))]
    df = spark.createDataFrame(rows, "i int, t string").select("i", omh.fingerprint("t").alias("f"))
    a, b = df.filter("i = 0").select(omh.F.col("f").alias("a")), df.select("i", omh.F.col("f").alias("b"))
    near = {r.i: r.n for r in b.join(a).select("i", omh.likeness("a", "b").alias("n")).collect()}
    assert near[0] == 1.0 > near[1] > near[2]
