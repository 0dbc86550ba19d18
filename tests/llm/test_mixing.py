import random

import numpy as np

from chronomesh.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, topic int"


def rows(n, seed=1):
    rng = random.Random(seed)
    forms = ["a | b ", "x*** ", "HEY!! ", "Licensed under X ", "plain "]
    return [(i, rng.choice(forms) * rng.randint(1, 200), rng.choices(["en", "de", "fr"], [6, 3, 1])[0], rng.choices(["s1", "s2", "s3"], [20, 3, 1])[0], 0) for i in range(n)]


def test_rake_meets_all_margins():
    rng = np.random.default_rng(1)
    tokens = rng.random(60) * 100 + 1
    codes = [np.arange(60) // 20, np.arange(60) // 5 % 4, np.arange(60) % 5]
    targets = [np.array([0.2, 0.5, 0.3]), np.array([0.1, 0.2, 0.3, 0.4]), np.full(5, 0.2)]
    w = mixing.rake(tokens, codes, targets, rounds=500)
    for code, target in zip(codes, targets):
        assert np.allclose(np.bincount(code, w), target, atol=1e-9)


def test_fill_level():
    rng = np.random.default_rng(2)
    for _ in range(100):
        tokens, share = rng.random(30) + 0.01, rng.random(30) + 0.01
        share /= share.sum()
        level = mixing.fill_level(tokens, share, 0.6 * tokens.sum())
        assert np.isclose(np.minimum(tokens, level * share).sum(), 0.6 * tokens.sum())


def test_sampled_tokens_follow_targets_and_tables_agree(spark):
    data = rows(4000)
    df = spark.createDataFrame(data, SCHEMA)
    plan = {r.doc_id: r for r in mixing.mixture(df).collect()}
    total = sum(r.n_tokens for r in plan.values())
    expected = sum(r.n_tokens * r.probability for r in plan.values())
    assert abs(expected / total - mixing.BUDGET) < 1e-6
    got = sum(r.n_tokens for r in plan.values() if r.selected)
    assert abs(got / expected - 1) < 0.05
    kept = {r.doc_id for r in mixing.sample(df).collect()}
    assert kept == {i for i, r in plan.items() if r.selected}
    table = {r.doc_id: r["__mix_probability"] for r in mixing.mix(df, local_cells=3).collect()}
    local = {r.doc_id: r["__mix_probability"] for r in mixing.mix(df).collect()}
    assert all(abs(table[i] - p) < 1e-9 for i, p in local.items())


def test_edge_cases(spark):
    data = rows(50) + [(None, None, None, None, None), (3, "", "en", "s1", 1), (60, "long " * 200_000, None, "s9", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mixture(df).collect()
    assert len(got) == len(data) and all(0 <= r.probability <= 1 for r in got)
    assert [(r.source, r.lang, r.n_tokens) for r in got if r.doc_id is None] == [("unknown", "unknown", 1)]
    assert mixing.mixture(df.limit(0)).count() == 0
    assert mixing.sample(df).columns == df.columns


def test_stated_shares_and_topic_column(spark):
    data = [(i, "one two three " * (1 + i % 7), "en", f"s{i % 3}", ("a", "b", "c", None)[i % 4]) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, subject string")
    margins = (mixing.Margin("source", 1.0, {"s0": 0.2, "s1": 0.6}), mixing.Margin("lang"), mixing.Margin("topic", 1.0, {"a": 0.5, "unknown": 0.1, "nowhere": 0.0}))
    got = mixing.mix(df, 0.2, margins, topic="subject").collect()
    expected = lambda column, value: sum(r["__mix_tokens"] * r["__mix_probability"] for r in got if r[column] == value)
    total = sum(r["__mix_tokens"] * r["__mix_probability"] for r in got)
    for column, value, share in (("__mix_source", "s0", 0.2), ("__mix_source", "s1", 0.6), ("__mix_source", "s2", 0.2), ("__mix_topic", "a", 0.5), ("__mix_topic", "unknown", 0.1), ("__mix_topic", "b", 0.2)):
        assert abs(expected(column, value) / total - share) < 0.01
    assert all(r["__mix_tokens"] == 3 * (1 + r.doc_id % 7) for r in got)


def test_tokens(spark):
    texts = [None, "", "  ", "a bc", "internationally 12345, x-y", "日本語 é!"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.tokens().alias("n")).collect()
    assert {r.i: r.n for r in got} == {0: 1, 1: 1, 2: 1, 3: 2, 4: 9, 5: 3}
