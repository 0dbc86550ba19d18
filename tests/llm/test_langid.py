import math
import random
import zlib

from pyspark.sql import functions as F

from chronomesh.llm import langid

PARTS = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ein", "ich"], "es": ["ción", "ado", "que", "os"]}


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(PARTS))
        out.append((i, " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), lang, "x"))
    return out


def test_held_out_accuracy(spark):
    data = rows(400)
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    held = [i for i in range(400) if got[i].held_out]
    assert len(held) > 60 and sum(got[i].lang_pred == data[i][2] for i in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    changed = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit("zz")).otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(changed).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_edge_cases(spark):
    data = rows(60) + [(100, None, "en", ""), (101, "", None, ""), (102, "12 -- !", "de", ""), (None, "thering ander", None, ""), (3, "schung", "de", ""), (103, "über " * 100_000, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[None].lang_pred == "en"
    assert langid.identify(df.limit(0)).count() == 0
    kept = langid.accept(df, langid.fit(df), 0.0)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {0, 1, None} and not {r.doc_id for r in kept.collect()} & {100, 101, 102}


def test_backoff_prefers_longest():
    base = [[0.0, 0.0]] * 6
    scorer = langid.Scorer(langid.Model(["a", "b"], base, {"cat": ((0, 2.0),)}, {" do": ((0, 4.0),), "o": ((1, 18.0),), " ": (), "og ": ((0, 8.0),)}))
    assert scorer.word("cat") == (((0, 1.0),), ((0, 2.0),))
    assert scorer.word("dog") == (((3, 2 / 3), (1, 1 / 3)), ((0, 4.0),))  # " do", "og " and the last blank, averaged
    assert scorer.predict("zzz")[0] == "a" and scorer.predict("")[0] == "und"


def test_words():
    assert langid.words_of("The CAT-2, x_y") == ["the", "cat", "x", "y"]
    assert langid.words_of("½ ² Ⅷ ३ 12 -- _") == []
    assert langid.words_of("हिन्दी भाषा, Été cafe\u0301") == ["हिन्दी", "भाषा", "été", "cafe\u0301"]


def brute_predictions(train, texts):
    """The method over plain tables: every count kept, every score a full vector."""
    counts = {}
    for text, lang in train:
        for word in langid.words_of(text):
            padded = f" {word} "
            for unit in [(0, word)] + [(k, padded[i : i + k]) for k in range(1, 6) for i in range(len(padded) - k + 1)]:
                counts.setdefault(unit, {}).setdefault(lang, 0)
                counts[unit][lang] += 1
    langs = sorted({lang for _, lang in train})
    size = {(k, lang): [n.get(lang, 0) for (o, _), n in counts.items() if o == k and lang in n] for k in range(6) for lang in langs}

    def vector(unit):
        seen, least = counts.get(unit, {}), 2 if unit[0] == 0 else 4
        seen = {lang: n for lang, n in seen.items() if n >= least}
        return seen and [math.log((seen.get(lang, 0) + 0.1) / (sum(size[unit[0], lang]) + 0.1 * (len(size[unit[0], lang]) + 1))) for lang in langs]

    out = []
    for text in texts:
        total, words = [0.0] * len(langs), langid.words_of(text)
        for word in words:
            held = [vector((0, word))] if vector((0, word)) else []
            padded, i = f" {word} ", 0
            while not vector((0, word)) and i < len(padded):
                k = next((k for k in range(min(5, len(padded) - i), 0, -1) if vector((k, padded[i : i + k]))), 0)
                held += [vector((k, padded[i : i + k]))] if k else []
                i += max(1, k - 1)
            total = [x + sum(h[j] for h in held) / max(1, len(held)) for j, x in enumerate(total)]
        best = max(range(len(langs)), key=lambda j: (total[j], -j))
        out.append((langs[best], 1 / sum(math.exp(x - total[best]) for x in total)) if words else ("und", 0.0))
    return out


def test_against_brute_force(spark):
    data = rows(120, 3) + [(500, "थाना हिन्दी ½", "hi", ""), (501, "थाना हिन्दी भाषा थाना", "hi", ""), (502, "½ ²", "hi", ""), (503, "andsch thado", None, "")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score string")
    model = langid.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    expect = brute_predictions([(t, lang) for _, t, lang, _ in data if lang], [r[1] for r in data])
    for (i, *_), (lang, score) in zip(data, expect):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9
    assert got[502] == ("und", 0.0)
