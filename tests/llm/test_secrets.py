import hashlib
import random
import re
from collections import Counter

from chronomesh.llm import secrets


def brute(text):
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    parts = ["password", "=", ": ", "'", '"', "Api_Key", "APIKEY", "toKen", "ſecret", "secret", "TOKEN", "abc", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", " ", "é", "/x.", "\n"]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert secrets.base_spans(text) == brute(text), text


def test_battery_separates_random_from_words():
    rng = random.Random(2)
    drawn = [secrets.score("".join(rng.choices(secrets.ALPHABETS["base62"], k=32))) for _ in range(200)]
    words = [secrets.score("".join(rng.choices(["tion", "the", "er", "ing", "and", "ed"], k=10))) for _ in range(200)]
    assert sum(drawn) / 200 > 75 > 50 > sum(words) / 200


def test_scan(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices(["ten", "the", "er", "ing", "and", "est"], k=rng.randint(1, 12))) for _ in range(n))
    keys = ["".join(rng.choices(secrets.ALPHABETS["base62"], k=40)) for _ in range(40)]
    texts = [prose(100) + (f" é {keys[i // 10]} " if i % 10 == 0 else " ") + prose(20) for i in range(400)]
    texts += [None, "", "password=hunter22", "x" * 300_000, "password: 'a' token=abcdef"]
    rows = [(None if i == 5 else i, t, 1) for i, t in enumerate(texts)] + [(402, texts[402], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = secrets.digests(secrets.scan(df)).collect()
    assert len(got) == len(rows)
    found = 0
    for r in got:
        text = texts[5 if r.doc_id is None else r.doc_id] or ""
        base = [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute(text)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex")]
        more = [x for x in r.spans.split(",") if x.startswith("random")]
        for x in more:
            _, s, e = x.split(":")
            assert text[int(s) : int(e)] in keys
        found += bool(more)
    assert found >= 36
    assert secrets.scan(df.limit(0)).count() == 0
    red = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert red[402] == "[SECRET]" and red[404] == "password: 'a' [SECRET]" and red[401] == "" and red[1] == texts[1]
    assert sum("[SECRET]" in (t or "") for t in red.values()) >= 38


def test_long_keys_in_ordinary_prose(spark):
    rng = random.Random(7)
    words = "the of a report was sent to every office in town and people who read it there said that most pages were about water prices for next year".split()
    plain = ["sendEveryReportToTheNextOffice", "most_pages_were_about_water_prices", "docs/town/office/report/prices", "NextYearsWaterPricesForEveryTown"]
    for n_docs in (30, 300):
        rows, planted = [], {}
        for i in range(n_docs):
            w = rng.choices(words, k=rng.randint(40, 90))
            if i % 6 == 0:
                chars = secrets.ALPHABETS[("base62", "base64")[i // 6 % 2]]
                planted[i] = "".join(rng.choices(chars, k=(40, 64)[i // 12 % 2]))
            w.insert(rng.randrange(len(w)), planted.get(i) or rng.choice(plain))
            rows.append((i, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = {r.doc_id: [rows[r.doc_id][1][s.start : s.end] for s in r.spans] for r in secrets.scan(df).collect()}
        assert not any(found[i] for i in range(n_docs) if i not in planted)
        assert sum(found[i] == [k] for i, k in planted.items()) >= 0.8 * len(planted)
        red = {r.doc_id: r.text for r in secrets.redact(df).collect()}
        assert all((k in red[i]) == (not found[i]) for i, k in planted.items())


def test_keys_beside_names_of_like_length():
    """Keys of 24 to 64 characters among twice as many names: recall and false discoveries, without Spark."""
    words = "the of a report was sent to every office in town and people who read it there said that most pages were about water prices for next year".split()
    kept, drawn, false, finds = Counter(), Counter(), 0, 0
    for seed in range(3):
        rng = random.Random(seed)
        forms = [lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), "_".join, "/".join, "-".join, lambda w: w[0] + "".join(x.capitalize() for x in w[1:]) + str(rng.randrange(100))]
        nulls, candidates, docs = Counter(), Counter(), []
        for i in range(300):
            w, key = rng.choices(words, k=rng.randint(40, 90)), None
            if i % 6 == 0:
                key = "".join(rng.choices(secrets.ALPHABETS[rng.choice(["base62", "base64", "base36"])], k=(24, 32, 40, 64)[i // 6 % 4]))
                w.insert(rng.randrange(len(w)), key)
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(forms)(rng.choices(words, k=rng.randint(4, 8))))
            text = " ".join(w)
            found = secrets.spans_of(text, nulls)[1]
            docs.append((text, key, found))
            candidates.update((c, v) for _, _, c, v in found)
        cut = secrets.thresholds(dict(secrets.fixed_nulls() + nulls), dict(candidates))
        for text, key, found in docs:
            got = {text[s:e] for s, e, c, v in found if v >= cut.get(c, secrets.BUCKETS + 1)}
            if key:
                drawn[len(key)] += 1
                kept[len(key)] += key in got
            finds, false = finds + len(got), false + len(got - {key})
    assert sum(kept.values()) >= 0.9 * sum(drawn.values()) and kept[32] >= 0.88 * drawn[32] and kept[64] >= 0.95 * drawn[64]
    assert false <= secrets.FALSE_DISCOVERY * finds


def test_thresholds_against_plain_benjamini_hochberg():
    rng = random.Random(9)
    for _ in range(50):
        nulls = Counter((0, rng.choice([10, 20, 30, 60, 90])) for _ in range(rng.randint(0, 200)))
        found = Counter((0, rng.choice([20, 60, 90, 99])) for _ in range(rng.randint(1, 40)))
        scores = sorted((s for (_, s), n in found.items() for _ in range(n)), reverse=True)
        total = sum(nulls.values())
        p = [(1 + sum(n for (_, s), n in nulls.items() if s >= x)) / (1 + total) for x in scores]
        passing = [x for k, x in enumerate(scores) if p[k] <= 0.05 * sum(y >= x for y in scores) / len(scores)]
        assert secrets.thresholds(nulls, found) == ({0: min(passing)} if passing else {})


def test_runs_of_kinds():
    assert secrets.kind_runs("aaaaBBBB1111aaaa", "base62") < 1e-3 < 0.5 < secrets.kind_runs("aB1aB1aB1aB1aB1a", "base62")
    assert secrets.kind_runs("0123456789", "decimal") == 1.0
