import math
import random
import re
import unicodedata
import zlib

import numpy as np

from chronomesh.llm import toxicity


def corpus(n, seed=1):
    rng = random.Random(seed)
    parts = ["ten", "the", "er", "ing", "and", "est"]
    prose = lambda k: ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(k)]
    docs, labels = [], []
    for i in range(n):
        words, toxic = prose(rng.randint(10, 120)), i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "grumpf", "zorkan" + rng.choice(parts), "zorkel" + rng.choice(parts)]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    return docs, labels


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    weak = vote(0.65)
    votes = np.stack([vote(0.85), vote(0.85), vote(0.8), weak, weak, weak, weak], axis=1)
    model = toxicity.fit_label_model(votes, y.astype(float))
    assert model.weights[3:].max() < 0.4 < 0.8 < model.weights[:3].min()
    assert model.correlations[3, 4] > 0.9 and abs(model.correlations[0, 1]) < 0.3
    accuracy = model.tables[:, 1, 2]
    assert accuracy[0] > accuracy[3]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85


def test_held_out_accuracy(spark):
    docs, labels = corpus(500)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(d, lab).collect()}
    held = [(got[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and len(held) > 60
    assert sum(r.predicted == t for r, t in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # labels of held-out rows are not read
    flipped = spark.createDataFrame([(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in toxicity.detect(d, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_edge_cases(spark):
    docs, labels = corpus(60)
    docs += [(None, "you idiot scum", ""), (900, None, None), (901, "", ""), (3, docs[3][1], ""), (902, "ten " * 100_000, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (4, 1), (77_777, 1)], "doc_id long, toxic int")
    got = toxicity.detect(d, lab).collect()
    assert len(got) == len(docs) and all(r.score is not None for r in got)
    assert toxicity.detect(d.limit(0), lab).count() == 0
    none = {r.doc_id: r.predicted for r in toxicity.detect(d, lab.limit(0)).collect()}
    assert none[None] == 1 and none[901] == 0


def test_whole_texts_are_judged():
    quiet, loud = "calm words here " * 200, "LOUD WORDS HERE " * 900
    assert toxicity.pattern_votes(quiet + loud, True)[0] == 1 and toxicity.pattern_votes(loud[:2400] + quiet * 4, True)[0] == 0
    opening = "report of the town office to all people who read these pages " * 2
    assert toxicity.signature(opening + "one") != toxicity.signature(opening + "two")
    assert toxicity.signature("One  text\n") == toxicity.signature("one TEXT")


def test_scores_against_plain_sums(spark):
    """A classifier's scores by their definition: which units a text has, one by one."""
    weights = {"idiot": 2.0, "zor*": 1.5, "zor**": 0.7, "हिन्दी": 1.1, "calm": -1.0, "ten": -0.2}
    model = toxicity.Classifier(weights, [0.5, 0.25, 0.75, 0.1, 0.2], -0.6, frozenset(["idiot", "zor*"]), toxicity.stems_of(weights))
    rng = random.Random(6)
    texts = [None, "", "IDIOT!! !! !!", "zorka ***", "zorka zorki", "zor", "हिन्दी calm"] + [" ".join(rng.choices(["idiot", "Zorka", "zorki", "calm", "ten", "x2y", "***", "!!", "WORD"], k=rng.randint(1, 200))) for _ in range(80)]

    def plain(text):
        words = re.sub(r"[\d_\W]", lambda m: m[0] if unicodedata.category(m[0])[0] in "LM" else " ", (text or "").lower()).split()
        longer = sum(w.startswith("zor") and len(w) > 3 for w in words)
        held = {w for w in words} | ({"zor*"} if longer else set()) | ({"zor**"} if longer > 1 else set())
        letters, upper = sum(c.isalpha() for c in text or ""), sum(c.isupper() for c in text or "")
        hit, long = bool(held & {"idiot", "zor*"}), len(text or "") > 400
        votes = [letters > 20 and upper > 0.6 * letters, (text or "").count("!!") >= 3, "***" in (text or ""), -(not hit and long), -(not hit and not long)]
        total = -0.6 + sum(v for u, v in weights.items() if u in held) + sum(w * v for w, v in zip(model.patterns, votes))
        return 1 / (1 + math.exp(-total))

    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert all(math.isclose(got[i], plain(t), rel_tol=1e-12) for i, t in enumerate(texts))


def test_posterior_against_bayes():
    tables = np.array([[[0.1, 0.7, 0.2], [0.05, 0.35, 0.6]], [[0.3, 0.6, 0.1], [0.2, 0.4, 0.4]]])
    model = toxicity.LabelModel(tables, np.array([1.0, 0.5]), np.zeros((2, 2)), 0.3)
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            one, none = (p * tables[0, y, a + 1] * tables[1, y, b + 1] ** 0.5 for y, p in ((1, 0.3), (0, 0.7)))
            assert math.isclose(model.posterior(np.array([[a, b]]))[0], one / (one + none), rel_tol=1e-12)
