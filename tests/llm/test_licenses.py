import math
import random
import re

from chronomesh.llm import licenses


def words(text):
    return re.sub(r"""["'`()\[\]{}<>,;:.!?*#]+""", " ", (text or "").lower()).split()


def shingles(text):
    w = words(text)
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])


def brute(text, templates, least):
    """All templates by the definition of windows, with no bands."""
    s, out = shingles(text), {}
    for name, template in templates.items():
        wanted = set(shingles(template))
        n = len(wanted)
        for at in range(0, len(s), n):
            window = s[at : at + 2 * n]
            both = wanted & set(window)
            if len(both) / n >= least:
                c, first = out.get(name, (0, math.inf))
                out[name] = (max(c, len(both) / n), min(first, at + min(window.index(x) for x in both)))
    return out


def test_bands_meet_their_guarantee():
    n = licenses.bands_for(0.8, 1e-4)
    assert (1 - 0.8 / 2.2) ** n <= 1e-4 < (1 - 0.8 / 2.2) ** (n - 1)


def test_against_brute_force(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choices(["the", "licensed", "under", "of", "source", "alpha", "beta"], k=n))
    texts = [None, "", "the", "under the apache", "x " * 100_000]
    for name, template in licenses.TEMPLATES.items():
        for cut in range(6):
            w = template.split()
            for _ in range(cut):
                w[rng.randrange(len(w))] = "zzz"
            texts.append(f"{prose(rng.randint(0, 90))}\n{' '.join(w)}\t{prose(rng.randint(0, 90))}")
    rows = [(None if i == 9 else i, t, 1) for i, t in enumerate(texts)] + [(8, texts[8], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license int").repartition(3)
    got = {(r.doc_id, r.license): (r.containment, r.first_word) for r in licenses.scan(df).collect()}
    expect = {(None if i == 9 else i, n): v for i, t in enumerate(texts) for n, v in brute(t, licenses.TEMPLATES, 0.8).items()}
    assert got == expect and len(got) > 20
    assert licenses.scan(df.limit(0)).count() == 0


def test_bare_rights_notice(spark):
    rows = [(1, "some prose ends here\nAll rights reserved."), (2, "all rights are reserved"), (3, licenses.TEMPLATES["Rights-reserved"])]
    got = {(r.doc_id, r.license, r.containment, r.first_word) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "Rights-reserved-line", 1.0, 4), (3, "Rights-reserved-line", 1.0, 0), (3, "Rights-reserved", 1.0, 0)}
