import hashlib
import random
import re

import pytest

from chronomesh.llm import substrings

SCHEMA = "doc_id long, text string, start int, n_words string"


def brute(rows, size):
    words = {}
    for doc, text in rows:
        words.setdefault(doc, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    seen, out = set(), {}
    for doc in sorted(words):
        w, gone = words[doc], set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone.update(range(s, s + size))
            seen.add(key)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


@pytest.mark.parametrize("batches,share", [(1, 0.75), (4, 0.75), (5, 0.0)])
def test_against_brute_force(spark, batches, share, monkeypatch):
    monkeypatch.setattr(substrings.occurrences, "__defaults__", (20, 200))
    monkeypatch.setattr(substrings.WindowIndex.__init__, "__defaults__", (20, share))
    rng = random.Random(batches)
    vocabulary = ["a", "b", "Ü", "d", "\u0085e", "\x1ff"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(5, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = rng.choices(passages, k=rng.randint(0, 3)) + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))]
        rng.shuffle(parts)
        rows.append((3 * i - 50, "\t\n".join(parts)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "same " * 500), (904, "x y " * 5000)]
    df = spark.createDataFrame([(d, t, 1, "") for d, t in rows][::-1], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substrings.remove_repeats(df, batches=batches, texts=True).collect()}
    assert got == brute(rows, 20)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("window_run")]


def test_edge_cases(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = " ".join(map(str, range(30)))
    rows = [(None, text), (5, text + " end"), (5, text + " end"), (6, text)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([(None, 30, 0), (5, 31, 30), (5, 31, 30), (6, 30, 30)], key=str)
    got = [(r.doc_id, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame([(7, text, 0, ""), (7, text, 0, "")], SCHEMA)).collect()]
    assert got == [(7, 0), (7, 0)]


def test_hashes_tell_thue_morse_texts_apart(spark):
    """Words of Thue-Morse letters and their complements collide in polynomials modulo 2 ** 64; here no word goes."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    rest = " ".join(f"w{i}" for i in range(19))
    for n in (64, 512, 1024, 2048):
        word, other = ("".join("ab"[b ^ flip] for b in bits[:n]) for flip in (0, 1))
        rows = [(1, f"{word} {rest}"), (2, f"{other} {rest}"), (3, f"{word} {rest}")]
        got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA), batches=1).collect()}
        assert got == {1: 0, 2: 0, 3: 20}
    letters = [" ".join("ab"[b ^ flip] for b in bits[:640]) for flip in (0, 1)]  # windows of Thue-Morse words
    rows = [(1, letters[0]), (2, letters[1])]
    got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(spark.createDataFrame([(d, t, 0, "") for d, t in rows], SCHEMA), batches=2).collect()}
    assert got == {d: n[1] for d, n in brute(rows, 20).items()}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 20, 33])
def test_window_hashes_of_any_size(size):
    rng = random.Random(size)
    texts = [" ".join(rng.choices("abc", k=rng.randint(0, 60))).encode() for _ in range(30)]
    owner, start, primary, check = substrings.window_hashes(texts, size)
    seen = {}
    for o, s, h, c in zip(owner.tolist(), start.tolist(), primary.tolist(), check.tolist()):
        assert seen.setdefault((h, c), texts[o].split()[s : s + size]) == texts[o].split()[s : s + size]
    assert len(seen) == len({tuple(t.split()[s : s + size]) for t in texts for s in range(len(t.split()) - size + 1)})
