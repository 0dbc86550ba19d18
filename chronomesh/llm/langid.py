"""Language identification: word-first backoff to shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import bucket_of_id, slices, stored, temporary

UNDETERMINED = "und"
#: A word is a letter and the letters and marks that follow it, by Unicode category.
WORD, ASCII_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+"), re.compile("[a-z]+")
LONGEST, SHORTEST = 5, 1
#: The model is fitted on about so many labelled rows at most, chosen by hashed ids.
FIT_ROWS = 5_000
#: A word or n-gram is known for a language once it was seen so often in it.
LEAST_SEEN, LEAST_SEEN_GRAM = 2, 4
#: Added to every count.
PRIOR = 0.1
#: Words whose backoff a worker remembers; what is forgotten is computed again.
MEMO = 20_000

#: ((language, evidence), ...): log((n + PRIOR) / PRIOR) for the languages that have a unit; the others have none.
Evidence = tuple[tuple[int, float], ...]


class Model(NamedTuple):
    """Known units by language. base[k][l]: log frequency in language l of a unit of order k (0: words) that it never showed."""

    langs: list[str]
    base: list[list[float]]
    words: dict[str, Evidence]
    grams: dict[str, Evidence]


def words_of(text: str) -> list[str]:
    """The lower-case words of a text."""
    low = text.lower()
    return ASCII_WORD.findall(low) if low.isascii() else WORD.findall(low)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words and of n-grams (of padded words) by language, one set of rows for each bounded slice."""
    for batch in slices(batches, limit=2 << 20):
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words.setdefault(lang, Counter()).update(words_of(text))
        rows: list[tuple[str, int, str, int]] = []
        for lang, seen in words.items():
            grams: Counter = Counter()
            for word, n in seen.items():
                padded = f" {word} "
                for k in range(SHORTEST, LONGEST + 1):
                    for i in range(len(padded) - k + 1):
                        grams[padded[i : i + k]] += n
            rows += [(lang, 0, w, n) for w, n in seen.items()]
            rows += [(lang, len(g), g, n) for g, n in grams.items()]
        lang, order, unit, n = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(order, pa.int32()), pa.array(unit, pa.string()), pa.array(n, pa.int64())], ["lang", "ord", "unit", "n"])


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on (doc_id, text, lang): log frequencies by language of known words and of n-grams of each order.

    About `rows` labelled rows at most take part, those whose hashed id lies below a cut that follows from their
    count, so that fitting costs the same at any size and no text is sorted or sent to choose them. What is collected
    and broadcast is bounded by these rows' words. Evidence is held for the languages that have a unit alone, so the
    model doesn't grow with units times languages.

    Rows with null text or lang don't take part; repeated rows count each; no rows give a model without languages.
    """
    usable = labelled.filter("lang is not null")
    share = min(1.0, rows / max(1, usable.count()))
    taken = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32))).filter("text is not null")
    counted = taken.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(_count, "lang string, ord int, unit string, n long")
    with temporary(labelled.sparkSession):
        counts = stored(counted.groupBy("lang", "ord", "unit").agg(F.sum("n").alias("n")), "langid-counts")
        sums = {(r.lang, r.ord): r for r in counts.groupBy("lang", "ord").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
        langs = sorted({k for k, _ in sums})
        total = lambda lang, k: (sums[lang, k].total + PRIOR * (sums[lang, k].kinds + 1)) if (lang, k) in sums else PRIOR
        base = [[math.log(PRIOR / total(lang, k)) for lang in langs] for k in range(LONGEST + 1)]
        known = counts.filter(F.expr(f"n >= if(ord = 0, {LEAST_SEEN}, {LEAST_SEEN_GRAM})"))
        units = known.groupBy("ord", "unit").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("seen"))
        place, shared = {lang: i for i, lang in enumerate(langs)}, {}
        tables: tuple[dict, dict] = ({}, {})
        for r in units.toLocalIterator(prefetchPartitions=True):
            seen = tuple((place[x.lang], math.log((x.n + PRIOR) / PRIOR)) for x in r.seen)
            tables[r.ord > 0][r.unit] = shared.setdefault(seen, seen)  # equal evidence is held once
    return Model(langs, base, *tables)


class Scorer:
    """Scores words under a model, remembering those it has seen lately."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, tuple[tuple[tuple[int, float], ...], Evidence]] = {}

    def backoff(self, word: str) -> tuple[tuple[tuple[int, float], ...], Evidence]:
        """An unseen word: from each place the longest known n-gram that starts there, averaged over the places used.

        Returns the orders used with their shares, and the evidence by language.
        """
        padded, i, used = f" {word} ", 0, 0
        orders: dict[int, int] = {}
        found: dict[int, float] = {}
        grams = self.model.grams
        while i < len(padded):
            step = 1
            for k in range(min(LONGEST, len(padded) - i), SHORTEST - 1, -1):
                evidence = grams.get(padded[i : i + k])
                if evidence is not None:
                    for lang, value in evidence:
                        found[lang] = found.get(lang, 0.0) + value
                    orders[k] = orders.get(k, 0) + 1
                    used += 1
                    step = max(1, k - 1)
                    break
            i += step
        return tuple((k, n / used) for k, n in orders.items()), tuple((lang, value / used) for lang, value in found.items())

    def word(self, word: str) -> tuple[tuple[tuple[int, float], ...], Evidence]:
        known = self.model.words.get(word)
        if known is not None:
            return ((0, 1.0),), known
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = self.backoff(word)
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        words = Counter(words_of(text)) if text else None
        langs = self.model.langs
        if not words or not langs:
            return UNDETERMINED, 0.0
        orders, total = [0.0] * (LONGEST + 1), [0.0] * len(langs)
        for word, n in words.items():
            used, evidence = self.word(word)
            for k, share in used:
                orders[k] += n * share
            for lang, value in evidence:
                total[lang] += n * value
        for k, n in enumerate(orders):
            if n:
                total = [x + n * y for x, y in zip(total, self.model.base[k])]
        best = max(range(len(total)), key=lambda i: total[i])  # ties: the first language by name
        return langs[best], 1.0 / sum(math.exp(max(-700.0, x - total[best])) for x in total)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred and score, the posterior probability of lang_pred under equal priors.

    Only text is read. Null text or one without a letter: `und` with score 0. A text none of whose units is known
    takes the first language by name with score 1 / languages. Null doc_id: returned as null. Repeated rows are each
    returned. An empty table gives no rows; a model fitted on nothing answers `und`.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            found = [scorer.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return taken.mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on documents whose crc32(doc_id) mod folds is not held, predict all: doc_id, held_out, lang_pred, score.

    Null, empty, repeated and tied cases as in fit() and predict(); a null doc_id counts as the empty text in the folds.
    """
    in_fold = bucket_of_id("doc_id", folds) == held
    predicted = predict(docs, fit(docs.filter(~in_fold), rows))
    return predicted.select("doc_id", (bucket_of_id("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all their columns, whose language is determined with a score of at least `least`.

    Null and empty texts and those without a letter go, whatever `least` is. Repeated rows are judged each, null ids like
    others; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            found = [scorer.predict(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([name != UNDETERMINED and value >= least for name, value in found], pa.bool_()))

    return docs.mapInArrow(run, schema)
