"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import bucket_of_id, slices, stored, temporary

# Seed lexicon of plain English insults.
SEEDS = ("clown", "disgusting", "dumb", "fool", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
PATTERNS = ("shouting", "exclaims", "masked", "clean long", "clean short")

WORD, ASCII_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+"), re.compile("[a-z]+")
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Voters and classifier are fitted on about so many labelled rows at most, chosen by hashed ids.
FIT_ROWS = 10_000
#: Units that are counted, that vote, and that the classifier reads, at most.
CANDIDATES, VOTERS, FEATURES = 20_000, 96, 4_000
LEAST_SEEN, LEAST_ODDS = 5, 2.0
LABEL_TRUST = 0.95


def units(text: str, stems: frozenset[str] | None = None) -> set[str]:
    """The lower-case words of a text, their beginnings marked by a star, and by two if several words begin so.

    stems: only these beginnings (without stars) are looked for.
    """
    low = text.lower()
    seen = Counter(ASCII_WORD.findall(low) if low.isascii() else WORD.findall(low))
    held: set[str] = set(seen)
    begun: dict[str, int] = {}
    for word, n in seen.items():
        for k in PREFIXES:
            if len(word) <= k:
                break
            stem = word[:k]
            if stems is None or stem in stems:
                begun[stem] = begun.get(stem, 0) + n
    held.update(s + "*" for s in begun)
    held.update(s + "**" for s, n in begun.items() if n > 1)
    return held


def stems_of(found) -> frozenset[str]:
    return frozenset(u.rstrip("*") for u in found if u.endswith("*"))


def signature(text: str) -> int:
    """Copies of a text share it, whatever their case and blanks; support of a unit is counted over distinct ones."""
    return xxhash.xxh64_intdigest(" ".join(text.lower().split()).encode("utf-8", "replace"))


def pattern_votes(text: str, hit: bool) -> list[int]:
    """Votes of the pattern voters: 1 toxic, -1 not, 0 none."""
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    return [int(letters > 20 and upper > 0.6 * letters), int(text.count("!!") >= 3), int("***" in text), -int(not hit and len(text) > 400), -int(not hit and len(text) <= 400)]


class LabelModel(NamedTuple):
    """Class-conditional vote probabilities (voter, class, vote + 1), each voter's weight under correlations, and the prior."""

    tables: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of each row. labels: given ones count as one more voter that is right with LABEL_TRUST."""
        logs = np.log(self.tables)
        odds = np.full(len(votes), math.log(self.prior / (1 - self.prior)))
        if labels is not None:
            odds += math.log(LABEL_TRUST / (1 - LABEL_TRUST)) * (2 * labels - 1)
        for j in range(votes.shape[1]):
            odds += self.weights[j] * (logs[j, 1] - logs[j, 0])[votes[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25) -> LabelModel:
    """EM over votes (rows, voters) in -1, 0, 1, starting from labels, which stay one voter among the others.

    Given the class, voters are taken as independent but for the correlation of what is left of their votes within
    the classes; a voter's evidence is divided by one plus its correlations with the others, so that a family of
    voters that say the same counts about once.
    """
    n, m = votes.shape
    p = np.clip(labels.astype(float), 0.02, 0.98)
    for _ in range(rounds):
        tables = np.empty((m, 2, 3))
        for y, mass in enumerate((1 - p, p)):
            for s in (-1, 0, 1):
                tables[:, y, s + 1] = ((votes == s) * mass[:, None]).sum(0) + 0.5
            tables[:, y] /= tables[:, y].sum(1, keepdims=True)
        means = tables[:, :, 2] - tables[:, :, 0]
        left = votes - (p[:, None] * means[:, 1] + (1 - p)[:, None] * means[:, 0])
        cov = left.T @ left / n
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = cov / np.outer(scale, scale)
        np.fill_diagonal(corr, 0.0)
        weights = 1 / (1 + np.maximum(corr - 0.05, 0).sum(1))
        model = LabelModel(tables, weights, corr, float(np.clip(p.mean(), 0.01, 0.99)))
        before, p = p, model.posterior(votes, labels)
        if np.abs(before - p).max() < 1e-4:
            break
    return model


class Classifier(NamedTuple):
    """A linear classifier over units and pattern votes; voters tells which units count as a hit for the patterns."""

    weights: dict[str, float]
    patterns: list[float]
    bias: float
    voters: frozenset[str]
    stems: frozenset[str]

    def score(self, text: str | None) -> float:
        text = text or ""
        held = units(text, self.stems)
        total = self.bias + sum(map(self.weights.get, held & self.weights.keys()))
        total += sum(w * v for w, v in zip(self.patterns, pattern_votes(text, not self.voters.isdisjoint(held))))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))


def fit_linear(rows: list[np.ndarray], extra: np.ndarray, target: np.ndarray, n: int, rounds: int = 400, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets: rows hold indices of present features, extra dense ones. AdaGrad, full batch."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]) if rows else np.empty(0, int)
    held = np.concatenate(rows) if rows else np.empty(0, int)
    w, v, b = np.zeros(n), np.zeros(extra.shape[1]), 0.0
    gw, gv, gb = np.full(n, 1e-6), np.full(extra.shape[1], 1e-6), 1e-6
    for _ in range(rounds):
        odds = b + extra @ v + np.bincount(at, w[held], len(rows))
        error = (1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target) / max(1, len(rows))
        dw, dv, db = np.bincount(held, error[at], n) + decay * w, extra.T @ error + decay * v, error.sum()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - rate * dw / np.sqrt(gw), v - rate * dv / np.sqrt(gv), b - rate * db / math.sqrt(gb)
    return w, v, b


def distinct_units(found: list[str], positive: dict[str, int], negative: dict[str, int]) -> list[str]:
    """Of units that begin alike and occur equally often (a word and its own beginnings) only the first; no seeds."""
    taken: dict[tuple[int, int], list[str]] = {}
    out = []
    for u in found:
        alike = taken.setdefault((positive[u], negative.get(u, 0)), [])
        stem = u.rstrip("*")
        if u not in SEEDS and not any(stem.startswith(v) or v.startswith(stem) for v in alike):
            out.append(u)
        alike.append(stem)
    return out


def _counted(taken: DataFrame, label: int, only: set[str] | None) -> DataFrame:
    """(unit, n): distinct signatures that hold a unit, summed over bounded slices."""
    sent = taken.sparkSession.sparkContext.broadcast((only, stems_of(only))) if only is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: Counter = Counter()
            for text in {signature(t): t for t in batch.column("text").to_pylist()}.values():
                counts.update(units(text, sent.value[1]) & sent.value[0] if sent else units(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["unit", "n"])

    return taken.filter(F.col("toxic") == label).select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """_fit() without leaving its tables in the shared folder."""
    with temporary(labelled.sparkSession):
        return _fit(labelled, rows)


def _fit(labelled: DataFrame, rows: int) -> Classifier:
    """Fit on (doc_id, text, toxic): units whose presence is telling become voters beside the seeds and patterns.

    About `rows` labelled rows at most take part, those whose hashed id lies below a cut that follows from their
    count. What comes to the driver is bounded: CANDIDATES counts, and the rows' votes and features.

    Rows with null text or label don't take part; empty texts do, with pattern votes alone. Repeated rows count each, but
    a unit's support counts distinct texts. Ties between units go to the first by name. No rows give the seeds alone.
    """
    usable = labelled.filter("text is not null and toxic is not null")
    share = min(1.0, rows / max(1, usable.count()))
    taken = stored(usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32))).select("text", "toxic"), "toxicity-sample")
    positive = {r.unit: r.n for r in _counted(taken, 1, None).filter(F.col("n") >= LEAST_SEEN).orderBy(F.desc("n"), "unit").limit(CANDIDATES).collect()}
    candidates = set(positive) | set(SEEDS)
    negative = {r.unit: r.n for r in _counted(taken, 0, candidates).collect()}
    totals = {r.toxic: r.n for r in taken.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    base = math.log((totals.get(1, 0) + 1) / (totals.get(0, 0) + 1))
    odds = {u: math.log((positive.get(u, 0) + 0.5) / (negative.get(u, 0) + 0.5)) - base for u in candidates}
    telling = sorted((u for u in positive if odds[u] >= LEAST_ODDS), key=lambda u: (-positive[u] * min(odds[u], 6.0), u))
    voters = [*SEEDS, *distinct_units(telling, positive, negative)[:VOTERS]]
    features = sorted(candidates, key=lambda u: (u not in voters, -abs(odds[u]) * math.sqrt(positive.get(u, 0) + negative.get(u, 0) + 1), u))[:FEATURES]
    place, voting = {u: i for i, u in enumerate(features)}, {u: j for j, u in enumerate(voters)}
    sent = taken.sparkSession.sparkContext.broadcast((place, frozenset(voters), stems_of([*features, *voters])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, hits, stems = sent.value
        for batch in slices(batches):
            found, votes = [], []
            for text in batch.column("text").to_pylist():
                held = units(text, stems)
                found.append(sorted(places[u] for u in held & places.keys()))
                votes.append(pattern_votes(text, not hits.isdisjoint(held)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int32())), batch.column("toxic")], ["held", "patterns", "toxic"])

    sample = taken.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(read, "held array<int>, patterns array<int>, toxic int").collect()
    rows_ = [np.array(r.held, int) for r in sample]
    patterns = np.array([r.patterns for r in sample], int).reshape(len(sample), len(PATTERNS))
    votes = np.zeros((len(sample), len(voters) + len(PATTERNS)), int)
    votes[:, len(voters) :] = patterns
    back = {i: voting[u] for u, i in place.items() if u in voting}
    for i, held in enumerate(rows_):
        for k in held.tolist():
            if k in back:
                votes[i, back[k]] = 1
    if not len(sample):
        return Classifier({u: 3.0 for u in SEEDS}, [0.0] * len(PATTERNS), -2.0, frozenset(SEEDS), frozenset())
    given = np.array([r.toxic for r in sample], float)
    posterior = fit_label_model(votes, given).posterior(votes, given)
    w, v, b = fit_linear(rows_, patterns.astype(float), posterior, len(features))
    return Classifier({u: float(x) for u, x in zip(features, w) if x}, [float(x) for x in v], float(b), frozenset(voters), stems_of([*features, *voters]))


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per document: doc_id, score (0 to 1) and predicted (1 if score >= 0.5). Only text is read.

    Null text counts as empty and is scored by the bias and patterns alone. Null doc_id: returned as null. Repeated
    rows are each returned. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches):
            found = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return taken.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = FIT_ROWS) -> DataFrame:
    """Fit on labelled documents whose crc32(doc_id) mod folds is not held; score all: doc_id, held_out, score, predicted.

    Labels that repeat a doc_id count once, the largest; null labels and ids are left out of the fit.
    """
    out = bucket_of_id("doc_id", folds) == held
    known = labels.filter(~out).filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, 2 * rows / max(1, known.count()))  # fewer labels meet the texts; fit() takes its share of these
    near = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 32)) < int(share * (1 << 32)))
    with temporary(docs.sparkSession):
        fitted = fit(stored(docs.select("doc_id", "text").join(near, "doc_id"), "toxicity-labelled"), rows)
    return score(docs, fitted).select("doc_id", out.alias("held_out"), "score", "predicted")
