"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import functools
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import slices, stored, temporary
from chronomesh.llm.licenses import TEMPLATES

# The base patterns and their least lengths.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

#: Tokens under test: unbroken runs of an encoding's characters.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
LEAST_CANDIDATE = 20
# Alphabets of the inferred encodings, narrowest first.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# Fixed value: letters by their usual frequency in text of Latin script.
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"


def _by_frequency(alphabet: str) -> str:
    """An alphabet's symbols, frequent letters first whatever their case, then digits and others: bins of neighbours then tell text from random symbols."""
    return "".join(sorted(alphabet, key=lambda c: (FREQUENT.find(c.lower()) if c.isalpha() else 26, c)))


_RANKS = {name: {c: i for i, c in enumerate(_by_frequency(a))} for name, a in ALPHABETS.items()}
_PLACES = {name: {c: i for i, c in enumerate(a)} for name, a in ALPHABETS.items()}
_SETS = {name: frozenset(a) for name, a in ALPHABETS.items()}
BUCKETS = 100
#: Upper bounds of the length classes; scores are compared within one of them and one encoding.
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96, 1 << 40)
FALSE_DISCOVERY = 0.05
#: Words and numbers that stand alone in a text; joined, they show how ordinary symbols of any length score.
PLAIN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9]{1,15}(?![A-Za-z0-9+/_-])")
#: Joined pieces that a document adds to the null scores, and that each class takes from the fixed texts of licenses.
DRAWS, FIXED_DRAWS = 12, 200


def chi_squared_tail(x: float, k: int) -> float:
    """P(X >= x) of a chi-squared variable with k degrees, by the Wilson-Hilferty cube root."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return min(1.0, max(1e-300, 0.5 * math.erfc(z / math.sqrt(2))))


def normal_tails(z: float) -> float:
    return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))


def inferred_encoding(token: str) -> str | None:
    held = set(token)
    return next((name for name, chars in _SETS.items() if held <= chars), None)


def _kind(c: str) -> int:
    """Digit, lower case, upper case, or another symbol."""
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


_KINDS_OF = {name: {c: _kind(c) for c in a} for name, a in ALPHABETS.items()}
#: Share of neighbouring symbols of one kind under uniform random symbols.
_SAME = {name: sum((n / len(a)) ** 2 for n in Counter(map(_kind, a)).values()) for name, a in ALPHABETS.items()}


def kind_runs(token: str, name: str) -> float:
    """p-value of as few runs of one kind of symbol (digits, lower, upper case, others) under uniform random symbols."""
    kinds, p, n = _KINDS_OF[name], _SAME[name], len(token) - 1
    if p >= 1 or n < 1:
        return 1.0
    held = [kinds[c] for c in token]
    same = sum(x == y for x, y in zip(held, held[1:]))
    return max(1e-300, 0.5 * math.erfc((same - 0.5 - n * p) / math.sqrt(2 * n * p * (1 - p))))


def randomness(token: str, name: str | None = None) -> tuple[float, float, float, float] | None:
    """p-values under uniform random symbols: chi-squared over up to 8 bins of letters of like frequency, runs about the middle, runs of one kind of symbol, lag-1 correlation."""
    name = name or inferred_encoding(token)
    if name is None:
        return None
    places, ranks, size, n = _PLACES[name], _RANKS[name], len(ALPHABETS[name]), len(token)
    codes = [places[c] for c in token]
    bins = min(8, size)
    counts = [0] * bins
    share = [0] * bins
    for i in range(size):
        share[i * bins // size] += 1
    for c in token:
        counts[ranks[c] * bins // size] += 1
    chi = sum((o - n * s / size) ** 2 / (n * s / size) for o, s in zip(counts, share))
    uniform = chi_squared_tail(chi, bins - 1)
    high = [2 * c >= size for c in codes]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs_p = normal_tails((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs_p = max(1e-300, 2.0 ** (1 - n)) if n < 900 else 1e-300
    middle = sum(codes) / n
    var = sum((c - middle) ** 2 for c in codes)
    serial = 0.0 if not var else sum((x - middle) * (y - middle) for x, y in zip(codes, codes[1:])) / var
    return uniform, runs_p, kind_runs(token, name), normal_tails(serial * math.sqrt(n)) if var else 1e-300


def score(token: str, name: str | None = None) -> int:
    """Fisher's combination of the battery as a bucket 0..BUCKETS: the higher, the more like random symbols of the named or inferred encoding."""
    found = randomness(token, name)
    if found is None:
        return 0
    combined = chi_squared_tail(-2 * sum(map(math.log, found)), 2 * len(found))
    repeated = len(set(token)) / min(len(token), len(ALPHABETS[name or inferred_encoding(token)]))
    # log scale down to 1e-10, weighted by the share of distinct symbols
    return max(0, min(BUCKETS, round(BUCKETS * (1 + math.log10(max(combined, 1e-10)) / 10) * min(1.0, repeated * 1.5))))


def is_ordinary(token: str) -> bool:
    """Letters of one case, or capitalised: the reference class from which null scores are learned."""
    return token.isalpha() and (token[1:].islower() or token.isupper())


def length_class(n: int) -> int:
    return next(i for i, most in enumerate(LENGTHS) if n <= most)


def token_class(name: str, n: int) -> int:
    """The class of tokens of one encoding and length class."""
    return list(ALPHABETS).index(name) * len(LENGTHS) + length_class(n)


def joined_piece(words: list[str], kind: int, start: int) -> str | None:
    """The class's shortest length of symbols from words joined from word `start` on, around the end; None if they are too few.

    Words are cased as the encoding has letters, capitalised where it has both cases; symbols outside of it are left out.
    """
    name, k = list(ALPHABETS)[kind // len(LENGTHS)], kind % len(LENGTHS)
    n, chars = LENGTHS[k - 1] + 1 if k else LEAST_CANDIDATE, _SETS[name]
    case = str.capitalize if "a" in chars and "A" in chars else str.upper if "A" in chars else str.lower
    out: list[str] = []
    for i in range(len(words)):
        out += filter(chars.__contains__, case(words[(start + i) % len(words)]))
        if len(out) >= n:
            return "".join(out[:n])
    return None


def joined_nulls(text: str, draws: int = DRAWS) -> Iterator[tuple[int, int]]:
    """(class, score) of pieces of a text's joined words; a hash of the text deals out classes and places."""
    words = PLAIN.findall(text)
    if not words:
        return
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    for kind in rng.sample(range(len(ALPHABETS) * len(LENGTHS)), draws):
        piece = joined_piece(words, kind, rng.randrange(len(words)))
        if piece:
            yield kind, score(piece, list(ALPHABETS)[kind // len(LENGTHS)])


@functools.cache
def fixed_nulls() -> Counter:
    """Null counts by (class, score) from the license texts, so that a small corpus can be judged too."""
    words = PLAIN.findall(" ".join(TEMPLATES.values()))
    counts: Counter = Counter()
    for kind in range(len(ALPHABETS) * len(LENGTHS)):
        for i in range(FIXED_DRAWS):
            piece = joined_piece(words, kind, i * len(words) // FIXED_DRAWS)
            if piece:
                counts[kind, score(piece, list(ALPHABETS)[kind // len(LENGTHS)])] += 1
    return counts


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


SCAN = "doc_id long, base array<struct<start: long, kind: int, end: long>>, candidates array<struct<start: long, end: long, class: int, score: int>>, nulls array<struct<class: int, score: int, n: long>>"


def spans_of(text: str, nulls: Counter | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The fixed patterns' spans, and (start, end, class, score) of other tokens; plain words and pieces of joined ones are counted into nulls."""
    base, found = base_spans(text), []
    for m in TOKEN.finditer(text):
        token, (s, e) = m[0], m.span()
        if is_ordinary(token):
            if nulls is not None:
                if name := inferred_encoding(token):
                    nulls[token_class(name, e - s), score(token)] += 1
        elif e - s >= LEAST_CANDIDATE and not any(b < e and s < f for b, _, f in base) and (name := inferred_encoding(token)):
            found.append((s, e, token_class(name, e - s), score(token)))
    if nulls is not None:
        nulls.update(joined_nulls(text))
    return base, found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    candidate = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("score", pa.int32())])
    null = pa.struct([("class", pa.int32()), ("score", pa.int32()), ("n", pa.int64())])
    for batch in slices(batches):
        nulls: Counter = Counter()
        bases, candidates = [], []
        for text in batch.column("text").to_pylist():
            base, found = spans_of(text, nulls) if text else ([], [])
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            candidates.append([{"start": s, "end": e, "class": k, "score": v} for s, e, k, v in found])
        seen = [{"class": k, "score": v, "n": n} for (k, v), n in nulls.items()]
        counts = [seen] + [[]] * (len(bases) - 1) if bases else []
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, pa.list_(span)), pa.array(candidates, pa.list_(candidate)), pa.array(counts, pa.list_(null))], ["doc_id", "base", "candidates", "nulls"])


def thresholds(nulls: dict[tuple[int, int], int], found: dict[tuple[int, int], int], q: float = FALSE_DISCOVERY) -> dict[int, int]:
    """For each class the least score that Benjamini-Hochberg rejects at rate q, from counts by (class, score).

    A candidate's p-value is the share of ordinary tokens and joined pieces of its class that score as high, plus one in both counts.
    """
    out = {}
    for k in {c for c, _ in found}:
        total, m = sum(n for (c, _), n in nulls.items() if c == k), sum(n for (c, _), n in found.items() if c == k)
        as_high = rank = 0
        for s in range(BUCKETS, -1, -1):
            as_high += nulls.get((k, s), 0)
            rank += found.get((k, s), 0)
            if found.get((k, s), 0) and (1 + as_high) / (1 + total) <= q * rank / m:
                out[k] = s
    return out


def _scanned(docs: DataFrame, q: float) -> tuple[DataFrame, dict[int, int]]:
    """The stored scan of docs, and the least score of a find for each class."""
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = stored(taken.mapInArrow(_scan, SCAN), "secrets")

    def counts(column: str, n: str) -> dict[tuple[int, int], int]:
        """At most len(ALPHABETS) * len(LENGTHS) * (BUCKETS + 1) rows."""
        rows = scanned.select(F.explode(column).alias("x")).groupBy("x.class", "x.score").agg(F.expr(f"sum({n})").alias("n")).collect()
        return {(r["class"], r.score): r.n for r in rows}

    return scanned, thresholds(fixed_nulls() + Counter(counts("nulls", "x.n")), counts("candidates", "1L"), q)


def scan(docs: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """One row per document: doc_id and spans array<struct<start, kind, end>> (code points, end exclusive) in order.

    Kinds: 0 assign, 1 access, 2 hex (fixed patterns) and 3 random, found by the test battery: tokens that are not
    plain words are scored, null scores are counted by encoding and length over plain long words and joined shorter
    ones of all documents and of fixed texts, and Benjamini-Hochberg per class at rate q decides. A token that overlaps a fixed pattern's span is not added.

    Null or empty text: no spans. Null doc_id: scanned, returned as null. Repeated rows are each returned. An empty
    table gives no rows. Columns besides doc_id and text are not read.
    """
    scanned, cut = _scanned(docs, q)
    passes = " or ".join(f"(c.class = {k} and c.score >= {s})" for k, s in cut.items()) or "false"
    added = f"transform(filter(candidates, c -> {passes}), c -> struct(c.start as start, 3 as kind, c.end as end))"
    return scanned.select("doc_id", F.expr(f"array_sort(concat(base, {added}))").alias("spans"))


def digests(scanned: DataFrame) -> DataFrame:
    """scan()'s rows as counts of the fixed kinds, the SHA-256 of their listing, and the listing of all spans."""
    names = ", ".join(f"'{k}'" for k in KINDS)

    def listing(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"

    def count(kind: int):
        return F.expr(f"cast(size(filter(spans, s -> s.kind = {kind})) as bigint)")

    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(listing("filter(spans, s -> s.kind < 3)")), 256).alias("base_sha256"),
        F.expr(listing("spans")).alias("spans"),
    )


def covered(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with spans replaced by mark; spans that overlap or touch are replaced as one."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start > at or not out:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, q: float = FALSE_DISCOVERY, mark: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with every span that scan() finds replaced by mark in text, and n_chars kept in step.

    A first pass over all documents settles the thresholds, a second one finds the spans again and covers them where
    the documents are read, so no text is shuffled. Rows without spans, null and empty texts stay as they are.
    """
    with temporary(docs.sparkSession):
        _, cut = _scanned(docs, q)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, changed = batch.column("text").to_pylist(), set()
            for i, text in enumerate(texts):
                base, found = spans_of(text) if text else ([], [])
                spans = [(s, e) for s, _, e in base] + [(s, e) for s, e, k, v in found if v >= cut.get(k, BUCKETS + 1)]
                if spans:
                    texts[i] = covered(text, spans, mark)
                    changed.add(i)
            columns = {n: batch.column(n) for n in names}
            if changed:
                columns["text"] = pa.array(texts, batch.column("text").type)
                if "n_chars" in columns:
                    old = columns["n_chars"]
                    columns["n_chars"] = pa.array([len(texts[i]) if i in changed else x for i, x in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)
