"""SimHash near-duplicates through a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import NULL_ID, slices, stored, temporary
from chronomesh.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 2
FANOUT = 8
#: Block groups of more distinct fingerprints than this are dealt out anew by sub-blocks of their other bits.
GROUP_LIMIT = 200_000
#: A task indexes whole groups of about so many codes at a time.
HELD_CODES = 200_000
#: Fingerprints of more documents than this are dealt out by doc_id too where documents get their components; up to so many of them are broadcast.
HOT_ROWS, SENT_CODES = 500, 500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(text: bytes) -> bytes:
    """A UTF-8 text with A-Z in lower case."""
    return text.translate(_LOWER)


def of_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of consecutive runs of `counts` 64-bit hashes as uint64: a bit is 1 if set in over half of a run; zero for an empty one."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    ends = np.cumsum(counts[full])
    planes = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.add.reduceat(planes, ends - counts[full], axis=0, dtype=np.int32)
    bits = (2 * sums > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each UTF-8 text as uint64: a bit is 1 if set in over half of its shingles' hashes."""
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest, before = xxhash.xxh64_intdigest, 0
    for i, text in enumerate(texts):
        words = lowered(text).split() if text else []
        if len(words) >= shingle:
            flat.extend(map(digest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(seed)))
        elif words:
            flat.append(digest(b" ".join(words), seed))
        counts[i], before = len(flat) - before, len(flat)
    return of_hashes(np.array(flat, np.uint64), counts)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.astype(np.uint64, copy=True)
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over codes sorted by group and Gray rank.

    A node covers up to `fanout` neighbours of one group on the level below. The bits that all its codes share are
    factored into it and left out below, so differences accumulate on the way down and a whole node is pruned as
    soon as they exceed the radius.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), groups))
        self.order, self.codes, self.groups = order, codes[order], groups[order]
        n = len(codes)
        group_start = np.flatnonzero(np.r_[True, self.groups[1:] != self.groups[:-1]]) if n else np.empty(0, np.int64)
        lo, group = np.arange(n), np.repeat(np.arange(len(group_start)), np.diff(np.r_[group_start, n]))
        hi = lo + 1
        both, either = self.codes, self.codes
        levels = [(lo, hi, both, ~np.zeros(n, np.uint64), np.arange(n), np.arange(n))]
        while len(lo) > len(group_start):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            heads = np.flatnonzero(within % fanout == 0)
            tails = np.r_[heads[1:], len(group)]
            both, either = np.bitwise_and.reduceat(both, heads), np.bitwise_or.reduceat(either, heads)
            lo, hi, group = lo[heads], hi[tails - 1], group[heads]
            levels.append((lo, hi, both, ~(both ^ either), heads, tails))
        self.levels, self.group_of = levels, np.repeat(np.arange(len(group_start)), np.diff(np.r_[group_start, n]))

    def pairs(self, radius: int, block: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of positions (i, j), i < j, of codes of one group that differ in at most radius bits."""
        for start in range(0, len(self.codes), block):
            query = np.arange(start, min(start + block, len(self.codes)))
            node = self.group_of[query]
            spent = np.zeros(len(query), np.int64)
            above = np.zeros(len(query), np.uint64)
            for depth in range(len(self.levels) - 1, -1, -1):
                lo, hi, pattern, shared, heads, tails = self.levels[depth]
                spent = spent + np.bitwise_count((self.codes[query] ^ pattern[node]) & shared[node] & ~above)
                keep = (spent <= radius) & (hi[node] > query + 1)
                query, node, spent = query[keep], node[keep], spent[keep]
                if not depth:
                    yield query, node
                    break
                above = shared[node]
                n = tails[node] - heads[node]
                at = np.repeat(np.arange(len(node)), n)
                node = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + heads[node][at]
                query, spent, above = query[at], spent[at], above[at]


def merged(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest linked position of each of n positions."""
    parent = np.arange(n)
    for a, b in pairs:
        while len(a):
            a, b = parent[a], parent[b]
            while True:
                up_a, up_b = parent[a], parent[b]
                if (up_a == a).all() and (up_b == b).all():
                    break
                a, b = up_a, up_b
            open_ = a != b
            a, b = a[open_], b[open_]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def _block_keys(code: str, radius: int, limit: int, distinct: DataFrame) -> DataFrame:
    """Rows (key, code): codes within radius share at least one of radius + 1 blocks of bits; hot blocks are cut once more."""
    blocks = radius + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def part(lo: int, hi: int) -> str:
        return f"(shiftrightunsigned({code}, {lo}) & {(1 << (hi - lo)) - 1}L)"

    keyed = distinct.select(code, F.expr(f"posexplode(array({', '.join(part(a, b) for a, b in zip(edges, edges[1:]))})) as (block, value)"))
    keyed = keyed.select(code, "block", F.expr(f"xxhash64(block, value)").alias("key"))
    hot = keyed.groupBy("key").count().filter(F.col("count") > limit).select("key", F.lit(True).alias("hot"))  # at most blocks * n / limit rows
    marked = keyed.join(hot, "key", "left")
    cold = marked.filter("hot is null").select("key", code)
    cut = []
    for b in range(blocks):
        others = [i for i in range(64) if not edges[b] <= i < edges[b + 1]]
        bounds = [len(others) * k // blocks for k in range(blocks + 1)]
        runs = []
        for lo, hi in zip(bounds, bounds[1:]):
            bits = sum(1 << i for i in others[lo:hi])
            runs.append(f"({code} & {bits - (1 << 64) if bits >> 63 else bits}L)" if bits != 1 << 63 else f"({code} & shiftleft(1L, 63))")
        cut.append(f"when block = {b} then array({', '.join(runs)})")
    fine = marked.filter("hot").select(code, "key", F.expr(f"posexplode(case {' '.join(cut)} end) as (sub, bits)")).select(F.expr("xxhash64(key, sub, bits)").alias("key"), code)
    return cold.unionAll(fine)


def code_links(distinct: DataFrame, code: str, radius: int = BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (u, v) that join all of these distinct 64-bit codes that are linked within radius: a spanning set, not all pairs.

    Codes are not null and distinct, so there are no ties; no codes give no rows.
    """

    def found(keys: list[np.ndarray], codes: list[np.ndarray]) -> pa.RecordBatch:
        index = GrayIndex(np.concatenate(keys), np.concatenate(codes).view(np.uint64))
        root = merged(len(index.codes), index.pairs(radius))
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(index.codes[own].view(np.int64)), pa.array(index.codes[root[own]].view(np.int64))], ["u", "v"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups are indexed together as they come, sorted by key, until enough codes are held."""
        keys, codes, held, enough = [], [], 0, HELD_CODES
        for batch in batches:
            if not batch.num_rows:
                continue
            key, value = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            if held >= enough:  # the last group may go on: what lies before it is complete
                last = np.concatenate(keys)
                whole = int(np.searchsorted(last == last[-1], True))
                if whole:
                    all_codes = np.concatenate(codes)
                    yield found([last[:whole]], [all_codes[:whole]])
                    keys, codes, held = [last[whole:]], [all_codes[whole:]], len(last) - whole
                enough = max(HELD_CODES, 2 * held)
            keys.append(key)
            codes.append(value)
            held += len(key)
        if held:
            yield found(keys, codes)

    dealt = _block_keys(code, radius, limit, distinct).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(search, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, radius: int = BITS, shingle: int = SHINGLE, limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links.

    Fingerprints are hashed where the documents are read; only (doc_id, fingerprint) goes on. Equal fingerprints are
    merged by an aggregate first. Distinct ones are dealt out by blocks of bits, each partition searches its groups
    in a GrayIndex and hands on a spanning set of links, which connected_components joins.

    Null or empty text, or one without words: fingerprint zero, linked like any other. A null doc_id counts as the
    smallest and is returned as null. Repeated rows are each returned. An empty table gives no rows. Columns besides
    doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = fingerprints(batch.column("text").cast(pa.binary()).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], ["doc_id", "code"])

    with temporary(docs.sparkSession):
        taken = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
        coded = stored(taken.mapInArrow(run, "doc_id long, code long"), "simhash")
        distinct = stored(coded.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-codes")
        roots = connected_components(code_links(distinct.select("code"), "code", radius, limit))
        linked = roots.join(distinct, roots.node == distinct.code)
        least = linked.groupBy("root").agg(F.min("least").alias("reached"))
        reached = linked.join(least, "root").select("code", "reached")
        codes = distinct.join(reached, "code", "left").select("code", "n", F.coalesce("reached", "least").alias("component"))
        # copies of one text share a code: a code of many documents is repeated once for each HOT_ROWS of them
        parts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
        hot = distinct.filter(F.col("n") > HOT_ROWS).select("code", parts.alias("parts"))
        hot = F.broadcast(hot) if hot.count() <= SENT_CODES else hot
        dealt = coded.join(hot, "code", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"), F.lit(0)))
        codes = codes.select("code", "component", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        named = dealt.join(codes, ["code", "part"]).select(
            F.expr(f"nullif(doc_id, {NULL_ID + 1}L - 1L)").alias("doc_id"),
            F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
            F.expr(f"nullif(component, {NULL_ID + 1}L - 1L)").alias("component_id"),
        )
        return stored(named, "simhash-named", result=True)
