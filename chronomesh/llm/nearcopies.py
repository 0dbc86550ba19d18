"""Near copies by five-word shingles: SimHash fingerprints in Gray-ordered indexes link most, shared rare shingles complete them, exact similarity decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import NULL_ID, free_shuffles, release, slices, stored, temporary
from chronomesh.llm.components import connected_components
from chronomesh.llm.simhash import GrayIndex, lowered, merged, of_hashes

SHINGLE = 5
#: Least Jaccard similarity of a link, as a fraction, so that it is decided in whole numbers.
LEAST = (4, 5)
#: Documents meet in a group first if they share a band; a pair of similarity 0.8 shares one with probability 1 - (1 - 0.8 ** ROWS) ** BANDS, 0.96.
#: What shares none, or is too far apart there, is found by `_crossing`.
BANDS, ROWS = 8, 5
#: Bits in which fingerprints of a pair may differ: about 10 at similarity 0.8, with a deviation of 3; unrelated ones differ in 32.
#: Small groups, whose pairs are few, get by with a wide radius; in large ones the first, nearest pairs are within the narrow one.
RADIUS, WIDE_RADIUS = 16, 24
#: Groups of more codes are cut by Gray rank, each band in another rotation of the bits, and every part keeps the group's head.
RUN = 512
PART = 8
#: All pairs of groups up to this size are proposed at once; of larger ones each code's nearest.
SMALL = 8
NEAREST = 12
#: Shingles are ordered by how many of about SAMPLED texts hold them, which COMMON at most are counted for. Any order gives the same result.
SAMPLED, COMMON = 10_000, 200_000
#: Rows that a task searches at a time, and pairs within one shingle's group over which the group is dealt out in blocks.
HELD_ROWS, GROUP_PAIRS = 200_000, 20_000_000
#: Bytes of a set's parities, at least a bit a shingle between these. They only spare comparisons: fewer give more pairs and the same links.
LEAST_PARITIES, MOST_PARITIES = 8, 1024
#: Of the pairs left between two components so many are tested first, those of the nearest fingerprints; if one links them, the others needn't be.
BEST = 16
#: Rows of up to 24 bytes that may be broadcast or linked on the driver; more are joined by shuffles.
SENT_ROWS = 200_000
SEED = 42

_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's runs of `size` words, of all words if there are fewer, as uint64."""
    words = lowered(text).split() if text else []
    runs = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64))


def band_hashes(held: np.ndarray, block: int = 4096) -> np.ndarray:
    """A hash for each band of a set's least values under BANDS * ROWS permutations."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(held), block):
        least = np.minimum(least, (_FACTORS[:, :1] * held[None, at : at + block] + _FACTORS[:, 1:]).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)], np.uint64)


def parities(held: np.ndarray) -> bytes:
    """How many shingles of a set leave each remainder, modulo 2: a power of two of bits."""
    n = min(max(1 << (len(held) - 1).bit_length(), 8 * LEAST_PARITIES), 8 * MOST_PARITIES)
    counts = np.bincount((held & np.uint64(n - 1)).astype(np.int64), minlength=n)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(sets: list[bytes], i: np.ndarray, j: np.ndarray, words: int = 1 << 20) -> np.ndarray:
    """For pairs of places in a list of parities, the bits in which these differ: at most as many as the shingles that one of the two sets holds alone.

    Shingles of both cancel out, each other one turns one bit. Wider parities are folded onto narrower ones.
    """
    flat = np.frombuffer(b"".join(sets), "<u8")
    wide = np.array([len(p) // 8 for p in sets], np.int64)
    start = np.cumsum(wide) - wide
    swap = wide[i] < wide[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    out = np.empty(len(i), np.int64)
    by = np.lexsort((wide[j], wide[i]))
    kinds = np.flatnonzero(np.r_[True, (np.diff(wide[i[by]]) != 0) | (np.diff(wide[j[by]]) != 0)]) if len(by) else by
    for lo, hi in zip(kinds, np.r_[kinds[1:], len(by)]):
        a, b = wide[i[by[lo]]], wide[j[by[lo]]]
        for at in np.split(by[lo:hi], range(max(1, words // a), hi - lo, max(1, words // a))):
            folded = np.bitwise_xor.reduce(flat[start[i[at], None] + np.arange(a)].reshape(len(at), -1, b), axis=1)
            out[at] = np.bitwise_count(folded ^ flat[start[j[at], None] + np.arange(b)]).sum(axis=1)
    return out


def prefix(held: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, rare ones first: of two sets of similarity LEAST or more, each has a shingle of the other among them.

    Such sets share at least LEAST of either, so what one holds besides is too little to fill these. common: sorted
    shingles and their counts; others come before them.
    """
    names, counts = common
    at = np.minimum(np.searchsorted(names, held), max(len(names) - 1, 0))
    n = np.where(names[at] == held, counts[at], 0) if len(names) else np.zeros(len(held), np.int64)
    return held[np.lexsort((held, n))[: len(held) + 1 + -LEAST[0] * len(held) // LEAST[1]]]


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about SAMPLED different texts hold, sorted, and how many of these do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            names, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])

    taken = _taken(docs)
    every = max(1, docs.count() // SAMPLED)
    counts = taken.filter(F.pmod("content", F.lit(every)) == 0).dropDuplicates(["content"]).select("text").mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    found = counts.filter("n > 1").orderBy(F.desc("n"), "name").limit(COMMON).toArrow()
    names, n = found.column("name").to_numpy().view(np.uint64), found.column("n").to_numpy()
    by = np.argsort(names)
    return names[by], n[by]


def _coded(docs: DataFrame, common: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0, np.int64))) -> DataFrame:
    """(doc_id, content, code, finger, bands, size, prefix, bits) per document: code stands for the shingle set, of `size` shingles, finger is its SimHash, bits its parities; without words code is 0 and bands, prefix and bits are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=1 << 20):
            sets = [shingles(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            codes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64)
            fingers = of_hashes(np.concatenate(sets) if sets else np.empty(0, np.uint64), np.array([len(s) for s in sets], np.int64))
            made: dict[int, tuple[np.ndarray, np.ndarray, bytes]] = {}  # copies share their bands
            for c, s in zip(codes.tolist(), sets):
                if c not in made:
                    made[c] = (band_hashes(s).view(np.int64), prefix(s, sent.value).view(np.int64), parities(s)) if len(s) else (s.view(np.int64), s.view(np.int64), b"")
            bands, first, bits = zip(*(made[c] for c in codes.tolist())) if len(codes) else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), pa.array(codes.view(np.int64)), pa.array(fingers.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array([len(s) for s in sets], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "content", "code", "finger", "bands", "size", "prefix", "bits"],
            )

    return _taken(docs).mapInArrow(run, "doc_id long, content long, code long, finger long, bands array<long>, size int, prefix array<long>, bits binary")


def _taken(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("content"), text.alias("text"))


def _dealt(distinct: DataFrame, run: int = RUN) -> DataFrame:
    """(key, code, finger, head, head_finger, rank): codes by band. A band of over `run` codes is cut by leading bits of the Gray
    rank of rotated fingerprints; near copies share these, so a part is dealt on by a hash of the code where it would hold over PART runs."""
    placed = distinct.select("code", "finger", F.posexplode("bands").alias("place", "band"))
    hot = placed.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("code", "finger")).alias("head")).filter(F.col("n") > run)  # at most BANDS * codes / run rows
    rank = "(shiftleft(finger, (place * 23) % 64) | shiftrightunsigned(finger, (64 - (place * 23) % 64) % 64))"
    for shift in (1, 2, 4, 8, 16, 32):
        rank = f"element_at(transform(array({rank}), r{shift} -> r{shift} ^ shiftrightunsigned(r{shift}, {shift})), 1)"
    part = f"pmod(xxhash64(code, band), cast(ceil(n / {PART * run}) as bigint))"
    key = F.when(F.col("n").isNull(), F.col("band")).otherwise(F.expr(f"xxhash64(band, shiftrightunsigned(rank, 63 - least(47, cast(log2(n / {run}) as int))), {part})"))
    marked = placed.withColumn("rank", F.expr(rank)).join(hot, "band", "left")
    return marked.select(key.alias("key"), "code", "finger", F.col("head.code").alias("head"), F.col("head.finger").alias("head_finger"), "rank")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], run: int, enough: int = 16_384) -> Iterator[list[list[tuple]]]:
    """Lists of groups of over one row that share the first column, from rows sorted by it; groups of over `run` rows are cut."""
    held: list[list[tuple]] = []
    group: list[tuple] = []
    total = 0
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if group and (row[0] != group[0][0] or len(group) >= run):
                if len(group) > 1:
                    held.append(group)
                    total += len(group)
                group = []
                if total >= enough:
                    yield held
                    held, total = [], 0
            group.append(row)
    if len(group) > 1:
        held.append(group)
    if held:
        yield held
    release()


def _near(index: GrayIndex, radius: int, nearest: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the index within radius, for each position its `nearest` ones."""
    best_i, best_j = np.empty(0, np.int64), np.empty(0, np.int64)
    for i, j in index.pairs(radius, 1024):
        a, b = np.r_[best_i, i, j], np.r_[best_j, j, i]
        far = np.bitwise_count(index.codes[a] ^ index.codes[b])
        by = np.lexsort((b, far, a))
        a, b = a[by], b[by]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        best_i, best_j = a[place < nearest], b[place < nearest]
    return best_i, best_j


def _indexed(groups: list[dict[int, int]]) -> tuple[GrayIndex, np.ndarray]:
    """An index over the fingerprints of groups {code: fingerprint}, and the codes in its order."""
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups]).astype(np.int64)
    index = GrayIndex(of, np.array([f for g in groups for f in g.values()], np.int64).view(np.uint64))
    return index, np.array([c for g in groups for c in g], np.int64)[index.order]


def _first_pairs(dealt: DataFrame, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """Pairs (u, v) to test first: all of small groups, and each code's nearest in larger ones."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in _groups(batches, ["key", "code", "finger", "head", "head_finger"], run):
            whole = []
            for group in groups:
                members = {c: f for _, c, f, _, _ in group}
                if group[0][3] is not None:
                    members[group[0][3]] = group[0][4]
                whole.append(members)
            few, many = [m for m in whole if len(m) <= SMALL], [m for m in whole if len(m) > SMALL]
            index, code = _indexed(few)
            pairs = [(code[i], code[j]) for i, j in index.pairs(WIDE_RADIUS, 1024)]
            index, code = _indexed(many)
            i, j = _near(index, radius)
            yield _sent(*(np.concatenate(x) for x in zip((code[i], code[j]), *pairs)))

    return dealt.repartition("key").sortWithinPartitions("key", "rank").mapInArrow(search, "u long, v long")


def _sent(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Each pair once, the smaller end first."""
    pair = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["u", "v"])


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], enough: int = HELD_ROWS) -> Iterator[list[np.ndarray]]:
    """Columns of whole groups that share the first one, from rows sorted by it; rows that are alone in their group are left out."""
    held: list[list[np.ndarray]] = []
    n, most = 0, enough

    def shared(columns: list[np.ndarray]) -> list[np.ndarray]:
        same = columns[0][1:] == columns[0][:-1]
        return [c[np.r_[False, same] | np.r_[same, False]] for c in columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(x).to_numpy(zero_copy_only=False) for x in names])
        n += batch.num_rows
        if n >= most:  # the last group may go on: what lies before it is complete
            columns = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            if cut:
                yield shared([c[:cut] for c in columns])
            held, n = [[c[cut:] for c in columns]], n - cut
            most = max(enough, 2 * n)
    if n:
        yield shared([np.concatenate(c) for c in zip(*held)])
    release()


def _met(distinct: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """(name, root, code, size, place, blocks) of shingles that codes of different roots hold in their prefixes, of those that the same codes hold the first only.

    All prefixes have one order, so that one comes first in each of them, and a pair's first shared shingle is never left out.
    blocks: into how many a group of over `most` pairs is to be dealt, else 1.
    """
    names = ["name", "root", "code", "size", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, names):
            order = np.lexsort((columns[1], columns[0]))
            name, root, code, size, place = (c[order] for c in columns)
            if not len(name):
                continue
            starts, _, n = _meetings(name, root)
            sizes = np.diff(np.r_[starts, len(name)])
            pairs = np.add.reduceat(n, starts)
            blocks = np.where(pairs > most, np.ceil(sizes / most**0.5), 1).astype(np.int32)
            same = np.add.reduceat(code.view(np.uint64), starts).view(np.int64)  # the codes are hashes
            ahead = place[code == np.repeat(np.minimum.reduceat(code, starts), sizes)]
            met = np.repeat(pairs > 0, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in (name, root, code, size, place, *(np.repeat(x, sizes) for x in (blocks, same, ahead)))], [*names, "blocks", "same", "ahead"])

    rows = _rooted(distinct, roots).select("code", "root", "size", F.posexplode("prefix").alias("place", "name"))
    schema = "name long, root long, code long, size int, place int, blocks int, same long, ahead int"
    met = stored(rows.select(names).repartition("name").sortWithinPartitions("name").mapInArrow(run, schema), "near-met")
    kept = stored(met.groupBy("same").agg(F.min(F.struct("ahead", "name")).alias("at")).select("at.name"), "near-names")
    return met.join(F.broadcast(kept) if kept.count() <= SENT_ROWS else kept, "name", "left_semi").select(*names, "blocks")


def _meetings(name: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by name and root: starts of names, each row's one, and how many rows of its name with smaller roots each row meets."""
    new = np.r_[True, name[1:] != name[:-1]]
    starts = np.flatnonzero(new)
    first = np.repeat(starts, np.diff(np.r_[starts, len(name)]))
    runs = np.flatnonzero(new | np.r_[True, root[1:] != root[:-1]])
    return starts, first, np.repeat(runs, np.diff(np.r_[runs, len(name)])) - first


def _crossing(distinct: DataFrame, roots: DataFrame, most: int = GROUP_PAIRS) -> DataFrame:
    """All pairs (u, v) of codes of different roots whose similarity can be LEAST or more: their prefixes share a shingle, their sizes
    are near enough, so many shingles follow the shared one in both, and their parities differ in so few bits. Nothing else is left out.
    A shingle's group of over `most` pairs is dealt out in blocks of its codes, each pair of blocks a group of its own."""
    names = ["name", "root", "code", "size", "place", "bits"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, names, HELD_ROWS // 4):
            order = np.lexsort((columns[1], columns[0]))
            name, root, code, size, place, bits = (c[order] for c in columns)
            if not len(name):
                continue
            _, first, n = _meetings(name, root)
            _, one, which = np.unique(code, return_index=True, return_inverse=True)
            sets = bits[one].tolist()
            at = np.flatnonzero(n > 0)
            ends = np.cumsum(n[at])
            rest = size - place
            for lo, hi in _blocks(ends, 1 << 20):
                i = np.repeat(at[lo:hi], n[at[lo:hi]])
                j = first[i] + np.arange(len(i)) - np.repeat(ends[lo:hi] - n[at[lo:hi]] - (ends[lo] - n[at[lo]]), n[at[lo:hi]])
                both = LEAST[0] * (size[i] + size[j])
                ok = ((LEAST[0] + LEAST[1]) * np.minimum(rest[i], rest[j]) >= both) & (LEAST[1] * np.minimum(size[i], size[j]) >= LEAST[0] * np.maximum(size[i], size[j]))
                i, j = i[ok], j[ok]
                pair = np.unique(np.minimum(which[i], which[j]) * len(one) + np.maximum(which[i], which[j]))
                a, b = pair // len(one), pair % len(one)
                ok = (LEAST[0] + LEAST[1]) * apart(sets, a, b) <= (LEAST[1] - LEAST[0]) * (size[one[a]] + size[one[b]])
                yield _sent(code[one[a[ok]]], code[one[b[ok]]])

    rows = _met(distinct, roots, most).join(distinct.select("code", "bits"), "code")
    rows = rows.withColumn("own", F.expr("cast(pmod(xxhash64(code), blocks) as int)")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("name", F.expr("if(blocks = 1, name, xxhash64(name, least(own, other), greatest(own, other)))"))
    found = rows.select(names).repartition("name").sortWithinPartitions("name").mapInArrow(search, "u long, v long")
    return stored(found.distinct(), "near-pairs")


def _rooted(distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """The codes with their root, a code without links being its own."""
    linked = roots.select(F.col("node").alias("code"), "root")
    linked = F.broadcast(linked) if linked.count() <= SENT_ROWS else linked
    return distinct.join(linked, "code", "left").withColumn("root", F.coalesce("root", "code"))


def _ranked(pairs: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v, a, b, nth): pairs of codes, the roots that they lie between, and their place among the pairs between these by the distance of fingerprints up to BEST, else null."""
    known = _rooted(distinct.select("code", "finger"), roots)
    ends = pairs.join(known.toDF("u", "finger_u", "root_u"), "u").join(known.toDF("v", "finger_v", "root_v"), "v")
    ends = ends.select("u", "v", F.least("root_u", "root_v").alias("a"), F.greatest("root_u", "root_v").alias("b"), F.expr("bit_count(finger_u ^ finger_v)").alias("far"))
    ends = stored(ends, "near-ends")
    best = ends.withColumn("nth", F.row_number().over(Window.partitionBy("a", "b").orderBy("far", "u", "v"))).filter(F.col("nth") <= BEST)
    return stored(ends.join(best.select("u", "v", "nth"), ["u", "v"], "left").select("u", "v", "a", "b", "nth"), "near-ranked")


def _blocks(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs (lo, hi) of items, by the running sum of their counts, of at most about `most` in all, or one item."""
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def _tested(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v, close) for pairs of codes, by the exact similarity of the shingle sets of texts (code, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in slices(batches, "y", 1 << 20):
            close = []
            for u, x, y in zip(batch.column("u").to_pylist(), batch.column("x").cast(pa.binary()).to_pylist(), batch.column("y").cast(pa.binary()).to_pylist()):
                if before[0] != u:
                    before = (u, shingles(x))
                a, b = before[1], shingles(y)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                close.append(LEAST[1] * shared >= LEAST[0] * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(close, pa.bool_())], ["u", "v", "close"])

    both = pairs.join(texts.select(F.col("code").alias("u"), F.col("text").alias("x")), "u").join(texts.select(F.col("code").alias("v"), F.col("text").alias("y")), "v")
    return both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long, close boolean")


def _texts(docs: DataFrame, coded: DataFrame, needed: DataFrame) -> DataFrame:
    """(code, text) of one document for each needed code. Texts of other documents don't leave their task where the keys can be broadcast."""
    chosen = stored(coded.join(needed, "code", "left_semi").groupBy("code").agg(F.min(F.struct("doc_id", "content")).alias("at")).select("code", "at.*"), "near-chosen")
    keys = F.broadcast(chosen) if chosen.count() <= SENT_ROWS else chosen
    found = _taken(docs).join(keys, ["doc_id", "content"])
    return stored(found.groupBy("code").agg(F.first("text").alias("text")), "near-texts")


def _linked(edges: DataFrame) -> DataFrame:
    """(node, root) as by connected_components; up to SENT_ROWS edges, which are stored, are joined on the driver."""
    if edges.count() > SENT_ROWS:
        return connected_components(edges)
    ends = edges.select("u", "v").toArrow()
    u, v = (ends.column(x).to_numpy() for x in ("u", "v"))
    nodes, place = np.unique(np.r_[u, v], return_inverse=True)
    root = nodes[merged(len(nodes), iter([(place[: len(u)], place[len(u) :])]))]
    return stored(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64())})), "near-roots")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots after these links (u, v) too."""
    return roots if links.isEmpty() else _linked(stored(links.union(roots.filter("node <> root")), "near-links"))


def near_copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, content (a hash of the text) and root, equal for documents linked by near copies.

    Two documents are linked if the exact Jaccard similarity of their sets of five-word shingles is at least 0.8. Equal
    sets are merged first. Different ones meet where they share a MinHash band; in each group a Gray-ordered index finds
    those whose SimHash fingerprints differ in few bits, and their texts are compared. In groups over SMALL each
    code is compared with its nearest ones, so a group of copies costs in proportion to its size. That links most. All pairs of codes not
    yet linked that can reach 0.8 are compared after that, the nearest between two components first: any two such sets share one of
    their rarest shingles, as many as either may hold besides what it shares. So no link between different components is lost but for equal hashes of 64 bits.
    Blocks of bits as in simhash.near_duplicates can't deal out so wide a radius, hence the bands.

    Null or empty text, or one without words: an empty set, equal to any other. A null doc_id is returned as NULL_ID.
    Repeated rows are each returned. Ties of distance go to the smaller place in Gray order and don't change the result. An
    empty table gives no rows. Columns besides doc_id and text are not read.
    """
    with temporary(docs.sparkSession):
        coded = stored(_coded(docs, _common(docs)), "near-coded")
        distinct = coded.filter("code <> 0").groupBy("code").agg(*(F.first(c).alias(c) for c in ("finger", "bands", "size", "prefix", "bits")))
        distinct = stored(distinct, "near-codes")
        pairs = stored(_first_pairs(_dealt(distinct)).distinct(), "near-found")
        roots = _linked(_close(docs, coded, pairs))
        free_shuffles(docs.sparkSession)
        left = _ranked(_crossing(distinct, roots), distinct, roots)
        roots = _joined(roots, _close(docs, coded, left.filter("nth is not null")))
        if not left.filter("nth is null").isEmpty():
            now = roots.select("node", "root")
            rest = left.filter("nth is null").join(now.toDF("a", "now_a"), "a", "left").join(now.toDF("b", "now_b"), "b", "left")
            rest = stored(rest.filter("coalesce(now_a, a) <> coalesce(now_b, b)").select("u", "v"), "near-rest")
            roots = _joined(roots, _close(docs, coded, rest))
        roots = roots.select(F.col("node").alias("code"), "root")
        named = coded.select("doc_id", "content", "code").join(roots, "code", "left").select("doc_id", "content", F.coalesce("root", "code").alias("root"))
        return stored(named, "near", result=True)


def _close(docs: DataFrame, coded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of codes, stored, whose exact similarity is LEAST or more."""
    texts = _texts(docs, coded, pairs.select(F.col("u").alias("code")).union(pairs.select("v")).distinct())
    return stored(_tested(pairs, texts).filter("close").select("u", "v"), "near-close")
