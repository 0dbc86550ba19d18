"""Exact removal of repeated passages through a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import NULL_ID, drop_stored, free_shuffles, scratch, slices

WINDOW = 20
BATCHES = 4
#: The newest run is merged with the one before it if it has at least this share of that one's rows.
MERGE_SHARE = 0.75
#: A task merges windows of equal words within so many words before they are dealt out.
CHUNK_WORDS = 500_000
#: Rows of an Arrow batch sent on.
SENT_ROWS = 65_536

ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"

def _mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of the public SplitMix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of the two hashes; the left part of a run is multiplied before the right one is added.
LEFT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 128-bit XXH3 of each word's bytes, as rows of two uint64."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").reshape(-1, 2).astype(np.uint64)


def run_hashes(words: np.ndarray, size: int, left: np.uint64) -> np.ndarray:
    """A hash of each run of `size` neighbouring word hashes, in log(size) steps.

    Runs of twice the length are made of two neighbours, each step mixed in a way that is not linear, so that what
    collides in sums or polynomials of words (texts of Thue-Morse form) doesn't here.
    """
    out, covered, power, length = None, 0, words, 1
    while length <= size:
        if size & length:
            piece = power[covered : covered + len(words) - size + 1]
            out = _mixed(piece + np.uint64(length)) if out is None else _mixed(out * left + piece)
            covered += length
        if 2 * length <= size:
            power = _mixed(power[:-length] * left + power[length:])
        length *= 2
    return out


def window_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `size` words within a text: the text's place, the first word's place in it, the primary
    hash, and 32 bits of one that starts from other bits of the words' hashes."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    words = word_hashes([w for part in split for w in part])
    first_word = np.cumsum(counts) - counts
    text_of = np.repeat(np.arange(len(texts)), counts)
    if len(words) < size:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint64), np.empty(0, np.uint32)
    starts = np.flatnonzero(text_of[: len(words) - size + 1] == text_of[size - 1 :])
    owner = text_of[starts]
    primary, check = (run_hashes(words[:, k], size, LEFT[k])[starts] for k in (0, 1))
    return owner, (starts - first_word[owner]).astype(np.int32), primary, (check >> np.uint64(32)).astype(np.uint32)


OCCURRENCES = "doc_id long, start int, n int, hash long, verify int"


def _occurrence_rows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """The first place of each window of this chunk; then ranges (start, n) of its repeats, with verify null."""
    if not parts:
        return
    doc, start, h, c = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((start, doc, c, h))
    doc, start, h, c = doc[by], start[by], h[by], c[by]
    new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = (doc != doc[head]) | (start != start[head])  # equal places come from rows that repeat a doc_id
    names = ["doc_id", "start", "n", "hash", "verify"]
    found = pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(start[new]), pa.array(np.ones(new.sum(), np.int32)), pa.array(h[new].view(np.int64)), pa.array(c[new].view(np.int32))], names)
    for at in range(0, found.num_rows, SENT_ROWS):
        yield found.slice(at, SENT_ROWS)
    d, s, h = doc[later], start[later], h[later]
    if len(d):
        at = np.lexsort((s, d))
        d, s, h = d[at], s[at], h[at]
        cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)])
        last = np.r_[cut[1:], len(d)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(d[cut]), pa.array(s[cut]), pa.array(s[last] - s[cut] + np.int32(1)), pa.array(h[cut].view(np.int64)), pa.nulls(len(cut), pa.int32())], names)


def occurrences(docs: DataFrame, size: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """Window occurrences of (doc_id, text), merged within bounded chunks of each task, so a hot window gives few rows.

    A row with verify null is a range of n windows from start that are repeats within their chunk; its hash only
    deals it out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, limit=1 << 20):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            owner, start, h, c = window_hashes(texts, size)
            if len(h):
                parts.append((ids[owner], start, h, c))
                held += len(h)
            if held >= chunk_words:
                yield from _occurrence_rows(parts)
                parts, held = [], 0
        yield from _occurrence_rows(parts)

    return docs.select("doc_id", "text").mapInArrow(run, OCCURRENCES)


class WindowIndex:
    """Log-structured index of the window hashes seen so far: immutable runs, bucketed and sorted by hash.

    Runs are tables of the session's catalog whose files lie in the shared folder. A new batch is dealt out and
    sorted by hash once and merge-joined with each run as it lies; its own new windows become the next run, which is
    merged with the run before it once the two are of like size. 64 bits of hash find a match, 32 of another hash of
    the words' bytes verify it.
    """

    def __init__(self, spark: SparkSession, size: int = WINDOW, merge_share: float = MERGE_SHARE):
        self.spark, self.size, self.merge_share = spark, size, merge_share
        self.runs: list[tuple[str, int]] = []
        self.made = 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = scratch(spark, "window-index")
        self.before = spark.conf.get(ORDERED)
        spark.conf.set(ORDERED, "true")  # a run's files are read in their order instead of sorted again

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _write(self, rows: DataFrame) -> str:
        name = f"window_run_{self.folder.rsplit('-', 1)[1]}_{self.made}"
        self.made += 1
        # sorted 64-bit hashes take about five bytes in delta pages of the second Parquet format
        rows.write.partitionBy("repeated").bucketBy(self.buckets, "hash").sortBy("hash").option("path", self._path(name)).option("parquet.writer.version", "PARQUET_2_0").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        drop_stored(self.spark, self._path(name))

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("repeated = 0").select("hash", "verify")

    def add(self, docs: DataFrame) -> DataFrame:
        """Ranges (doc_id, start, n) of docs' windows that occur earlier: in the index, or at a smaller (doc_id, start) of docs.

        Whatever the index holds counts as earlier than docs. The ranges can be read until settle() is called.
        """
        by = Window.partitionBy("hash", "verify").orderBy("doc_id", "start")
        rows = occurrences(docs, self.size).repartition(self.buckets, "hash")
        rows = rows.withColumn("place", F.rank().over(by)).withColumn("row", F.row_number().over(by)).withColumn("known", F.lit(False))
        for name, _ in self.runs:
            run = self._run(name).toDF("run_hash", "run_verify").hint("merge")
            verified = (F.col("hash") == F.col("run_hash")) & (F.col("verify").bitwiseXOR(F.col("run_verify")) == 0)
            rows = rows.join(run, verified, "left").withColumn("known", F.col("known") | F.col("run_hash").isNotNull()).drop("run_hash", "run_verify")
        rows = rows.withColumn("repeated", F.expr("if(verify is null or known or place > 1, 1, 0)")).filter("repeated = 1 or row = 1")
        fresh = F.col("repeated") == 0
        kept = [F.when(~fresh, F.col(c)).alias(c) for c in ("doc_id", "start", "n")]
        self.last = self._write(rows.select(*kept, "hash", F.when(fresh, F.col("verify")).alias("verify"), "repeated"))
        return self.spark.table(self.last).filter("repeated = 1").select("doc_id", "start", "n")

    def settle(self) -> None:
        """Make the last batch's new windows a run, drop its ranges, and merge runs of like size."""
        drop_stored(self.spark, f"{self._path(self.last)}/repeated=1")
        self.spark.catalog.refreshTable(self.last)
        self.runs.append((self.last, self._run(self.last).count()))
        free_shuffles(self.spark)
        while len(self.runs) > 1 and self.runs[-1][1] >= self.merge_share * self.runs[-2][1]:
            (a, n), (b, m) = self.runs[-2:]
            left, right = self._run(a), self._run(b).toDF("other", "other_verify")
            both = left.join(right.hint("merge"), (F.col("hash") == F.col("other")) & (F.col("verify").bitwiseXOR(F.col("other_verify")) == 0), "full")
            none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("start", "int"), ("n", "int"))]
            name = self._write(both.select(*none, F.coalesce("hash", "other").alias("hash"), F.coalesce("verify", "other_verify").alias("verify"), F.lit(0).alias("repeated")))
            self._drop(a)
            self._drop(b)
            self.runs[-2:] = [(name, n + m)]

    def drop(self) -> None:
        for name, _ in self.runs:
            self._drop(name)
        if getattr(self, "last", None):
            self._drop(self.last)
        drop_stored(self.spark, self.folder)
        self.spark.conf.set(ORDERED, self.before)
        free_shuffles(self.spark)


def cut_out(text: bytes | None, starts: np.ndarray, counts: np.ndarray, size: int) -> tuple[int, list[bytes]]:
    """The number of words, and the words that no window of these ranges covers."""
    words = (text or b"").split()
    if not len(starts):
        return len(words), words
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.minimum(starts, len(words)), 1)
    np.subtract.at(covered, np.minimum(starts + counts + size - 1, len(words)), 1)
    kept = np.cumsum(covered[:-1]) == 0
    return len(words), words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k]


def remove_repeats(docs: DataFrame, size: int = WINDOW, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256 (kept words joined by blanks) and, on demand, kept_text.

    A word goes if a window of `size` words covers it whose words also start earlier: in a smaller doc_id, or earlier
    in the same one. Documents are taken in `batches` ranges of doc_id; each is looked up in a WindowIndex of all
    before it and then added. Results of a batch are written to the shared folder.

    Null or empty text: no words. A null doc_id counts as the smallest and is returned as null. Rows that repeat a
    doc_id are judged together: a start that is repeated in one is repeated in all, and equal places don't count as
    earlier. An empty table gives no rows. Columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    taken = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = taken.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    bounds = [None, *cuts, None]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(rows):
            out: list[list] = [[], [], [], []]
            lists = batch.column("ranges")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            starts, counts = (pc.list_flatten(lists).field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for text, a, b in zip(batch.column("text").cast(pa.binary()).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                n, kept = cut_out(text, starts[a:b], counts[a:b], size)
                joined = b" ".join(kept)
                for column, value in zip(out, (n, n - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode())):
                    column.append(value)
            arrays = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(arrays[: 4 + texts], [c.split()[0] for c in schema.split(", ")])

    index, results = WindowIndex(spark, size), []
    try:
        for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            part = taken
            if lo is not None:
                part = part.filter(F.col("doc_id") > lo)
            if hi is not None:
                part = part.filter(F.col("doc_id") <= hi)
            ranges = index.add(part).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
            results.append(scratch(spark, "kept"))
            part.join(ranges.hint("shuffle_merge"), "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(run, schema).write.parquet(results[-1])
            if k < len(bounds) - 2:
                index.settle()
    finally:
        index.drop()
    return spark.read.schema(schema).parquet(*results).withColumn("doc_id", F.expr(f"nullif(doc_id, {NULL_ID + 1}L - 1L)"))


def oracle_sql(size: int = WINDOW) -> str:
    """The rows of remove_repeats() over a table `documents` of distinct ids, by comparing the windows' words."""
    return f"""with e as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) w from documents),
        x as (select doc_id, w, unnest(range(1, len(w) - {size - 2})) s from e where len(w) >= {size}),
        r as (select doc_id, s, row_number() over (partition by array_to_string(w[s:s + {size - 1}], ' ') order by doc_id, s) > 1 again from x),
        p as (select distinct doc_id, unnest(range(s, s + {size})) i from r where again),
        u as (select doc_id, unnest(w) word, generate_subscripts(w, 1) i from e),
        a as (select u.doc_id, count(p.i) gone, string_agg(word, ' ' order by u.i) filter (where p.i is null) kept from u left join p using (doc_id, i) group by u.doc_id)
        select e.doc_id, len(w) n_words, coalesce(gone, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from e left join a using (doc_id)"""
