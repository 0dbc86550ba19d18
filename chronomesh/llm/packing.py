"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import slices

END_ID = 1
WINDOW = 2048
STEP_WINDOWS = 8
#: A chunk of a task's documents is packed once it holds so many tokens; memory of a task is bounded by it.
CHUNK_TOKENS = 2_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Encoder for a byte-level BPE vocabulary file of the tokenizers library, run by tiktoken, which gives the same ids faster.

    Strings of special tokens in a text become those tokens, as they do by that library's default.
    """
    import json

    import public_tokenizers
    import tiktoken

    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(vocabulary, encoding="utf-8") as f:
        made = json.load(f)
    special = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in word): i for word, i in made["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def tier_of(length: int, window: int) -> int:
    """The shortest context size (a power of two up to the window) that holds the length."""
    return min(window, 1 << max(0, length - 1).bit_length())


def pack_lengths(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token of documents of these lengths once.

    Full windows are cut off long documents. What is left is routed to the shortest context size that holds it.
    From the longest tier down, each piece opens a sequence of its tier's size; the gap takes the largest piece
    of shorter tiers that fits, and at last a part of one. A tier that finds nothing else cuts a piece of its own.
    What remains at the end is split at powers of two, so no sequence needs padding.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    for d, n in enumerate(lengths):
        whole = n // window
        sequences += [[(d, k * window, window)] for k in range(whole)]
        if n % window:
            pool.append((n % window, d, whole * window))
    pool.sort()
    while pool:
        n, d, start = pool.pop()
        size = tier_of(n, window)
        held, gap = [(d, start, n)], size - n
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0))
            if at:
                m, e, s = pool.pop(at - 1)
                held.append((e, s, m))
                gap -= m
            else:
                m, e, s = pool.pop(0)
                held.append((e, s, gap))
                insort(pool, (m - gap, e, s + gap))
                gap = 0
        if not gap:
            sequences.append(held)
            continue
        total = size - gap  # nothing is left to fill with: split at powers of two
        while total:
            part, row = 1 << (total.bit_length() - 1), []
            total -= part
            while part:
                e, s, m = held.pop(0)
                take = min(m, part)
                row.append((e, s, take))
                part -= take
                if take < m:
                    held.insert(0, (e, s + take, m - take))
            sequences.append(row)
    return sequences


def step_groups(sizes: list[int], budget: int) -> list[int]:
    """A group for each sequence so that groups hold the same number of tokens: sizes descend, each goes on filling the last group."""
    order, out, group, used = sorted(range(len(sizes)), key=lambda i: -sizes[i]), [0] * len(sizes), 0, 0
    for i in order:
        if used + sizes[i] > budget:
            group, used = group + 1, 0
        out[i] = group
        used += sizes[i]
    return out


def _pack_chunk(ids: list, tokens: list[np.ndarray], window: int, first_sequence: int, first_group: int, steps: int):
    lengths = [len(t) for t in tokens]
    packed = pack_lengths(lengths, window)
    sizes = [sum(m for _, _, m in s) for s in packed]
    groups = step_groups(sizes, steps * window)
    rows: list[list] = [[] for _ in range(9)]
    for k, (sequence, size, group) in enumerate(zip(packed, sizes, groups)):
        offset = 0
        for d, s, m in sequence:
            for column, value in zip(rows, (ids[d], s, m, zlib.crc32(tokens[d][s : s + m].tobytes()), lengths[d], first_sequence + k, offset, size, first_group + group)):
                column.append(value)
            offset += m
    kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)
    return made, first_sequence + len(packed), first_group + max(groups, default=-1) + 1


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, steps: int = STEP_WINDOWS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Pack documents (doc_id, text) into sequences; one row per piece.

    Each task tokenises and packs its own documents in chunks, so no token is shuffled and a chunk's memory is
    bounded; a chunk leaves no padding. tier is the sequence's size (a power of two up to window), step_group
    numbers groups of sequences of equal token counts. A special token's string in a text is that token, as by the
    tokenizers library's default.

    Null or empty text: one piece of the end id alone. Null doc_id: packed, returned as null. Repeated rows are
    packed each. An empty table gives no rows. Columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        sequence = group = TaskContext.get().partitionId() << 32
        ids: list = []
        tokens: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = encode.encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
                tokens.append(np.append(found.astype("<u4", copy=False), np.uint32(END_ID)).astype("<u4", copy=False))
                ids.append(doc)
                held += len(tokens[-1])
            if held >= chunk_tokens:
                made, sequence, group = _pack_chunk(ids, tokens, window, sequence, group, steps)
                yield made
                ids, tokens, held = [], [], 0
        if ids:
            yield _pack_chunk(ids, tokens, window, sequence, group, steps)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
