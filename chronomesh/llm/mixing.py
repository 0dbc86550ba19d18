"""Mixing sources to target weights: raking of token weights to several marginals, then calibrated sampling."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.common import stored

UNKNOWN = "unknown"
#: Share of all tokens that is sampled.
BUDGET = 0.6
ROUNDS, TOLERANCE = 60, 1e-12
#: Rounds between two writes of a table of cells.
ROUNDS_A_JOB = 5
#: Cells (combinations of source, language and topic) are raked on the driver up to so many, as a table beyond.
LOCAL_CELLS = 100_000


class Margin(NamedTuple):
    """Target of one dimension: named values get their stated share; the others divide the rest by their tokens to the power."""

    name: str
    power: float = 1.0
    shares: dict[str, float] = {}


MARGINS = (Margin("source", 0.5), Margin("lang", 0.7), Margin("topic", 1.0, {"noisy": 0.02, "shouting": 0.01, "table": 0.05}))

#: Topic by form, first match first: a name and what the text contains. For tables that bring no topic of their own.
TOPICS = (("table", (" | ",)), ("noisy", ("***", "###", "$$$", "%%%", "&&&")), ("shouting", ("!!",)), ("licensed", ("icensed under",)))

#: A token: up to six letters, up to three digits, or one other symbol that isn't a blank; like the pieces of a common subword vocabulary.
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\p{L}\p{N}\x09-\x0D\x20]"


def topic_sql(text: str = "text") -> str:
    """SQL (of Spark and of others) of a text's topic; prose if nothing matches, also for null and empty texts."""
    tests = [f"when {' or '.join(f'''contains({text}, '{x}')''' for x in found)} then '{name}'" for name, found in TOPICS]
    return f"case {' '.join(tests)} else 'prose' end"


def tokens(text: str = "text") -> Column:
    """A text's weight: the number of its TOKENs, one at least; null and empty texts weigh one."""
    return F.greatest(F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long"), F.lit(1).cast("long"))


def target_shares(tokens: np.ndarray, values: list[str], margin: Margin) -> np.ndarray:
    """Target share of each value of a margin; stated shares of values that don't occur fall to the others."""
    stated = np.array([margin.shares.get(v, np.nan) for v in values])
    own = np.isnan(stated)
    out = np.where(own, 0.0, stated)
    if own.any():
        mass = np.where(own, tokens**margin.power, 0.0)
        out = out + max(0.0, 1 - out.sum()) * mass / mass.sum()
    return out / out.sum()


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Iterative proportional fitting: cell weights that start from tokens and meet each margin's target shares."""
    w = tokens / tokens.sum()
    for _ in range(rounds):
        worst = 0.0
        for code, target in zip(codes, targets):
            held = np.bincount(code, w, len(target))
            factor = np.divide(target, held, out=np.zeros_like(target), where=held > 0)
            worst = max(worst, np.abs(factor[held > 0] - 1).max(initial=0.0))
            w = w * factor[code]
        if worst < tolerance:
            break
    return w / w.sum()


def fill_level(tokens: np.ndarray, share: np.ndarray, budget: float) -> float:
    """The level at which sampling min(tokens, level * share) of each cell gives budget tokens in all."""
    order = np.argsort(tokens / share, kind="stable")
    t, s = tokens[order], share[order]
    before_t, before_s = np.cumsum(t) - t, np.cumsum(s) - s
    level = (budget - before_t) / np.maximum(1 - before_s, 1e-300)
    fits = np.flatnonzero(level <= t / s)
    return float(level[fits[0]]) if len(fits) else float("inf")


def _local(cells: list, margins: tuple[Margin, ...], budget: float) -> list[tuple]:
    tokens = np.array([r.tokens for r in cells], float)
    codes, targets = [], []
    for m in margins:
        values, code = np.unique([r[m.name] for r in cells], return_inverse=True)
        codes.append(code)
        targets.append(target_shares(np.bincount(code, tokens), values.tolist(), m))
    share = rake(tokens, codes, targets)
    used = share > 0
    level = fill_level(tokens[used], share[used], budget * tokens.sum())
    p = np.where(used, np.minimum(1.0, level * share / tokens), 0.0)
    return [(*(r[m.name] for m in margins), float(a), float(b)) for r, a, b in zip(cells, share, p)]


def _as_table(cells: DataFrame, margins: tuple[Margin, ...], budget: float) -> DataFrame:
    """The same for more cells than the driver should hold; a few rounds make a job, and what a job leaves is written."""
    keys = [m.name for m in margins]
    total = cells.agg(F.sum("tokens")).first()[0]
    w = cells.withColumn("w", F.col("tokens") / F.lit(float(total)))
    for m in margins:
        stated = F.create_map(*[F.lit(x) for v in m.shares.items() for x in v]) if m.shares else None
        mass = cells.groupBy(m.name).agg(F.sum("tokens").alias("t")).withColumn("stated", stated[F.col(m.name)] if m.shares else F.lit(None).cast("double"))
        mass = mass.withColumn("mass", F.when(F.col("stated").isNull(), F.pow(F.col("t").cast("double"), F.lit(m.power))).otherwise(0.0))
        sums = mass.agg(F.sum("mass").alias("mass"), F.coalesce(F.sum("stated"), F.lit(0.0)).alias("stated")).first()
        rest = max(0.0, 1 - sums.stated) if sums.mass else 0.0
        to = F.coalesce("stated", F.lit(rest) * F.col("mass") / F.lit(sums.mass or 1.0)) / F.lit(sums.stated + rest)
        w = w.join(mass.select(m.name, to.alias(f"to_{m.name}")), m.name)
    w = stored(w, "cells")
    for k in range(ROUNDS):
        if k % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            w = w.withColumn("before", F.col("w"))
        for m in margins:
            held = F.sum("w").over(Window.partitionBy(m.name))
            w = w.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"to_{m.name}") / held).otherwise(0.0))
        if k % ROUNDS_A_JOB == ROUNDS_A_JOB - 1:
            w = stored(w, "cells")
            moved = w.agg(F.max(F.when(F.col("before") > 0, F.abs(F.col("w") / F.col("before") - 1)))).first()[0]
            if moved is None or moved < TOLERANCE:
                break
    whole = w.agg(F.sum("w")).first()[0]
    w = stored(w.select(*keys, F.col("tokens").cast("double").alias("tokens"), (F.col("w") / F.lit(whole)).alias("share")), "cells")
    level = budget * total
    while True:  # cells that the level fills give all they have; what they can't give raises the level of the others
        full = F.col("share") * F.lit(level) >= F.col("tokens")
        got = w.filter("share > 0").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)).alias("given"), F.sum(F.when(full, 0.0).otherwise(F.col("share"))).alias("open")).first()
        if not got.open:
            level = float("inf")
            break
        after = (budget * total - got.given) / got.open
        if after <= level * (1 + 1e-15):
            break
        level = after
    return w.select(*keys, "share", F.when(F.col("share") > 0, F.least(F.lit(1.0), F.lit(level) * F.col("share") / F.col("tokens"))).otherwise(0.0).alias("probability"))


def mix(docs: DataFrame, budget: float = BUDGET, margins: tuple[Margin, ...] = MARGINS, local_cells: int = LOCAL_CELLS, seed: str = "mix", topic: str | None = None) -> DataFrame:
    """All rows and columns of docs with __mix_tokens, __mix_topic, __mix_share, __mix_probability and __mix_selected.

    Needs doc_id, text, source and lang. Token weights of (source, lang, topic) cells are raked to the margins'
    target shares, then budget of all tokens is sampled: a cell's documents are drawn with one probability, so that
    expected tokens follow the raked shares as far as a cell's documents suffice; what full cells cannot give falls
    to the others. A document is drawn by the MD5 of seed and doc_id, so copies of an id are drawn together. topic names
    a column; without it a text's form is its topic.

    Null source, lang or topic: the value `unknown`. Null or empty text: one token. A null doc_id is drawn as the empty
    text. An empty table gives no rows.
    """
    named = docs.withColumns(
        {
            "__mix_tokens": tokens(),
            "__mix_source": F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN)),
            "__mix_lang": F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)),
            "__mix_topic": F.coalesce(F.col(topic).cast("string"), F.lit(UNKNOWN)) if topic else F.expr(topic_sql()),
        }
    )
    keys = {"source": "__mix_source", "lang": "__mix_lang", "topic": "__mix_topic"}
    cells = named.groupBy(*[F.col(keys[m.name]).alias(m.name) for m in margins]).agg(F.sum("__mix_tokens").alias("tokens"))
    held = cells.limit(local_cells + 1).collect()
    if not held:
        found = docs.sparkSession.createDataFrame([], ", ".join(f"{m.name} string" for m in margins) + ", share double, probability double")
    elif len(held) <= local_cells:
        held.sort(key=lambda r: tuple(r[m.name] for m in margins))
        found = F.broadcast(docs.sparkSession.createDataFrame(_local(held, margins, budget), ", ".join(f"{m.name} string" for m in margins) + ", share double, probability double"))
    else:
        found = _as_table(stored(cells, "cells"), margins, budget)
    found = found.select(*[F.col(m.name).alias(f"__mix_at_{m.name}") for m in margins], F.col("share").alias("__mix_share"), F.col("probability").alias("__mix_probability"))
    on = [F.col(keys[m.name]) == F.col(f"__mix_at_{m.name}") for m in margins]
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return named.join(found, on, "left").drop(*[f"__mix_at_{m.name}" for m in margins]).withColumn("__mix_selected", drawn < F.col("__mix_probability"))


def mixture(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """mix() as a plan: doc_id, source, lang, topic, n_tokens, cell_share, probability, selected for every document.

    Nulls, empty texts, repeated rows and empty tables as in mix().
    """
    return mix(docs.select("doc_id", "text", "lang", "source"), budget).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("__mix_source").alias("source"),
        F.col("__mix_lang").alias("lang"),
        F.col("__mix_topic").alias("topic"),
        F.col("__mix_tokens").alias("n_tokens"),
        F.round("__mix_share", 8).alias("cell_share"),
        F.round("__mix_probability", 8).alias("probability"),
        F.col("__mix_selected").alias("selected"),
    )


def sample(docs: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents that mix() draws, with docs' own columns. Rows that repeat a doc_id are drawn together; nulls as in mix()."""
    return mix(docs, budget).filter("__mix_selected").select(*docs.columns)


def oracle_sql(rounds: int = 25, budget: float = BUDGET) -> str:
    """The rows of mixture() over a table `documents`, with the raking rounds written out."""
    count = f"greatest(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')), 1)"
    steps = [
        f"""d as (select doc_id, coalesce(source, '{UNKNOWN}') source, coalesce(lang, '{UNKNOWN}') lang, {topic_sql()} topic, {count} n_tokens from documents)""",
        "c as (select source, lang, topic, cast(sum(n_tokens) as double) tokens from d group by all)",
    ]
    columns = []
    for m in MARGINS:
        stated = f"case {m.name} " + " ".join(f"when '{v}' then cast({x} as double)" for v, x in m.shares.items()) + " end" if m.shares else "cast(null as double)"
        steps.append(f"a_{m.name} as (select {m.name}, {stated} stated, pow(sum(tokens), {m.power}) mass from c group by {m.name})")
        steps.append(f"b_{m.name} as (select {m.name}, coalesce(stated, greatest(0.0, 1 - coalesce(sum(stated) over (), 0.0)) * mass / sum(case when stated is null then mass end) over ()) target from a_{m.name})")
        steps.append(f"m_{m.name} as (select {m.name}, target / sum(target) over () target from b_{m.name})")
        columns.append(f"m_{m.name}.target to_{m.name}")
    steps.append(f"w0 as (select c.*, tokens / sum(tokens) over () w, {', '.join(columns)} from c join m_source using (source) join m_lang using (lang) join m_topic using (topic))")
    at = 0
    for _ in range(rounds):
        for m in MARGINS:
            steps.append(f"w{at + 1} as (select * replace (w * to_{m.name} / sum(w) over (partition by {m.name}) as w) from w{at})")
            at += 1
    steps += [
        f"s as (select source, lang, topic, tokens, w / sum(w) over () share from w{at})",
        "o as (select *, sum(tokens) over (order by tokens / share, source, lang, topic) - tokens bt, sum(share) over (order by tokens / share, source, lang, topic) - share bs, sum(tokens) over () total from s)",
        f"l as (select arg_min(level, r) level from (select ({budget} * total - bt) / greatest(1 - bs, 1e-300) level, tokens / share r from o) where level <= r)",
        "p as (select s.*, least(1.0, level * share / tokens) probability from s, l)",
    ]
    drawn = "cast(cast('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as double) / 4294967296.0"
    return f"with {', '.join(steps)} select doc_id, source, lang, topic, n_tokens, round(share, 8) cell_share, round(probability, 8) probability, {drawn} < probability selected from d join p using (source, lang, topic)"
