"""Order MinHash fingerprints of documents, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronomesh.llm.common import NULL_ID

BUCKET_BITS = 6
POSITION_BITS = 24


def _let(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, which is then computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def words_sql(text: str) -> str:
    """SQL of a text's words: runs of characters other than 32 and 9 to 13."""
    trimmed = f"trim(both ' \t\n\x0b\x0c\r' from {text})"
    split = r"split(t, '[\\x20\\x09-\\x0D]+')"
    return _let(trimmed, "t", f"if(t = '', cast(array() as array<string>), {split})")


def fingerprint(text: str) -> Column:
    """array<bigint>: the Order MinHash of a text's words, one 32-bit value for each bucket that is not empty.

    K-mers are pairs of neighbouring words, the text's ends counting as words. Each is numbered among its equals, and
    a hash of k-mer and number deals it to one of 2^BUCKET_BITS buckets and orders it there (one-permutation hashing).
    A bucket's least two are put in text order and hashed as a tuple, led by the bucket's number; a bucket of one takes
    the least of the next filled bucket as its second, the first bucket following the last, so each tuple has an order.
    Sorting packed longs keeps it at n log n within the row. In a text of over 2^POSITION_BITS words neighbours share positions.
    """
    shift, top, low = POSITION_BITS, 64 - BUCKET_BITS, (1 << POSITION_BITS) - 1
    pair = "xxhash64(coalesce(get(w, i - 1), '^'), i = 0, coalesce(get(w, i), '$'), i = size(w))"
    packed = f"sort_array(transform(sequence(0, size(w)), i -> ({pair} & {~low}L) | cast(i div (1 + size(w) div {low}) as bigint)))"
    runs = f"filter(sequence(0, size(s) - 1), q -> q = 0 or shiftrightunsigned(s[q], {shift}) <> shiftrightunsigned(s[greatest(q - 1, 0)], {shift}))"
    numbered = f"(xxhash64(shiftrightunsigned(s[q], {shift}), q - a) & {~low}L) | (s[q] & {low}L)"
    span = _let("r[j]", "a", f"transform(sequence(a, coalesce(get(r, j + 1), size(s)) - 1), q -> {numbered})")
    dealt = f"sort_array(flatten(transform(sequence(0, size(r) - 1), j -> {span})))"
    heads = f"filter(sequence(0, size(p) - 1), q -> q = 0 or shiftrightunsigned(p[q], {top}) <> shiftrightunsigned(p[greatest(q - 1, 0)], {top}))"
    first, second = "p[q]", "p[(q + 1) % size(p)]"
    one, two = f"shiftrightunsigned({first}, {shift})", f"shiftrightunsigned({second}, {shift})"
    ordered = f"case when size(p) = 1 then xxhash64({one}) when ({first} & {low}L) <= ({second} & {low}L) then xxhash64({one}, {two}) else xxhash64({two}, {one}) end"
    value = f"shiftrightunsigned(shiftleft(shiftrightunsigned({first}, {top}), {top}) | shiftrightunsigned({ordered}, {BUCKET_BITS}), 32)"
    made = _let(packed, "s", _let(runs, "r", _let(dealt, "p", f"transform({heads}, q -> {value})")))
    return F.expr(_let(words_sql(text), "w", made))


def likeness(a: str, b: str) -> Column:
    """Share of the buckets filled in either fingerprint that hold the same tuple in both: 0 to 1."""
    buckets = [f"transform({x}, v -> shiftrightunsigned(v, {32 - BUCKET_BITS}))" for x in (a, b)]
    return F.expr(f"cast(size(array_intersect({a}, {b})) as double) / size(array_union({buckets[0]}, {buckets[1]}))")


def as_text(values: str) -> Column:
    """A fingerprint as hex digits, eight for each filled bucket."""
    return F.expr(f"array_join(transform({values}, v -> lower(lpad(hex(v), 8, '0'))), '')")


def successors(ids: DataFrame) -> DataFrame:
    """(id, next_id) of distinct 64-bit ids in ascending order, the first following the last.

    Ids are grouped by their leading 48 bits, so that no window holds over 65,536 of them; each group's last id gets
    the first one of the next group, found the same way among the groups, and so on up to the leading 16 bits.
    """
    item, level, tables = F.col("id"), ids.select("id", F.col("id").alias("item"), F.col("id").alias("least")), []
    for bits in (16, 32, 48):
        group = F.shiftright("id", bits)
        by = Window.partitionBy("group").orderBy("item")
        tables.append(level.withColumn("group", group).withColumn("after", F.lead("least").over(by)).select("id", "item", "group", "least", "after"))
        level = level.groupBy(group.alias("item")).agg(F.min("least").alias("least")).withColumn("id", F.col("least"))
    everything = Window.orderBy("item")  # at most 65,536 rows
    first = Window.orderBy("item").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upper = level.select(F.col("item").alias("group"), F.coalesce(F.lead("least").over(everything), F.min("least").over(first)).alias("beyond"))
    for table in reversed(tables):
        upper = table.join(upper, "group", "left").select(F.col("item").alias("group"), F.coalesce("after", "beyond").alias("beyond"))
    return upper.select(F.col("group").alias("id"), F.col("beyond").alias("next_id"))


def neighbours(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text, edited (its last quarter replaced by the next document's first characters), their
    fingerprints values and edited_values, and the next document's, next_values.

    A quarter is floor(characters / 4); the next document is that of the next larger doc_id, the first following the
    last. Texts are dealt out by doc_id once; only the next document's head and fingerprint go to its predecessor.

    Null text counts as empty. A null doc_id counts as the smallest and is returned as null. Rows that repeat a doc_id
    are each returned; as a next document the least of their heads counts. An empty table gives no rows. Columns
    besides doc_id and text are not read.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = base.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    after = successors(sizes.select(F.col("doc_id").alias("id")))
    # sent: the document next_id gives its predecessor `id` as many characters as that replaces
    sent = after.join(sizes, after.id == sizes.doc_id).select("next_id", F.col("id").alias("to"), (F.col("n") / 4).cast("int").alias("quarter"))
    made = base.withColumn("values", fingerprint("text"))  # once, where the documents are read; both joins take it from one exchange
    heads = made.join(sent.hint("shuffle_merge"), made.doc_id == sent.next_id).select("to", F.expr("left(text, quarter)").alias("head"), F.col("values").alias("next_values"))
    heads = heads.groupBy("to").agg(F.min(F.struct("head", "next_values")).alias("next"))
    n = "char_length(text)"
    edited = F.expr(f"concat(left(text, {n} - {n} div 4), left(next.head, cast({n} div 4 as int)))")
    joined = made.join(heads.hint("shuffle_merge"), made.doc_id == heads["to"])
    joined = joined.select("doc_id", "text", "values", edited.alias("edited"), F.col("next.next_values").alias("next_values"))
    joined = joined.withColumn("edited_values", fingerprint("edited"))
    return joined.withColumn("doc_id", F.expr(f"nullif(doc_id, {NULL_ID + 1}L - 1L)"))


def edit_sensitivity(docs: DataFrame) -> DataFrame:
    """neighbours()'s rows as digests: how alike a document's fingerprint is to its edited text's and to the next one's."""
    return neighbours(docs).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("values").alias("fingerprint"),
        as_text("edited_values").alias("edited_fingerprint"),
        likeness("values", "edited_values").alias("near_edited"),
        likeness("values", "next_values").alias("near_next"),
    )
