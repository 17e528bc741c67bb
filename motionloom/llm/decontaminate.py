"""Benchmark decontamination: a broadcast hash set of test n-grams meets the windows of the training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .common import ascii_lower, let, row_key, small, words

#: All ASCII but digits and lower-case letters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Candidates that may be broadcast: under 400 bytes each with their n-gram's words.
HIT_ROWS = 200_000


def tokens(text: Column) -> Column:
    return words(ascii_lower(text), SEPARATORS)


def windows(ws: Column, n: int) -> Column:
    """Hashes of all windows of ``n`` words, in order; none if the text is shorter."""

    def among(h):
        return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(1), F.size(h) - n + 1), lambda i: F.xxhash64(F.slice(h, i, n)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda x: F.xxhash64(x)), among)


def test_grams(items: DataFrame, n: int) -> DataFrame:
    """(gram, gram_words, item_id) of the items: windows of ``n`` words, or a shorter item whole."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("m", F.least(F.size("w"), F.lit(n)))
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.slice("w", i, F.col("m")))).alias("gram_words"))
    return w.select(F.xxhash64(F.transform("gram_words", lambda x: F.xxhash64(x))).alias("gram"), "gram_words", "item_id").distinct()


def candidates(docs: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """(row, pos, m, item_id, gram_words) where a window hashes like a test n-gram; nothing else leaves the scan's tasks."""
    base = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), tokens(F.col("text")).alias("w"))
    grams, found = small(grams), None
    for m in lengths:
        at = base.select("row", windows(F.col("w"), m).alias("grams")).select("row", F.posexplode_outer("grams").alias("pos", "gram"))
        one = at.join(grams.where(F.size("gram_words") == m), "gram").select("row", "pos", F.lit(m).alias("m"), "item_id", "gram_words")
        found = one if found is None else found.union(one)
    return found


def hits(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """One row per document row with what ``items`` left in it.

    Columns: row (key), doc_id, n_words, n_hit, item_ids (sorted strings), hit_words (positions from 1).
    The n-grams are a broadcast hash set up to ``BROADCAST_ROWS`` of them, else they are joined by shuffle. A window
    that hashes like one is compared word by word before it counts: the few candidates are brought back to
    the texts, broadcast up to ``HIT_ROWS`` of them, else by a shuffle join.

    Null and empty texts have no words and no hits; an item without words hits nothing; repeated
    rows are answered alike; a null item_id counts as a hit but is not named in ``item_ids``.
    """
    grams = staged(test_grams(items, n), "test-grams")
    lengths = sorted(r[0] for r in grams.select(F.size("gram_words")).distinct().collect())  # at most n numbers
    base = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", tokens(F.col("text")).alias("w"))
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    if not lengths:
        return base.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none[1].alias("item_ids"), none[0].alias("hit_words"))
    found = staged(candidates(docs, grams, lengths), "test-hits")
    per_row = found.groupBy("row").agg(F.collect_set(F.struct("pos", "m", "item_id", "gram_words")).alias("at"))
    if found.limit(HIT_ROWS + 1).count() <= HIT_ROWS:
        per_row = F.broadcast(per_row)
    out = base.join(per_row, "row", "left")
    true = F.filter("at", lambda a: F.slice("w", a["pos"] + 1, a["m"]) == a["gram_words"])
    out = out.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), true.alias("at"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a["pos"] + 1, a["pos"] + a["m"])))))
    named = F.array_sort(F.array_distinct(F.filter(F.transform("at", lambda a: a["item_id"]), lambda x: x.isNotNull())))
    out = out.select("row", "doc_id", "n_words", F.coalesce(named, none[1]).alias("item_ids"), F.coalesce(covered, none[0]).alias("hit_words"))
    return out.select("row", "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "item_ids", "hit_words")


def remove_contaminated(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a test n-gram; columns as they were."""
    cols = docs.columns
    bad = small(staged(hits(docs, items, n).where("n_hit > 0").select(F.col("row").alias("__hit")).distinct(), "test-documents"))
    keyed = docs.withColumn("__row", row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(bad, F.col("__row") == F.col("__hit"), "left_anti").select(*cols)


def remove_spans(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """(doc_id, clean_text): the normalised words outside every hit, joined by a space."""
    h = hits(docs, items, n).select("row", "hit_words").distinct()
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", tokens(F.col("text")).alias("w"))
    marked = keyed.join(h, "row").select("doc_id", "w", F.map_from_arrays("hit_words", F.transform("hit_words", lambda x: F.lit(True))).alias("hit"))
    left = F.filter(F.transform("w", lambda w, i: F.when(F.col("hit")[i + 1].isNull(), w)), lambda w: w.isNotNull())
    return marked.select("doc_id", F.array_join(left, " ").alias("clean_text"))
