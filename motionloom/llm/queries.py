"""The registered queries of the text operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import conversation_sql, decontaminate, jaccard, lempelziv, linededup, mixing, mixlm, polytope, quality, repair, secrets, suffix, tokencount, trie
from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_suffix_dedup")
def op1(spark, sf):
    return suffix.remove_repeats(table(spark, sf, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


#: Tokens above which a document does not fit the model's context.
TOKEN_LIMIT = 4096


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed vocabulary files lie: in the package, so on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op4_token_counts")
def op4(spark, sf):
    out = tokencount.token_counts(table(spark, sf, "documents"), tokenizer_path())
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op5_substring_dedup")
def op5(spark, sf):
    return lempelziv.remove_copies(table(spark, sf, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op2_quality_rules")
def op2(spark, sf):
    out = quality.quality_rules(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3 = r"""
WITH words AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM grams),
wins AS (SELECT r, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, sizes WHERE len(w) >= m)),
hits AS (SELECT r, i, wins.m, item_id FROM wins JOIN grams ON wins.g = grams.g AND wins.m = grams.m),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM words LEFT JOIN cover USING (r) LEFT JOIN named USING (r)
"""


@query("op3_decontaminate", OP3)
def op3(spark, sf):
    out = decontaminate.hits(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    names = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), names.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6 = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host,
  string_split(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', chr(10), 'g'), '<[^>]*>', chr(10), 'g'), chr(10)) AS lines FROM pages),
d AS (SELECT DISTINCT host, lines FROM p),
t AS (SELECT host, count(*) AS pages FROM d GROUP BY host),
n AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM d) WHERE trim(line, ' ') <> '' GROUP BY host, line),
b AS (SELECT n.host, line FROM n JOIN t ON n.host = t.host WHERE n >= 2 AND n > 0.1 * pages AND n * n >= pages),
l AS (SELECT r, page_id, host, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM p),
k AS (SELECT l.r, l.page_id, l.host, l.line, i, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.host = b.host AND l.line = b.line)
SELECT page_id, host, count(*) FILTER (WHERE trim(line, ' ') <> '') AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY r, page_id, host
"""


@query("op6_line_dedup", OP6)
def op6(spark, sf):
    out = linededup.drop_lines(linededup.page_rows(table(spark, sf, "pages")))
    left = F.size(F.filter("kept", lambda x: F.trim(x) != "")).cast("long")
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - left).alias("n_dropped"), F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"))


@query("op7_jaccard_join")
def op7(spark, sf):
    docs = table(spark, sf, "documents")
    out = jaccard.jaccard_components(docs, words=3, similarity=(90, 100))
    number = lambda c: F.when(F.col(c) != jaccard.ABSENT, F.col(c))
    return out.select(number("doc").alias("doc_id"), "n_shingles", number("component").alias("component_id"))


@query("op8_secret_scan")
def op8(spark, sf):
    out = secrets.find_secrets(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    base = F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return out.select("doc_id", count(0), count(1), count(2), base, secrets.written(F.concat("base", "found")).alias("spans"))


@query("op9_mixing")
def op9(spark, sf):
    return mixing.mixing_rates(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("row")


@query("op10_lm_scoring")
def op10(spark, sf):
    return mixlm.score_texts(table(spark, sf, "documents"))


@query("op11_conversation_repair", conversation_sql.REPAIR)
def op11(spark, sf):
    return repair.repair_damaged(table(spark, sf, "conversations"))


@query("op12_prefix_trie", conversation_sql.TRIE)
def op12(spark, sf):
    return trie.conversation_trie(table(spark, sf, "conversations"))


@query("op13_nearest_neighbours")
def op13(spark, sf):
    rows = table(spark, sf, "embeddings")
    return polytope.nearest_neighbours(rows, rows.where("vec_id % 100 = 0"), k=10)


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
