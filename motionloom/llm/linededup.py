"""Line dedup by site-relative frequency: a line on too large a share of a host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionloom.session import staged

from .common import row_key, small

#: Production parameter: the share of a host's pages above which a line is boilerplate. On small hosts the share rises: a line
#: must stand on two pages and on the square root of the host's pages at least, which prevails below 1 / RATIO**2 pages.
RATIO = 0.1


def page_rows(pages: DataFrame) -> DataFrame:
    """(row, page_id, host, lines) of raw pages (page_id, url, html), parsed once and written; ``row`` is a 128-bit key of the whole row."""
    whole = [F.col(c) for c in ("page_id", "url", "html")]
    key = F.concat(F.hex(F.xxhash64(*whole)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *whole)))
    return staged(pages.select(key.alias("row"), "page_id", page_host(F.col("url")).alias("host"), html_lines(F.col("html")).alias("lines")), "page-lines")


def page_host(url: Column) -> Column:
    """The lower-case host of a URL, without user, port and path."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def html_lines(html: Column) -> Column:
    """The text of a page as lines: one per run between tags; scripts, styles and comments are left out."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "\n")
    return F.split(F.regexp_replace(text, r"<[^>]*>", "\n"), "\n")


def line_rows(pages: DataFrame, *keep: str) -> DataFrame:
    """(host, line hash, ...) of the distinct lines with text on each page; a null host is the empty one."""
    at = pages.select(F.coalesce("host", F.lit("")).alias("host"), *keep, F.explode_outer(F.array_distinct("lines")).alias("text"))
    return at.where(F.trim("text") != "").select("host", F.xxhash64("text").alias("line"), *keep)


def boilerplate(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(host, line hash) of the lines to drop, from ``pages`` (host, lines).

    A line counts once per page, and pages with equal lines count as one page: copies of a page
    are left to the document-level operators and don't make their own text boilerplate.
    """
    pages = pages.withColumn("page", F.xxhash64("lines"))
    totals = pages.groupBy(F.coalesce("host", F.lit("")).alias("host")).agg(F.count_distinct("page").alias("pages"))
    often = line_rows(pages, "page").groupBy("host", "line").agg(F.count_distinct("page").alias("n")).where("n >= 2")
    return often.join(totals, "host").where((F.col("n") > F.lit(ratio) * F.col("pages")) & (F.col("n") * F.col("n") >= F.col("pages"))).select("host", "line")


def dropped_lines(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(row, dropped): hashes of the boilerplate lines of each page that has some, from ``pages`` (row, host, lines)."""
    drop = boilerplate(pages, ratio)
    return line_rows(pages, "row").join(drop, ["host", "line"]).groupBy("row").agg(F.collect_set("line").alias("dropped"))


def kept_lines(lines: Column, dropped: Column) -> Column:
    return F.when(dropped.isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(dropped, F.xxhash64(x))))


def drop_lines(pages: DataFrame, ratio: float = RATIO) -> DataFrame:
    """``pages`` (row, host, lines, ...) without boilerplate lines: row, host, n_lines, kept (lines) and the other columns; one row per row.

    Null hosts form one host, the empty one; null lines are none; blank lines are kept and not
    counted; repeated rows are answered alike. ``row`` must not be null.
    """
    out = pages.withColumn("lines", F.coalesce("lines", F.array().cast("array<string>"))).join(dropped_lines(pages, ratio), "row", "left")
    n = F.size(F.filter("lines", lambda x: F.trim(x) != "")).cast("long")
    rest = [c for c in pages.columns if c not in ("row", "host", "lines", "n_lines", "kept", "dropped")]
    return out.select("row", *rest, F.coalesce("host", F.lit("")).alias("host"), n.alias("n_lines"), kept_lines(F.col("lines"), F.col("dropped")).alias("kept"))


def drop_document_lines(docs: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Documents with their source's boilerplate lines taken out of ``text``; ``n_chars`` follows where present.

    Columns and rows stay; null texts stay null; a text that loses no line keeps every character.
    """
    cols = docs.columns
    keyed = docs.withColumn("__row", row_key(F.col("source"), F.col("text")))
    pages = keyed.where(F.col("text").isNotNull()).select(F.col("__row").alias("row"), F.col("source").alias("host"), F.split("text", "\n").alias("lines"))
    hit = dropped_lines(pages, ratio).select(F.col("row").alias("__row"), F.col("dropped").alias("__dropped"))
    out = keyed.join(small(staged(hit, "dropped-lines")), "__row", "left")  # texts stay where they are unless very many lose lines
    cut = F.array_join(kept_lines(F.split("text", "\n"), F.col("__dropped")), "\n")
    out = out.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("__dropped").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*cols)
