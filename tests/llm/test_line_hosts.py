"""Line dedup on small hosts and awkward pages, against its SQL twin."""

import duckdb
import pandas as pd
import pytest

from motionloom.llm import linededup, queries

COLUMNS = ["page_id", "host", "n_lines", "n_dropped", "kept_sha256"]


def page(lines):
    return "<html><script>var x;</script>" + "".join(f"<p>{x}</p>" for x in lines) + "</html>"


@pytest.fixture(scope="module")
def pages():
    rows = [(i, f"https://u@small.org:80/{i}", page([f"own {i}", "menu"])) for i in range(9)]
    rows += [(100 + i, "https://pair.org/", page([f"p {i}", "both"])) for i in range(2)] + [(200, "https://one.org/", page(["alone", "alone"]))]
    rows += [(300 + i, "https://wide.org/", page([f"w {i}", "rare" if i < 3 else f"x {i}"])) for i in range(20)]  # 15 % of the pages, but below their root
    rows += [(None, "https://null.org/", page([f"n {i}", "menu"])) for i in range(12)]
    rows += [(7, "https://null.org/", page(["menu", "y"])), (7, "https://other.org/", page(["menu", "z"])), rows[3], rows[3], (None, None, None), (5000, "https://small.org/long", page([f"line {i}" for i in range(30000)]))]
    return rows


def both(spark, rows):
    con = duckdb.connect()
    con.register("given", pd.DataFrame([[str(v) if v is not None else None for v in r] for r in rows], columns=["page_id", "url", "html"]))
    con.sql("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM given")
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, lines string, n int")
    got = linededup.drop_lines(linededup.page_rows(df))
    return got, con.sql(queries.ORACLE["op6_line_dedup"])


def test_small_hosts_and_page_ids(spark, pages):
    got, want = both(spark, pages)
    kept = {}
    for r in got.collect():
        kept.setdefault((r["page_id"], r["host"]), []).append([x for x in r["kept"] if x.strip()])
    assert kept[4, "small.org"] == [["own 4"]] and kept[3, "small.org"] == [["own 3"]] * 3 and kept[100, "pair.org"] == [["p 0"]]
    assert kept[200, "one.org"] == [["alone", "alone"]] and ["w 0", "rare"] in kept[300, "wide.org"]
    assert all("menu" not in x for x in kept[None, "null.org"]) and kept[7, "null.org"] == [["y"]] and kept[7, "other.org"] == [["menu", "z"]]
    at = [want.columns.index(c) for c in ("page_id", "host", "n_lines")]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key) == sorted(((r["page_id"], r["host"], r["n_lines"]) for r in got.collect()), key=key)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_pages_lose_lines_as_in_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    want = con.sql(queries.ORACLE["op6_line_dedup"])
    at = [want.columns.index(c) for c in COLUMNS]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op6_line_dedup"](spark, f"/root/testdata/{sf}").collect())
    assert got == sorted(tuple(r[i] for i in at) for r in want.fetchall()) and sum(r[3] for r in got) > 0
