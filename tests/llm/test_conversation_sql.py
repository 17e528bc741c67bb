"""The SQL twins of the conversation operators, on awkward rows and on the given tables."""

import duckdb
import pandas as pd
import pytest

from motionloom.llm import conversation_sql, queries, repair, trie

from . import conversations as brute

CASES = {"op11_conversation_repair": (conversation_sql.REPAIR, repair.repair_damaged), "op12_prefix_trie": (conversation_sql.TRIE, trie.conversation_trie)}


def same(got, want):
    cols = sorted(got.columns)
    key = lambda r: tuple((v is None, 0 if v is None else v) for v in r)
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols and a == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, name, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{sf}/conversations.parquet'")
    same(queries.QUERIES[name](spark, f"/root/testdata/{sf}"), con.sql(CASES[name][0]))


@pytest.mark.parametrize("name", CASES)
def test_awkward_rows(spark, name):
    rows = [r for r in brute.rows(5, 40) if r[0] != 999]
    con = duckdb.connect()
    table = pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("given", table)
    con.sql("CREATE TABLE conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM given")
    same(CASES[name][1](spark.createDataFrame(rows, brute.SCHEMA)), con.sql(CASES[name][0]))
