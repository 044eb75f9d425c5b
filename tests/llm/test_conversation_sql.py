"""The SQL of the conversation queries on ties, repeats, nulls and odd roles."""

import random

import duckdb
import pytest

from lernwerk.llm import registry


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_structure_repair"])
def test_sql_equals_query(spark, tmp_path, name):
    rng = random.Random(8)
    rows = [(c, rng.choice([None, 0, 1, 1, 2, 3, 7]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["One.", "two", "", " \t", None, "Drei! ", "é?"])) for c in [*range(90), 100, 101, 230] for _ in range(rng.randint(1, 9))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
