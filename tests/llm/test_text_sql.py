"""The SQL of the queries on personal data and on repeats, on nulls, repeated rows, long texts, characters of several bytes and IBANs within each other."""

import random

import duckdb
import pytest

from lernwerk.llm import registry

IBANS = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO9386011117947", "GB82WEST12345698765433", "DE89 3704 0044 0532 0130 00 AB12 CD34"]
OTHERS = ["mail to a.b+c@mail-host.example.org.", "x@y", "@@a@b.c@d.e", "host 10.0.0.255", "1.2.3.4.5.6.7.8", "ip 256.1.1.1 0010.0.0.0001", "card 4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559000", "tel +49 (30) 1234-5678", "+1 2", "Grüße, 12 é ñ", "IBAN\n"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(5)
    passages = ["".join(rng.choice("abé ñ€x.") for _ in range(n)) for n in (60, 99, 101, 180, 400, 2500)]
    texts = [None, "", "a" * 99, "b" * 100, "é" * 700, passages[5] * 3]
    texts += ["".join(rng.choice([*passages, *IBANS, *OTHERS, " ", "_", "\n", "Z"]) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, "null key " * 20)]
    path = tmp_path_factory.mktemp("texts")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), db


@pytest.mark.parametrize("name", ["op2_suffix_dedup", "op9_pii"])
def test_sql_equals_query(spark, made, name):
    got = registry.QUERIES[name](spark, made[0])
    want = made[1].sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    found, told = (sorted(map(repr, map(tuple, x))) for x in (got.select(*want.columns).collect(), want.fetchall()))
    assert [pair for pair in zip(found, told, strict=True) if pair[0] != pair[1]] == []
