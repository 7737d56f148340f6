"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from pyspark.sql import functions as F

from quirework.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    plain = lambda v: None if pd.isna(v) else str(round(float(v), 5)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    spark.catalog.clearCache()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_days_end_at_midnight(spark, tmp_path):
    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT i AS user_id, TIMESTAMP '2024-01-01 23:59:59' + to_microseconds(i * 100000 + d * 86400000000) AS ts FROM range(12) a(i), (VALUES (0), (1), (5)) b(d)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    got, want = QUERIES["compact_ranges"](spark, str(tmp_path)).toPandas(), con.sql(ORACLES["compact_ranges"]).df()
    assert len(set(want["ranges"])) == 2 and rows(got) == rows(want)


def test_characters_are_looked_up_and_not_tried_one_by_one(spark):
    """Every unit that can stand alone, halves of pairs, null; no pattern of many ranges, none for each unit."""
    from quirework.functions import text as T

    texts = ["".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000)))), "a😀\tb\x7f𝄞€", "", None, "→x→Ω→"]
    table = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    got = {r["i"]: r for r in table.select("i", T.winansi_offenders(F.col("s")).alias("o"), T.dropped_characters(F.col("s")).alias("d")).collect()}
    fine = {*range(0x20, 0x7F), *range(0xA0, 0x100), *(ord(bytes([b]).decode("cp1252", "ignore") or " ") for b in range(0x80, 0xA0))}
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-16-be")
        units = [int.from_bytes(raw[k : k + 2]) for k in range(0, len(raw), 2)]
        assert [tuple(o) for o in got[i]["o"]] == [("�" if 0xD800 <= u < 0xE000 else chr(u), f"U+{u:04X}", k) for k, u in enumerate(units) if u not in fine]
        assert got[i]["d"] == list(dict.fromkeys(c for c in text or "" if ord(c) > 0xFF and ord(c) not in fine))
    plan = table.select(T.winansi_offenders(F.col("s")), T.dropped_characters(F.col("s")))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "™š" not in plan and "u2122" not in plan
