"""Queries against their SQL on small tables with keys and texts that the given ones lack."""

import duckdb
import pytest

from lexiloom.plans import registry
from tests.conftest import SF


def both(spark, folder, name, **tables):
    """(rows of the query, rows of its SQL), each sorted, over the given DataFrames as tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    sql = con.sql(registry.sql()[name])
    assert sorted(sql.columns) == sorted(df.columns)
    return sorted(map(tuple, df.select(*sql.columns).collect()), key=str), sorted(sql.fetchall(), key=str)


def test_merge_edges_with_part_keys_beyond_a_million(spark, tmp_path):
    parts = [0, 3, 4, 9, 15, 1_000_003, 1_000_009, 1_000_015]
    lines = spark.createDataFrame([(1, p, 0.02) for p in parts[:5]] + [(2, 7, 0.02)], "l_suppkey long, l_partkey long, l_discount double")
    got, want = both(spark, tmp_path, "merge_edges", lineitem=lines, supplier=spark.createDataFrame([(1,)], "s_suppkey long"), part=spark.createDataFrame([(p,) for p in parts], "p_partkey long"))
    assert got == want


@pytest.mark.parametrize("agency", ["wac", "rcw", "smc", "spu", "ibc"])
def test_lines_like_headers_do_not_split_a_section(spark, tmp_path, agency):
    lines = ["42.97.92.12 Thanat at", "a", "WAC 365-196-010 x", "RCW 36.70A.010 x", "12.15.210 - x", "#", "10.1", "", "## WAC 51-50-0101 y.", "WAC 51-11-1010", "12/11/2020 z", " ", "12.15.210 -"]
    docs = spark.createDataFrame([(155880, "\n".join(lines)), (7, "42.97 t\n"), (8, ""), (9, "\n\n"), (10, None)], "doc_id long, text string")
    got, want = both(spark, tmp_path, f"chunk_split_{agency}", documents=docs)
    assert got == want


def test_closed_sessions_come_from_files_not_from_the_driver(spark):
    before = {t.name for t in spark.catalog.listTables()}
    df = registry.queries()["stream_session_ttl"](spark, SF)
    assert df.inputFiles() and {t.name for t in spark.catalog.listTables()} <= before
    assert df.count() > 0
