"""Queries against their SQL on small tables that hold the odd rows."""

import datetime

import duckdb

import itemloom.queries  # noqa: F401
from itemloom.registry import QUERIES


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = QUERIES[name].run(spark, str(folder))
    cur = con.execute(QUERIES[name].sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(got.columns)
    have = [tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    return want


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_reorder_next_to_takes_the_middle_where_orders_tie(spark, tmp_path):
    rows = [(k, "x", "en", "src1", n) for k, n in [(1, 5), (2, 97 * 3 + 7), (3, 97 * 2 + 7), (4, 97 + 8), (5, 97 + 7)]]
    assert same_as_sql(spark, tmp_path, "reorder_next_to", documents=(rows, DOCUMENTS)) == [(1, 7.0)]


def test_empty_recognition_reads_the_signs_its_sql_reads(spark, tmp_path):
    seconds = ["É.", "...", "ab", "![p](q)", "!![", "", None, "九", "7!"]
    rows = [(k, None if s is None else f"x\n{s}", "en", "src1", 9) for k, s in enumerate(seconds)]
    assert sorted(same_as_sql(spark, tmp_path, "empty_recognition", documents=(rows, DOCUMENTS))) == [(0,), (1,), (4,), (5,), (7,)]


LINEITEM = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


def order_lines(order, rows):
    """(number, flag, status) in paper order."""
    day = datetime.datetime(1995, 1, 1)
    return [(order, 100 + k, 7, n, 1.0, 10.0, 0.0, 0.0, flag, status, day + datetime.timedelta(days=k)) for k, (n, flag, status) in enumerate(rows)]


def test_segmented_papers_keeps_shifted_tails(spark, tmp_path):
    rows = order_lines(1, [(1, "A", "F"), (2, "N", "F"), (2, "R", "F"), (3, "N", "O"), (1, "A", "O"), (2, "N", "O")])
    assert same_as_sql(spark, tmp_path, "segmented_papers", lineitem=(rows, LINEITEM)) == [(1, 6, 11)]


def test_segmented_papers_keeps_the_zone_where_numbers_restart(spark, tmp_path):
    rows = order_lines(1, [(n, "N", "F") for n in (1, 2, 3, 4, 5, 1, 3, 3, 4)])
    assert same_as_sql(spark, tmp_path, "segmented_papers", lineitem=(rows, LINEITEM)) == [(1, 9, 26)]


def test_stream_ingest_reads_a_table_of_several_files(spark, tmp_path):
    rows = [(k, "x", "en", f"src{k % 2}", k % 3) for k in range(9)]
    assert len(same_as_sql(spark, tmp_path, "stream_ingest", documents=(rows, DOCUMENTS))) == 6
