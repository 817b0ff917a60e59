"""Regions that share an id and a size go by their boxes, in the query and in its SQL."""

import duckdb
import pytest

from tests.oracle import TABLES, rows_of_query, rows_of_sql
from timedtext.plans import region_queries as Q

#: Parts 33 apart are equally high and differ in x or in their times; suppliers differ in y; all lines of an order have number 1.
LINES = """SELECT k AS l_orderkey, CAST(1 + 33 * ((k * 7 + i * 5) % 11) + k % 3 AS BIGINT) AS l_partkey, CAST((i * 3 + k) % 17 AS BIGINT) AS l_suppkey, 1::INT AS l_linenumber, CAST(13 + 40 * ((i + k) % 2) AS DOUBLE) AS l_quantity
FROM range(60) a(k), range(12) b(i) ORDER BY k {0}, i {0}"""


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_equal_ids_and_sizes(spark, tmp_path, name):
    results = []
    for order in ("ASC", "DESC"):
        d = tmp_path / order
        d.mkdir()
        for t in TABLES:
            rows = LINES.format(order) if t == "lineitem" else f"SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'"
            duckdb.sql(f"COPY ({rows}) TO '{d}/{t}.parquet'")
        results += [rows_of_query(Q.QUERIES[name](spark, str(d))), rows_of_sql(Q.ORACLE_SQL[name], str(d))]
    assert all(r == results[0] for r in results)
