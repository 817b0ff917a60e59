"""Queries over picture regions: four orders are a video, their lines are its regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import micro
from ..operators import regions as R
from . import views as V

REGIONS = """
SELECT CAST(floor(l_orderkey / 4) AS BIGINT) AS video_id, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS region_id, CAST(l_quantity AS BIGINT) % 6 = 0 AS validated,
  CASE WHEN l_partkey % 3 = 0 THEN CAST(l_suppkey % 7 * 1000 AS BIGINT) END AS start_ms, CASE WHEN l_partkey % 3 = 0 THEN CAST(l_suppkey % 7 * 1000 + 2500 AS BIGINT) END AS end_ms,
  CAST(l_partkey * 7 % 60 AS DOUBLE) AS x, CAST(l_suppkey * 13 % 80 AS DOUBLE) AS y, CAST(l_quantity * 3 % 40 + 2 AS DOUBLE) AS w, CAST(l_partkey % 11 + 4 AS DOUBLE) AS h FROM {lineitem}
"""
BANDS = "SELECT DISTINCT CAST(floor(o_orderkey / 4) AS BIGINT) AS video_id, CAST(5 AS DOUBLE) AS x, CAST(floor(o_orderkey / 4) % 20 + 60 AS DOUBLE) AS y, CAST(90 AS DOUBLE) AS w, CAST(12 AS DOUBLE) AS h FROM {orders} WHERE floor(o_orderkey / 4) % 5 > 0"


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(REGIONS, lineitem=V.table(spark, d, "lineitem"))


def _shown(r: DataFrame) -> DataFrame:
    return r.select("video_id", "region_id", "start_ms", *[micro(c).alias(c) for c in "xywh"])


def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.merge_regions(_regions(spark, d)))


def blur_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth video has no band."""
    return _shown(R.blur_boxes(_regions(spark, d), spark.sql(BANDS, orders=V.table(spark, d, "orders"))))


QUERIES = {f.__name__: f for f in (merged_regions, blur_boxes)}


def _share(a: str, b: str) -> str:
    over = lambda p, n: f"greatest(0, least({a}.{p} + {a}.{n}, {b}.{p} + {b}.{n}) - greatest({a}.{p}, {b}.{p}))"
    return f"({over('x', 'w')} * {over('y', 'h')} / greatest(1, least({a}.w * {a}.h, {b}.w * {b}.h)))"


_ROW = "{'id': region_id, 'v': validated, 'a': start_ms, 'b': end_ms, 'x': x, 'y': y, 'w': w, 'h': h}"
_KEPT = f"""r AS ({REGIONS.format(lineitem='lineitem')}), n AS (SELECT video_id, {_ROW} AS r, row_number() OVER (PARTITION BY video_id ORDER BY NOT coalesce(validated, FALSE), start_ms IS NOT NULL, -w * h NULLS FIRST, region_id NULLS FIRST, start_ms NULLS FIRST, end_ms NULLS FIRST, x NULLS FIRST, y NULLS FIRST, w NULLS FIRST, h NULLS FIRST) AS k FROM r),
m(video_id, k, acc) AS (
  SELECT DISTINCT video_id, 0::BIGINT, []::STRUCT(id BIGINT, v BOOLEAN, a BIGINT, b BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] FROM r
  UNION ALL
  SELECT video_id, k, CASE WHEN coalesce(pl, 0) = 0 THEN acc || [r] WHEN acc[pl].v THEN acc ELSE acc[:pl - 1] || [{{'id': acc[pl].id, 'v': acc[pl].v, 'a': acc[pl].a, 'b': acc[pl].b, 'x': round_even(least(acc[pl].x, r.x), 0), 'y': round_even(least(acc[pl].y, r.y), 0),
      'w': round_even(greatest(acc[pl].x + acc[pl].w, r.x + r.w) - least(acc[pl].x, r.x), 0), 'h': round_even(greatest(acc[pl].y + acc[pl].h, r.y + r.h) - least(acc[pl].y, r.y), 0)}}] || acc[pl + 1:] END
  FROM (SELECT n.video_id, n.k, n.r, m.acc, list_position(list_transform(m.acc, lambda e: n.r.a IS NULL AND e.a IS NULL AND {_share('n.r', 'e')} > 0.45), TRUE) AS pl FROM m JOIN n ON n.video_id = m.video_id AND n.k = m.k + 1)),
kept AS (SELECT video_id, arg_max(acc, k) AS rows FROM m GROUP BY 1)"""
_OUT = "video_id, e.id AS region_id, e.a AS start_ms, " + ", ".join(f"cast(floor(e.{c} * 1000000 + 0.5) AS BIGINT) AS {c}" for c in "xywh")
ORACLE_SQL = {
    "merged_regions": f"WITH RECURSIVE {_KEPT} SELECT {_OUT} FROM (SELECT video_id, unnest(rows) AS e FROM kept)",
    "blur_boxes": f"""WITH RECURSIVE {_KEPT}, band AS ({BANDS.format(orders='orders')}),
g AS (SELECT video_id, unnest(rows) AS e, generate_subscripts(rows, 1) AS k FROM kept),
q AS (SELECT video_id, k, {{'id': e.id, 'v': e.v, 'a': e.a, 'b': e.b, 'x': e.x, 'y': CASE WHEN e.y <= 15 AND e.a IS NULL THEN 0 ELSE e.y END, 'w': e.w, 'h': CASE WHEN e.y <= 15 AND e.a IS NULL THEN least(e.h, 13) ELSE e.h END}} AS r FROM g),
z AS (SELECT q.video_id, q.k, q.r, band.x IS NOT NULL AND q.r.a IS NULL AND {_share('q.r', 'band')} > 0.25 AS inside FROM q LEFT JOIN band USING (video_id)),
f(video_id, k, acc) AS (
  SELECT video_id, 0::BIGINT, []::STRUCT(id BIGINT, v BOOLEAN, a BIGINT, b BIGINT, x DOUBLE, y DOUBLE, w DOUBLE, h DOUBLE)[] FROM kept
  UNION ALL
  SELECT z.video_id, z.k, CASE WHEN z.inside OR len(list_filter(f.acc, lambda e: {_share('z.r', 'e')} > 0.6 AND (z.r.a IS NULL OR e.a IS NULL OR greatest(z.r.a, e.a) < least(z.r.b, e.b)))) > 0 THEN f.acc ELSE f.acc || [z.r] END
  FROM f JOIN z ON z.video_id = f.video_id AND z.k = f.k + 1)
SELECT {_OUT} FROM (SELECT video_id, unnest(arg_max(acc, k)) AS e FROM f GROUP BY 1)""",
}
