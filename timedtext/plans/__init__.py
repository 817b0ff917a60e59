"""Derived views over the driver tables and the registered queries with their SQL."""

from . import cue_queries, interval_queries, match_queries, region_queries, report_queries, rescore_queries, score_queries, segment_queries, source_queries, story_queries, text_queries

_MODULES = (interval_queries, cue_queries, score_queries, segment_queries, match_queries, source_queries, report_queries, text_queries, rescore_queries, story_queries, region_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
