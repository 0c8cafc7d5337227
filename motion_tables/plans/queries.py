"""The registered queries over the given tables, and their SQL: one module for each family of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motion_tables.plans import catalog_queries, contract_queries, document_queries, edit_queries, fit_queries, follow_queries, join_queries, label_queries, label_set_queries, legacy_queries, measure_queries, metric_queries, series_queries, shaft_queries, shape_queries, snapshot_queries, space3d_queries, space_queries, store_queries

PARTS = (shape_queries, series_queries, join_queries, metric_queries, catalog_queries, space_queries, label_queries, shaft_queries, contract_queries, space3d_queries, document_queries, measure_queries, snapshot_queries, legacy_queries, fit_queries, label_set_queries, follow_queries, edit_queries, store_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for part in PARTS for k, v in part.ORACLE_SQL.items()}
