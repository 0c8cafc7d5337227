"""Catalog jobs: rules as rows, edits, drift.  A catalog is a few tables; every rule is a query that yields its violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motion_tables.operators.joins import unknown_references


def violations(*rules: DataFrame) -> DataFrame:
    """All violations of several rules, one row each, in columns entity, id, rule."""
    return reduce(DataFrame.unionByName, [r.select("entity", F.col("id").cast("string").alias("id"), "rule") for r in rules])


def rule(df: DataFrame, entity: str, id_column: str, condition, text: str) -> DataFrame:
    return df.where(condition).select(F.lit(entity).alias("entity"), F.col(id_column).alias("id"), F.lit(text).alias("rule"))


def duplicates(df: DataFrame, entity: str, id_column: str, text: str) -> DataFrame:
    d = df.groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1")
    return rule(d, entity, id_column, F.lit(True), text)


def dangling(child: DataFrame, entity: str, column: str, parent: DataFrame, id_column: str, text: str) -> DataFrame:
    return unknown_references(child, column, parent, id_column, text).select(F.lit(entity).alias("entity"), F.col("reference").alias("id"), "rule")


def reasons(*checks) -> F.Column:
    """The texts of the conditions that hold: pairs of a condition and its text."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))


def drift(frozen: DataFrame, working: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that differ between a frozen and a working copy: the key, the change (added, removed, changed) and the columns that differ."""
    a = frozen.select(key, *[F.col(c).alias("a_" + c) for c in columns], F.lit(True).alias("in_a"))
    b = working.select(key, *[F.col(c).alias("b_" + c) for c in columns], F.lit(True).alias("in_b"))
    j = a.join(b, key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col("a_" + c).eqNullSafe(F.col("b_" + c)), F.lit(c)) for c in columns]))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").otherwise("changed")
    return j.select(key, change.alias("change"), F.when(change == "changed", changed).otherwise(F.array().cast("array<string>")).alias("fields")).where("change <> 'changed' or size(fields) > 0")


def upserted(current: DataFrame, edits: DataFrame, key: str, kept: list[str], replaced: list[str]) -> DataFrame:
    """current with edits by key: an existing row keeps its ``kept`` columns, takes the edit's others; new rows are the edit's."""
    e = edits.withColumnsRenamed({c: "_new_" + c for c in [*kept, *replaced]}).withColumn("_edit", F.lit(True))
    j = current.withColumn("_old", F.lit(True)).join(e, key, "full")
    pick = [F.when(F.col("_old").isNull(), F.col("_new_" + c)).otherwise(F.col(c)).alias(c) for c in kept]
    pick += [F.when(F.col("_edit").isNull(), F.col(c)).otherwise(F.col("_new_" + c)).alias(c) for c in replaced]
    return j.select(key, *pick)


def revision_checked(stored: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """edits (key, loaded_revision, value) against stored (key, revision): accepted with the next revision, or a conflict with the stored one.  Nothing stored is revision null."""
    j = edits.join(stored.select(key, "revision"), key, "left")
    ok = F.col("revision").eqNullSafe(F.col("loaded_revision"))
    return j.select(key, F.when(ok, "accepted").otherwise("conflict").alias("outcome"), F.when(ok, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"))


def last_edits(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last entry of an edit log for each key."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
