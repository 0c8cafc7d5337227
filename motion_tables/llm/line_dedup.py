"""Line dedup by cross-site spread, in DataFrame operations alone.

A line is boilerplate if it stands on at least ``min_sites`` distinct sites.  Each line hash gets a HyperLogLog
sketch of its sites; sketches of the same line merge in the aggregation.  An estimate clear of the threshold by the
sketch's error decides; lines near it get an exact distinct count.  Every occurrence of a boilerplate line but the first goes.

Before sketches are made, one plain aggregation leaves out lines that occur fewer times than sites are asked for,
or on one site only: none of those can be boilerplate.

A line may be a third of all rows.  Its occurrences are dealt out by a salt from their rows' keys: joins are on (line, salt), with the
other side repeated for every salt, and what follows is summed in each task before it meets by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import row_key, stored, with_own_columns

LG_K = 10
#: Three standard errors of a sketch of 2^LG_K registers.
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)


#: Parts that the occurrences of a line are dealt into.
SALTS = 32


def salted(lines: DataFrame) -> DataFrame:
    """Rows of one line each, repeated for every salt; their number grows with the corpus, so they are never broadcast."""
    return lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def normal(line: Column) -> Column:
    """A line without white space at its ends, in lower case."""
    return F.lower(F.btrim(line, F.lit(" \t\x0b\x0c\r")))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines (line, salt, site) that stand on at least min_sites sites."""
    counted = lines.groupBy("line").agg(F.count("*").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"))
    spread = counted.where((F.col("n") >= min_sites) & ((F.col("low") != F.col("high")) | F.lit(min_sites <= 1)))
    on = ["line", "salt"]
    at = lines.select(*on, "site").join(salted(spread.select("line")), on, "left_semi")
    sketched = stored(at.groupBy("line").agg(F.hll_sketch_agg("site", LG_K).alias("sketch")).select("line", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    near = sketched.where((F.col("sites") >= min_sites * (1 - ERROR)) & (F.col("sites") < min_sites * (1 + ERROR)))
    exact = lines.select(*on, "site").join(salted(near.select("line")), on, "left_semi").select("line", "site").distinct().groupBy("line").agg(F.count("*").alias("sites"))
    sure = sketched.where(F.col("sites") >= min_sites * (1 + ERROR))
    return sure.select("line").union(exact.where(F.col("sites") >= min_sites).select("line"))


def dedup_lines(docs: DataFrame, *, site: str = "source", min_sites: int = 6, min_chars: int = 20) -> DataFrame:
    """docs with every boilerplate line but its first occurrence (by doc_id, nulls last) taken out of ``text``.

    Adds lines_removed long and words_left boolean (false if no line with a visible character is left); columns of
    these names are replaced, all others are kept as they are.  Lines end at \\n; the kept ones are joined by \\n again.

    Lines of fewer than ``min_chars`` characters once normalised are neither counted nor removed.  A null text stays null and has
    no lines; an empty one has none that count.  A null site is one site of its own.  Equal rows are treated alike: if one
    holds a line's first occurrence, all do.  An empty table gives an empty result.
    """
    key = row_key()
    cut = docs.select(key.alias("rkey"), "doc_id", F.xxhash64(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    line = normal(F.col("raw"))
    lines = cut.withColumn("raw", line).where(F.length("raw") >= min_chars).select("rkey", "doc_id", "site", "pos", F.xxhash64("raw").alias("line"), F.pmod("rkey", F.lit(SALTS)).cast("int").alias("salt"))
    lines = stored(lines, "lines")
    common = stored(boilerplate(lines, min_sites), "boilerplate")
    hits = lines.join(salted(common), ["line", "salt"]).select("line", "salt", "rkey", "doc_id", "pos")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "rkey", "pos")
    first = hits.groupBy("line").agg(F.min(place).alias("first"))
    extra = hits.join(salted(first), ["line", "salt"]).where((F.col("rkey") != F.col("first.rkey")) | (F.col("pos") != F.col("first.pos")))
    removed = extra.groupBy("rkey").agg(F.collect_set("pos").alias("_removed_lines")).withColumnRenamed("rkey", "_row_of_lines")

    out = docs.withColumn("_row_of_lines", key).join(removed, "_row_of_lines", "left")
    out = out.withColumn("_line_parts", F.split("text", "\n"))  # a column of its own, split once a row
    kept = F.array_except(F.sequence(F.lit(0), F.size("_line_parts") - 1), F.col("_removed_lines"))
    text = F.when(F.col("_removed_lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_line_parts"), i)), "\n"))
    gone = F.coalesce(F.size("_removed_lines"), F.lit(0))
    out = out.withColumn("lines_removed", F.when(F.col("_removed_lines").isNull(), F.lit(0)).otherwise(gone).cast("long")).withColumn("text", text)
    return out.withColumn("words_left", F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).drop("_row_of_lines", "_removed_lines", "_line_parts")


def deduped(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, with their own columns, without repeated boilerplate; rows of which it leaves no visible character go.  A column n_chars counts the new text."""

    def step(d: DataFrame) -> DataFrame:
        out = dedup_lines(d, **how).where("words_left or lines_removed = 0")
        return out.withColumn("n_chars", F.when(F.col("lines_removed") > 0, F.length("text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in d.columns else out

    return with_own_columns(docs, ["lines_removed", "words_left"], step)
