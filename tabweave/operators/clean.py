"""Simple cleaning and validation before modelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.missing import CLIENT_TOKENS, text_missing
from tabweave.operators.order import column_quantiles
from tabweave.plans.physical import one_row, running_sums


def blank_to_null(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = CLIENT_TOKENS) -> DataFrame:
    """Missing tokens and NaN as null, in `columns`."""
    kinds, out = dict(df.dtypes), {}
    for c in columns:
        v = F.col(f"`{c}`")
        out[c] = F.when(~F.isnan(v), v) if kinds[c] in ("double", "float") else F.when(~text_missing(v, tokens), v) if kinds[c] == "string" else v
    return df.withColumns(out)


def clean(df: DataFrame, numbers: list[str], labels: list[str], target: str | None = None, tokens: tuple[str, ...] = CLIENT_TOKENS) -> DataFrame:
    """Numbers filled with their median (0 if none), labels with their most frequent value (the least if tied; UNKNOWN if none), rows without a target dropped."""
    fill = [c for c in labels if c != target]
    bare = blank_to_null(df, [*numbers, *fill, *([target] if target else [])], tokens)
    q = column_quantiles(bare, numbers, [0.5]).agg(F.map_from_entries(F.collect_list(F.struct("c", "q0"))).alias("m")) if numbers else None
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("v")) for c in fill]) if fill else None
    out = {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.element_at(one_row(q)["m"], F.lit(c)), F.lit(0.0)) for c in numbers}
    if fill:
        counts = bare.select(F.explode(cells).alias("e")).where(F.col("e.v").isNotNull()).groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("k"), "v"))["v"].alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("c", "v"))).alias("m"))
        out |= {c: F.coalesce(F.col(f"`{c}`"), F.element_at(one_row(best)["m"], F.lit(c)), F.lit("UNKNOWN")) for c in fill}
    kept = bare.where(F.col(f"`{target}`").isNotNull()) if target else bare
    return kept.withColumns(out)


def exclude(df: DataFrame, other: DataFrame, key: str, other_key: str | None = None) -> DataFrame:
    """Rows whose `key` does not occur in `other`; a null key never occurs."""
    return df.join(other.select(F.col(other_key or key).alias(key)), key, "left_anti")


def sort_rows(df: DataFrame, by: list, unique: str) -> DataFrame:
    """Every row with its place (from 1) in the order of `by` (columns or sort expressions), ties by `unique`: ranges of the whole order,
    not one task."""
    return running_sums(df.withColumn("_one", F.lit(1)), [], [*by, unique], ["_one"]).withColumnRenamed("_one_upto", "place").drop("_one", "_one_all")


def clean_log(df: DataFrame, numbers: list[str], labels: list[str], target: str | None = None, tokens: tuple[str, ...] = CLIENT_TOKENS) -> DataFrame:
    """(column_name, action, n): what clean() does: fill_median, fill_mode, drop_target, zero_variance."""
    bare = blank_to_null(df, [*numbers, *labels, *([target] if target else [])], tokens)
    parts = [F.struct(F.lit(c).alias("column_name"), F.lit(a).alias("action"), n.cast("bigint").alias("n")) for c, a, n in [
        *[(c, "fill_median", F.count_if(F.col(f"`{c}`").isNull())) for c in numbers],
        *[(c, "fill_mode", F.count_if(F.col(f"`{c}`").isNull())) for c in labels if c != target],
        *([(target, "drop_target", F.count_if(F.col(f"`{target}`").isNull()))] if target else []),
        *[(c, "zero_variance", (F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True))).cast("int")) for c in numbers],
    ]]
    return bare.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("e")).select("e.*").where(F.col("n") > 0)


def validate(df: DataFrame, target: str, numbers: list[str], labels: list[str], tokens: tuple[str, ...] = CLIENT_TOKENS) -> DataFrame:
    """(severity, code, detail): what stands in the way of modelling; empty if nothing does."""
    columns = [*numbers, *labels]
    bare = blank_to_null(df, [*columns, target], tokens)
    classes = bare.where(F.col(f"`{target}`").isNotNull()).groupBy(F.col(f"`{target}`").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    c = one_row(classes.agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") < 3).alias("tiny")))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, x in enumerate(columns):
        aggs.append(F.count(f"`{x}`").alias(f"n{i}"))
        if x in numbers:
            aggs.append(F.coalesce(F.stddev_samp(f"`{x}`"), F.lit(0.0)).alias(f"s{i}"))
        else:
            aggs.append(F.count_distinct(f"`{x}`").alias(f"d{i}"))
    one = bare.agg(*aggs).withColumn("k", c["k"]).withColumn("tiny", c["tiny"])
    rows, c = F.col("rows"), {"k": F.col("k"), "tiny": F.col("tiny")}
    issues = [
        (rows < 10, "error", "too_few_rows", rows),
        (c["k"] < 2, "error", "too_few_classes", c["k"]),
        ((c["k"] >= 2) & (c["tiny"] > 0), "warning", "tiny_classes", c["tiny"]),
        (F.lit(not numbers), "error", "no_numeric_feature", F.lit(0)),
    ]
    for i, x in enumerate(columns):
        issues.append((F.col(f"n{i}") == 0, "warning", "all_missing", F.lit(x)))
        issues.append((F.col(f"s{i}") == 0, "warning", "zero_variance", F.lit(x)) if x in numbers else (F.col(f"d{i}") > 50, "warning", "many_categories", F.lit(x)))
    present = sum((F.col(f"n{i}") for i in range(1, len(columns))), F.col("n0")) if columns else rows
    issues.append((1 - present / (rows * len(columns)) > 0.3, "warning", "many_missing", F.round(100 * (1 - present / (rows * len(columns))), 1)))
    found = F.filter(F.array(*[F.when(w, F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"), d.cast("string").alias("detail"))) for w, s, k, d in issues]), lambda e: e.isNotNull())
    return one.select(F.explode(found).alias("e")).select("e.*")


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    keep = F.lit(False)
    for c in columns:
        keep = keep | (F.btrim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) != "")
    return df.where(keep)
