"""Column profiles, types, class balance, outliers and the need for augmentation."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.missing import CLIENT_TOKENS, SERVICE_TOKENS, text_missing
from tabweave.functions.scalars import clean_number, parse_datetime, strict_number, trim
from tabweave.operators.order import column_quantiles, melt
from tabweave.plans.physical import one_row

# Names that mark a column as an identifier.
ID_NAMES = "id _id uuid guid pk ssn email index key identifier client_id customer_id user_id order_id patient_id".split()


def skewness(n: Column, g: Column) -> Column:
    """Adjusted skewness from the population one; 0 under three values or without spread."""
    return F.when((n < 3) | g.isNull() | F.isnan(g), F.lit(0.0)).otherwise(F.sqrt(n * (n - 1.0)) / (n - 2) * g)


def kurtosis(n: Column, g: Column) -> Column:
    """Sample excess kurtosis from the population one; 0 under four values or without spread."""
    return F.when((n < 4) | g.isNull() | F.isnan(g), F.lit(0.0)).otherwise((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g + 6))


def moments(long: DataFrame) -> DataFrame:
    """(c, n, min, max, mean, std, skew, kurt) of each column of a long table; std is 0 for one value."""
    x = F.col("x")
    m = long.groupBy("c").agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    flat = F.col("max") == F.col("min")
    return m.select("c", "n", "min", "max", "mean", F.when(flat, 0.0).otherwise(F.col("std")).alias("std"), F.when(flat, 0.0).otherwise(skewness(F.col("n"), F.col("g1"))).alias("skew"), F.when(flat, 0.0).otherwise(kurtosis(F.col("n"), F.col("g2"))).alias("kurt"))


def numeric_profile(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """One row a column: present values, range, mean, deviation, skewness; missing values are left out."""
    r = lambda c: F.round(c, digits).alias(c)
    return moments(melt(df, columns)).select(F.col("c").alias("column_name"), "n", *[r(c) for c in ("min", "max", "mean", "std", "skew")])


def five_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact quartiles, median and interquartile distance of each column."""
    q = column_quantiles(df, columns, [0.25, 0.5, 0.75])
    return q.select(F.col("c").alias("column_name"), "n", F.round("q0", 6).alias("q1"), F.round("q1", 6).alias("median"), F.round("q2", 6).alias("q3"), F.round(F.col("q2") - F.col("q0"), 6).alias("iqr"))


def outliers(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> DataFrame:
    """(c, n, lower, upper, count): values beyond the quartiles by more than `multiplier` times their distance."""
    fences = [(r.c, r.n, r.q0 - (r.q1 - r.q0) * multiplier, r.q1 + (r.q1 - r.q0) * multiplier) for r in column_quantiles(df, columns, [0.25, 0.75]).collect()]
    x = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    far = df.agg(*[F.count_if((x(c) < F.lit(a)) | (x(c) > F.lit(b))).alias(f"k{i}") for i, (c, _, a, b) in enumerate(fences)]).first() if fences else []
    return df.sparkSession.createDataFrame([(*f, k) for f, k in zip(fences, far)], "c string, n bigint, lower double, upper double, count bigint")


def class_counts(df: DataFrame, target: str, unknown: str = "UNKNOWN") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(target).cast("string"), F.lit(unknown)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def class_balance(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """(value, n, pct): the `most` most frequent values (ties by value) and the rest as __other__; missing values are left out."""
    counts = df.where(~text_missing(F.col(column).cast("string"), SERVICE_TOKENS)).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(most)
    total = counts.agg(F.sum("n").alias("total"))
    all_, kept = one_row(total)["total"], F.coalesce(one_row(top.agg(F.sum("n").alias("kept")))["kept"], F.lit(0))
    rest = total.select(F.lit("__other__").alias("value"), (F.col("total") - kept).alias("n")).where(F.col("n") > 0)
    return top.unionByName(rest).select("value", "n", F.round(100.0 * F.col("n") / all_, 2).alias("pct"))


def imbalance(df: DataFrame, target: str) -> DataFrame:
    """One row: classes, smallest and largest class (the last by name if tied), ratio and severity."""
    c = class_counts(df, target)
    one = c.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.max(F.struct((-F.col("n")).alias("k"), "label"))["label"].alias("min_class"), F.max(F.struct("n", "label"))["label"].alias("max_class"))
    ratio = F.when(F.col("classes") > 1, F.round(F.col("max_n") / F.col("min_n"), 2)).otherwise(F.lit(1.0))
    one = one.withColumn("ratio", ratio)
    return one.withColumn("severity", F.when(F.col("ratio") > 10, "severe").when(F.col("ratio") >= 3, "moderate").when(F.col("ratio") >= 1.5, "mild").otherwise("none"))


def infer_types(df: DataFrame, columns: list[str], profile: str = "service") -> DataFrame:
    """(column_name, data_type) of text columns. service: at least 95 % numbers, else at least 95 % moments, else categorical.
    client: over 80 % numbers; two boolean-like values, or few distinct values, categorical; else text."""
    client = profile == "client"
    tokens = CLIENT_TOKENS if client else SERVICE_TOKENS
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.when(~text_missing(F.col(f"`{c}`").cast("string"), tokens), trim(F.col(f"`{c}`").cast("string"))).alias("v")) for c in columns])
    each = df.select(F.explode(cells).alias("e")).select("e.c", "e.v").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("v")
    number = (clean_number(v) if client else strict_number(v)).isNotNull()
    moment = F.lit(False) if client else (~number & parse_datetime(v).isNotNull())
    boolean = F.lower(v).isin("true", "false", "yes", "no", "0", "1", "t", "f", "y", "n")
    low = each.withColumn("low", F.lower(v)).withColumn("number", number).withColumn("moment", moment).groupBy("c", "low").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("number"), F.col("n"))).alias("numbers"), F.sum(F.when(F.col("moment"), F.col("n"))).alias("moments"), F.min(boolean).alias("boolean"))
    there = F.col("low").isNotNull()
    s = low.groupBy("c").agg(
        F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("n"), F.count_if(there).alias("distinct"), F.coalesce(F.sum("numbers"), F.lit(0)).alias("numbers"),
        F.coalesce(F.sum("moments"), F.lit(0)).alias("moments"), F.min(F.when(there, F.col("boolean"))).alias("boolean"))
    n, d = F.col("n"), F.col("distinct")
    if client:
        kind = F.when(n == 0, "text").when(F.col("numbers") / n > 0.8, "numeric").when((d <= 2) & F.col("boolean"), "categorical").when((d / n < 0.5) | (d <= 30), "categorical").otherwise("text")
    else:
        kind = F.when(n == 0, "categorical").when(F.col("numbers") / n >= 0.95, "numeric").when(F.col("moments") / n >= 0.95, "datetime").otherwise("categorical")
    return s.select(F.col("c").alias("column_name"), kind.alias("data_type"))


def missing_report(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = CLIENT_TOKENS) -> DataFrame:
    """(column_name, missing, missing_pct, distinct): NaN and missing tokens count as missing; distinct is exact."""
    kinds = dict(df.dtypes)
    cells = []
    for c in columns:
        v = F.col(f"`{c}`")
        gone = F.isnan(v) if kinds[c] in ("double", "float") else F.lit(False)
        cells.append(F.struct(F.lit(c).alias("c"), F.when(~(text_missing(v.cast("string"), tokens) | F.coalesce(gone, F.lit(False))), v.cast("string")).alias("v")))
    each = df.select(F.explode(F.array(*cells)).alias("e")).groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n"))
    s = each.groupBy("c").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("v").alias("distinct"))
    return s.select(F.col("c").alias("column_name"), "missing", F.round(100.0 * F.col("missing") / F.col("rows"), 1).alias("missing_pct"), "distinct")


def id_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, is_id): by name, by nearly all distinct text, or by a gapless run of whole numbers."""
    kinds = dict(df.dtypes)
    number = {c for c in columns if kinds[c] in ("int", "bigint", "double", "float", "smallint", "tinyint")}
    cells = [F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v"), (F.col(f"`{c}`").cast("double") if c in number else F.lit(None).cast("double")).alias("x")) for c in columns]
    each = df.select(F.explode(F.array(*cells)).alias("e")).select("e.*").where(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"))
    s = each.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.col("x") == F.floor("x")).alias("whole"))
    ratio = F.col("d") / F.col("n")
    named = F.lower(trim(F.col("c"))).isin(*ID_NAMES)
    dense = F.coalesce(F.col("whole"), F.lit(False)) & (F.col("n") >= 20) & (ratio > 0.98) & (F.col("hi") - F.col("lo") == F.col("n") - 1)
    text = ~F.col("c").isin(*number) & (F.col("n") >= 20) & (ratio > 0.95) if number else (F.col("n") >= 20) & (ratio > 0.95)
    return s.select(F.col("c").alias("column_name"), (named | dense | text).alias("is_id"))


def is_id_name(name: str) -> bool:
    return re.fullmatch("|".join(ID_NAMES), name.strip().lower()) is not None


def histogram(long: DataFrame, ranges: DataFrame, bins: int, by: list[str] | None = None) -> DataFrame:
    """(by, c, bin, n) with empty bins. ranges: c, min, max."""
    by = by or []
    width = (F.col("max") - F.col("min")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("min")) / width)).cast("int")).otherwise(F.lit(0))
    counts = long.join(F.broadcast(ranges), "c").select(*by, "c", place.alias("bin")).groupBy(*by, "c", "bin").agg(F.count(F.lit(1)).alias("n"))
    frame = counts.select(*by, "c").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return frame.join(counts, [*by, "c", "bin"], "left").select(*by, "c", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def distribution_labels(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, distribution): unknown, uniform, normal, skewed or bimodal, from moments and the dips of ten bins."""
    long = melt(df, columns)
    m = moments(long)
    h = histogram(long, m.select("c", "min", "max"), 10)
    w = Window.partitionBy("c").orderBy("bin")
    dips = h.select("c", ((F.col("n") < F.lag("n").over(w)) & (F.col("n") < F.lead("n").over(w))).alias("dip")).groupBy("c").agg(F.count_if("dip").alias("dips"))
    r = F.col("max") - F.col("min")
    even = r / F.sqrt(F.lit(12.0))
    sk, kt = F.abs("skew"), F.col("kurt")
    label = (
        F.when((F.col("n") < 10) | (r == 0), "unknown")
        .when((sk < 0.5) & (F.abs(kt) < 0.5), F.when(F.abs(F.col("std") - even) / even < 0.3, "uniform").otherwise("normal"))
        .when(sk > 1.0, "skewed")
        .when((F.col("dips") >= 1) & (kt < -0.5), "bimodal")
        .otherwise("normal"))
    return m.join(dips, "c").select(F.col("c").alias("column_name"), label.alias("distribution"))


def feature_analysis(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a numeric column: distribution, outliers, noise estimate, missing share and whether it is an identifier."""
    m = moments(melt(df, columns))
    r = F.col("max") - F.col("min")
    noise = F.when(r > 0, F.round(F.least(F.lit(1.0), 1.5 * F.col("std") / r), 2)).otherwise(F.lit(0.0))
    base = m.select(F.col("c").alias("column_name"), "n", noise.alias("noise"))
    o = outliers(df, columns).select(F.col("c").alias("column_name"), F.col("count").alias("outliers"))
    t = base.join(o, "column_name").join(distribution_labels(df, columns), "column_name").join(missing_report(df, columns), "column_name").join(id_columns(df, columns), "column_name")
    return t.select("column_name", "is_id", "distribution", "outliers", F.round(100.0 * F.col("outliers") / F.greatest(F.col("n"), F.lit(1)), 1).alias("outlier_pct"), "noise", "missing", "missing_pct")


def need_score(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """One row: score 0..100 of the need for augmentation, its parts, and health = 100 - score."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    odd = feature_analysis(df, columns).agg(F.max(F.coalesce((F.col("outlier_pct") > 5) & ~F.col("is_id"), F.lit(False))).alias("odd"))
    t = imbalance(df, target).withColumn("rows", one_row(rows)["rows"]).withColumn("odd", one_row(odd)["odd"])
    a = F.when(F.col("severity") == "severe", 50).when(F.col("severity") == "moderate", 35).when(F.col("severity") == "mild", 15).otherwise(0)
    b = F.when(F.col("rows") < 150, 25).when(F.col("rows") < 500, 15).otherwise(5)
    c = F.when(F.coalesce("odd", F.lit(False)), 10).otherwise(0)
    score = F.least(F.lit(100), a + b + c)
    return t.select("ratio", "severity", "min_class", "max_class", "rows", a.alias("imbalance_part"), b.alias("size_part"), c.alias("outlier_part"), score.alias("need_score"), (100 - score).alias("health_score"))


def top_categories(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """(column_name, rank, value, n): the k most frequent values of each column, ties by value."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in columns])
    counts = df.select(F.explode(cells).alias("e")).groupBy("e.c", "e.v").agg(F.count(F.lit(1)).alias("n")).where(F.col("v").isNotNull())
    w = Window.partitionBy("c").orderBy(F.desc("n"), "v")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("c").alias("column_name"), "rank", F.col("v").alias("value"), "n")


def normalize(df: DataFrame, columns: list[str], how: str = "minmax") -> DataFrame:
    """`columns` scaled to 0..1 (minmax) or to mean 0 and deviation 1 (zscore); a constant column becomes 0."""
    aggs = [e for c in columns for e in ((F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b")) if how == "minmax" else (F.avg(c).alias(f"{c}_a"), F.stddev_samp(c).alias(f"{c}_b")))]
    one, scaled = df.agg(*aggs), {}
    for c in columns:
        a, b = one_row(one)[f"{c}_a"], one_row(one)[f"{c}_b"]
        scaled[c] = F.coalesce((F.col(c) - a) / F.nullif(b - a if how == "minmax" else b, F.lit(0.0)), F.lit(0.0))
    return df.withColumns(scaled)


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column for each category; a value not among them gives zeros in all."""
    return df.withColumns({f"{column}_{k}": F.coalesce((F.col(column) == k).cast("int"), F.lit(0)) for k in categories})


def dataset_profile(df: DataFrame, kinds: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(column_name, data_type, null_count, missing_pct, unique_count, min, max, mean, std, skewness) of every column of a table, and one
    row of it as a whole: rows, columns, columns of each type, cells, missing ones. `kinds` gives types (numeric, datetime,
    categorical) where the column's own type does not: numbers are numeric, dates and timestamps datetime, all else categorical.
    Datetimes have their range as milliseconds since 1970 in UTC."""
    own = {c: "numeric" if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") else "datetime" if t in ("date", "timestamp", "timestamp_ntz") else "categorical" for c, t in df.dtypes}
    own |= kinds or {}
    numbers, moments_ = [c for c in own if own[c] == "numeric"], [c for c in own if own[c] == "datetime"]
    m = missing_report(df, list(own), SERVICE_TOKENS)
    at = df.select(*[F.unix_millis(F.col(f"`{c}`").cast("timestamp")).cast("double").alias(c) for c in moments_])
    stats = moments(melt(df, numbers)).select("c", "min", "max", "mean", "std", "skew") if numbers else None
    ends = melt(at, moments_).groupBy("c").agg(F.min("x").alias("min"), F.max("x").alias("max"), *[F.lit(None).cast("double").alias(k) for k in ("mean", "std", "skew")]) if moments_ else None
    both = reduce(DataFrame.unionByName, [t for t in (stats, ends) if t is not None]) if numbers or moments_ else None
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in own.items() for v in pair]), F.col("column_name"))
    rows = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    t = m.join(both.withColumnRenamed("c", "column_name"), "column_name", "left") if both is not None else m.select("*", *[F.lit(None).cast("double").alias(k) for k in ("min", "max", "mean", "std", "skew")])
    share = F.coalesce(F.round(100.0 * F.col("missing") / F.nullif(rows, F.lit(0)), 2), F.lit(0.0))
    columns = t.select("column_name", kind.alias("data_type"), F.col("missing").alias("null_count"), share.alias("missing_pct"), F.col("distinct").alias("unique_count"), "min", "max", "mean", "std", F.col("skew").alias("skewness"))
    cells = rows * F.lit(len(own))
    whole = m.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing")).select(
        rows.alias("rows"), F.lit(len(own)).alias("columns"), *[F.lit(sum(v == k for v in own.values())).alias(f"{k}_columns") for k in ("numeric", "categorical", "datetime")], cells.alias("cells"), "missing",
        F.coalesce(F.round(100.0 * F.col("missing") / F.nullif(cells, F.lit(0)), 2), F.lit(0.0)).alias("missing_pct"))
    return columns, whole


def retarget(df: DataFrame, target: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """class_counts() and need_score() of a table under another target."""
    return class_counts(df, target), need_score(df, target, [c for c in columns if c != target])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


