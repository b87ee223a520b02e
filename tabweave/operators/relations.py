"""Pairwise relations of numeric columns: correlation, covariance, mutual information."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.operators.order import melt
from tabweave.plans.physical import one_row, running_sums


def _gram(width: int, change: Callable[[np.ndarray], np.ndarray] | None = None):
    """Sums of products of the batch's columns: of values (kind 0), of values where the other is present (1), of squares likewise (2),
    and how often both are present (3)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, width, width))
        for b in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in b.columns])
            x = change(x) if change else x
            there = ~np.isnan(x)
            x[~there] = 0.0
            mask = there.astype(np.float64)
            for k, (left, right) in enumerate(((x, x), (x, mask), (x * x, mask), (mask, mask))):
                sums[k] += left.T @ right
        k, i, j = np.indices(sums.shape).reshape(3, -1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(j), pa.array(sums.ravel())], names=["k", "i", "j", "v"])

    return run


def pair_statistics(df: DataFrame, columns: list[str], diagonal: bool = False) -> DataFrame:
    """(a, b, n, r, cov): pairwise-complete Pearson correlation (0 without spread) and sample covariance.

    One scan adds up a matrix of products of the columns, each shifted by its mean, whatever the number of pairs; only sums reach the
    driver.
    """
    d, spark = len(columns), df.sparkSession
    clean = df.select(*[F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")).alias(f"x{j}") for j, c in enumerate(columns)])
    means = clean.agg(*[F.avg(F.when(F.abs(f"x{j}") < F.lit(float("inf")), F.col(f"x{j}"))).alias(f"m{j}") for j in range(d)]).first() if d else []
    shift = [float(m or 0.0) for m in means]
    shifted = clean.select(*[(F.col(f"x{j}") - F.lit(shift[j])).alias(f"x{j}") for j in range(d)])
    return spark.createDataFrame(_from_sums(_products(shifted, None), columns, shift, diagonal), "a string, b string, n bigint, r double, cov double")


def scored_correlation(df: DataFrame, columns: list[str], score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The correlation matrix of score(rows by columns), an array function whose values lie around 0; one scan."""
    d, m = len(columns), np.eye(len(columns))
    for a, b, _, r, _ in _from_sums(scored_products(df, columns, score), list(range(d)), [0.0] * d, False):
        m[a, b] = m[b, a] = r
    return m


def scored_products(df: DataFrame, columns: list[str], score: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sums of products (see _gram()) of score(rows by columns)."""
    return _products(df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(columns)]), score)


def _products(rows: DataFrame, change: Callable[[np.ndarray], np.ndarray] | None) -> np.ndarray:
    d = len(rows.columns)
    s = np.zeros((4, d, d))
    for r in rows.mapInArrow(_gram(d, change), "k int, i int, j int, v double").groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect() if d else []:
        s[r.k, r.i, r.j] = r.v
    return s


def _from_sums(s: np.ndarray, columns: list, shift: list[float], diagonal: bool) -> list[tuple]:
    """(a, b, n, r, cov) out of the sums of products of shifted columns."""
    d, rows = len(columns), []
    for i, j in [*combinations(range(d), 2), *([(i, i) for i in range(d)] if diagonal else [])]:
        n = int(s[3, i, j])
        if n:
            x, y = s[1, i, j], s[1, j, i]
            both, own, other = s[0, i, j] - x * y / n, s[2, i, j] - x * x / n, s[2, j, i] - y * y / n
            # A constant column leaves rounding errors of its shift, no spread.
            flat = min(own / (1e-300 + n * shift[i] ** 2), other / (1e-300 + n * shift[j] ** 2)) < 1e-28 or min(own, other) <= 0
            r = 0.0 if flat or not np.isfinite(both) else float(np.clip(both / np.sqrt(own) / np.sqrt(other), -1, 1))
            rows.append((columns[i], columns[j], n, r, float(both / (n - 1)) if n > 1 else 0.0))
        else:
            rows.append((columns[i], columns[j], 0, 0.0, 0.0))
    return rows


def correlations(df: DataFrame, columns: list[str], high: float = 0.85) -> DataFrame:
    """(a, b, r, is_high) of the pairs with more than two complete rows."""
    t = pair_statistics(df, columns).where(F.col("n") > 2).select("a", "b", F.round("r", 3).alias("r"))
    return t.withColumn("is_high", F.abs("r") > high)


def ordinal_ranks(df: DataFrame, columns: list[str], rid: str) -> DataFrame:
    """(rid, c, x, rank): 1-based ranks, ties by row id, so neither a column nor a value held by many rows is one task."""
    t = running_sums(melt(df, columns, [rid]).withColumn("one", F.lit(1)), ["c"], ["x", rid], ["one"])
    return t.select(rid, "c", "x", F.col("one_upto").alias("rank"))


def spearman(df: DataFrame, columns: list[str], rid: str) -> DataFrame:
    """(a, b, r): correlation of ordinal ranks of rows where all columns are present."""
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns))
    ranks = ordinal_ranks(whole, columns, rid)
    wide = ranks.groupBy(rid).agg(*[F.max(F.when(F.col("c") == c, F.col("rank"))).cast("double").alias(c) for c in columns])
    return pair_statistics(wide, columns).select("a", "b", F.round("r", 6).alias("r"))


def covariance_distance(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """One row: Frobenius distance of the sample covariance matrices, missing values read as 0."""
    zero = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    a, b = (pair_statistics(d.withColumns(zero), columns, diagonal=True) for d in (first, second))
    both = a.select("a", "b", F.col("cov").alias("x")).join(b.select("a", "b", F.col("cov").alias("y")), ["a", "b"])
    return both.agg(F.round(F.sqrt(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2) * F.pow(F.col("x") - F.col("y"), F.lit(2.0)))), 4).alias("frobenius"))


def correlation_fidelity(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """One row: 1 - |R1 - R2| / |R1| in the Frobenius norm, at least 0, and 1 - the mean absolute difference of the pairs."""
    a, b = (pair_statistics(d, columns) for d in (first, second))
    both = a.select("a", "b", F.col("r").alias("x")).join(b.select("a", "b", F.col("r").alias("y")), ["a", "b"])
    d = F.sqrt(2 * F.sum(F.pow(F.col("x") - F.col("y"), F.lit(2.0))))
    norm = F.sqrt(F.lit(float(len(columns))) + 2 * F.sum(F.pow(F.col("x"), F.lit(2.0))))
    return both.agg(F.round(F.greatest(F.lit(0.0), 1 - d / norm), 4).alias("correlation_fidelity"), F.round(F.greatest(F.lit(0.0), 1 - F.avg(F.abs(F.col("x") - F.col("y")))), 4).alias("pairwise_fidelity"))


def binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Each column as text: numbers by equal-width bin, others as they stand."""
    kinds = dict(df.dtypes)
    numbers = [c for c in columns if kinds[c] not in ("string", "boolean")]
    one = df.agg(*[e for c in numbers for e in (F.min(c).alias(f"{c}_a"), F.max(c).alias(f"{c}_b"))]) if numbers else None

    def cut(c: str) -> Column:
        if c not in numbers:
            return F.coalesce(F.col(c).cast("string"), F.lit("null"))
        a, b = one_row(one)[f"{c}_a"].cast("double"), one_row(one)[f"{c}_b"].cast("double")
        return F.least(F.lit(bins - 1), F.floor((F.col(c) - a) / F.when(b > a, b - a).otherwise(1.0) * bins)).cast("string")

    return df.select(*[cut(c).alias(c) for c in columns])


def mutual_information(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """(a, b, mi) of every pair in nats: one aggregation over rows, the rest on joint counts."""
    cut = binned(df, columns, bins)
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(columns, 2)]
    joint = cut.select(F.explode(F.array(*pairs)).alias("e")).groupBy("e.a", "e.b", "e.x", "e.y").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("a", "b")
    t = joint.select("a", "b", "n", F.sum("n").over(w).alias("all"), F.sum("n").over(Window.partitionBy("a", "b", "x")).alias("nx"), F.sum("n").over(Window.partitionBy("a", "b", "y")).alias("ny"))
    return t.groupBy("a", "b").agg(F.round(F.greatest(F.lit(0.0), F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny"))))), 6).alias("mi"))
