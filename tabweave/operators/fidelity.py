"""How like two tables are: distances of distributions, correlation structure and closeness of single rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.operators.neighbours import nearest_rows
from tabweave.operators.order import GATHERED, Cells, melt, order_statistics
from tabweave.operators.relations import correlation_fidelity, covariance_distance
from tabweave.plans.physical import one_row, running_sums


def two_cells(first: DataFrame, second: DataFrame, columns: list[str]) -> Cells:
    """The counted cells of both tables, for ks() and wasserstein() to share."""
    return Cells.of_two(first, second, columns)


def ks(first: DataFrame, second: DataFrame, columns: list[str], ties: str = "reference", cells: Cells | None = None) -> DataFrame:
    """(c, n1, n2, d): two-sample Kolmogorov-Smirnov statistic. ties `exact` compares the distributions at each value; `reference`
    also counts the point inside a tie where the shorter run of equal values ends.

    The distance at the end of a cell is exact and one inside a cell is bounded by the counts at both of its ends, so only cells
    whose bound exceeds the best end are read again.
    """
    cells = cells or two_cells(first, second, columns)
    best: dict[str, float] = {}
    open_: dict[int, list[int]] = {}
    size = {c: (cells.total(c, "a"), cells.total(c, "b")) for c in cells.names}

    def at(i, j, a, b, n1, n2):
        end = np.abs((i + a) / n1 - (j + b) / n2)
        m = np.minimum(a, b)
        return end if ties == "exact" else np.maximum(end, np.abs((i + m) / n1 - (j + m) / n2))

    for c, (n1, n2) in size.items():
        if not (n1 and n2):
            continue
        p = cells.place[c]
        a, b = cells.n["a"][p], cells.n["b"][p]
        i, j = np.cumsum(a) - a, np.cumsum(b) - b
        one = np.array([cells.settled(p, k) for k in range(len(a))])
        known = np.where(one, at(i, j, a, b, n1, n2), np.abs((i + a) / n1 - (j + b) / n2))
        best[c] = float(known.max())
        bound = np.maximum((i + a) / n1 - j / n2, (j + b) / n2 - i / n1)
        todo = np.flatnonzero(~one & (bound > best[c]))
        if len(todo):
            open_[p] = todo.tolist()
    if open_:
        every = [(p, k) for p, own in open_.items() for k in own]
        offsets = [(o, cells.names[p], int(cells.n["a"][p][:k].sum()), int(cells.n["b"][p][:k].sum())) for o, (p, k) in enumerate(every)]
        values = cells.values(open_)
        if sum(int(cells.n[w][p][k]) for p, k in every for w in "ab") <= GATHERED:
            table = values.toPandas().sort_values(["o", "x"])
            for o, part in table.groupby("o"):
                _, c, i, j = offsets[int(o)]
                a, b = part["a"].to_numpy(), part["b"].to_numpy()
                best[c] = max(best[c], float(at(i + np.cumsum(a) - a, j + np.cumsum(b) - b, a, b, *size[c]).max()))
        else:
            run = running_sums(values, ["o"], ["x"], ["a", "b"]).join(F.broadcast(cells.spark.createDataFrame([(*x, *size[x[1]]) for x in offsets], "o bigint, c string, i0 bigint, j0 bigint, n1 bigint, n2 bigint")), "o")
            i, j, a, b, n1, n2 = F.col("i0") + F.col("a_upto") - F.col("a"), F.col("j0") + F.col("b_upto") - F.col("b"), *(F.col(k) for k in ("a", "b", "n1", "n2"))
            m, end = F.least(a, b), F.abs((i + a) / n1 - (j + b) / n2)
            d = end if ties == "exact" else F.greatest(end, F.abs((i + m) / n1 - (j + m) / n2))
            for r in run.groupBy("c").agg(F.max(d).alias("d")).collect():
                best[r.c] = max(best[r.c], r.d)
    return cells.spark.createDataFrame([(c, *size[c], d) for c, d in best.items()], "c string, n1 bigint, n2 bigint, d double")


# The distances from which a column's drift is called severe or moderate.
def severity(d: Column) -> Column:
    return F.when(d >= 0.35, "severe").when(d >= 0.18, "moderate").otherwise("safe")


def ks_p(d: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic p value, 20 terms; 1 where the argument is at most 0.05."""
    en = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (en + 0.12 + 0.11 / en) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam))
    p = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(lam <= 0.05, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def wasserstein(first: DataFrame, second: DataFrame, columns: list[str], profile: str = "client", cells: Cells | None = None) -> DataFrame:
    """(c, w1): mean distance of 100 quantiles, taken at floor(q / 101 n) (client) or floor(q / 100 n) (service), q = 1..100."""
    over = 101.0 if profile == "client" else 100.0
    cells = cells or two_cells(first, second, columns)
    both = [c for c in cells.names if cells.total(c, "a") and cells.total(c, "b")]
    at = lambda n: [min(int(np.floor(q / over * n)), n - 1) for q in range(1, 101)]
    found = cells.pick({(c, k): at(cells.total(c, k)) for c in both for k in "ab"})
    return cells.spark.createDataFrame([(c, float(np.mean(np.abs(np.subtract(found[c, "a"], found[c, "b"]))))) for c in both], "c string, w1 double")


def total_variation(first: DataFrame, second: DataFrame, columns: list[str]) -> DataFrame:
    """(c, tvd): half the sum of differences of shares; a null is a category of its own."""
    def shares(d: DataFrame, name: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in columns])
        return d.select(F.explode(cells).alias("e")).groupBy("e.c", "e.v").agg((F.count(F.lit(1)) / one_row(d.agg(F.count(F.lit(1)).alias("n")))["n"]).alias(name))
    both = shares(first, "p").join(shares(second, "q"), ["c", "v"], "full")
    return both.groupBy("c").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tvd"))


def category_shares(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """(category, real, synthetic) at four digits, over the categories of either table."""
    def shares(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("category")).agg(F.round(F.count(F.lit(1)) / one_row(d.agg(F.count(F.lit(1)).alias("n")))["n"], 4).alias(name))
    return shares(first, "real").join(shares(second, "synthetic"), "category", "full").select("category", F.coalesce("real", F.lit(0.0)).alias("real"), F.coalesce("synthetic", F.lit(0.0)).alias("synthetic"))


def feature_audit(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """One row a numeric column: KS, fidelity, Wasserstein distance by range, means, deviations, severity."""
    side = lambda d, s: melt(d, columns).groupBy("c").agg(F.avg("x").alias(f"{s}_mean"), F.coalesce(F.stddev_samp("x"), F.lit(1.0)).alias(f"{s}_std"), F.min("x").alias(f"{s}_min"), F.max("x").alias(f"{s}_max"))
    cells = two_cells(real, synth, columns)
    t = ks(real, synth, columns, cells=cells).join(wasserstein(real, synth, columns, cells=cells), "c").join(side(real, "r"), "c").join(side(synth, "s"), "c")
    width = F.when(F.col("r_max") > F.col("r_min"), F.col("r_max") - F.col("r_min")).otherwise(1.0)
    return t.select(
        F.col("c").alias("column_name"), F.round("d", 4).alias("ks"), F.round(F.greatest(F.lit(0.0), 1 - F.round("d", 4)), 4).alias("ks_fidelity"), F.round("w1", 4).alias("w1"), F.round(F.col("w1") / width, 4).alias("w1_by_range"),
        F.round("r_mean", 2).alias("real_mean"), F.round("s_mean", 2).alias("synth_mean"), F.round("r_std", 2).alias("real_std"), F.round("s_std", 2).alias("synth_std"),
        F.when(F.col("r_mean") != 0, F.round(100 * F.abs(F.col("s_mean") - F.col("r_mean")) / F.abs("r_mean"), 1)).otherwise(0.0).alias("mean_diff_pct"), severity(F.round("d", 4)).alias("severity"))


def closest_records(real: DataFrame, synth: DataFrame, rid: str, sid: str, numbers: list[str], labels: list[str], profile: str = "client") -> DataFrame:
    """(sid, dcr): distance of each synthetic row to the closest real one. client: by range, labels count 1, root of the mean over
    dimensions; service: by deviation, missing read as 0, root of the sum, labels ignored."""
    if profile == "service":
        zero = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in numbers}
        spread = real.agg(*[F.stddev_samp(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in numbers]).first()
        scale = [spread[c] or 1.0 for c in numbers]
        found = nearest_rows(synth.withColumns(zero), real.withColumns(zero), sid, rid, numbers, [], scale, 1, by_dims=False)
    else:
        ends = real.agg(*[e for c in numbers for e in (F.min(c).cast("double").alias(f"{c}_a"), F.max(c).cast("double").alias(f"{c}_b"))]).first()
        scale = [((ends[f"{c}_b"] or 0.0) - (ends[f"{c}_a"] or 0.0)) or 1.0 for c in numbers]
        found = nearest_rows(synth, real, sid, rid, numbers, labels, scale, 1, by_dims=True)
    return found.select(F.col("qid").alias(sid), F.col("dist").alias("dcr"))


def privacy(dcr: DataFrame, profile: str = "client") -> DataFrame:
    """One row out of the distances. client: median (the upper of two), least, share under 0.03, score; service: mean and share of rows that are no exact copy."""
    if profile == "service":
        return dcr.agg(F.round(F.avg("dcr"), 4).alias("dcr_score"), F.round(100.0 * F.count_if(F.col("dcr") >= 1e-4) / F.count(F.lit(1)), 1).alias("zero_memorization_rate"))
    long = dcr.select(F.lit("dcr").alias("c"), F.col("dcr").alias("x"))
    middle = order_statistics(long, {"n": F.lit(1)}, {"n": F.array(F.floor(F.col("n_all") / 2))}).select(F.round("n", 4).alias("m"))
    one = dcr.agg(F.round(F.min("dcr"), 4).alias("min_dcr"), F.round(100.0 * F.count_if(F.col("dcr") < 0.03) / F.count(F.lit(1)), 1).alias("risk_pct"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(100 - 2 * F.col("risk_pct") + 0.5)))
    return one.select(one_row(middle)["m"].alias("median_dcr"), "min_dcr", "risk_pct", score.cast("int").alias("privacy_score"))


def audit(real: DataFrame, synth: DataFrame, numbers: list[str], labels: list[str]) -> DataFrame:
    """One row: numeric, categorical and correlation fidelity and the overall score (0.4, 0.3, 0.3)."""
    n = ks(real, synth, numbers).agg(F.avg(F.greatest(F.lit(0.0), 1 - F.round("d", 4))).alias("v")) if numbers else None
    c = total_variation(real, synth, labels).agg(F.avg(F.round(F.greatest(F.lit(0.0), 1 - F.col("tvd")), 4)).alias("v")) if labels else None
    r = correlation_fidelity(real, synth, numbers) if len(numbers) > 1 else None
    value = lambda d, k: F.coalesce(one_row(d)[k], F.lit(1.0)) if d is not None else F.lit(1.0)
    t = real.sparkSession.range(1).select(value(n, "v").alias("a"), value(c, "v").alias("b"), value(r, "correlation_fidelity").alias("c"))
    return t.select(F.floor((0.4 * F.col("a") + 0.3 * F.col("b") + 0.3 * F.col("c")) * 100 + 0.5).cast("int").alias("overall_score"), F.round("a", 4).alias("numeric_fidelity"), F.round("b", 4).alias("categorical_fidelity"), F.col("c").alias("correlation_fidelity"))


def audit_service(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean p value, share of columns with p >= 0.05, mean Wasserstein distance, covariance distance."""
    cells = two_cells(real, synth, columns)
    t = ks(real, synth, columns, cells=cells).withColumn("p", F.round(ks_p(F.col("d"), F.col("n1"), F.col("n2")), 4)).agg(F.round(F.avg("p"), 4).alias("ks_p_mean"), F.round(F.avg((F.col("p") >= 0.05).cast("int")), 2).alias("ks_passed"))
    w = wasserstein(real, synth, columns, "service", cells).agg(F.round(F.avg(F.round("w1", 4)), 4).alias("w"))
    return t.select("ks_p_mean", "ks_passed", one_row(w)["w"].alias("wasserstein_mean"), one_row(covariance_distance(real, synth, columns))["frobenius"].alias("covariance_frobenius"))


def top_drift(real: DataFrame, synth: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the column with the largest KS statistic (at four digits), and that."""
    k = ks(real, synth, columns).withColumn("k", F.round("d", 4))
    return k.agg(F.max_by("c", "k").alias("feature"), F.max("k").alias("ks"))


def audit_service_whole(real: DataFrame, synth: DataFrame, rid: str, sid: str, columns: list[str]) -> DataFrame:
    """audit_service() with the closeness of single rows (mean distance to the closest record, share of rows that are no copy) and the
    number of columns."""
    p = privacy(closest_records(real, synth, rid, sid, columns, [], "service"), "service")
    return audit_service(real, synth, columns).select("*", *[one_row(p)[k].alias(k) for k in ("dcr_score", "zero_memorization_rate")], F.lit(len(columns)).alias("columns"))


def drift(real: DataFrame, augmented: DataFrame, columns: list[str]) -> DataFrame:
    return feature_audit(real, augmented, columns).select("column_name", "real_mean", "synth_mean", "real_std", "synth_std", "ks", "severity", "w1")
