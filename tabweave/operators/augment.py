"""Balancing classes with new rows: SMOTE, ADASYN, oversampling, noise; all draws by the counter generator."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rng import gaussian, uniform
from tabweave.operators.fidelity import closest_records, ks
from tabweave.operators.neighbours import all_tomek_links, nearest_in_cells, nearest_rows
from tabweave.operators.relations import correlation_fidelity
from tabweave.plans.physical import free_name, materialize, one_row, running_sums


def class_needs(df: DataFrame, label: str, ratio: float = 1.0, least: int = 1) -> DataFrame:
    """(cls, n_c, need): new rows that lift each class by `ratio` of its distance to the largest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("cls")).agg(F.count(F.lit(1)).alias("n_c"))
    top = one_row(counts.agg(F.max("n_c").alias("m")))["m"]
    return counts.withColumn("need", F.floor((top - F.col("n_c")) * ratio + 0.5)).where((F.col("need") > 0) & (F.col("n_c") >= least))


def ranked(df: DataFrame, label: str, rid: str) -> DataFrame:
    """(cls, rank0, rid): the rows of each class numbered from 0 in the order of their id, which keeps its type: hashed ids beyond 2^53
    are told apart."""
    rows = df.where(F.col(label).isNotNull() & F.col(rid).isNotNull()).select(F.col(label).cast("string").alias("cls"), F.col(rid).alias("rid")).distinct()
    return running_sums(rows.withColumn("one", F.lit(1)), ["cls"], ["rid"], ["one"]).select("cls", (F.col("one_upto") - 1).alias("rank0"), "rid")


def column_ranges(df: DataFrame, numbers: list[str]) -> list[float]:
    r = df.agg(*[(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double"))).alias(c) for c in numbers]).first()
    return [r[c] or 1.0 for c in numbers]


def _blend(picks: DataFrame, df: DataFrame, rid: str, numbers: list[str], labels: list[str], seed: int) -> DataFrame:
    """Rows between an anchor and a neighbour. picks: key, cls, rid, nid; the key names the new row to the generator."""
    a = df.select(F.col(rid).alias("rid"), *[F.col(c).alias(f"a_{c}") for c in [*numbers, *labels]])
    b = df.select(F.col(rid).alias("nid"), *[F.col(c).alias(f"b_{c}") for c in [*numbers, *labels]])
    alpha = uniform(seed, F.col("key"), 2)
    t = picks.join(a, "rid").join(b, "nid")
    nums = [F.round(F.col(f"a_{c}") + alpha * (F.col(f"b_{c}") - F.col(f"a_{c}")), 4).alias(c) for c in numbers]
    return t.select("key", "cls", *nums, *[F.when(uniform(seed, F.col("key"), f"n{j}") > 0.5, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c) for j, c in enumerate(labels)])


def smote(df: DataFrame, label: str, rid: str, numbers: list[str], labels: list[str] | None = None, k: int = 5, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """(key, cls, numbers, labels): new rows of the smaller classes, each between a random row and one of its k nearest of the class.
    Neighbours are searched only for rows that were drawn."""
    labels = labels or []
    need = class_needs(df, label, ratio, 2)
    draws = need.select("cls", "n_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need"))).alias("s")).withColumn("key", F.concat_ws("#", "cls", "s"))
    anchors = draws.withColumn("rank0", F.floor(uniform(seed, F.col("key"), 0) * F.col("n_c"))).join(ranked(df, label, rid), ["cls", "rank0"])
    asked = df.join(anchors.select(F.col("rid").alias(rid)).distinct(), rid, "left_semi")
    scale = column_ranges(df, numbers)
    if labels:
        near = nearest_rows(asked, df, rid, rid, numbers, labels, scale, k, group=label, exclude_self=True)
    else:
        v, vector = free_name(df, "_v"), F.array(*[F.col(c).cast("double") / F.lit(s) for c, s in zip(numbers, scale)])
        near = nearest_in_cells(asked.withColumn(v, vector), df.withColumn(v, vector), rid, rid, v, k, label)
    place = F.floor(uniform(seed, F.col("key"), 1) * F.least(F.lit(k), F.col("n_c") - 1)) + 1
    picks = anchors.withColumn("rank", place).join(near.select(F.col("qid").alias("rid"), F.col("rid").alias("nid"), "rank"), ["rid", "rank"])
    return _blend(picks.select("key", "cls", "rid", "nid"), df, rid, numbers, labels, seed)


def adasyn_weights(queries: DataFrame, df: DataFrame, label: str, rid: str, numbers: list[str], labels: list[str], k: int = 5, vector: str | None = None) -> DataFrame:
    """(rid, cls, r): the share of other classes among the k nearest of all rows."""
    scale = [] if vector else column_ranges(df, numbers)
    near = nearest_rows(queries, df, rid, rid, numbers, labels, scale, k, exclude_self=True, vector=vector)
    lab = df.select(F.col(rid).alias("id"), F.col(label).cast("string").alias("lab"))
    t = near.join(lab.select(F.col("id").alias("qid"), F.col("lab").alias("cls")), "qid").join(lab.select(F.col("id").alias("rid"), F.col("lab").alias("other")), "rid")
    return t.groupBy(F.col("qid").alias("id"), "cls").agg(F.avg((F.col("cls") != F.col("other")).cast("double")).alias("r"))


def adasyn(df: DataFrame, label: str, rid: str, numbers: list[str], labels: list[str] | None = None, k: int = 5, threshold: float = 0.9, seed: int = 42) -> DataFrame:
    """Like smote(), with more new rows where a row's neighbours are of other classes; equal weights in a class without any."""
    labels = labels or []
    need = class_needs(df, label, threshold, 2)
    minor = df.join(need.select(F.col("cls").alias(label)), label, "left_semi")
    r = adasyn_weights(minor, df, label, rid, numbers, labels, k)
    total = r.groupBy("cls").agg(F.sum("r").alias("total"))
    t = r.join(need, "cls").join(total, "cls")
    weight = F.when(F.col("total") > 0, F.col("r") / F.col("total")).otherwise(1.0 / F.col("n_c"))
    t = t.withColumn("own", F.floor(weight * F.col("need") + 0.5)).where(F.col("own") > 0)
    near = nearest_rows(minor, df, rid, rid, numbers, labels, column_ranges(df, numbers), k, group=label, exclude_self=True)
    draws = t.select("cls", "n_c", F.col("id").alias("rid"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("own"))).alias("s")).withColumn("key", F.concat_ws("#", "rid", "s"))
    place = F.floor(uniform(seed, F.col("key"), 1) * F.least(F.lit(k), F.col("n_c") - 1)) + 1
    picks = draws.withColumn("rank", place).join(near.select(F.col("qid").alias("rid"), F.col("rid").alias("nid"), "rank"), ["rid", "rank"])
    return _blend(picks.select("key", "cls", "rid", "nid"), df, rid, numbers, labels, seed)


def without_tomek(df: DataFrame, rid: str, label: str, vector: str, remove: str = "both", majority: str | None = None) -> DataFrame:
    """`df` without the members of Tomek links: both, or only those of the class `majority`."""
    links = all_tomek_links(df, rid, label, vector)
    gone = links.select(F.col("a").alias(rid)).union(links.select(F.col("b").alias(rid))).distinct()
    if remove == "majority":
        gone = gone.join(df.where(F.col(label).cast("string") == str(majority)).select(rid), rid, "left_semi")
    return df.join(gone, rid, "left_anti")


def smote_tomek(df: DataFrame, label: str, rid: str, numbers: list[str], k: int = 5, seed: int = 42, remove: str = "both", majority: str | None = None) -> DataFrame:
    """(rid, label, numbers): the rows and SMOTE's new ones (with negative ids) without the members of Tomek links, on range-scaled numbers."""
    new = smote(df, label, rid, numbers, [], k, 1.0, seed)
    made = new.select((-F.abs(F.xxhash64("key"))).alias(rid), F.col("cls").alias(label), *numbers)
    whole = df.select(F.col(rid).cast("bigint").alias(rid), F.col(label).cast("string").alias(label), *[F.col(c).cast("double").alias(c) for c in numbers]).unionByName(made)
    scale = column_ranges(df, numbers)
    scaled = whole.withColumn("_v", F.array(*[F.col(c) / F.lit(s) for c, s in zip(numbers, scale)]))
    return without_tomek(materialize(scaled, "resampled"), rid, label, "_v", remove, majority).drop("_v")


def oversample(df: DataFrame, label: str, rid: str, numbers: list[str], ratio: float = 1.0, jitter: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, cls, numbers): random rows of the smaller classes with normal noise of `jitter` deviations."""
    sd = one_row(df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in numbers]))
    draws = class_needs(df, label, ratio).select("cls", "n_c", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need"))).alias("s")).withColumn("key", F.concat_ws("#", "cls", "s"))
    anchors = draws.withColumn("rank0", F.floor(uniform(seed, F.col("key"), 0) * F.col("n_c"))).join(ranked(df, label, rid), ["cls", "rank0"])
    t = anchors.join(df.select(F.col(rid).alias("rid"), *numbers), "rid")
    return t.select("key", "cls", *[F.round(F.col(c) + gaussian(seed, F.col("key"), c) * F.coalesce(F.nullif(sd[c], F.lit(0.0)), F.lit(1.0)) * jitter, 4).alias(c) for c in numbers])


def inject_noise(df: DataFrame, rid: str, numbers: list[str], factor: float = 0.08, seed: int = 42) -> DataFrame:
    """One noisy copy of every row, at `factor` deviations of each column; null stays null."""
    sd = one_row(df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in numbers]))
    return df.withColumns({c: F.round(F.col(c) + gaussian(seed, F.col(rid), c) * F.coalesce(F.nullif(sd[c], F.lit(0.0)), F.lit(1.0)) * factor, 4) for c in numbers})


def synthetic_quality(real: DataFrame, synth: DataFrame, rid: str, sid: str, numbers: list[str], labels: list[str], near: float = 0.04) -> DataFrame:
    """One row: share of synthetic rows closer than `near` to a real one, mean shift of means in deviations, diversity 0..100."""
    dims = float(len(numbers) + len(labels))
    d = closest_records(real, synth, rid, sid, numbers, labels).agg(F.round(100.0 * F.count_if(F.col("dcr") * F.sqrt(F.lit(dims)) < near) / F.count(F.lit(1)), 1).alias("redundancy"))
    a = one_row(real.agg(*[F.avg(c).alias(f"m_{c}") for c in numbers], *[F.stddev_samp(c).alias(f"s_{c}") for c in numbers]))
    b = one_row(synth.agg(*[F.avg(c).alias(f"m_{c}") for c in numbers]))
    gaps = [F.abs(b[f"m_{c}"] - a[f"m_{c}"]) / F.coalesce(F.nullif(a[f"s_{c}"], F.lit(0.0)), F.lit(1.0)) for c in numbers]
    shift = F.round(sum(gaps[1:], gaps[0]) / len(numbers), 3)
    t = d.withColumn("distribution_shift", shift)
    return t.withColumn("diversity", F.floor((1 - F.least(F.lit(1.0), F.col("distribution_shift") * 0.5)) * 88 + 0.5).cast("int"))


def _mean_distance(df: DataFrame, rid: str, numbers: list[str], first: int) -> float | None:
    """Mean distance of the pairs of the `first` rows by id, missing numbers as 0; None under two rows."""
    x = df.orderBy(rid).limit(first).select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in numbers]).toPandas().to_numpy()
    if len(x) < 2:
        return None
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    return float(d.sum() / (len(x) * (len(x) - 1)))


def synthesis_quality(real: DataFrame, synth: DataFrame, rid: str, sid: str, numbers: list[str], pair_rows: int = 50, near_rows: int = 200, near: float = 0.05) -> DataFrame:
    """One row: correlation_fidelity (1 - mean difference of correlations), distribution_fidelity (1 - twice the mean KS distance),
    diversity (80 times the ratio of mean distances among the first `pair_rows` rows of each side, at most 100; 50 where there are no
    pairs) and redundancy (percent of the first `near_rows` synthetic rows closer than `near` to a real one, by range and per
    dimension). Both row counts are part of the measure; correlations and distributions are of all rows."""
    c = one_row(correlation_fidelity(real, synth, numbers))["pairwise_fidelity"] if len(numbers) > 1 else F.lit(1.0)
    d = one_row(ks(real, synth, numbers).agg(F.sum("d").alias("d")))["d"] / F.lit(len(numbers))
    a, b = _mean_distance(synth, sid, numbers, pair_rows), _mean_distance(real, rid, numbers, pair_rows)
    spread = 50 if a is None else int(np.floor(max(0.0, min(100.0, 80 * (a / b if b else 1.0))) + 0.5))
    head = synth.orderBy(sid).limit(near_rows)
    close = closest_records(real, head, rid, sid, numbers, [])
    share = one_row(close.agg(F.round(100.0 * F.count_if(F.col("dcr") < near) / F.count(F.lit(1)), 1).alias("r")))["r"]
    return real.sparkSession.range(1).select(c.alias("correlation_fidelity"), F.round(F.greatest(F.lit(0.0), 1 - 2 * d), 4).alias("distribution_fidelity"), F.lit(spread).alias("diversity"), F.coalesce(share, F.lit(0.0)).alias("redundancy"))
