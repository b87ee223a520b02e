"""Splits, nearest-neighbour and library classifiers, metrics, and what they say about synthetic or augmented data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.rng import normal_cdf
from tabweave.operators.neighbours import CELLS, nearest_rows
from tabweave.operators.order import column_quantiles
from tabweave.plans.physical import materialize, one_row, running_sums


def split_key(seed: int, rid: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(rid).cast("string")))


def stratified_split(df: DataFrame, label: str, rid: str, ratio: float = 0.25, seed: int = 42) -> DataFrame:
    """`df` with is_test: of each class max(1, round(n x ratio)) rows, those with the least hash of (seed, rid).
    The hash that divides a class is found among its counts by hash prefix, so no class is sorted in one task."""
    t = df.withColumn("_h", split_key(seed, rid)).withColumn("_p", F.substring("_h", 1, 4))
    counts = t.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_p")
    cells = counts.select(label, "_p", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(label)).alias("_all"))
    joined = t.join(cells, [label, "_p"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", rid))
    return joined.withColumn("is_test", place <= F.greatest(F.lit(1), F.floor(F.col("_all") * ratio + 0.5))).drop("_h", "_p", "_before", "_all")


def shuffled_split(df: DataFrame, rid: str, ratio: float = 0.25, seed: int = 42) -> DataFrame:
    """Like stratified_split() over all rows as one class, with at least two test rows: max(floor(n x ratio), 2)."""
    t = df.withColumn("_h", split_key(seed, rid)).withColumn("_p", F.substring("_h", 1, 4))
    counts = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    cells = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    total = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", rid))
    return t.join(F.broadcast(cells), "_p").withColumn("is_test", place <= F.greatest(F.floor(total * ratio), F.lit(2))).drop("_h", "_p", "_before")


def sequential_split(df: DataFrame, rid: str, ratio: float = 0.25) -> DataFrame:
    """`df` with is_test: all rows after the first floor(n x (1 - ratio)) in the order of `rid`, which must tell rows apart."""
    t = running_sums(df.withColumn("_one", F.lit(1)), [], [rid], ["_one"])
    return t.withColumn("is_test", F.col("_one_upto") > F.floor(F.col("_one_all") * F.lit(1 - ratio))).drop("_one", "_one_upto", "_one_all")


def split_target(df: DataFrame, target: str, rid: str) -> tuple[DataFrame, DataFrame]:
    """The features (with `rid`) and (rid, target) of a table."""
    return df.drop(target), df.select(rid, target)


def splice_target(features: DataFrame, targets: DataFrame, rid: str, target: str, columns: list[str]) -> DataFrame:
    """split_target() undone: the columns in their first order, rows without a target with null."""
    return features.join(targets.select(rid, target), rid, "left").select(*columns)


@dataclass(frozen=True)
class Encoder:
    """What encode() needs to know of the rows it was fitted on: (column, median, mean, deviation) and (column, mode, categories)."""

    numbers: tuple[tuple[str, float, float, float], ...]
    labels: tuple[tuple[str, str, tuple[str, ...]], ...]

    @property
    def columns(self) -> list[str]:
        return [f"e{i}" for i in range(max(1, len(self.numbers) + sum(len(k) for _, _, k in self.labels)))]


def fit_encoder(train: DataFrame, numbers: list[str], labels: list[str] | None = None, ids: list[str] | None = None, most: int = 50) -> Encoder:
    """Medians, means and deviations of `numbers`, modes and categories of `labels` of the training rows; `ids` are left out. A label has
    its `most` most frequent categories (ties by name), in the order of their names. A column without values has median and mean 0,
    one without spread the deviation 1; a label without values the mode UNKNOWN."""
    numbers, labels = ([c for c in own or [] if c not in (ids or [])] for own in (numbers, labels))
    number = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in numbers}
    middle = {r.c: r.q0 for r in column_quantiles(train, numbers, [0.5]).collect()} if numbers else {}
    one = train.agg(*[e for i, x in enumerate(number.values()) for e in (F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"))]).first() if numbers else {}
    usable = lambda v: v is not None and v > 0 and np.isfinite(v)
    found = tuple((c, float(middle.get(c) or 0.0), float(one[f"m{i}"] or 0.0), float(one[f"s{i}"]) if usable(one[f"s{i}"]) else 1.0) for i, c in enumerate(numbers))
    kinds = []
    for c in labels:
        v = F.col(f"`{c}`").cast("string")
        top = train.where(v.isNotNull() & (v != "")).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(most).collect()
        kinds.append((c, top[0].v if top else "UNKNOWN", tuple(sorted(r.v for r in top))))
    return Encoder(found, tuple(kinds))


def encode(df: DataFrame, encoder: Encoder, keep: list[str]) -> DataFrame:
    """`keep` and the encoder's columns: numbers filled with the median and standardised, then 1 or 0 for each category (a missing label
    is its mode, an unknown one 0 in all); one column of zeros if there are none."""
    parts = []
    for c, median, mean, sd in encoder.numbers:
        x = F.col(f"`{c}`").cast("double")
        parts.append((F.coalesce(F.when(~F.isnan(x), x), F.lit(median)) - F.lit(mean)) / F.lit(sd))
    for c, mode, kinds in encoder.labels:
        v = F.coalesce(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit(mode))
        parts += [F.when(v == k, 1.0).otherwise(0.0) for k in kinds]
    return df.select(*keep, *[e.alias(n) for e, n in zip(parts or [F.lit(0.0)], encoder.columns)])


def knn_predict(train: DataFrame, test: DataFrame, rid: str, label: str, k: int = 3, vector: str | None = None, numbers: list[str] | None = None) -> DataFrame:
    """(rid, actual, predicted): the most frequent label of the k nearest training rows, ties by label."""
    near = nearest_rows(test, train, rid, rid, numbers or [], [], [1.0] * len(numbers or []), k, vector=vector)
    lab = train.select(F.col(rid).alias("rid"), F.col(label).cast("string").alias("lab"))
    votes = near.join(lab, "rid").groupBy("qid", "lab").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("n")).alias("k"), "lab"))["lab"].alias("predicted"))
    return best.join(test.select(F.col(rid).alias("qid"), F.col(label).cast("string").alias("actual")), "qid").select(F.col("qid").alias(rid), "actual", "predicted")


def knn_classify(train: DataFrame, test: DataFrame, rid: str, label: str, numbers: list[str], fit_rows: int, k: int = 3, seed: int = 42) -> DataFrame:
    """Like knn_predict() by numbers, for any number of test rows: the model is the at most `fit_rows` training rows with the least hash
    (not that of the split), every task holds it, and every test row is scored where it lies. Missing dimensions are left out."""
    own = train.where(F.col(label).isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), F.col(label).cast("string").alias("lab"), *[F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(numbers)])
    kept = own.orderBy(split_key(seed + 1, "rid"), "rid").limit(fit_rows).toPandas().sort_values("rid")
    names, code = np.unique(kept["lab"].to_numpy(str), return_inverse=True)
    model = kept[[f"x{j}" for j in range(len(numbers))]].to_numpy(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(model)))
        for b in batches:
            x = np.column_stack([np.asarray(b.column(2 + j).to_numpy(zero_copy_only=False), np.float64) for j in range(len(numbers))])
            best = np.zeros(b.num_rows, np.int64)
            for a in range(0, b.num_rows, step):
                part = x[a : a + step]
                d = np.zeros((len(part), len(model)))
                for j in range(len(numbers)):
                    gap = part[:, j, None] - model[None, :, j]
                    gap *= gap
                    d += np.nan_to_num(gap, copy=False) if np.isnan(gap).any() else gap
                votes, row = np.zeros((len(part), len(names)), int), np.arange(len(part))
                for _ in range(min(k, len(model))):
                    near = d.argmin(1)
                    votes[row, code[near]] += 1
                    d[row, near] = np.inf
                best[a : a + step] = votes.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[best].tolist(), pa.string())], names=["rid", "actual", "predicted"])

    asked = test.select(F.col(rid).cast("bigint").alias("rid"), F.col(label).cast("string").alias("actual"), *[F.col(c).cast("double").alias(c) for c in numbers])
    found = asked.mapInArrow(run, "rid bigint, actual string, predicted string") if len(model) else asked.limit(0).select("rid", "actual", F.lit("").alias("predicted"))
    return found.select(F.col("rid").alias(rid), "actual", "predicted")


def label_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """(k): the labels that occur in either one-column table, each once."""
    return first.toDF("k").union(second.toDF("k")).distinct()


def confusion(pred: DataFrame) -> DataFrame:
    """(actual, predicted, n, share): all pairs of labels that occur on either side, share of the actual label at four digits."""
    seen = pred.select(F.explode(F.array("actual", "predicted")).alias("k")).distinct()
    every = one_row(seen.agg(F.sort_array(F.collect_set("k")).alias("ks")))["ks"]
    counts = pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    dense = seen.select(F.col("k").alias("actual"), F.explode(every).alias("predicted")).join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    row = F.sum("n").over(Window.partitionBy("actual"))
    return dense.withColumn("share", F.when(row > 0, F.round(F.col("n") / row, 4)).otherwise(0.0))


def class_metrics(pred: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, tn, precision, recall, f1, support, specificity) of each label on either side."""
    c = confusion(pred).select("actual", "predicted", "n")
    total = one_row(pred.agg(F.count(F.lit(1)).alias("n")))["n"]
    each = c.select(F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("label"), "actual", "predicted", "n")
    hit, own, said = (F.col("actual") == F.col("label")) & (F.col("predicted") == F.col("label")), F.col("actual") == F.col("label"), F.col("predicted") == F.col("label")
    t = each.groupBy("label").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(said & ~own, F.col("n")).otherwise(0)).alias("fp"), F.sum(F.when(own & ~said, F.col("n")).otherwise(0)).alias("fn"))
    t = t.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    t = t.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return t.select("label", "tp", "fp", "fn", "tn", F.round("precision", 4).alias("precision"), F.round("recall", 4).alias("recall"), F.round(f1, 4).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"), F.round(safe(F.col("tn"), F.col("tn") + F.col("fp")), 4).alias("specificity"))


def summary_metrics(pred: DataFrame) -> DataFrame:
    """One row: accuracy, macro precision, recall and F1 at four digits."""
    m = class_metrics(pred).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"), F.avg("f1").alias("f"))
    a = one_row(pred.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("a")))["a"]
    return m.select(F.round(a, 4).alias("accuracy"), F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round("f", 4).alias("f1"))


# The lifts of F1 at which a synthetic table is called useful or harmful, and those names.
def utility_verdict(lift: Column) -> Column:
    return F.when(lift >= 0.02, "VERIFIED_POSITIVE").when(lift < -0.03, "DEGRADED_REJECT").otherwise("VIABLE_NEUTRAL")


def tstr(real: DataFrame, synth: DataFrame, rid: str, label: str, vector: str | None = None, numbers: list[str] | None = None, test_size: float = 0.25, seed: int = 42, k: int = 3, in_order: bool = False) -> DataFrame:
    """One row: a k-nearest-neighbour model trained on real and one trained on synthetic rows, both tested on the same real rows: a random
    quarter, or the last by `rid` if `in_order`."""
    s = materialize(sequential_split(real, rid, test_size) if in_order else shuffled_split(real, rid, test_size, seed), "split")
    test, train = s.where("is_test"), s.where("NOT is_test")
    base = summary_metrics(knn_predict(train, test, rid, label, k, vector, numbers))
    made = one_row(summary_metrics(knn_predict(synth, test, rid, label, k, vector, numbers)))
    t = base.select(F.col("accuracy").alias("baseline_accuracy"), F.col("f1").alias("baseline_f1"), made["accuracy"].alias("synthetic_accuracy"), made["f1"].alias("synthetic_f1"))
    t = t.withColumn("f1_lift", F.round(F.col("synthetic_f1") - F.col("baseline_f1"), 4))
    kept = F.when(F.col("baseline_accuracy") > 0, F.round(100 * F.col("synthetic_accuracy") / F.col("baseline_accuracy"), 1)).otherwise(100.0)
    return t.select("*", kept.alias("retention"), utility_verdict(F.col("f1_lift")).alias("verdict"))


def paired_t(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: t of the paired differences, degrees of freedom, p by the normal tail, significant at 0.05."""
    d = F.col(a) - F.col(b)
    one = df.agg(F.count(d).alias("n"), F.avg(d).alias("m"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("s"))
    t = F.when(F.col("n") < 2, 0.0).when(F.col("s") == 0, F.when(F.col("m") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise(F.col("m") / (F.col("s") / F.sqrt(F.col("n").cast("double"))))
    one = one.withColumn("t", t)
    p = F.when(F.col("n") < 2, 1.0).when(F.col("s") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(2 * (1 - normal_cdf(F.abs("t"))))
    return one.select("n", F.round("t", 6).alias("t"), (F.col("n") - 1).alias("df"), F.round(p, 6).alias("p"), (p < 0.05).alias("significant"))


def model(kind: str, seed: int = 42):
    """decision_tree, logistic_regression, random_forest with the depths and sizes of the reference models."""
    if kind == "decision_tree":
        return DecisionTreeClassifier(maxDepth=4, impurity="gini", seed=seed, labelCol="_y", featuresCol="_x")
    if kind == "logistic_regression":
        return OneVsRest(classifier=LogisticRegression(maxIter=45, regParam=0.001, labelCol="_y", featuresCol="_x"), labelCol="_y", featuresCol="_x")
    if kind == "random_forest":
        return RandomForestClassifier(numTrees=7, maxDepth=4, featureSubsetStrategy="sqrt", seed=seed, labelCol="_y", featuresCol="_x")
    raise ValueError(f"unknown model {kind!r}")


def fit_predict(train: DataFrame, test: DataFrame, rid: str, label: str, numbers: list[str], kind: str, seed: int = 42, fit_rows: int | None = None) -> DataFrame:
    """(rid, actual, predicted) of all test rows by a library model fitted on all training rows. `fit_rows` bounds the training rows
    that knn keeps (see knn_classify()); without it knn searches all of them for the queries in blocks."""
    if kind == "knn":
        return knn_classify(train, test, rid, label, numbers, fit_rows, 3, seed) if fit_rows else knn_predict(train, test, rid, label, 3, None, numbers)
    index = StringIndexer(inputCol="_l", outputCol="_y", handleInvalid="skip")
    data = [d.withColumn("_l", F.col(label).cast("string")).na.fill(0.0, numbers) for d in (train, test)]
    fitted = Pipeline(stages=[index, VectorAssembler(inputCols=numbers, outputCol="_x"), model(kind, seed)]).fit(data[0])
    names = F.array(*[F.lit(x) for x in fitted.stages[0].labels])
    scored = fitted.stages[2].transform(fitted.stages[1].transform(data[1]))
    return scored.select(rid, F.col("_l").alias("actual"), F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def controlled_predictions(df: DataFrame, rid: str, label: str, numbers: list[str], strategies: dict[str, Callable[[DataFrame, int], DataFrame] | None], runs: int = 3, kind: str = "decision_tree", ratio: float = 0.25, seed: int = 42, labels: list[str] | None = None) -> DataFrame:
    """(strategy, run, rid, actual, predicted) of all test rows: each strategy (None is the baseline) augments only the training rows of
    each run, and numbers (and `labels`, if the strategies keep them) are encoded by what the rows it trains on say."""
    parts, labels = [], labels or []
    for run in range(runs):
        own = seed + 17 * run
        s = materialize(stratified_split(df.select(rid, label, *numbers, *labels), label, rid, ratio, own), "split")
        test, train = s.where("is_test").drop("is_test"), s.where("NOT is_test").drop("is_test")
        for name, augment in strategies.items():
            used = train.select(F.col(rid).cast("bigint").alias(rid), F.col(label).cast("string").alias(label), *numbers, *labels)
            if augment is not None:
                # Every new row has an id of its own, below all ids there are.
                made = running_sums(augment(train, own).withColumn("_one", F.lit(1)), [], ["key"], ["_one"])
                low = one_row(train.agg(F.least(F.min(rid), F.lit(0)).cast("bigint").alias("m")))["m"]
                have = [c if c in made.columns else F.lit(None).cast("string").alias(c) for c in labels]
                used = used.unionByName(made.select((low - F.col("_one_upto")).alias(rid), F.col("cls").alias(label), *numbers, *have))
            e = fit_encoder(used, numbers, labels)
            found = fit_predict(encode(used, e, [rid, label]), encode(test, e, [rid, label]), rid, label, e.columns, kind, own)
            parts.append(found.select(F.lit(name).alias("strategy"), F.lit(run).alias("run"), rid, "actual", "predicted"))
    return materialize(reduce(DataFrame.unionByName, parts), "predictions")


def _class_counts(pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, tp, said, own) of each label on either side, from counts of pairs: one aggregation over rows."""
    counts = pred.groupBy(*keys, "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("actual").alias("label"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("own")),
                    F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("own")))
    return counts.select(*keys, F.explode(sides).alias("e")).select(*keys, "e.*").groupBy(*keys, "label").agg(*[F.sum(k).alias(k) for k in ("tp", "said", "own")])


def grouped_metrics(pred: DataFrame, keys: list[str]) -> DataFrame:
    """summary_metrics() of each group of `keys`."""
    c = _class_counts(pred, keys)
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    t = c.withColumn("p", safe(F.col("tp"), F.col("said"))).withColumn("r", safe(F.col("tp"), F.col("own")))
    t = t.withColumn("f", F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0)))
    m = t.groupBy(*keys).agg(F.round(F.sum("tp") / F.sum("own"), 4).alias("accuracy"), *[F.round(F.avg(F.round(k, 4)), 4).alias(name) for k, name in (("p", "precision"), ("r", "recall"), ("f", "f1"))])
    return m.select(*keys, "accuracy", "precision", "recall", "f1")


def controlled_evaluation(df: DataFrame, rid: str, label: str, numbers: list[str], strategies: dict[str, Callable[[DataFrame, int], DataFrame] | None], runs: int = 3, kind: str = "decision_tree", ratio: float = 0.25, seed: int = 42, labels: list[str] | None = None) -> DataFrame:
    """(strategy, run, accuracy, precision, recall, f1) of controlled_predictions()."""
    return grouped_metrics(controlled_predictions(df, rid, label, numbers, strategies, runs, kind, ratio, seed, labels), ["strategy", "run"])


def averaged_confusion(pred: DataFrame) -> DataFrame:
    """(strategy, actual, predicted, n): the confusion counts of controlled_predictions() over its runs, on average, at two digits; pairs
    that never occur are left out."""
    runs = pred.groupBy("strategy").agg(F.count_distinct("run").alias("runs"))
    counts = pred.groupBy("strategy", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(runs), "strategy").select("strategy", "actual", "predicted", F.round(F.col("n") / F.col("runs"), 2).alias("n"))


def recall_impact(pred: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(strategy, label, delta, impact): mean recall over the runs against the baseline's, in percent at one digit; improved or degraded
    beyond 0.03."""
    r = _class_counts(pred, ["strategy", "run"]).groupBy("strategy", "label").agg(F.sum(F.coalesce(F.col("tp") / F.nullif(F.col("own"), F.lit(0)), F.lit(0.0))).alias("r"))
    r = r.join(F.broadcast(pred.groupBy("strategy").agg(F.count_distinct("run").alias("runs"))), "strategy").select("strategy", "label", (F.col("r") / F.col("runs")).alias("r"))
    base = r.where(F.col("strategy") == baseline).select("label", F.col("r").alias("r0"))
    d = F.col("r") - F.coalesce("r0", F.lit(0.0))
    return r.where(F.col("strategy") != baseline).join(base, "label", "left").select("strategy", "label", F.round(100 * d, 1).alias("delta"), F.when(d > 0.03, "improved").when(d < -0.03, "degraded").otherwise("unchanged").alias("impact"))


def metrics_table(runs: DataFrame, experiment: str, kind: str, ratio: float = 0.25, baseline: str = "baseline") -> DataFrame:
    """One row a strategy with the fifteen columns of an experiment's metrics file: experiment, model, runs, split, strategy, means and
    deviation, gain over the baseline in percent, p value, whether it is significant, verdict."""
    own = runs.groupBy("strategy").agg(F.count(F.lit(1)).alias("runs"), *[F.round(F.avg(k), 4).alias(f"{k}_mean") for k in ("f1", "accuracy", "precision", "recall")], F.round(F.coalesce(F.stddev_samp("f1"), F.lit(0.0)), 4).alias("f1_std"))
    t = own.join(recommendations(runs, baseline).select("strategy", "improvement_pct", "p", "significant"), "strategy", "left")
    first = F.col("strategy") == baseline
    verdict = F.when(first, "Baseline").when(F.col("improvement_pct") > 1, "Recommended").when(F.col("improvement_pct") < -1, "Harmful").otherwise("Marginal")
    return t.select(
        F.lit(experiment).alias("experiment"), F.lit(kind).alias("model"), "runs", F.lit(1 - ratio).alias("train_share"), "strategy", "f1_mean", "f1_std", "accuracy_mean", "precision_mean", "recall_mean",
        F.coalesce("improvement_pct", F.lit(0.0)).alias("f1_gain_pct"), F.coalesce("p", F.lit(1.0)).alias("p"), F.coalesce("significant", F.lit(False)).alias("significant"), verdict.alias("verdict"), (~first).alias("augmented"))


def compare_experiments(first: DataFrame, second: DataFrame) -> DataFrame:
    """(strategy, f1_a, f1_b, delta, better): two metrics_table()s side by side, by strategy; null where one lacks it."""
    a, b = (t.select("strategy", F.col("f1_mean").alias(n)) for t, n in ((first, "f1_a"), (second, "f1_b")))
    d = F.round(F.col("f1_b") - F.col("f1_a"), 4)
    return a.join(b, "strategy", "full").select("strategy", "f1_a", "f1_b", d.alias("delta"), F.when(d > 0, "b").when(d < 0, "a").when(d == 0, "same").alias("better"))


def recommendations(runs: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(strategy, f1, f1_std, delta, improvement_pct, p, significant, verdict, high_variance) against the baseline's runs."""
    base = runs.where(F.col("strategy") == baseline).select("run", F.col("f1").alias("f0"))
    both = runs.where(F.col("strategy") != baseline).join(base, "run")
    d = F.col("f1") - F.col("f0")
    t = both.groupBy("strategy").agg(F.count(d).alias("n"), F.avg("f1").alias("f1m"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("f1s"), F.avg("f0").alias("f0m"), F.avg(d).alias("m"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("s"))
    p = F.when(F.col("n") < 2, 1.0).when(F.col("s") == 0, F.when(F.col("m") == 0, 1.0).otherwise(0.0)).otherwise(2 * (1 - normal_cdf(F.abs(F.col("m") / (F.col("s") / F.sqrt(F.col("n").cast("double")))))))
    pct = F.round(F.coalesce(100 * F.col("m") / F.nullif(F.col("f0m"), F.lit(0.0)), F.lit(0.0)), 1)
    t = t.withColumn("p", F.round(p, 4)).withColumn("improvement_pct", pct)
    verdict = F.when(F.col("improvement_pct") > 1, F.when(F.col("p") < 0.05, "recommended").otherwise("use_with_caution")).when(F.abs("improvement_pct") <= 1, "inconclusive").otherwise("not_recommended")
    return t.select("strategy", F.round("f1m", 4).alias("f1"), F.round("f1s", 4).alias("f1_std"), F.round("m", 4).alias("delta"), "improvement_pct", "p", (F.col("p") < 0.05).alias("significant"), verdict.alias("verdict"), (F.col("f1s") > 0.05).alias("high_variance"))


def overall_verdict(recommended: DataFrame) -> DataFrame:
    """One row: the best strategy and what is said of it."""
    best = recommended.agg(F.max(F.struct("improvement_pct", "strategy", "significant")).alias("b")).select("b.*")
    v = F.when(F.col("improvement_pct") > 2, F.when(F.col("significant"), "recommended").otherwise("inconclusive")).when(F.col("improvement_pct") < -1, "not_recommended").otherwise("inconclusive")
    return best.select(F.col("strategy").alias("best_strategy"), "improvement_pct", v.alias("verdict"), F.when(F.col("significant"), "high").otherwise("medium").alias("confidence"))


def task_type(df: DataFrame, target: str) -> DataFrame:
    number = dict(df.dtypes)[target] not in ("string", "boolean")
    return df.agg(F.when(F.lit(number) & (F.count_distinct(target) > 10), "regression").otherwise("classification").alias("task"))


def report(verdict: DataFrame, analysis: DataFrame) -> str:
    """A plain-text report of one verdict and one need score."""
    v, a = verdict.first(), analysis.first()
    lines = ["Augmentation report", "", f"Rows: {a.rows}. Imbalance {a.ratio}:1 ({a.severity}); smallest class {a.min_class}, largest {a.max_class}.", f"Need score {a.need_score}, health {a.health_score}."]
    if v is not None:
        lines.append(f"Best strategy: {v.best_strategy} ({v.improvement_pct:+.1f} % macro F1), {v.verdict}, confidence {v.confidence}.")
    return "\n".join(lines)


def compare(baseline: DataFrame, other: DataFrame) -> DataFrame:
    """One row: differences of two one-row summary_metrics() and the change of F1 in percent."""
    b = one_row(baseline)
    t = other.select(*[F.round(F.col(k) - b[k], 4).alias(f"delta_{k}") for k in ("accuracy", "precision", "recall", "f1")], b["f1"].alias("base"))
    return t.select("delta_accuracy", "delta_precision", "delta_recall", "delta_f1", F.round(F.coalesce(100 * F.col("delta_f1") / F.nullif(F.col("base"), F.lit(0.0)), F.lit(0.0)), 1).alias("f1_change_pct"))


def script(table: str, label: str, numbers: list[str], kind: str, strategy: str, seed: int = 42) -> str:
    """A standalone PySpark program that repeats one evaluation."""
    return "\n".join([
        "from tabweave import build_session", "from tabweave.operators import augment, evaluate", "", "spark = build_session()", f"df = spark.read.parquet({table!r})",
        f"numbers = {numbers!r}", f"strategies = {{'baseline': None, {strategy!r}: lambda x, s: augment.{strategy}(x, {label!r}, 'id', numbers, seed=s)}}",
        f"runs = evaluate.controlled_evaluation(df, 'id', {label!r}, numbers, strategies, kind={kind!r}, seed={seed})", "evaluate.recommendations(runs).show()", ""])


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, value) of the product of two matrices in the same form."""
    return a.join(b.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("value").alias("other")), "j").groupBy("i", F.col("k").alias("j")).agg(F.sum(F.col("value") * F.col("other")).alias("value"))


def matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.asarray(a, float) @ np.asarray(b, float)
