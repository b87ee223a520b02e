"""Filling missing numbers and labels by chained equations, from rows of the same group or near in time.

Every field is expressed as a difference from its group (the mean, or the share of each label), so what is filled starts
from rows of the same group; the equations explain what is left by the other fields. A number's equation is a ridge
regression, a label's a linear discriminant with the group's shares as prior. Both need only sums of products, so one pass
over the rows adds up the sums of all equations at once, wherever the rows lie; the sums, not rows, reach the driver. The next pass
applies the equations so far to each row in a chain, each filled field serving the next, and adds up again. What is filled
keeps the variation its equation leaves over, drawn from a hash of the row's key: it does not depend on partitioning or on a retry.

Rows meet their group's figures in one join: broadcast if those were counted small, else shuffled, where adaptive execution splits a hot
group. Outliers are clipped inside the equations only, at the quartiles of the whole column plus three times their distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import ALL_TOKENS, bare, number_missing, text_missing
from tabweave.plans.physical import Veil, free_name, materialize, small_side

#: Random rows of a group whose rare label a cell may get.
RARE_DRAWS = 4
SUMS = "kind int, i int, j int, v double"
#: Rows whose group gives nothing for a field fall back on rows of their dataset in the same span of time, then on their dataset, then on all.
SOURCES = ("group", "time", "dataset", "all")


@dataclass
class Equations:
    """One round of fitted equations: per number (weights, deviation), per label field (weights by class, offsets)."""

    numbers: list[tuple[np.ndarray, float]]
    labels: list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Shape:
    """Where each field stands in the row of features: a one, the numbers, then a column per class of each label field."""

    numbers: int
    classes: tuple[int, ...]
    filled: int

    @property
    def width(self) -> int:
        return 1 + self.numbers + sum(self.classes)

    def span(self, f: int) -> slice:
        a = 1 + self.numbers + sum(self.classes[:f])
        return slice(a, a + self.classes[f])


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """In (0, 1), from a hash of `key` and `salt`."""
    x = key.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _normal(key: np.ndarray, salt: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniform(key, 2 * salt))) * np.cos(2 * np.pi * _uniform(key, 2 * salt + 1))


def complete(shape: Shape, rounds: list[Equations], key: np.ndarray, z: np.ndarray, at: list[np.ndarray], share: list[np.ndarray], seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(features, classes) after the rounds. z: numbers as differences from the group, NaN where missing; at: class numbers, -1 where
    missing; share: the group's shares of each class."""
    n = len(key)
    x = np.zeros((n, shape.width))
    x[:, 0] = 1
    gaps = [np.flatnonzero(np.isnan(z[:, j])) for j in range(shape.numbers)]
    x[:, 1 : 1 + shape.numbers] = np.nan_to_num(z, nan=0.0)
    at = [a.copy() for a in at]
    voids = []
    for f, k in enumerate(shape.classes):
        there = np.flatnonzero(at[f] >= 0)
        voids.append(np.flatnonzero(at[f] < 0))
        block = np.zeros((n, k))
        block[there] = -share[f][there]
        block[there, at[f][there]] += 1
        x[:, shape.span(f)] = block
    for r, eq in enumerate(rounds):
        for j, gap in enumerate(gaps):
            if len(gap):
                w, deviation = eq.numbers[j]
                x[gap, 1 + j] = np.clip(x[gap] @ w + deviation * _normal(key[gap], seed + 1000 * r + j), -8, 8)
        for f in range(shape.filled):
            gap = voids[f]
            if len(gap) and shape.classes[f]:
                w, offset = eq.labels[f]
                score = x[gap] @ w + offset + np.log(share[f][gap] + 1e-3)
                p = np.exp(score - score.max(1, keepdims=True))
                p = p.cumsum(1)
                pick = (p < (_uniform(key[gap], seed + 1000 * r + 500 + f) * p[:, -1])[:, None]).sum(1).clip(0, shape.classes[f] - 1)
                at[f][gap] = pick
                block = -share[f][gap]
                block[np.arange(len(gap)), pick] += 1
                x[gap, shape.span(f)] = block
    return x, at


def solve(shape: Shape, sums: dict[int, np.ndarray]) -> Equations:
    """The equations whose sums of products are `sums`: kind j for number j, then one kind per class of each filled label field."""
    zero, d = np.zeros((shape.width, shape.width)), shape.width
    numbers = []
    for j in range(shape.numbers):
        m = sums.get(j, zero)
        n, own = m[0, 0], 1 + j
        rest = np.array([i for i in range(d) if i != own])
        w, deviation = np.zeros(d), 1.0
        if n > 2 * d:
            a = m[np.ix_(rest, rest)] + np.eye(d - 1) * 1e-3 * n
            b = np.linalg.solve(a, m[rest, own])
            w[rest] = b
            deviation = float(np.sqrt(max(0.0, (m[own, own] - 2 * b @ m[rest, own] + b @ m[np.ix_(rest, rest)] @ b) / n)))
        numbers.append((w, deviation))
    labels, kind = [], shape.numbers
    for f in range(shape.filled):
        own, k = shape.span(f), shape.classes[f]
        parts = [sums.get(kind + c, zero) for c in range(k)]
        kind += k
        w, offset = np.zeros((d, k)), np.zeros(k)
        n = sum(p[0, 0] for p in parts)
        if k and n > 2 * d:
            rest = np.array([i for i in range(1, d) if not own.start <= i < own.stop])
            means = [p[0, rest] / p[0, 0] if p[0, 0] else np.zeros(len(rest)) for p in parts]
            spread = sum(p[np.ix_(rest, rest)] - p[0, 0] * np.outer(m, m) for p, m in zip(parts, means)) / n + np.eye(len(rest)) * 1e-3
            for c, m in enumerate(means):
                v = np.linalg.solve(spread, m)
                w[rest, c], offset[c] = v, -m @ v / 2
        labels.append((w, offset))
    return Equations(numbers, labels)


def _arrays(shape: Shape, columns: list[np.ndarray]) -> tuple:
    """key, z, at, share out of columns in the order of _inputs()."""
    it = iter(columns)
    key = next(it).astype(np.int64)
    z = np.column_stack([next(it).astype(np.float64) for _ in range(shape.numbers)]) if shape.numbers else np.zeros((len(key), 0))
    at, share = [], []
    for k in shape.classes:
        at.append(np.nan_to_num(next(it).astype(np.float64), nan=-1).astype(np.int64))
        share.append(np.column_stack([np.nan_to_num(next(it).astype(np.float64)) for _ in range(k)]) if k else np.zeros((len(key), 0)))
    return key, z, at, share


def _adder(shape: Shape, rounds: list[Equations], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            key, z, at, share = _arrays(shape, [c.to_numpy(zero_copy_only=False) for c in b.columns])
            x, _ = complete(shape, rounds, key, z, at, share, seed)
            masks = [~np.isnan(z[:, j]) for j in range(shape.numbers)]
            masks += [at[f] == c for f in range(shape.filled) for c in range(shape.classes[f])]
            for kind, mask in enumerate(masks):
                part = x[mask]
                sums[kind] = sums.get(kind, 0) + part.T @ part
        d = shape.width
        i, j = np.divmod(np.arange(d * d), d)
        for kind, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, kind, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(m.ravel())], names=["kind", "i", "j", "v"])

    return run


def fit_chain(rows: DataFrame, inputs: list[str], shape: Shape, iterations: int, seed: int) -> list[Equations]:
    """`iterations` rounds of equations; one job each, whose result has a size fixed by the number of fields."""
    rounds: list[Equations] = []
    for _ in range(iterations):
        added = rows.select(*inputs).mapInArrow(_adder(shape, list(rounds), seed), SUMS).groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))
        sums: dict[int, np.ndarray] = {}
        for r in added.collect():
            sums.setdefault(r.kind, np.zeros((shape.width, shape.width)))[r.i, r.j] = r.v
        rounds.append(solve(shape, sums))
    return rounds


def _filler(shape: Shape, rounds: list[Equations], seed: int):
    out = T.StructType([T.StructField(f"z{j}", T.DoubleType()) for j in range(shape.numbers)] + [T.StructField(f"a{f}", T.IntegerType()) for f in range(shape.filled)])

    def run(*columns: pd.Series) -> pd.DataFrame:
        key, z, at, share = _arrays(shape, [c.to_numpy() for c in columns])
        x, at = complete(shape, rounds, key, z, at, share, seed)
        return pd.DataFrame({f"z{j}": x[:, 1 + j] for j in range(shape.numbers)} | {f"a{f}": at[f].astype(np.int32) for f in range(shape.filled)})

    return F.pandas_udf(run, out)


def _label_list(df: DataFrame, c: Column, tokens: tuple[str, ...], most: int) -> tuple[list[tuple[str, str]], bool]:
    """(label, its most frequent spelling) of the `most` most frequent labels, and whether there are others."""
    t = F.btrim(c, F.lit(" \t"))
    each = df.select(F.when(~text_missing(c, tokens), t).alias("t")).where(F.col("t").isNotNull()).groupBy("t").count()
    labels = each.groupBy(F.lower("t").alias("k")).agg(F.sum("count").alias("n"), F.max(F.struct("count", "t")).alias("m"))
    found = [(r.k, r.m.t) for r in labels.orderBy(F.desc("n"), "k").limit(most + 1).collect()]
    return found[:most], len(found) > most


def impute(
    df: DataFrame,
    key: str = "row_id",
    group: tuple[str, ...] = ("dataset_id", "load_no", "site_code"),
    dataset: str = "dataset_id",
    time: str = "observed_at",
    numbers: tuple[str, ...] = ("account_age_months", "monthly_charges", "usage_hours", "support_tickets"),
    labels: tuple[str, ...] = ("contract_type",),
    helpers: tuple[str, ...] = ("churn_risk",),
    decimals: dict[str, int] | None = None,
    span_days: int = 7,
    iterations: int = 3,
    most_labels: int = 50,
    seed: int = 42,
    tokens: tuple[str, ...] = ALL_TOKENS,
    keep: list[str] | None = None,
) -> DataFrame:
    """`df` (its columns `keep`, or all) plus, for each of `numbers` and `labels`, c_filled and c_source.

    c_filled is the value, cleaned (labels in their most frequent spelling) and with gaps filled; c_source is null for a value that
    was there, else where the filled one starts from: group (same group, which has a value), time (rows of the dataset in the same
    span of days), dataset or all. `helpers` are label fields that explain others and are never filled. Filled numbers stay within what
    their group has, at `decimals`. A group key that is null or a missing token makes no group. A field without any value anywhere
    stays null. The `most_labels` most frequent labels are classes of their own; the others share one, and a cell of that class is filled
    with the label of a random row of its group that has such a one. Every row comes out once, repeated ones too; an
    empty table gives an empty one. New names that are taken get a trailing underscore.
    """
    decimals = decimals or {}
    v = Veil(df)
    col, kinds = v.col, dict(v.df.dtypes)
    kept = [F.col(i) for i in v.inner] if keep is None else [col(c) for c in keep]
    keep = v.names if keep is None else keep
    fields = [*labels, *helpers]
    x = [F.when(~number_missing(col(c).cast("double")), col(c).cast("double")) for c in numbers]
    quart = v.df.agg(*[F.percentile_approx(e, [0.25, 0.75], 1000).alias(f"q{i}") for i, e in enumerate(x)]).first() if numbers else []
    fence = []
    for q in quart:
        lo, hi = (q[0], q[1]) if q else (0.0, 0.0)
        fence.append((lo - 3 * (hi - lo), hi + 3 * (hi - lo)) if hi > lo else (-float("inf"), float("inf")))
    listed = [_label_list(v.df, col(c), tokens, most_labels) for c in fields]
    # Labels beyond the most frequent share a last class; which of them is filled in is drawn among the rows of the group.
    words = [[*w, ("", "")] if more else w for w, more in listed]
    spot = []
    for c, (w, more) in zip(fields, listed):
        at = F.nullif(F.array_position(F.array(*[F.lit(k) for k, _ in w]), bare(col(c))), F.lit(0)).cast("int") - 1 if w else F.lit(None).cast("int")
        spot.append(F.when(~text_missing(col(c), tokens), F.coalesce(at, F.lit(len(w)))) if more else at)
    rare = [f for f, (_, more) in enumerate(listed[: len(labels)]) if more]
    known = F.lit(True)
    for g in group:
        known = known & ~(text_missing(col(g), tokens) if kinds[v.name(g)] == "string" else col(g).isNull())
    cut = [F.least(F.greatest(e, F.lit(lo)), F.lit(hi)) for e, (lo, hi) in zip(x, fence)]
    clean = v.df.select(
        *[e.alias(f"k{i}") for i, e in enumerate(kept)], F.xxhash64(col(key)).alias("key"), col(dataset).alias("d"), F.floor(F.unix_seconds(col(time).cast("timestamp")) / (86_400 * span_days)).alias("span"),
        *[col(g).alias(f"g{i}") for i, g in enumerate(group)], known.alias("known"), *[e.alias(f"x{i}") for i, e in enumerate(x)],
        *[F.when(F.isnotnull(e), c).alias(f"c{i}") for i, (e, c) in enumerate(zip(x, cut))], *[s.alias(f"s{f}") for f, s in enumerate(spot)],
        *[F.when(~text_missing(col(c), tokens), F.btrim(col(c), F.lit(" \t"))).alias(f"t{f}") for f, c in enumerate(labels)])
    figures = []
    for i in range(len(numbers)):
        c = F.col(f"c{i}")
        figures += [F.count(c).alias(f"n{i}"), F.sum(c).alias(f"sum{i}"), F.sum(c * c).alias(f"sq{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    for f, w in enumerate(words):
        figures += [F.count_if(F.col(f"s{f}") == k).alias(f"m{f}_{k}") for k in range(len(w))]
    for f in rare:
        draw = lambda i, f=f: F.max(F.when(F.col(f"s{f}") == len(words[f]) - 1, F.struct(F.xxhash64(F.lit(seed + i), "key").alias("h"), F.col(f"t{f}").alias("t"))))
        figures += [draw(i).alias(f"r{f}_{i}") for i in range(RARE_DRAWS)]
    names = [f"g{i}" for i in range(len(group))]
    groups = materialize(clean.where("known").groupBy(*names).agg(*figures), "groups")
    drawn = [f"r{f}_{i}" for f in rare for i in range(RARE_DRAWS)]
    total = groups.agg(
        *[F.max(r).alias(r) for r in drawn],
        F.count(F.lit(1)).alias("groups"),
        *[e for i in range(len(numbers)) for e in (F.sum(f"n{i}").alias(f"n{i}"), F.sum(f"sum{i}").alias(f"sum{i}"), F.sum(F.col(f"sq{i}") - F.col(f"sum{i}") * F.col(f"sum{i}") / F.col(f"n{i}")).alias(f"w{i}"), F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"))],
        *[F.sum(f"m{f}_{k}").alias(f"m{f}_{k}") for f, w in enumerate(words) for k in range(len(w))]).first()
    scale = [max(1e-9, float(np.sqrt(max(0.0, (total[f"w{i}"] or 0.0) / max(1, (total[f"n{i}"] or 0)))))) for i in range(len(numbers))]

    def start(level: str) -> list[Column]:
        """Means, ranges and shares out of joined figures; null where they have none."""
        e = []
        for i in range(len(numbers)):
            n = F.nullif(F.col(f"n{i}"), F.lit(0))
            e += [(F.col(f"sum{i}") / n).alias(f"{level}mean{i}"), F.col(f"lo{i}").alias(f"{level}lo{i}"), F.col(f"hi{i}").alias(f"{level}hi{i}")]
        for f, w in enumerate(words):
            ms = [F.col(f"m{f}_{k}") for k in range(len(w))]
            whole = F.nullif(sum(ms[1:], ms[0]), F.lit(0)) if ms else F.lit(None)
            e += [(m / whole).alias(f"{level}share{f}_{k}") for k, m in enumerate(ms)]
        return e + [F.col(f"{r}.t").alias(f"{level}{r}") for r in drawn]

    near = groups.select(*names, *start("G"))
    rows = clean.join(small_side(near, total["groups"], 8 * (3 * len(numbers) + sum(map(len, words)) + 4)), names, "left")
    # Where the group has nothing for a field that the row lacks, other rows are asked.
    lack = F.lit(False)
    for i in range(len(numbers)):
        lack = lack | (F.col(f"x{i}").isNull() & F.col(f"Gmean{i}").isNull())
    for f, w in enumerate(words):
        if w and f < len(labels):
            lack = lack | (F.col(f"t{f}").isNull() & F.col(f"Gshare{f}_0").isNull())
    rows = materialize(rows.withColumn("lack", lack).drop(*names, "known"), "rows")
    timed = clean.groupBy("d", "span").agg(*figures)
    whole = timed.groupBy("d").agg(*[(F.min if n.startswith("lo") else F.max if n.startswith(("hi", "r")) else F.sum)(n).alias(n) for n in timed.columns[2:]])
    far = rows.where("lack").join(timed.select("d", "span", *start("T")), ["d", "span"], "left").join(whole.select("d", *start("D")), ["d"], "left")
    far = materialize(far, "far")
    have = set(rows.columns)
    full = rows.where(~F.col("lack"))
    full = full.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in far.dtypes if c not in have]).unionByName(far)

    mean, low, high, source, share = [], [], [], [], []
    for i in range(len(numbers)):
        n = total[f"n{i}"] or 0
        mean.append(F.coalesce(*[F.col(f"{lv}mean{i}") for lv in "GTD"], F.lit((total[f"sum{i}"] / n) if n else None).cast("double")))
        low.append(F.coalesce(*[F.col(f"{lv}lo{i}") for lv in "GTD"], F.lit(total[f"lo{i}"]).cast("double")))
        high.append(F.coalesce(*[F.col(f"{lv}hi{i}") for lv in "GTD"], F.lit(total[f"hi{i}"]).cast("double")))
        source.append(F.coalesce(*[F.when(F.col(f"{lv}mean{i}").isNotNull(), s) for lv, s in zip("GTD", SOURCES)], F.lit(SOURCES[3] if n else None)))
    for f, w in enumerate(words):
        ms = [total[f"m{f}_{k}"] or 0 for k in range(len(w))]
        share.append([F.coalesce(*[F.col(f"{lv}share{f}_{k}") for lv in "GTD"], F.lit(m / max(1, sum(ms)))) for k, m in enumerate(ms)])
        if f < len(labels):
            source.append(F.coalesce(*[F.when(F.col(f"{lv}share{f}_0").isNotNull(), s) for lv, s in zip("GTD", SOURCES)], F.lit(SOURCES[3] if sum(ms) else None)) if w else F.lit(None).cast("string"))
    shape = Shape(len(numbers), tuple(map(len, words)), len(labels))
    ready = full.select(
        "*", *[((F.col(f"c{i}") - mean[i]) / scale[i]).alias(f"z{i}") for i in range(len(numbers))], *[e.alias(f"P{f}_{k}") for f, es in enumerate(share) for k, e in enumerate(es)])
    inputs = ["key", *[f"z{i}" for i in range(len(numbers))]]
    for f, w in enumerate(words):
        inputs += [f"s{f}", *[f"P{f}_{k}" for k in range(len(w))]]
    rounds = fit_chain(ready, inputs, shape, iterations, seed)
    done = ready.withColumn("got", _filler(shape, rounds, seed)(*inputs))
    out = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    for i, c in enumerate(numbers):
        value = F.least(F.greatest(mean[i] + F.col(f"got.z{i}") * scale[i], low[i]), high[i])
        value = F.round(value, decimals[c]) if c in decimals else value
        gap = F.col(f"x{i}").isNull()
        out += [F.when(gap, value).otherwise(F.col(f"x{i}")).alias(free_name(df, f"{c}_filled")), F.when(gap & value.isNotNull(), source[i]).alias(free_name(df, f"{c}_source"))]
    for f, c in enumerate(labels):
        spelled = F.get(F.array(*[F.lit(s) for _, s in words[f]]), F.col(f"got.a{f}")) if words[f] else F.lit(None).cast("string")
        if f in rare:  # one of a few rows of the group that have such a label, by the row's own hash
            picks = [F.coalesce(*[F.col(f"{lv}r{f}_{i}") for lv in "GTD"], F.lit(total[f"r{f}_{i}"].t)) for i in range(RARE_DRAWS)]
            spelled = F.when(F.col(f"got.a{f}") == len(words[f]) - 1, F.get(F.array(*picks), F.pmod("key", F.lit(RARE_DRAWS)).cast("int"))).otherwise(spelled)
        gap = F.col(f"t{f}").isNull()
        clean_label = F.coalesce(F.get(F.array(*[F.lit(s) for _, s in listed[f][0]]), F.col(f"s{f}")), F.col(f"t{f}")) if words[f] else F.col(f"t{f}")
        out += [F.when(gap, spelled).otherwise(clean_label).alias(free_name(df, f"{c}_filled")), F.when(gap & spelled.isNotNull(), source[len(numbers) + f]).alias(free_name(df, f"{c}_source"))]
    return done.select(*out)


def filled_cells(done: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column_name, source, value): one row for each cell that `impute` filled."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_source").alias("source"), F.col(f"{c}_filled").cast("string").alias("value")) for c in columns])
    return done.select(key, F.explode(cells).alias("e")).select(key, "e.*").where(F.col("source").isNotNull() & F.col("value").isNotNull())
