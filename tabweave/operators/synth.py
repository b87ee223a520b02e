"""Making new rows like those of a table: copula, kernel density, Bayesian network, jitter, interpolation, autoencoder.

What is fitted is small (matrices of the number of columns, grids of quantiles, tables of counts); new rows come from
`spark.range` and the counter generator, so their number is bounded by nothing and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.rng import gaussian, normal_cdf, probit_array, uniform
from tabweave.operators.augment import column_ranges, ranked
from tabweave.operators.neighbours import nearest_rows
from tabweave.operators.order import Cells, column_quantiles, melt, running_counts
from tabweave.operators.relations import binned, mutual_information, scored_correlation, scored_products, spearman
from tabweave.plans.physical import materialize, one_row, running_sums, small_side


def cholesky_psd(r: np.ndarray) -> np.ndarray:
    """A factor of the nearest positive definite matrix: eigenvalues are lifted to 1e-6, the diagonal to 1."""
    values, vectors = np.linalg.eigh((r + r.T) / 2)
    fixed = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    d = np.sqrt(np.diag(fixed))
    return np.linalg.cholesky(fixed / np.outer(d, d) + 1e-10 * np.eye(len(r)))


def ecdf(df: DataFrame, columns: list[str], profile: str = "client") -> DataFrame:
    """(c, x, u) of each distinct value. client: (number <= x) / (n + 1), 1 at the largest; service: mid-rank (below + half) / n in [1e-4, 0.9999]."""
    run = running_counts(melt(df, columns), {"n": F.lit(1)})
    below, upto, n = F.col("n_upto") - F.col("n"), F.col("n_upto"), F.col("n_all")
    u = F.when(upto == n, 1.0).otherwise(upto / (n + 1)) if profile == "client" else F.least(F.lit(0.9999), F.greatest(F.lit(1e-4), (below + 0.5) / n))
    return run.select("c", "x", u.alias("u"))


def category_shares(df: DataFrame, c: str) -> DataFrame:
    """(value, below, share): the cumulative share of each value of `c` in lexicographic order, without and with itself."""
    counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    t = running_sums(counts.withColumn("all", F.lit(0)), ["all"], ["value"], ["n"])
    return t.select("value", ((F.col("n_upto") - F.col("n")) / F.col("n_all")).alias("below"), (F.col("n_upto") / F.col("n_all")).alias("share"))


def with_draws(out: DataFrame, df: DataFrame, labels: list[str], seed: int) -> DataFrame:
    """`out` and for each label column a value drawn by its share: the first one whose cumulative share is at least the draw. Draws and
    values meet in equal ranges of share, as many as there are values."""
    for j, c in enumerate(labels):
        table = materialize(category_shares(df, c), "cumulative")
        n = table.count()
        cells = min(1 << 20, max(16, n))
        cell = lambda u: F.floor(u * cells)
        low = F.when(F.col("below") > 0, F.col("below")).otherwise(-1.0)
        spans = table.select(F.col("value").alias("_value"), low.alias("_low"), F.col("share").alias("_high"), F.explode(F.sequence(cell(F.col("below")), cell(F.col("share")))).alias("_cell"))
        u = out.withColumn("_u", uniform(seed, F.col("row_id"), f"c{j}")).withColumn("_cell", cell(F.col("_u")))
        spans = small_side(spans, n + cells, 64)
        meet = (u["_cell"] == spans["_cell"]) & (F.col("_u") > F.col("_low")) & (F.col("_u") <= F.col("_high"))
        out = u.join(spans, meet, "left").select(*[u[k] for k in out.columns], F.col("_value").alias(c))
    return out


def copula(df: DataFrame, numbers: list[str], labels: list[str], n: int, seed: int = 42, method: str = "pearson", rid: str | None = None, grid: int = 2000) -> DataFrame:
    """(row_id, numbers, labels): n rows with the marginals and the correlation of the scores of `df`; labels are drawn apart.
    A marginal is the exact cumulative share at the ends of `grid` cells of its column, linear in between; constants stay, and a value
    that fills a cell is a step."""
    cells = Cells.of_columns(df, numbers, grid, stable=True)
    marks = {c: cells.steps(c, "n") if c in cells.place else (np.zeros(2), np.array([0.0, 1.0])) for c in numbers}
    d, m = len(numbers), np.eye(len(numbers))
    if method == "spearman" and rid:
        for p in spearman(df, numbers, rid).collect():
            i, j = numbers.index(p.a), numbers.index(p.b)
            m[i, j] = m[j, i] = p.r
    elif d > 1:
        ways = [_forward(marks[c]) for c in numbers]
        m = scored_correlation(df, numbers, lambda x: np.column_stack([probit_array(way(x[:, j])) for j, way in enumerate(ways)]))
    lower = cholesky_psd(m) if d else m
    base = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    g = [gaussian(seed, F.col("row_id"), f"g{j}") for j in range(d)]
    base = base.withColumns({f"_g{j}": e for j, e in enumerate(g)})
    out = base
    for i, c in enumerate(numbers):
        z = sum((F.lit(float(lower[i, j])) * F.col(f"_g{j}") for j in range(i + 1)), F.lit(0.0))
        out = out.withColumn(c, F.round(_inverse(marks[c])(normal_cdf(z)), 4))
    return with_draws(out.select("row_id", *numbers), df, labels, seed)


def _forward(marks: tuple[np.ndarray, np.ndarray]):
    """The share of the values at most x, kept off 0 and 1; null stays null."""
    values, shares = marks

    def forward(v: np.ndarray) -> np.ndarray:
        at = np.searchsorted(values, v, "right")
        a, b = np.clip(at - 1, 0, len(values) - 1), np.clip(at, 0, len(values) - 1)
        width = values[b] - values[a]
        u = shares[a] + np.where(width > 0, (v - values[a]) / np.where(width > 0, width, 1.0), 0.0) * (shares[b] - shares[a])
        return np.where(np.isnan(v), np.nan, np.clip(np.where(at > 0, u, 0.0), 0.001, 0.999))

    return forward


def _inverse(marks: tuple[np.ndarray, np.ndarray]):
    values, shares = marks

    @F.pandas_udf(T.DoubleType())
    def inverse(u: pd.Series) -> pd.Series:
        return pd.Series(np.interp(u, shares, values))

    return inverse


def copula_service(df: DataFrame, numbers: list[str], labels: list[str], n: int, rid: str, seed: int = 42) -> DataFrame:
    """(row_id, numbers, labels): as copula(), but with the sums of products of the scores over n - 1, at most 0.99 in size, as
    correlations, with values that occur (the one at place floor(u n) of its column) and with each label from a random row."""
    if not numbers:
        return jitter(df, numbers, n, rid, seed)
    cells = Cells.of_columns(df, numbers, 2000, stable=True)
    ways = [_forward(cells.steps(c, "n") if c in cells.place else (np.zeros(2), np.array([0.0, 1.0]))) for c in numbers]
    d, m = len(numbers), np.eye(len(numbers))
    score = lambda x: np.column_stack([probit_array(np.clip(way(x[:, j]), 1e-4, 0.9999)) for j, way in enumerate(ways)])
    s = scored_products(df, numbers, score)
    for i in range(d):
        for j in range(i):
            m[i, j] = m[j, i] = float(np.clip(s[0, i, j] / max(1.0, s[3, i, j] - 1), -0.99, 0.99))
    lower = cholesky_psd(m)
    base = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    out = base.withColumns({f"_g{j}": gaussian(seed, F.col("row_id"), f"g{j}") for j in range(d)})
    values = running_sums(melt(df, numbers, [rid]).withColumn("one", F.lit(1)), ["c"], ["x", rid], ["one"]).select("c", "x", (F.col("one_upto") - 1).alias("place"), "one_all")
    for i, c in enumerate(numbers):
        z = sum((F.lit(float(lower[i, j])) * F.col(f"_g{j}") for j in range(i + 1)), F.lit(0.0))
        size = cells.total(c, "n") if c in cells.place else 0
        own = values.where(F.col("c") == c).select("place", F.round("x", 4).alias(c))
        out = out.withColumn("place", F.least(F.floor(normal_cdf(z) * size), F.lit(size - 1)).cast("bigint")).join(own, "place", "left").drop("place")
    rows = ranked(df.withColumn("_all", F.lit("all")), "_all", rid).select("rank0", F.col("rid").alias(rid)).join(df.select(rid, *labels), rid)
    total = one_row(rows.agg(F.count(F.lit(1)).alias("n")))["n"]
    for c in labels:
        out = out.withColumn("rank0", F.floor(uniform(seed, F.col("row_id"), f"label_{c}") * total)).join(rows.select("rank0", c), "rank0", "left").drop("rank0")
    return out.select("row_id", *numbers, *labels)


def bandwidths(df: DataFrame, columns: list[str], multiplier: float = 1.0) -> DataFrame:
    """(c, h): Silverman's 0.9 min(s, IQR / 1.34) n^-0.2; the deviation alone where the quartiles meet."""
    q = column_quantiles(df, columns, [0.25, 0.75])
    s = melt(df, columns).groupBy("c").agg(F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("s"))
    iqr = (F.col("q1") - F.col("q0")) / 1.34
    spread = F.when(iqr > 0, F.least("s", iqr)).otherwise(F.col("s"))
    return q.join(s, "c").select("c", (0.9 * spread * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * multiplier).alias("h"))


def _resample(df: DataFrame, numbers: list[str], n: int, seed: int, rid: str, alone: bool) -> DataFrame:
    """n rows of random rows of df; with `alone` each column from a row of its own."""
    rank = ranked(df.withColumn("_all", F.lit("all")), "_all", rid).select("rank0", F.col("rid").alias(rid))
    base = rank.join(df.select(rid, *numbers), rid)
    total = one_row(base.agg(F.count(F.lit(1)).alias("n")))["n"]
    out = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    if not alone:
        return out.withColumn("rank0", F.floor(uniform(seed, F.col("row_id"), "row") * total)).join(base.drop(rid), "rank0").drop("rank0")
    for c in numbers:
        out = out.withColumn("rank0", F.floor(uniform(seed, F.col("row_id"), f"row_{c}") * total)).join(base.select("rank0", c), "rank0").drop("rank0")
    return out


def kde(df: DataFrame, numbers: list[str], labels: list[str], n: int, rid: str, seed: int = 42, multiplier: float = 1.0) -> DataFrame:
    """(row_id, numbers, labels): a random value of each column plus normal noise at its bandwidth."""
    h = {r.c: r.h for r in bandwidths(df, numbers, multiplier).collect()}
    t = _resample(df, numbers, n, seed, rid, alone=True)
    new = t.select("row_id", *[F.round(F.col(c) + gaussian(seed, F.col("row_id"), f"h_{c}") * F.lit(float(h.get(c, 0.0))), 4).alias(c) for c in numbers])
    return with_draws(new, df, labels, seed)


def jitter(df: DataFrame, numbers: list[str], n: int, rid: str, seed: int = 42, jitter_std: float = 0.05) -> DataFrame:
    """(row_id, numbers): random rows with normal noise of `jitter_std` deviations."""
    sd = one_row(df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in numbers]))
    t = _resample(df, numbers, n, seed, rid, alone=False)
    return t.select("row_id", *[F.round(F.col(c) + gaussian(seed, F.col("row_id"), c) * sd[c] * jitter_std, 4).alias(c) for c in numbers])


def interpolate(df: DataFrame, numbers: list[str], n: int, rid: str, seed: int = 42, k: int = 5) -> DataFrame:
    """(row_id, numbers): between a random row and one of its k nearest, classes apart from."""
    rank = ranked(df.withColumn("_all", F.lit("all")), "_all", rid)
    total = one_row(rank.agg(F.count(F.lit(1)).alias("n")))["n"]
    draws = df.sparkSession.range(n).withColumnRenamed("id", "row_id").withColumn("rank0", F.floor(uniform(seed, F.col("row_id"), 0) * total)).join(rank.select("rank0", "rid"), "rank0")
    asked = df.join(draws.select(F.col("rid").alias(rid)).distinct(), rid, "left_semi")
    near = nearest_rows(asked, df, rid, rid, numbers, [], column_ranges(df, numbers), k, exclude_self=True)
    t = draws.withColumn("rank", F.floor(uniform(seed, F.col("row_id"), 1) * k) + 1).join(near.select(F.col("qid").alias("rid"), F.col("rid").alias("nid"), "rank"), ["rid", "rank"])
    a = df.select(F.col(rid).alias("rid"), *[F.col(c).alias(f"a_{c}") for c in numbers])
    b = df.select(F.col(rid).alias("nid"), *[F.col(c).alias(f"b_{c}") for c in numbers])
    alpha = uniform(seed, F.col("row_id"), 2)
    return t.join(a, "rid").join(b, "nid").select("row_id", *[F.round(F.col(f"a_{c}") + alpha * (F.col(f"b_{c}") - F.col(f"a_{c}")), 4).alias(c) for c in numbers])


def network_parents(mi: dict[tuple[str, str], float], columns: list[str], most: int = 3, least: float = 0.01) -> dict[str, list[str]]:
    """The parents of each column: among its `most` strongest partners above `least`, those that come before it."""
    out = {}
    for i, c in enumerate(columns):
        others = sorted(((mi.get((a, c), mi.get((c, a), 0.0)), a) for a in columns if a != c), key=lambda t: (-t[0], t[1]))
        out[c] = [a for v, a in others[:most] if v > least and columns.index(a) < i]
    return out


def bayes_network(df: DataFrame, numbers: list[str], labels: list[str], n: int, seed: int = 42, bins: int = 5, most: int = 3) -> DataFrame:
    """(row_id, columns): each column drawn from its table given the bins of its parents, numbers uniform inside their bin.
    A combination of parents that was never seen draws from the column's own table."""
    columns = [*numbers, *labels]
    df = df.select(*columns).dropna()
    mi = {(r.a, r.b): r.mi for r in mutual_information(df, columns).collect()}
    parents = network_parents(mi, columns, most)
    ends = df.agg(*[e for c in numbers for e in (F.min(c).cast("double").alias(f"{c}_a"), F.max(c).cast("double").alias(f"{c}_b"))]).first() if numbers else {}
    cut = binned(df, columns, bins)
    out = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    for j, c in enumerate(columns):
        for level, ps in enumerate([parents[c], []] if parents[c] else [[]]):
            key = F.concat_ws("|", *[F.col(p) for p in ps]) if ps else F.lit("")
            counts = cut.groupBy(key.alias("_key"), F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
            w = Window.partitionBy("_key").orderBy("_v")
            shares = counts.select("_key", "_v", (F.sum("_n").over(w) / F.sum("_n").over(Window.partitionBy("_key"))).alias("_p"))
            table = shares.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias(f"_t{level}"))
            if ps:
                out = out.withColumn("_key", F.concat_ws("|", *[F.col(f"_b_{p}") for p in ps])).join(table, "_key", "left").drop("_key")
            else:
                out = out.withColumn(f"_t{level}", one_row(table)[f"_t{level}"])
        levels = 2 if parents[c] else 1
        t = F.coalesce(*[F.col(f"_t{i}") for i in range(levels)])
        drawn = F.get(F.filter(t, lambda e: e["_p"] >= uniform(seed, F.col("row_id"), f"v{j}") - 1e-12), F.lit(0))["_v"]
        out = out.withColumn(f"_b_{c}", drawn).drop(*[f"_t{i}" for i in range(levels)])
    final = [F.col("row_id")]
    for c in numbers:
        a, b = ends[f"{c}_a"], ends[f"{c}_b"]
        final.append(F.round(F.lit(a) + (F.col(f"_b_{c}").cast("double") + uniform(seed, F.col("row_id"), f"in_{c}")) * F.lit((b - a) / bins), 4).alias(c))
    return out.select(*final, *[F.col(f"_b_{c}").alias(c) for c in labels])


def _row_noise(z: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Normal draws, `width` a row, that depend on (seed, values of the row) and on nothing else."""
    def mix(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return v ^ (v >> np.uint64(31))

    key = np.full(len(z), seed, np.uint64)
    for j in range(z.shape[1]):
        key = mix(key + np.uint64(0x9E3779B97F4A7C15) + np.ascontiguousarray(z[:, j]).view(np.uint64))
    u = [(mix(key[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(first, first + width, dtype=np.uint64)) >> np.uint64(11)) / 2.0**53 for first in (1, 1 + width)]
    return np.sqrt(-2 * np.log(np.maximum(u[0], 1e-12))) * np.cos(2 * np.pi * u[1])


def _gradient(z: np.ndarray, w: dict[str, np.ndarray], eps: np.ndarray) -> np.ndarray:
    """The sums over the rows of z of the gradients of the weights, one after the other."""
    h = np.tanh(z @ w["e"])
    m, lv = h @ w["m"], np.clip(h @ w["v"], -6, 6)
    c = m + np.exp(lv / 2) * eps
    hd = np.tanh(c @ w["d"])
    err = hd @ w["o"] - z
    dh = (err @ w["o"].T) * (1 - hd**2)
    dc = dh @ w["d"].T
    dm, dv = dc + 0.01 * m, dc * eps * np.exp(lv / 2) / 2 + 0.005 * (np.exp(lv) - 1)
    g = {"o": hd.T @ err, "d": c.T @ dh, "m": h.T @ dm, "v": h.T @ dv, "e": z.T @ ((dm @ w["m"].T + dv @ w["v"].T) * (1 - h**2))}
    return np.concatenate([g[k].ravel() for k in w])


def autoencoder(df: DataFrame, numbers: list[str], n: int, seed: int = 42, latent: int = 4, epochs: int = 50, rate: float = 0.01) -> DataFrame:
    """(row_id, numbers): decoded from a normal latent space by a small variational autoencoder. Means, deviations and the gradients of
    each epoch are sums over all rows without a missing number, added up by the tasks that hold them; one job an epoch. Decoding runs on
    all executors. No rows come out where there are none to fit on."""
    part = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(numbers)]).dropna()
    d, hidden = len(numbers), 16
    r = part.agg(F.count(F.lit(1)).alias("n"), *[e for j in range(d) for e in (F.avg(f"x{j}").alias(f"m{j}"), F.stddev_pop(f"x{j}").alias(f"s{j}"))]).first()
    mu, sd = np.array([r[f"m{j}"] or 0.0 for j in range(d)]), np.array([r[f"s{j}"] or 1.0 for j in range(d)])
    spread = max(df.sparkSession.sparkContext.defaultParallelism, r.n // 1_000_000)
    rows = materialize(part.select(*[((F.col(f"x{j}") - F.lit(float(mu[j]))) / F.lit(float(sd[j]))).alias(f"z{j}") for j in range(d)]).repartition(spread), "standardised")
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.3, s) for k, s in {"e": (d, hidden), "m": (hidden, latent), "v": (hidden, latent), "d": (latent, hidden), "o": (hidden, d)}.items()}
    velocity = {k: np.zeros_like(a) for k, a in w.items()}

    def adder(w: dict[str, np.ndarray], epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum(a.size for a in w.values()))
            for b in batches:
                if b.num_rows:
                    z = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in b.columns])
                    total += _gradient(z, w, _row_noise(z, latent, seed + epoch))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

        return run

    for epoch in range(epochs if r.n else 0):
        added = rows.mapInArrow(adder(dict(w), epoch), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(sum(a.size for a in w.values()))
        for x in added:
            flat[x.i] = x.v / r.n
        at = 0
        for k in w:
            velocity[k] = 0.9 * velocity[k] - rate * flat[at : at + w[k].size].reshape(w[k].shape) * 10
            at += w[k].size
            w[k] = w[k] + velocity[k]
    n = n if r.n else 0
    decode = [w["d"], w["o"], mu, sd]
    codes = df.sparkSession.range(n).select(F.col("id").alias("row_id"), *[gaussian(seed, F.col("id"), f"z{j}").alias(f"z{j}") for j in range(latent)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.tanh(b[[f"z{j}" for j in range(latent)]].to_numpy() @ decode[0]) @ decode[1] * decode[3] + decode[2]
            yield pd.DataFrame({"row_id": b["row_id"]} | {c: np.round(x[:, i], 4) for i, c in enumerate(numbers)})

    return codes.mapInPandas(run, "row_id bigint, " + ", ".join(f"`{c}` double" for c in numbers))


def synthesize(df: DataFrame, algorithm: str, n: int, rid: str, numbers: list[str], labels: list[str] | None = None, seed: int = 42, **params) -> DataFrame:
    """Dispatch by name: copula, copula_service, kde, bayes_network, jitter (gaussian_jitter), smote, autoencoder (vae)."""
    labels = labels or []
    if algorithm == "copula":
        return copula(df, numbers, labels, n, seed, **params) if numbers else jitter(df, numbers, n, rid, seed)
    if algorithm == "copula_service":
        return copula_service(df, numbers, labels, n, rid, seed, **params)
    if algorithm == "kde":
        return kde(df, numbers, labels, n, rid, seed, **params)
    if algorithm == "bayes_network":
        return bayes_network(df, numbers, labels, n, seed, **params)
    if algorithm in ("jitter", "gaussian_jitter"):
        return jitter(df, numbers, n, rid, seed, **params)
    if algorithm in ("smote", "interpolate"):
        return interpolate(df, numbers, n, rid, seed, **params)
    if algorithm in ("autoencoder", "vae"):
        return autoencoder(df, numbers, n, seed, **params)
    raise ValueError(f"unknown algorithm {algorithm!r}")
