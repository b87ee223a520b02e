"""Column-level quality profile of every load of a table, and what changed since the load before.

One scan cuts every row into cells and pre-aggregates them by (load, column, form): the form of a code is its shape, of a
label its cleaned spelling, of a number the bucket of an order-preserving grid. A second scan counts values and adds up exact, mergeable
power sums, distincts and violations of patterns. Both end in one table, the profile, whose size follows the number of loads and not
the number of rows. column_profile() shows it; column_defects() takes its issues from it, with two-sided bounds on the Kolmogorov
distance between neighbouring loads from the counted forms. Only the buckets where those bounds leave the verdict open are read again
value by value, so the verdict is exact without sorting the values of a column anywhere.

A hot load or account is harmless: the first aggregation combines on the map side and no window runs over rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from math import ceil, comb, floor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabweave.functions.missing import ALL_TOKENS, bare, number_missing, text_missing
from tabweave.plans.physical import materialize, pin

#: Numbers from here on, and those with more than six digits after the point, have no exact sums; ODD stands for their digits.
LARGEST, ODD = 1e10, 9
#: Powers of d = u x LIMB + v as sums of products: for each power k, (times u, times v) of its terms, whose factor is a binomial.
LIMB = 100_000_000
TERMS = [(k, i, k - i) for k in (2, 3, 4) for i in range(k + 1)]
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


@dataclass(frozen=True)
class Limits:
    """Beyond which a difference is a defect; the defaults are the project's."""

    nulls: float = 0.101
    range_factor: float = 5.001
    drift: float = 0.301
    label_drift: float = 0.201
    shape: float = 0.0101


@dataclass(frozen=True)
class Layout:
    """Which columns are profiled and how. `numbers`: negative values are missing unless `negative_ok` or the column is `signed`. `codes`:
    one shape is expected. `patterns`: per column a regex that every present value should match in full. `times`: timestamps, which only
    column_profile() reads."""

    group: str = "dataset_id"
    load: str = "load_no"
    codes: tuple[str, ...] = ("account_id", "plan_code")
    numbers: tuple[str, ...] = ("account_age_months", "monthly_charges", "usage_hours", "support_tickets")
    labels: tuple[str, ...] = ("contract_type", "churn_risk")
    negative_ok: bool = False
    signed: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    tokens: tuple[str, ...] = ALL_TOKENS
    patterns: dict[str, str] = field(default_factory=dict)
    #: Buckets to each unit of ln(1 + |x|), and decimals kept by the exact power sums.
    resolution: int = 16
    scale: int = 6

    @property
    def columns(self) -> list[str]:
        return [*self.codes, *self.numbers, *self.labels]

    def lacks_negatives(self, name: str) -> bool:
        return not (self.negative_ok or name in self.signed)


def shape_of(c: Column) -> Column:
    """Every A-Z as A, a-z as a, 0-9 as 9, all else as it stands."""
    return F.translate(c, UPPER + LOWER + DIGITS, "A" * 26 + "a" * 26 + "9" * 10)


def bucket_of(x: Column, resolution: int) -> Column:
    """An integer that never falls as `x` rises; infinities get the outermost ones."""
    grid = F.floor(F.least(F.log1p(F.abs(x)), F.lit(1e6)) * resolution)
    return F.when(x < 0, -1 - grid).when(x >= 0, grid)


#: Columns cut to cells in one projection. More would make one method that the JVM does not compile (over 8,000 bytes of code) and then
#: takes five times as long; each part of the union reads its own columns only.
AT_ONCE = 3


def _melted(df: DataFrame, lay: Layout, columns: list[str], fields: Callable[[str, Column], list[Column]]) -> DataFrame:
    """(g, l, c, fields): one row a cell of `columns`; c is the place in the layout. Rows without a group or load are left out."""
    g, l = F.col(f"`{lay.group}`"), F.col(f"`{lay.load}`")
    own = [(i, name) for i, name in enumerate(lay.columns) if name in columns]
    parts = []
    for at in range(0, len(own), AT_ONCE):
        cells = F.array(*[F.struct(F.lit(i).cast("int").alias("c"), *fields(name, F.col(f"`{name}`"))) for i, name in own[at : at + AT_ONCE]])
        parts.append(df.where(g.isNotNull() & l.isNotNull()).select(g.alias("g"), l.alias("l"), F.explode(cells).alias("e")).select("g", "l", "e.*"))
    return reduce(DataFrame.unionByName, parts)


def _cells(df: DataFrame, lay: Layout, columns: list[str]) -> DataFrame:
    """One row a cell: g, l, c (place in the layout), x (number), b (bucket), f (form). All null where missing."""
    def fields(name: str, c: Column) -> list[Column]:
        if name in lay.numbers:
            x = c.cast("double")
            x = F.when(~number_missing(x, lay.lacks_negatives(name)), x + F.lit(0.0))
            return [x.alias("x"), bucket_of(x, lay.resolution).alias("b"), F.lit(None).cast("string").alias("f")]
        f = F.when(~text_missing(c, lay.tokens), bare(c) if name in lay.labels else shape_of(c))
        return [F.lit(None).cast("double").alias("x"), F.lit(None).cast("bigint").alias("b"), f.alias("f")]

    return _melted(df, lay, columns, fields)


def form_counts(df: DataFrame, lay: Layout = Layout()) -> DataFrame:
    """(g, l, c, b, f): n, lo, hi; decimals, the most digits after the point of the numbers that are whole multiples of 10^-6 and below
    LARGEST, and odd, the count of the others."""
    x = F.col("x")
    whole = lambda d: F.rint(x * 10.0**d) / 10.0**d == x
    digits = F.when(x.isNotNull(), F.when(F.abs(x) >= LARGEST, ODD).when(x == F.rint(x), 0).when(whole(2), 2).when(whole(4), 4).when(whole(6), 6).otherwise(ODD))
    cells = _cells(df, lay, lay.columns).withColumn("digits", digits)
    return cells.groupBy("g", "l", "c", "b", "f").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max(F.when(F.col("digits") < ODD, F.col("digits"))).alias("decimals"), F.count(F.when(F.col("digits") == ODD, 1)).alias("odd"))


@dataclass(frozen=True)
class Scale:
    """How the numbers of a column become whole ones for exact sums: d = round(x 10^decimals) - shift, at most `reach` in size, whose
    square is cut into h x limb + w. A sum has at most `rows` terms."""

    decimals: int
    shift: int
    reach: int
    rows: int

    @property
    def limb(self) -> int:
        return max(1, self.reach)

    @property
    def way(self) -> str:
        """short; long: the sums pass 64 bits; wide: so do squares, and all products are decimals."""
        return "wide" if self.reach >= 2**31 - 2 else "short" if 2 * (self.reach + 1) ** 2 * self.rows < 2**62 else "long"


def scales_of(counts: DataFrame) -> dict[int, Scale]:
    """By column number, from form_counts(): one row a column reaches the driver."""
    sizes = counts.groupBy("g", "l", "c").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("decimals").alias("decimals"), F.min(F.when(F.col("lo") > -LARGEST, F.col("lo"))).alias("a"), F.max(F.when(F.col("hi") < LARGEST, F.col("hi"))).alias("b"))
    out = {}
    for r in sizes.where("lo IS NOT NULL").groupBy("c").agg(F.max("n").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("decimals").alias("decimals")).collect():
        if r.decimals is not None:
            lo, hi = (max(-LARGEST, min(LARGEST, v if v is not None else e)) for v, e in ((r.a, -LARGEST), (r.b, LARGEST)))
            lo, hi = floor(lo * 10**r.decimals), ceil(hi * 10**r.decimals)
            shift = (lo + hi) // 2
            out[r.c] = Scale(r.decimals, shift, max(hi - shift, shift - lo, 1), r.n)
    return out


#: The sums of products by the columns' way of adding up, with how each goes into the sum of the power k.
SHORT = ["d", "h", "w", "dh", "dw", "hh", "hw", "ww"]


def value_sums(df: DataFrame, lay: Layout, scales: dict[int, Scale]) -> DataFrame:
    """(g, l, c): distinct present values, violations of patterns, and exact sums over the rows of products of the whole numbers d of a
    column, its square's parts h and w (see Scale).

    Values are counted first, so patterns and products are worked out once a distinct value. The sums are whole numbers, exact and
    the same in any order of merging; central_moments() makes sums of powers of any size of them. Numbers that are no multiple of 10^-6
    or too large are left to loose_moments().
    """
    def fields(name: str, c: Column) -> list[Column]:
        if name in lay.numbers:
            x = c.cast("double")
            return [F.when(~number_missing(x, lay.lacks_negatives(name)), x + F.lit(0.0)).alias("x"), F.lit(None).cast("string").alias("v")]
        return [F.lit(None).cast("double").alias("x"), F.when(~text_missing(c, lay.tokens), c.cast("string")).alias("v")]

    parts = []
    for way in ("text", "short", "long", "wide"):
        columns = [name for i, name in enumerate(lay.columns) if (scales[i].way if i in scales else "text") == way]
        if columns:
            each = _melted(df, lay, columns, fields).where("x IS NOT NULL OR v IS NOT NULL").groupBy("g", "l", "c", "x", "v").agg(F.count(F.lit(1)).alias("n"))
            parts.append(_added(each, lay, scales, way))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _added(each: DataFrame, lay: Layout, scales: dict[int, Scale], way: str) -> DataFrame:
    """The figures of value_sums() of the columns that are added up in this way, out of counted values."""
    wrong = F.lit(False)
    for name, pattern in lay.patterns.items():
        wrong = wrong | ((F.col("c") == lay.columns.index(name)) & ~F.rlike(F.coalesce("v", F.col("x").cast("string")), F.lit(rf"^(?:{pattern})\z")))

    def of(value, default: int) -> Column:
        return F.element_at(F.array(*[F.lit(value(scales[i]) if i in scales else default).cast("bigint") for i in range(len(lay.columns))]), F.col("c") + 1)

    x, n = F.col("x"), F.col("n")
    unit = F.element_at(F.array(*[F.lit(10.0 ** scales[i].decimals if i in scales else 1.0) for i in range(len(lay.columns))]), F.col("c") + 1)
    fits = (F.abs(x) < LARGEST) & F.col("c").isin(*scales) if scales else F.lit(False)
    aggs = [F.count(F.lit(1)).alias("distinct"), F.sum(F.when(wrong, n).otherwise(0)).alias("violations")]
    if way == "text":
        return each.groupBy("g", "l", "c").agg(*aggs)
    each = each.withColumn("d", F.when(fits, F.rint(x * unit).cast("bigint") - of(lambda s: s.shift, 0)))
    whole = lambda e: e.cast("decimal(20,0)")
    d = F.col("d")
    if way == "wide":  # d = u x LIMB + v, every product of powers of u and v apart
        each = each.withColumn("u", F.expr(f"d div {LIMB}L")).withColumn("w", d - F.col("u") * LIMB)
        u, v = F.col("u"), F.col("w")
        uu, uv, vv = u * u, u * v, v * v
        product = {(2, 0): whole(uu), (1, 1): whole(uv), (0, 2): whole(vv), (3, 0): whole(uu) * whole(u), (2, 1): whole(uu) * whole(v), (1, 2): whole(vv) * whole(u), (0, 3): whole(vv) * whole(v),
                   (4, 0): whole(uu) * whole(uu), (3, 1): whole(uu) * whole(uv), (2, 2): whole(uu) * whole(vv), (1, 3): whole(vv) * whole(uv), (0, 4): whole(vv) * whole(vv)}
        aggs.append(F.sum(whole(d) * whole(n)).alias("t1_1"))
        for p, i, j in TERMS:
            e = product[i, j].cast("decimal(38,0)")
            aggs.append(F.try_sum(F.when(n == 1, e).otherwise(F.try_multiply(e, whole(n)))).alias(f"t{p}_{i}"))
        return each.groupBy("g", "l", "c").agg(*aggs)
    each = each.withColumn("k", of(lambda s: s.limb, 1)).withColumn("h", F.expr("(d * d) div k")).withColumn("w", d * d - F.col("h") * F.col("k"))
    h, w = F.col("h"), F.col("w")
    for name, e in {"d": d, "h": h, "w": w, "dh": d * h, "dw": d * w, "hh": h * h, "hw": h * w, "ww": w * w}.items():
        if way == "short":
            aggs.append(F.sum(n * e).alias(f"a_{name}"))
        else:
            aggs.append(F.sum(F.when(n == 1, whole(e).cast("decimal(38,0)")).otherwise(F.try_multiply(whole(e), whole(n)).cast("decimal(38,0)"))).alias(f"b_{name}"))
    return each.groupBy("g", "l", "c").agg(*aggs)


def central_moments(scales: dict[int, Scale], names: list[str]):
    """(mean, m2, m3, m4) out of c, a count and the sums of value_sums(), called `names`: sums of powers of the distance from the mean,
    in whole numbers of any size until the last division, so that values far from zero keep all their digits. Null where a sum passed 38
    digits. Runs on one row a (load, column)."""
    binomial = {(k, i): comb(k, i) * LIMB**i for k, i, _ in TERMS}

    def powers(c: int, t: dict[str, int]) -> tuple[int, int, int, int] | None:
        s = scales[c]
        try:
            if s.way == "wide":
                return (t["t1_1"], *[sum(binomial[k, i] * t[f"t{k}_{i}"] for i in range(k + 1)) for k in (2, 3, 4)])
            d, h, w, dh, dw, hh, hw, ww = (t[("a_" if s.way == "short" else "b_") + k] for k in SHORT)
        except KeyError:
            return None
        k = s.limb
        return d, k * h + w, k * dh + dw, k * k * hh + 2 * k * hw + ww

    def one(c: int, n: int, t: dict[str, int]) -> tuple:
        p = powers(c, t)
        if p is None:
            return (None,) * 4
        s, s1, s2, s3, s4 = scales[c], *p
        unit = 10**s.decimals
        m2 = n * s2 - s1**2
        m3 = n * n * s3 - 3 * n * s1 * s2 + 2 * s1**3
        m4 = n**3 * s4 - 4 * n * n * s1 * s3 + 6 * n * s1**2 * s2 - 3 * s1**4
        return (s1 + n * s.shift) / (n * unit), m2 / (n * unit**2), m3 / (n * n * unit**3), m4 / (n**3 * unit**4)

    def run(c: pd.Series, n: pd.Series, *sums: pd.Series) -> pd.DataFrame:
        rows = []
        for c_, n_, *r in zip(c.tolist(), n.tolist(), *[x.tolist() for x in sums]):
            rows.append((None,) * 4 if pd.isna(n_) or c_ not in scales else one(c_, int(n_), {k: int(v) for k, v in zip(names, r) if not pd.isna(v)}))
        return pd.DataFrame(rows, columns=_MOMENTS.names, dtype="float64")

    return F.pandas_udf(run, _MOMENTS)


_MOMENTS = T.StructType([T.StructField(k, T.DoubleType()) for k in ("mean", "m2", "m3", "m4")])


def loose_moments(df: DataFrame, lay: Layout, origins: dict[str, float]) -> DataFrame:
    """(g, l, c): mean and sums of powers of the distance from it, by merging central moments in floating point: for values that have
    more digits than the exact sums hold. Columns are read as their distance from `origins`. Null where a value is infinite."""
    finite = lambda e: F.when(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), e)
    n = F.col("n")
    origin = F.element_at(F.array(*[F.lit(float(origins.get(c, 0.0))) for c in lay.columns]), F.col("c") + 1)
    x = F.col("x") - origin
    t = _cells(df, lay, list(origins)).where(x.isNotNull()).groupBy("g", "l", "c").agg(F.count(x).cast("double").alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("v"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    v = finite(F.col("v"))
    return t.select("g", "l", "c", (finite(F.col("mean")) + origin).alias("mean"), (v * n).alias("m2"), (F.col("g1") * n * F.pow(v, F.lit(1.5))).alias("m3"), ((F.col("g2") + 3) * n * v * v).alias("m4"))


def _with_moments(df: DataFrame, counts: DataFrame, summary: DataFrame, lay: Layout) -> DataFrame:
    """`summary` with distinct, violations, inexact, mean and m2 to m4 of each (g, l, c)."""
    scales = scales_of(counts)
    sums = value_sums(df, lay, scales)
    names = [c for c in sums.columns if c not in ("g", "l", "c", "distinct", "violations")]
    t = summary.join(sums, ["g", "l", "c"], "left").withColumn("n", F.when(F.col("inexact") == 0, F.nullif(F.col("present"), F.lit(0))).cast("bigint"))
    # As decimals: a column of 64-bit numbers with nulls would reach Python as doubles.
    t = pin(t, "m", central_moments(scales, names)("c", "n", *[F.col(k).cast("decimal(38,0)") for k in names])).drop("n", *names)
    t = materialize(t, "profile")
    # Lost: a sum passed 38 digits.
    t = t.withColumn("inexact", F.when(F.col("m.mean").isNull() & (F.col("inexact") == 0) & F.col("lo").isNotNull(), F.col("present")).otherwise(F.col("inexact")))
    some = F.when(F.abs("lo") < F.lit(float("inf")), F.col("lo"))
    odd = {lay.columns[r.c]: r.at or 0.0 for r in t.where("inexact > 0").groupBy("c").agg(F.avg(some).alias("at")).collect()}
    if odd:
        own = loose_moments(df, lay, odd).select("g", "l", "c", F.struct("mean", "m2", "m3", "m4").alias("loose"))
        t = t.join(own, ["g", "l", "c"], "left").withColumn("m", F.when(F.col("inexact") > 0, F.col("loose")).otherwise(F.col("m"))).drop("loose")
    return t.select("*", "m.*").drop("m")


def _with_neighbours(summary: DataFrame) -> DataFrame:
    """Adds the load before (suffix 0) and the number of the next, per column."""
    w = Window.partitionBy("g", "c").orderBy("l")
    return summary.select("*", *[F.lag(k).over(w).alias(f"{k}0") for k in ("l", "rows", "present", "hi", "lo")], F.lead("l").over(w).alias("next_l"), F.lead("present").over(w).alias("next_present"))


def summaries(counts: DataFrame, lay: Layout = Layout()) -> DataFrame:
    """(g, l, c): rows, present, lo, hi, and the count of the most frequent form, with the load before beside them."""
    there = F.col("b").isNotNull() | F.col("f").isNotNull()
    base = counts.groupBy("g", "l", "c").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("present"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max(F.when(F.col("f").isNotNull(), F.col("n"))).alias("top"), *([F.sum("odd").alias("inexact")] if "odd" in counts.columns else []))
    return _with_neighbours(base)


def _pairs(counts: DataFrame, summary: DataFrame) -> DataFrame:
    """(g, l, c, b, f): l0, the load before, n1 of the load itself and n0 of the load before, with both totals; loads without one before are left out."""
    s = summary.select("g", "l", "c", "l0", "next_l", F.col("present").alias("m"), F.col("present0").alias("m0"), F.col("next_present").alias("m2"))
    joined = counts.where(F.col("b").isNotNull() | F.col("f").isNotNull()).select("g", "l", "c", "b", "f", "n", "lo", "hi").join(s, ["g", "l", "c"])
    zero = F.lit(0).cast("bigint")
    own = F.struct(F.col("l").alias("l"), F.col("l0").alias("l0"), F.col("n").alias("n1"), zero.alias("n0"), F.col("m").alias("m1"), F.col("m0").alias("m0"))
    next_ = F.struct(F.col("next_l").alias("l"), F.col("l").alias("l0"), zero.alias("n1"), F.col("n").alias("n0"), F.col("m2").alias("m1"), F.col("m").alias("m0"))
    roles = F.filter(F.array(F.when(F.col("l0").isNotNull(), own), F.when(F.col("next_l").isNotNull(), next_)), lambda r: r.isNotNull())
    return joined.select("g", "c", "b", "f", "lo", "hi", F.explode(roles).alias("r")).groupBy("g", F.col("r.l").alias("l"), "c", "b", "f").agg(
        F.max("r.l0").alias("l0"), F.sum("r.n1").alias("n1"), F.sum("r.n0").alias("n0"), F.max("r.m1").alias("m1"), F.max("r.m0").alias("m0"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def label_distances(pairs: DataFrame) -> DataFrame:
    """(g, l, c, distance): half the sum of absolute differences of shares, for columns with forms."""
    gap = F.abs(F.col("n1") / F.col("m1") - F.col("n0") / F.col("m0"))
    return pairs.where(F.col("f").isNotNull() & (F.col("m1") > 0) & (F.col("m0") > 0)).groupBy("g", "l", "c").agg((F.sum(gap) / 2).alias("distance"))


def _bounds(pairs: DataFrame) -> DataFrame:
    """One row a bucket: d at its upper end, top beyond which no value inside it can go, and the counts before it."""
    w = Window.partitionBy("g", "l", "c").orderBy("b")
    p = pairs.where(F.col("b").isNotNull() & (F.col("m1") > 0) & (F.col("m0") > 0)).select("*", F.sum("n1").over(w).alias("c1"), F.sum("n0").over(w).alias("c0"))
    f1, f0 = F.col("c1") / F.col("m1"), F.col("c0") / F.col("m0")
    g1, g0 = (F.col("c1") - F.col("n1")) / F.col("m1"), (F.col("c0") - F.col("n0")) / F.col("m0")
    end = F.abs(f1 - f0)
    return p.withColumn("d", end).withColumn("top", F.when(F.col("lo") == F.col("hi"), end).otherwise(F.greatest(f1 - g0, f0 - g1)))


def drift_distances(df: DataFrame, pairs: DataFrame, lay: Layout, limit: float | None) -> DataFrame:
    """(g, l, c, distance) of numeric columns, exact against `limit`: a column is read again only in buckets that can lift it past
    the limit, so that distance > limit holds exactly where it does for the true distance. With `limit` None every bucket that can
    lift the distance found at bucket ends is read, and the distance itself is exact.
    """
    b = _bounds(pairs)
    best = Window.partitionBy("g", "l", "c")
    b = b.withColumn("best", F.max("d").over(best))
    coarse = b.groupBy("g", "l", "c").agg(F.max("d").alias("distance"))
    open_ = F.col("top") > F.col("best") if limit is None else (F.col("best") <= limit) & (F.col("top") > limit)
    todo = b.where(open_)
    roles = F.explode(F.array(F.struct(F.col("l").alias("at"), F.lit(1).alias("one")), F.struct(F.col("l0").alias("at"), F.lit(0).alias("one"))))
    s = todo.select("g", "l", "c", "b", "m1", "m0", (F.col("c1") - F.col("n1")).alias("a1"), (F.col("c0") - F.col("n0")).alias("a0"), roles.alias("r"))
    asked = s.select(F.col("g").alias("qg"), F.col("r.at").alias("ql"), F.col("c").alias("qc"), F.col("b").alias("qb"), "l", "m1", "m0", "a1", "a0", F.col("r.one").alias("one"))
    cells = _cells(df, lay, list(lay.numbers)).where(F.col("b").isNotNull()).select(F.col("g"), F.col("l").alias("load"), "c", "b", "x")
    hit = cells.join(asked, (F.col("g") == F.col("qg")) & (F.col("load") == F.col("ql")) & (F.col("c") == F.col("qc")) & (F.col("b") == F.col("qb")))
    values = hit.groupBy("g", "l", "c", "b", "x").agg(
        F.sum("one").alias("v1"), F.sum(1 - F.col("one")).alias("v0"), *[F.max(k).alias(k) for k in ("m1", "m0", "a1", "a0")])
    w = Window.partitionBy("g", "l", "c", "b").orderBy("x")
    gap = F.abs((F.col("a1") + F.sum("v1").over(w)) / F.col("m1") - (F.col("a0") + F.sum("v0").over(w)) / F.col("m0"))
    fine = values.select("g", "l", "c", gap.alias("distance"))
    return coarse.unionByName(fine).groupBy("g", "l", "c").agg(F.max("distance").alias("distance"))


def _named(lay: Layout, c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in lay.columns]), c + 1)


def column_defects(df: DataFrame, stored: DataFrame | None, lay: Layout = Layout(), limits: Limits = Limits()) -> DataFrame:
    """(group, load, column_name, issue, amount, mean_shift): the columns of `df` with a defect. All come out of the profile of the load;
    mean_shift is the standardised difference of means since the load before (null for text).

    issue is one of
      nulls   the share of missing values moved by more than limits.nulls since the load before;
      range   the largest value is more than limits.range_factor times the largest before;
      drift   the distributions of the two loads differ by more than limits.drift (largest distance of the cumulative
              distributions) or, for labels, limits.label_drift (half the sum of differences of shares);
      shape   more than limits.shape of the present codes are not of the load's most frequent shape;
      stored  `stored` (group, load, column_name, null_count, min_value, max_value) has the column with other figures.
    The load before is the next lower load number there is. Repeated rows count as often as they come; a load or column with
    no present value has no range, drift or shape; an empty table has no defect. Rows without a group or load belong to none and are
    left out. Other columns of either table are ignored, whatever their names.
    """
    counts = materialize(form_counts(df, lay), "forms")
    summary = materialize(_shaped(_with_moments(df, counts, summaries(counts, lay), lay)), "summaries")
    pairs = materialize(_pairs(counts, summary), "pairs")
    found = []
    share = lambda r, p: (r - p) / r
    moved = F.abs(share(F.col("rows"), F.col("present")) - share(F.col("rows0"), F.col("present0")))
    code = F.col("c") < len(lay.codes)
    odd = (F.col("present") - F.col("top")) / F.nullif(F.col("present"), F.lit(0))
    for issue, amount, wrong in (
        ("nulls", moved, moved > limits.nulls),
        ("range", F.col("hi") / F.nullif(F.col("hi0"), F.lit(0.0)), F.col("hi") > limits.range_factor * F.col("hi0")),
        ("shape", odd, code & (odd > limits.shape)),
    ):
        found.append((issue, amount, wrong))
    flags = F.filter(F.array(*[F.when(wrong, F.struct(F.lit(issue).alias("issue"), amount.cast("double").alias("amount"))) for issue, amount, wrong in found]), lambda z: z.isNotNull())
    result = summary.select("g", "l", "c", F.explode(flags).alias("i")).select("g", "l", "c", "i.issue", "i.amount")
    drift = drift_distances(df, pairs, lay, limits.drift).where(F.col("distance") > limits.drift)
    labels = label_distances(pairs).where((F.col("distance") > limits.label_drift) & (F.col("c") >= len(lay.codes) + len(lay.numbers)))
    for d in (drift, labels):
        result = result.unionByName(d.select("g", "l", "c", F.lit("drift").alias("issue"), F.col("distance").alias("amount")))
    result = result.withColumn("column_name", _named(lay, F.col("c")))
    if stored is not None:
        kept = stored.select(F.col(lay.group).alias("g"), F.col(lay.load).alias("l"), F.col("column_name"), *[F.col(k).cast("double").alias(k) for k in ("null_count", "min_value", "max_value")])
        own = summary.select("g", "l", _named(lay, F.col("c")).alias("column_name"), (F.col("rows") - F.col("present")).cast("double").alias("missing"), "lo", "hi")
        wrong = ~(F.col("null_count").eqNullSafe(F.col("missing")) & F.col("min_value").eqNullSafe(F.col("lo")) & F.col("max_value").eqNullSafe(F.col("hi")))
        bad = own.join(kept, ["g", "l", "column_name"]).where(wrong).select("g", "l", "column_name", F.abs(F.col("null_count") - F.col("missing")).alias("amount")).groupBy("g", "l", "column_name").agg(F.max("amount").alias("amount"))
        result = result.select("g", "l", "column_name", "issue", "amount").unionByName(bad.select("g", "l", "column_name", F.lit("stored").alias("issue"), "amount"))
    shifts = summary.select("g", "l", _named(lay, F.col("c")).alias("column_name"), "mean_shift")
    result = result.select("g", "l", "column_name", "issue", "amount").join(shifts, ["g", "l", "column_name"])
    return result.select(F.col("g").alias(lay.group), F.col("l").alias(lay.load), "column_name", "issue", "amount", "mean_shift")


def _timed(df: DataFrame, lay: Layout) -> tuple[DataFrame, Layout, dict[str, int]]:
    """`df` with its `times` as signed numbers, seconds after the whole second next to the column's mean; the layout for it; those seconds."""
    if not lay.times:
        return df, lay, {}
    micros = {c: F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(f"`{c}`")).cast("timestamp") if dict(df.dtypes)[c] == "timestamp_ntz" else F.col(f"`{c}`")) for c in lay.times}
    means = df.agg(*[F.avg(m / 1e6).alias(c) for c, m in micros.items()]).first()
    origin = {c: round(means[c] or 0) for c in lay.times}
    df = df.withColumns({c: (m - F.lit(origin[c] * 1_000_000)) / 1e6 for c, m in micros.items()})
    return df, replace(lay, numbers=(*lay.numbers, *lay.times), signed=(*lay.signed, *lay.times), times=()), origin


def _shaped(t: DataFrame) -> DataFrame:
    """Adds std, skew, kurtosis and mean_shift to the sums of powers in `t`."""
    n = F.col("present").cast("double")
    m2 = F.when(F.col("m2").isNotNull(), F.greatest(F.col("m2"), F.lit(0.0)))
    t = t.withColumn("std", F.when(n >= 2, F.sqrt(m2 / (n - 1))))
    pop = F.nullif(m2 / n, F.lit(0.0))
    flat = F.when(F.col("m2").isNotNull(), F.lit(0.0))
    t = t.withColumn("skew", F.when(n >= 3, F.coalesce(F.sqrt(n * (n - 1)) / (n - 2) * (F.col("m3") / n) / F.pow(pop, F.lit(1.5)), flat)))
    t = t.withColumn("kurtosis", F.when(n >= 4, F.coalesce((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((F.col("m4") / n) / (pop * pop) - 3) + 6), flat)))
    w = Window.partitionBy("g", "c").orderBy("l")
    mean0, std0, n0 = (F.lag(k).over(w) for k in ("mean", "std", "present"))
    pooled = F.sqrt((F.pow(F.col("std"), F.lit(2.0)) * (n - 1) + F.pow(std0, F.lit(2.0)) * (n0 - 1)) / (n + n0 - 2))
    return t.withColumn("mean_shift", F.when((n >= 2) & (n0 >= 2), (F.col("mean") - mean0) / F.nullif(pooled, F.lit(0.0)))).drop("m2", "m3", "m4")


def column_profile(df: DataFrame, lay: Layout = Layout()) -> DataFrame:
    """One row a (group, load, column): rows, missing, distinct, range, moments, violations, shape and change since the load before.

    Moments come from the power sums (mean, sample deviation, adjusted skewness and excess kurtosis); `mean_shift` is the difference
    of means since the load before over the pooled deviation. `distinct` counts present values as they stand. Null where a figure has
    too few values to exist (deviation under 2, skewness under 3, kurtosis under 4 values) or no load comes before. Times are seconds since
    1970 in UTC, summed as their distance from the column's mean, so that their moments keep their digits.
    """
    df, lay, origin = _timed(df, lay)
    back = F.element_at(F.array(*[F.lit(float(origin.get(c, 0))) for c in lay.columns]), F.col("c") + 1)
    counts = materialize(form_counts(df, lay), "forms")
    top = counts.where(F.col("f").isNotNull()).groupBy("g", "l", "c").agg(F.max(F.struct("n", "f"))["f"].alias("top_form"))
    t = _shaped(_with_moments(df, counts, summaries(counts, lay), lay)).join(top, ["g", "l", "c"], "left")
    gap = (F.col("rows") - F.col("present")) / F.col("rows")
    return t.select(
        F.col("g").alias(lay.group), F.col("l").alias(lay.load), _named(lay, F.col("c")).alias("column_name"), "rows", (F.col("rows") - F.col("present")).alias("missing"),
        gap.alias("missing_share"), (gap - (F.col("rows0") - F.col("present0")) / F.col("rows0")).alias("missing_shift"), F.coalesce("distinct", F.lit(0)).alias("distinct"),
        (F.col("lo") + back).alias("min"), (F.col("hi") + back).alias("max"), (F.col("mean") + back).alias("mean"), "std", "skew", "kurtosis", "mean_shift", "top_form", F.col("top").alias("top_count"), F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("inexact", F.lit(0)).alias("inexact"))
