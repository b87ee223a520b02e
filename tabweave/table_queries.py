"""Queries of the table operators (profile, relations, fidelity, cleaning, augmentation, synthesis, evaluation, export) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import rng, scalars
from tabweave.functions.missing import CLIENT_TOKENS, bare, number_missing, text_missing
from tabweave.operators import augment, clean, describe, evaluate, fidelity, neighbours, relations, synth
from tabweave.operators.order import melt
from tabweave.plans.physical import materialize, one_row, shared_dir
from tabweave.sources import export
from tabweave.streaming import windowed_moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
L4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHURN = ["account_age_months", "monthly_charges", "usage_hours", "support_tickets"]


def query(sql: str | None = None):
    """Register the function under its name, with the SQL that gives the same rows."""
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf: f(lambda t: spark.read.parquet(f"{sf}/{t}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def _long(table: str, columns: list[str], where: str = "TRUE", extra: str = "") -> str:
    """SQL of melt(): (c, x, extra)."""
    return " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS DOUBLE) AS x{extra} FROM {table} WHERE {where} AND {c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in columns)


def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def _u(seed: int, row: str, draw: str) -> str:
    """SQL of rng.uniform()."""
    return f"(CAST('0x' || substr(md5('{seed}|' || {row} || '|{draw}'), 1, 8) AS UBIGINT) / 4294967296.0)"


def _g(seed: int, row: str, draw: str) -> str:
    """SQL of rng.gaussian()."""
    return f"(sqrt(-2 * ln(greatest({_u(seed, row, draw + 'a')}, 1e-12))) * cos(2 * pi() * {_u(seed, row, draw + 'b')}))"


_MOMENTS = """count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, CASE WHEN min(x) = max(x) THEN 0 ELSE coalesce(stddev_samp(x), 0) END AS std,
 CASE WHEN min(x) = max(x) OR count(*) < 3 THEN 0 ELSE skewness(x) END AS skew, CASE WHEN min(x) = max(x) OR count(*) < 4 THEN 0 ELSE kurtosis(x) END AS kurt"""
LO, LF = "l_linestatus = 'O'", "l_linestatus = 'F'"


# Profiles ----------------------------------------------------------------------------------------------------------------


@query(f"SELECT c AS column_name, n, round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 6) AS mean, round(std, 6) AS std, round(skew, 6) AS skew FROM (SELECT c, {_MOMENTS} FROM ({_long('lineitem', L4)}) GROUP BY c)")
def profile_numeric(t):
    return describe.numeric_profile(t("lineitem"), L4)


@query(f"SELECT c AS column_name, n, round(kurt, 6) AS kurt FROM (SELECT c, {_MOMENTS} FROM ({_long('lineitem', L4)}) GROUP BY c)")
def kurtosis_numeric(t):
    return describe.moments(melt(t("lineitem"), L4)).select(F.col("c").alias("column_name"), "n", F.round("kurt", 6).alias("kurt"))


@query(f"SELECT c AS column_name, count(*) AS n, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM ({_long('lineitem', L4)}) GROUP BY c")
def quartiles(t):
    return describe.five_numbers(t("lineitem"), L4)


_OUT = f"""v AS ({{long}}), q AS (SELECT c, count(*) AS n, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM v GROUP BY c),
o AS (SELECT c, any_value(n) AS n, any_value(a - 1.5 * (b - a)) AS lower, any_value(b + 1.5 * (b - a)) AS upper, count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS k FROM v JOIN q USING (c) GROUP BY c)"""
_EV = _long("events", ["value"])


@query(f"WITH {_OUT.format(long=_long('lineitem', L4) + ' UNION ALL ' + _EV)} SELECT c AS column_name, n, round(lower, 6) AS lower, round(upper, 6) AS upper, k AS count FROM o")
def iqr_outliers(t):
    both = describe.outliers(t("lineitem"), L4).unionByName(describe.outliers(t("events"), ["value"]))
    return both.select(F.col("c").alias("column_name"), "n", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "count")


_CB = "c AS (SELECT part_type AS v, count(*) AS n FROM (SELECT p_name AS part_type FROM part) WHERE lower(trim(part_type)) NOT IN ('','na','n/a','nan','null','none','nil','undefined','?','#n/a') GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k, sum(n) OVER () AS s FROM c)"


@query(f"WITH {_CB} SELECT v AS value, n, round(100.0 * n / s, 2) AS pct FROM r WHERE k <= 50 UNION ALL SELECT '__other__', sum(n), round(100.0 * sum(n) / any_value(s), 2) FROM r WHERE k > 50 HAVING count(*) > 0")
def class_balance(t):
    return describe.class_balance(t("part"), "p_name")


@query("SELECT coalesce(lang, 'UNKNOWN') AS label, count(*) AS n FROM documents GROUP BY 1")
def class_distribution(t):
    return describe.class_counts(t("documents").select("lang"), "lang")


_IMB = "SELECT count(*) AS classes, min(n) AS min_n, max(n) AS max_n, max(label) FILTER (n = (SELECT min(n) FROM k)) AS min_class, max(label) FILTER (n = (SELECT max(n) FROM k)) AS max_class, round(max(n) / min(n), 2) AS ratio, CASE WHEN round(max(n) / min(n), 2) > 10 THEN 'severe' WHEN round(max(n) / min(n), 2) >= 3 THEN 'moderate' WHEN round(max(n) / min(n), 2) >= 1.5 THEN 'mild' ELSE 'none' END AS severity FROM k"


@query(f"WITH k AS (SELECT coalesce(lang, 'UNKNOWN') AS label, count(*) AS n FROM documents GROUP BY 1) {_IMB}")
def imbalance(t):
    return describe.imbalance(t("documents").select("lang"), "lang")


_MISS = "(" + ",".join(f"'{t}'" for t in CLIENT_TOKENS) + ")"


def _missing_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL OR lower(trim(CAST({c} AS VARCHAR), ' \t')) IN {_MISS}) AS missing, round(100.0 * count(*) FILTER ({c} IS NULL OR lower(trim(CAST({c} AS VARCHAR), ' \t')) IN {_MISS}) / count(*), 1) AS missing_pct, count(DISTINCT {c}) FILTER (NOT ({c} IS NULL OR lower(trim(CAST({c} AS VARCHAR), ' \t')) IN {_MISS})) AS \"distinct\" FROM {table}" for c in columns)


@query(_missing_sql("churn_rows", ["account_id", "site_code", "plan_code", *CHURN, "contract_type", "churn_risk"]))
def missing_report(t):
    return describe.missing_report(t("churn_rows"), ["account_id", "site_code", "plan_code", *CHURN, "contract_type", "churn_risk"])


_ID = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, " + (f"(count(*) >= 20 AND count(DISTINCT {c}) / count(*) > 0.98 AND bool_and({c} = floor({c})) AND max({c}) - min({c}) = count(*) - 1)" if c != "o_orderstatus" else f"(count(*) >= 20 AND count(DISTINCT {c}) / count(*) > 0.95)") + " AS is_id FROM orders" for c in _ID))
def id_columns(t):
    return describe.id_columns(t("orders"), _ID)


_DIST = f"""m AS (SELECT c, {_MOMENTS} FROM v GROUP BY c),
h AS (SELECT c, b, coalesce(n, 0) AS n FROM (SELECT c, unnest(range(10)) AS b FROM m) LEFT JOIN (SELECT v.c, CAST(least(9, floor((x - lo) / ((hi - lo) / 10))) AS BIGINT) AS b, count(*) AS n FROM v JOIN m ON m.c = v.c WHERE hi > lo GROUP BY 1, 2) USING (c, b)),
d AS (SELECT c, count(*) FILTER (n < p AND n < f) AS dips FROM (SELECT c, n, lag(n) OVER (PARTITION BY c ORDER BY b) AS p, lead(n) OVER (PARTITION BY c ORDER BY b) AS f FROM h) GROUP BY c),
lab AS (SELECT m.*, CASE WHEN n < 10 OR hi = lo THEN 'unknown' WHEN abs(skew) < 0.5 AND abs(kurt) < 0.5 THEN CASE WHEN abs(std - (hi - lo) / sqrt(12)) / ((hi - lo) / sqrt(12)) < 0.3 THEN 'uniform' ELSE 'normal' END WHEN abs(skew) > 1 THEN 'skewed' WHEN dips >= 1 AND kurt < -0.5 THEN 'bimodal' ELSE 'normal' END AS distribution FROM m JOIN d USING (c))"""


@query(f"WITH v AS ({_long('lineitem', L4)} UNION ALL {_EV}), {_DIST} SELECT c AS column_name, distribution FROM lab")
def distribution_labels(t):
    return describe.distribution_labels(t("lineitem"), L4).unionByName(describe.distribution_labels(t("events"), ["value"]))


@query(f"WITH {_OUT.format(long=_long('lineitem', L4))}, {_DIST} SELECT lab.c AS column_name, FALSE AS is_id, distribution, o.k AS outliers, round(100.0 * o.k / lab.n, 1) AS outlier_pct, round(least(1.0, 1.5 * std / (hi - lo)), 2) AS noise, 0 AS missing, 0.0 AS missing_pct FROM lab JOIN o USING (c)")
def feature_analysis(t):
    return describe.feature_analysis(t("lineitem"), L4)


@query(f"""WITH {_OUT.format(long=_long('lineitem', L4))}, k AS (SELECT l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1), i AS ({_IMB}),
s AS (SELECT i.*, (SELECT count(*) FROM lineitem) AS rows, CASE severity WHEN 'severe' THEN 50 WHEN 'moderate' THEN 35 WHEN 'mild' THEN 15 ELSE 0 END AS a, CASE WHEN (SELECT bool_or(round(100.0 * o.k / o.n, 1) > 5) FROM o) THEN 10 ELSE 0 END AS c FROM i)
SELECT ratio, severity, min_class, max_class, rows, a AS imbalance_part, CASE WHEN rows < 150 THEN 25 WHEN rows < 500 THEN 15 ELSE 5 END AS size_part, c AS outlier_part, least(100, a + c + CASE WHEN rows < 150 THEN 25 WHEN rows < 500 THEN 15 ELSE 5 END) AS need_score, 100 - least(100, a + c + CASE WHEN rows < 150 THEN 25 WHEN rows < 500 THEN 15 ELSE 5 END) AS health_score FROM s""")
def need_score(t):
    return describe.need_score(t("lineitem"), "l_returnflag", L4)


@query("WITH c AS (SELECT 'c_mktsegment' AS column_name, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM c) SELECT column_name, rank, value, n FROM r WHERE rank <= 5")
def top_categories(t):
    return describe.top_categories(t("customer"), ["c_mktsegment", "c_nationkey"])


@query("SELECT c_custkey, round((c_acctbal - a) / (b - a), 9) AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer)")
def normalize_minmax(t):
    return describe.normalize(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 9))


@query("SELECT c_custkey, round((c_acctbal - a) / b, 8) AS c_acctbal FROM customer, (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS b FROM customer)")
def standardize(t):
    return describe.normalize(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "zscore").withColumn("c_acctbal", F.round("c_acctbal", 8))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O FROM orders")
def one_hot(t):
    return describe.one_hot(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"]).drop("o_orderstatus")


_HR = "(SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)"


@query(f"WITH k AS (SELECT l_linestatus, CAST(least(19, floor((l_extendedprice - a) / ((b - a) / 20))) AS INT) AS bin, count(*) AS n FROM lineitem, {_HR} GROUP BY ALL) SELECT l_linestatus, 'l_extendedprice' AS column_name, bin, coalesce(k.n, 0) AS n FROM (SELECT l_linestatus, unnest(range(20)) AS bin FROM (SELECT DISTINCT l_linestatus FROM lineitem)) LEFT JOIN k USING (l_linestatus, bin)")
def histogram_overlay(t):
    long = melt(t("lineitem"), ["l_extendedprice"], ["l_linestatus"])
    h = describe.histogram(long, long.groupBy("c").agg(F.min("x").alias("min"), F.max("x").alias("max")), 20, ["l_linestatus"])
    return h.select("l_linestatus", F.col("c").alias("column_name"), F.col("bin").cast("bigint").alias("bin"), "n")


_TYPES = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


@query("SELECT 'o_orderkey' AS column_name, 'numeric' AS data_type UNION ALL SELECT 'o_totalprice', CASE WHEN (SELECT count(*) FILTER (try_cast(CAST(o_totalprice AS VARCHAR) AS DOUBLE) IS NOT NULL) / count(*) FROM orders) >= 0.95 THEN 'numeric' ELSE 'categorical' END UNION ALL SELECT 'o_orderstatus', 'categorical' UNION ALL SELECT 'o_orderdate', CASE WHEN (SELECT count(*) FILTER (try_cast(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) IS NOT NULL) / count(*) FROM orders) >= 0.95 THEN 'datetime' ELSE 'categorical' END")
def infer_types(t):
    return describe.infer_types(t("orders").select(*[F.col(c).cast("string").alias(c) for c in _TYPES]), _TYPES, "service")


_CLIENT = f"""v AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, trim({e}, ' \t\r\n') AS v FROM churn_rows WHERE {c} IS NOT NULL AND lower(trim({e}, ' \t')) NOT IN {_MISS}" for c, e in (("account_id", "account_id"), ("site_code", "site_code"), ("contract_type", "contract_type"), ("monthly_charges", "'$' || monthly_charges")))}),
k AS (SELECT c, count(*) AS n, count(DISTINCT lower(v)) AS d, count(*) FILTER (regexp_full_match(v, '[$]-?[0-9.]+(e[+-]?[0-9]+)?')) AS numbers FROM v GROUP BY c)"""


@query(f"WITH {_CLIENT} SELECT c AS column_name, CASE WHEN numbers / n > 0.8 THEN 'numeric' WHEN d / n < 0.5 OR d <= 30 THEN 'categorical' ELSE 'text' END AS data_type FROM k")
def infer_types_client(t):
    return describe.infer_types(t("churn_rows").select("account_id", "site_code", "contract_type", F.concat(F.lit("$"), F.col("monthly_charges").cast("string")).alias("monthly_charges")), ["account_id", "site_code", "contract_type", "monthly_charges"], "client")


# Relations ---------------------------------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 3) AS r, abs(round(corr({a}, {b}), 3)) > 0.85 AS is_high FROM lineitem" for a, b in _pairs(L4)))
def correlation_pearson(t):
    return relations.correlations(t("lineitem"), L4)


@query("WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS x, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS y FROM orders) SELECT 'o_totalprice' AS a, 'o_custkey' AS b, round(corr(x, y), 6) AS r FROM r")
def correlation_spearman(t):
    return relations.spearman(t("orders").select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"], "o_orderkey")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for a, b in _pairs(L4) + [(c, c) for c in L4]))
def covariance_matrix(t):
    return relations.pair_statistics(t("lineitem"), L4, diagonal=True).select("a", "b", "n", F.round("cov", 4).alias("cov"))


_MIC = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
_BIN = {c: (f"least(9, floor(({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem) * 10))" if c in L4 else c) for c in _MIC}


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(greatest(0.0, sum(n / s * ln(n * s / (p * q)))), 6) AS mi FROM (SELECT n, sum(n) OVER () AS s, sum(n) OVER (PARTITION BY x) AS p, sum(n) OVER (PARTITION BY y) AS q FROM (SELECT {_BIN[a]} AS x, {_BIN[b]} AS y, count(*) AS n FROM lineitem GROUP BY 1, 2))" for a, b in _pairs(_MIC)))
def mutual_information(t):
    return relations.mutual_information(t("lineitem"), _MIC)


# Fidelity ----------------------------------------------------------------------------------------------------------------


def _halves(t) -> tuple[DataFrame, DataFrame]:
    d = t("lineitem")
    return d.where(F.col("l_linestatus") == "O"), d.where(F.col("l_linestatus") == "F")


_KSV = " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS x, count(*) FILTER ({LO}) AS a, count(*) FILTER ({LF}) AS b FROM lineitem GROUP BY {c}" for c in L4)
_KS = f"""kv AS ({_KSV}), kw AS (SELECT *, sum(a) OVER w AS i, sum(b) OVER w AS j, sum(a) OVER (PARTITION BY c) AS n1, sum(b) OVER (PARTITION BY c) AS n2 FROM kv WINDOW w AS (PARTITION BY c ORDER BY x)),
ks AS (SELECT c, any_value(n1) AS n1, any_value(n2) AS n2, max(greatest(abs(i / n1 - j / n2), abs((i - a + least(a, b)) / n1 - (j - b + least(a, b)) / n2))) AS d, max(abs(i / n1 - j / n2)) AS exact_d FROM kw GROUP BY c)"""
_EN = "sqrt(n1 * n2 / (n1 + n2))"
_LAM = f"(({_EN} + 0.12 + 0.11 / {_EN}) * d)"
_P = f"CASE WHEN {_LAM} <= 0.05 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 21), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * {_LAM} * {_LAM}))))) END"


@query(f"WITH {_KS} SELECT c AS column_name, round(d, 4) AS ks, round(exact_d, 6) AS exact, CASE WHEN round(d, 4) >= 0.35 THEN 'severe' WHEN round(d, 4) >= 0.18 THEN 'moderate' ELSE 'safe' END AS severity FROM ks")
def ks_two_sample(t):
    a, b = _halves(t)
    cells = fidelity.two_cells(a, b, L4)
    exact = fidelity.ks(a, b, L4, "exact", cells).select("c", F.round("d", 6).alias("exact"))
    return fidelity.ks(a, b, L4, cells=cells).join(exact, "c").select(F.col("c").alias("column_name"), F.round("d", 4).alias("ks"), "exact", fidelity.severity(F.round("d", 4)).alias("severity"))


@query(f"WITH {_KS} SELECT c AS column_name, round({_P}, 4) AS p, round({_P}, 4) >= 0.05 AS passed FROM ks")
def ks_p_value(t):
    r = fidelity.ks(*_halves(t), L4).select(F.col("c").alias("column_name"), F.round(fidelity.ks_p(F.col("d"), F.col("n1"), F.col("n2")), 4).alias("p"))
    return r.withColumn("passed", F.col("p") >= 0.05)


def _w1(over: str) -> str:
    return f"""o AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, list_sort(list({c}) FILTER ({LO})) AS p, list_sort(list({c}) FILTER ({LF})) AS q FROM lineitem" for c in L4)}),
w AS (SELECT c, list_avg(list_transform(range(1, 101), lambda k: abs(p[1 + least(len(p) - 1, CAST(floor(k / {over} * len(p)) AS BIGINT))] - q[1 + least(len(q) - 1, CAST(floor(k / {over} * len(q)) AS BIGINT))]))) AS w1 FROM o)"""


@query(f"WITH {_w1('101.0')} SELECT c AS column_name, round(w1, 4) AS w1 FROM w")
def wasserstein_client(t):
    return fidelity.wasserstein(*_halves(t), L4, "client").select(F.col("c").alias("column_name"), F.round("w1", 4).alias("w1"))


@query(f"WITH {_w1('100.0')} SELECT c AS column_name, round(w1, 4) AS w1 FROM w")
def wasserstein_service(t):
    return fidelity.wasserstein(*_halves(t), L4, "service").select(F.col("c").alias("column_name"), F.round("w1", 4).alias("w1"))


_TV = ["l_returnflag", "l_linenumber"]
_TVD = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) FILTER ({LO}) / (SELECT count(*) FROM lineitem WHERE {LO}) AS p, count(*) FILTER ({LF}) / (SELECT count(*) FROM lineitem WHERE {LF}) AS q FROM lineitem GROUP BY {c}" for c in _TV)


@query(f"SELECT c AS column_name, round(sum(abs(p - q)) / 2, 4) AS tvd FROM ({_TVD}) GROUP BY c")
def total_variation(t):
    return fidelity.total_variation(*_halves(t), _TV).select(F.col("c").alias("column_name"), F.round("tvd", 4).alias("tvd"))


@query(f"SELECT v AS category, round(p, 4) AS real, round(q, 4) AS synthetic FROM ({_TVD}) WHERE c = 'l_returnflag'")
def category_shares(t):
    return fidelity.category_shares(*_halves(t), "l_returnflag")


_COVS = " UNION ALL ".join(f"SELECT {1 if a == b else 2} AS w, covar_samp({a}, {b}) FILTER ({LO}) - covar_samp({a}, {b}) FILTER ({LF}) AS d, corr({a}, {b}) FILTER ({LO}) AS r, corr({a}, {b}) FILTER ({LF}) AS s FROM lineitem" for a, b in _pairs(L4) + [(c, c) for c in L4])
_CF = f"(SELECT round(greatest(0.0, 1 - sqrt(sum(w * (r - s) * (r - s)) FILTER (w = 2)) / sqrt(4 + sum(w * r * r) FILTER (w = 2))), 4) FROM ({_COVS}))"


@query(f"SELECT round(sqrt(sum(w * d * d)), 4) AS frobenius FROM ({_COVS})")
def covariance_frobenius(t):
    return relations.covariance_distance(*_halves(t), L4)


@query(f"SELECT {_CF} AS correlation_fidelity, (SELECT round(greatest(0.0, 1 - avg(abs(r - s)) FILTER (w = 2)), 4) FROM ({_COVS})) AS pairwise_fidelity")
def correlation_fidelity(t):
    return relations.correlation_fidelity(*_halves(t), L4)


_SIDE = f"""s AS ({" UNION ALL ".join(f"SELECT '{c}' AS c, avg({c}) FILTER ({LO}) AS rm, stddev_samp({c}) FILTER ({LO}) AS rs, avg({c}) FILTER ({LF}) AS sm, stddev_samp({c}) FILTER ({LF}) AS ss, max({c}) FILTER ({LO}) - min({c}) FILTER ({LO}) AS width FROM lineitem" for c in L4)})"""
_SEV = "CASE WHEN round(d, 4) >= 0.35 THEN 'severe' WHEN round(d, 4) >= 0.18 THEN 'moderate' ELSE 'safe' END AS severity"


@query(f"WITH {_KS}, {_w1('101.0')}, {_SIDE} SELECT c AS column_name, round(d, 4) AS ks, round(greatest(0.0, 1 - round(d, 4)), 4) AS ks_fidelity, round(w1, 4) AS w1, round(w1 / width, 4) AS w1_by_range, round(rm, 2) AS real_mean, round(sm, 2) AS synth_mean, round(rs, 2) AS real_std, round(ss, 2) AS synth_std, round(100 * abs(sm - rm) / abs(rm), 1) AS mean_diff_pct, {_SEV} FROM ks JOIN w USING (c) JOIN s USING (c)")
def feature_audit(t):
    return fidelity.feature_audit(*_halves(t), L4)


@query(f"WITH {_KS}, {_w1('101.0')}, {_SIDE} SELECT c AS column_name, round(rm, 2) AS real_mean, round(sm, 2) AS synth_mean, round(rs, 2) AS real_std, round(ss, 2) AS synth_std, round(d, 4) AS ks, {_SEV}, round(w1, 4) AS w1 FROM ks JOIN w USING (c) JOIN s USING (c)")
def feature_drift(t):
    return fidelity.drift(*_halves(t), L4)


@query(f"WITH {_KS} SELECT max_by(c, round(d, 4)) AS feature, max(round(d, 4)) AS ks FROM ks")
def top_drift(t):
    return fidelity.top_drift(*_halves(t), L4)


@query(f"WITH {_KS}, a AS (SELECT (SELECT avg(greatest(0.0, 1 - round(d, 4))) FROM ks) AS n, (SELECT avg(x) FROM (SELECT round(1 - sum(abs(p - q)) / 2, 4) AS x FROM ({_TVD}) GROUP BY c)) AS k, {_CF} AS r) SELECT CAST(floor((0.4 * n + 0.3 * k + 0.3 * r) * 100 + 0.5) AS INT) AS overall_score, round(n, 4) AS numeric_fidelity, round(k, 4) AS categorical_fidelity, r AS correlation_fidelity FROM a")
def audit_score(t):
    return fidelity.audit(*_halves(t), L4, _TV)


@query(f"WITH {_KS}, {_w1('100.0')} SELECT (SELECT round(avg(round({_P}, 4)), 4) FROM ks) AS ks_p_mean, (SELECT round(avg(CASE WHEN round({_P}, 4) >= 0.05 THEN 1 ELSE 0 END), 2) FROM ks) AS ks_passed, (SELECT round(avg(round(w1, 4)), 4) FROM w) AS wasserstein_mean, (SELECT round(sqrt(sum(w * d * d)), 4) FROM ({_COVS})) AS covariance_frobenius")
def audit_service(t):
    return fidelity.audit_service(*_halves(t), L4)


_DCRC = """d AS (SELECT c_custkey, min(sqrt((((c_acctbal - s_acctbal) / w) ** 2 + CASE WHEN c_nationkey <> s_nationkey THEN 1 ELSE 0 END) / 2)) AS dcr FROM customer, supplier, (SELECT max(s_acctbal) - min(s_acctbal) AS w FROM supplier) WHERE c_custkey % 20 = 0 GROUP BY 1)"""


def _closest(t, profile: str) -> DataFrame:
    real = t("supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nation"))
    made = t("customer").where(F.col("c_custkey") % 20 == 0).select("c_custkey", F.col("c_acctbal").alias("bal"), F.col("c_nationkey").alias("nation"))
    return fidelity.closest_records(real, made, "s_suppkey", "c_custkey", ["bal"], ["nation"], profile)


@query(f"WITH {_DCRC} SELECT c_custkey, round(dcr, 6) AS dcr FROM d")
def closest_record_client(t):
    return _closest(t, "client").select("c_custkey", F.round("dcr", 6).alias("dcr"))


_DCRS = "d AS (SELECT c_custkey, min(abs(c_acctbal - s_acctbal) / w) AS dcr FROM customer, supplier, (SELECT stddev_samp(s_acctbal) AS w FROM supplier) WHERE c_custkey % 20 = 0 GROUP BY 1)"


@query(f"WITH {_DCRS} SELECT c_custkey, round(dcr, 6) AS dcr FROM d")
def closest_record_service(t):
    return _closest(t, "service").select("c_custkey", F.round("dcr", 6).alias("dcr"))


@query(f"WITH {_DCRC}, r AS (SELECT list_sort(list(dcr)) AS l, round(min(dcr), 4) AS m, round(100.0 * count(*) FILTER (dcr < 0.03) / count(*), 1) AS k FROM d) SELECT round(l[1 + len(l) // 2], 4) AS median_dcr, m AS min_dcr, k AS risk_pct, CAST(greatest(0, least(100, floor(100 - 2 * k + 0.5))) AS INT) AS privacy_score FROM r")
def privacy_client(t):
    return fidelity.privacy(_closest(t, "client"))


@query(f"WITH {_DCRS} SELECT round(avg(dcr), 4) AS dcr_score, round(100.0 * count(*) FILTER (dcr >= 1e-4) / count(*), 1) AS zero_memorization_rate FROM d")
def privacy_service(t):
    return fidelity.privacy(_closest(t, "service"), "service")


# Neighbours --------------------------------------------------------------------------------------------------------------

_NN = "nn AS (SELECT q.vec_id AS q, r.vec_id AS r, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(r.embedding AS DOUBLE[])) AS d, q.label AS ql, r.label AS rl FROM embeddings q, embeddings r WHERE q.vec_id <> r.vec_id AND {0}), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, r) AS rank FROM nn)"
_Q20 = "q.vec_id % 20 = 0"


def _ask(t) -> DataFrame:
    return t("embeddings").where(F.col("vec_id") % 20 == 0)


@query(f"WITH {_NN.format(_Q20)} SELECT q AS vec_id, r AS neighbour, rank, round(d, 6) AS dist FROM k WHERE rank <= 5")
def knn_topk(t):
    return neighbours.nearest_rows(_ask(t), t("embeddings"), "vec_id", "vec_id", [], [], [], 5, exclude_self=True, vector="embedding").select(F.col("qid").alias("vec_id"), F.col("rid").alias("neighbour"), "rank", F.round("dist", 6).alias("dist"))


@query(f"WITH {_NN.format('TRUE')} SELECT a.q AS a, a.r AS b FROM k a JOIN k b ON a.r = b.q AND b.r = a.q AND b.rank = 1 WHERE a.rank = 1 AND a.ql <> a.rl AND a.q % 20 = 0")
def tomek_links(t):
    return neighbours.tomek_links(_ask(t), t("embeddings"), "vec_id", "label", "embedding")


@query(f"WITH {_NN.format(_Q20)} SELECT q AS vec_id, CAST(any_value(ql) AS VARCHAR) AS cls, round(avg(CASE WHEN ql <> rl THEN 1.0 ELSE 0.0 END), 6) AS r FROM k WHERE rank <= 5 GROUP BY q")
def adasyn_weights(t):
    r = augment.adasyn_weights(_ask(t), t("embeddings"), "label", "vec_id", [], [], 5, "embedding")
    return r.select(F.col("id").alias("vec_id"), "cls", F.round("r", 6).alias("r"))


# Cleaning ----------------------------------------------------------------------------------------------------------------

_CL = f"b AS (SELECT row_id, {', '.join(f'CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}' for c in CHURN)}, CASE WHEN lower(trim(contract_type, ' \t')) IN {_MISS} THEN NULL ELSE contract_type END AS contract_type, CASE WHEN lower(trim(churn_risk, ' \t')) IN {_MISS} THEN NULL ELSE churn_risk END AS churn_risk FROM churn_rows)"


@query(f"WITH {_CL}, m AS (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS m_{c}' for c in CHURN)} FROM b), k AS (SELECT contract_type AS v FROM b WHERE contract_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT row_id, {', '.join(f'coalesce({c}, m_{c}, 0) AS {c}' for c in CHURN)}, coalesce(contract_type, (SELECT v FROM k), 'UNKNOWN') AS contract_type, churn_risk FROM b, m WHERE churn_risk IS NOT NULL")
def impute_median_mode(t):
    return clean.clean(t("churn_rows").select("row_id", *CHURN, "contract_type", "churn_risk"), CHURN, ["contract_type"], "churn_risk")


@query(f"WITH {_CL} SELECT * FROM ({' UNION ALL '.join(f'''SELECT '{c}' AS column_name, '{a}' AS action, count(*) FILTER ({c} IS NULL) AS n FROM b''' for c, a in [*[(c, 'fill_median') for c in CHURN], ('contract_type', 'fill_mode'), ('churn_risk', 'drop_target')])}) WHERE n > 0")
def clean_log(t):
    return clean.clean_log(t("churn_rows"), CHURN, ["contract_type"], "churn_risk")


@query(f"""WITH {_CL}, k AS (SELECT churn_risk, count(*) AS n FROM b WHERE churn_risk IS NOT NULL GROUP BY 1),
i AS (SELECT 'error' AS severity, 'too_few_rows' AS code, CAST(count(*) AS VARCHAR) AS detail, count(*) < 10 AS w FROM b
UNION ALL SELECT 'error', 'too_few_classes', CAST(count(*) AS VARCHAR), count(*) < 2 FROM k
UNION ALL SELECT 'warning', 'tiny_classes', CAST(count(*) FILTER (n < 3) AS VARCHAR), count(*) >= 2 AND count(*) FILTER (n < 3) > 0 FROM k
UNION ALL SELECT 'warning', 'many_categories', 'account_id', count(DISTINCT CASE WHEN lower(trim(account_id, ' \t')) IN {_MISS} THEN NULL ELSE account_id END) > 50 FROM churn_rows)
SELECT severity, code, detail FROM i WHERE w""")
def validate(t):
    return clean.validate(t("churn_rows"), "churn_risk", CHURN, ["contract_type", "account_id"])


_NUMS = "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(12, 2)) AS VARCHAR) WHEN 1 THEN '(' || CAST(CAST(l_tax AS DECIMAL(6, 2)) AS VARCHAR) || ')' WHEN 2 THEN CAST(CAST(l_discount AS DECIMAL(6, 2)) AS VARCHAR) || '%' ELSE 'n/a' END AS s FROM lineitem"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN s = 'n/a' THEN NULL WHEN s[1] = '(' THEN -CAST(s[2:-2] AS DOUBLE) ELSE CAST(trim(s, '$%') AS DOUBLE) END AS x FROM ({_NUMS})")
def clean_numbers(t):
    d = t("lineitem")
    s = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("("), F.col("l_tax").cast("decimal(6,2)").cast("string"), F.lit(")")))
    s = s.when(F.col("l_linenumber") % 4 == 2, F.concat(F.col("l_discount").cast("decimal(6,2)").cast("string"), F.lit("%"))).otherwise(F.lit("n/a"))
    return d.select("l_orderkey", "l_linenumber", scalars.clean_number(s).alias("x"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate) AS ms FROM orders")
def parse_datetimes(t):
    d = t("orders")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(F.col("o_orderdate"), "dd/MM/yyyy HH:mm:ss"))
    return d.select("o_orderkey", F.unix_millis(scalars.parse_datetime(text)).alias("ms"))


# Scalars -----------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) >= 1000 THEN printf('%.1f', round(c_acctbal / 1000, 1)) || 'K' ELSE printf('%.0f', round(c_acctbal)) END AS compact, CASE WHEN c_acctbal >= 0 THEN '+' ELSE '' END || printf('%.2f', round(c_acctbal, 2)) AS delta, CASE WHEN length(c_name) > 10 THEN c_name[1:10] || '...' ELSE c_name END AS short, round(1 / (1 + exp(-c_acctbal / 1000)), 9) AS sigmoid FROM customer")
def scalar_formats(t):
    x = F.col("c_acctbal")
    return t("customer").select("c_custkey", scalars.compact(x).alias("compact"), scalars.signed_delta(x).alias("delta"), scalars.truncate(F.col("c_name"), 10).alias("short"), F.round(scalars.sigmoid(x / 1000), 9).alias("sigmoid"))


@query("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS dot, round(1.0 / list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: exp(x - list_max(CAST(embedding AS DOUBLE[]))))), 9) AS top_softmax FROM embeddings")
def vector_math(t):
    e = F.col("embedding").cast("array<double>")
    return t("embeddings").select("vec_id", F.round(scalars.dot(e, e), 6).alias("dot"), F.round(F.array_max(scalars.softmax(e)), 9).alias("top_softmax"))


@query("SELECT n_nationkey, sha256(n_name) AS sha FROM nation")
def hash_text(t):
    return t("nation").select("n_nationkey", scalars.sha256(F.col("n_name")).alias("sha"))


@query(f"SELECT o_orderkey, round({_u(42, 'o_orderkey', '0')}, 12) AS u, round({_g(42, 'o_orderkey', 'x')}, 8) AS g FROM orders")
def random_draws(t):
    return t("orders").select("o_orderkey", F.round(rng.uniform(42, F.col("o_orderkey"), 0), 12).alias("u"), F.round(rng.gaussian(42, F.col("o_orderkey"), "x"), 8).alias("g"))


# Augmentation and synthesis ----------------------------------------------------------------------------------------------

_SEGN = "n AS (SELECT c_mktsegment AS cls, count(*) AS n_c FROM customer GROUP BY 1), need AS (SELECT cls, n_c, CAST(floor((SELECT max(n_c) FROM n) - n_c + 0.5) AS BIGINT) AS need FROM n WHERE n_c < (SELECT max(n_c) FROM n)), rk AS (SELECT c_mktsegment AS cls, c_custkey, c_acctbal, c_nationkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS rank0 FROM customer), dr AS (SELECT cls, n_c, cls || '#' || s AS key FROM (SELECT cls, n_c, unnest(range(1, need + 1)) AS s FROM need))"
_SEGA = f"an AS (SELECT key, dr.cls, n_c, c_custkey, c_acctbal, c_nationkey FROM dr JOIN rk ON rk.cls = dr.cls AND rk.rank0 = floor({_u(42, 'key', '0')} * n_c))"


@query("WITH " + _SEGN + " SELECT cls, n_c, need FROM need")
def class_needs(t):
    return augment.class_needs(t("customer"), "c_mktsegment")


@query(f"""WITH {_SEGN}, {_SEGA}, w AS (SELECT max(c_acctbal) - min(c_acctbal) AS w FROM customer),
nb AS (SELECT a.c_custkey AS a, r.c_custkey AS b, r.c_acctbal AS bal, r.c_nationkey AS nat, row_number() OVER (PARTITION BY a.c_custkey ORDER BY sqrt(((a.c_acctbal / w - r.c_acctbal / w)) ** 2 + CASE WHEN a.c_nationkey <> r.c_nationkey THEN 1 ELSE 0 END), r.c_custkey) AS rank FROM (SELECT DISTINCT cls, c_custkey, c_acctbal, c_nationkey FROM an) a JOIN rk r ON r.cls = a.cls AND r.c_custkey <> a.c_custkey, w)
SELECT key, cls, round(c_acctbal + {_u(42, 'key', '2')} * (bal - c_acctbal), 4) AS c_acctbal, CASE WHEN {_u(42, 'key', 'n0')} > 0.5 THEN nat ELSE c_nationkey END AS c_nationkey FROM an JOIN nb ON nb.a = an.c_custkey AND nb.rank = floor({_u(42, 'key', '1')} * least(5, n_c - 1)) + 1""")
def smote_sample(t):
    return augment.smote(t("customer"), "c_mktsegment", "c_custkey", ["c_acctbal"], ["c_nationkey"])


@query(f"WITH {_SEGN}, {_SEGA} SELECT key, cls, round(c_acctbal + {_g(42, 'key', 'c_acctbal')} * (SELECT stddev_samp(c_acctbal) FROM customer) * 0.05, 4) AS c_acctbal FROM an")
def oversample(t):
    return augment.oversample(t("customer"), "c_mktsegment", "c_custkey", ["c_acctbal"])


@query(f"SELECT c_custkey, round(c_acctbal + {_g(42, 'c_custkey', 'c_acctbal')} * (SELECT stddev_samp(c_acctbal) FROM customer) * 0.08, 4) AS c_acctbal FROM customer")
def noise_injection(t):
    return augment.inject_noise(t("customer").select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"])


@query()
def adasyn_sample(t):
    return augment.adasyn(t("supplier").withColumn("side", (F.col("s_acctbal") > 7000).cast("string")), "side", "s_suppkey", ["s_acctbal"], ["s_nationkey"])


@query()
def smote_tomek_sample(t):
    return augment.smote_tomek(t("supplier").withColumn("side", (F.col("s_acctbal") > 7000).cast("string")), "side", "s_suppkey", ["s_acctbal", "s_nationkey"])


@query(f"WITH r AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer), i AS (SELECT unnest(range(1000)) AS row_id) SELECT row_id, round(c_acctbal + {_g(42, 'row_id', 'c_acctbal')} * (SELECT stddev_samp(c_acctbal) FROM customer) * 0.05, 4) AS c_acctbal FROM i JOIN r ON r.k = floor({_u(42, 'row_id', 'row')} * n)")
def jitter_sample(t):
    return synth.jitter(t("customer"), ["c_acctbal"], 1000, "c_custkey")


@query(f"SELECT c AS column_name, round(0.9 * CASE WHEN quantile_cont(x, 0.75) > quantile_cont(x, 0.25) THEN least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) ELSE stddev_samp(x) END * pow(count(*), -0.2), 6) AS h FROM ({_long('lineitem', L4)}) GROUP BY c")
def kde_bandwidth(t):
    return synth.bandwidths(t("lineitem"), L4).select(F.col("c").alias("column_name"), F.round("h", 6).alias("h"))


@query(f"""WITH r AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS k, count(*) OVER () AS n FROM customer),
h AS (SELECT 0.9 * CASE WHEN quantile_cont(c_acctbal, 0.75) > quantile_cont(c_acctbal, 0.25) THEN least(stddev_samp(c_acctbal), (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) / 1.34) ELSE stddev_samp(c_acctbal) END * pow(count(*), -0.2) AS h FROM customer),
s AS (SELECT v, coalesce(lag(p) OVER (ORDER BY v), -1) AS low, p FROM (SELECT c_mktsegment AS v, sum(count(*)) OVER (ORDER BY c_mktsegment) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1)),
i AS (SELECT unnest(range(1000)) AS row_id), u AS (SELECT row_id, {_u(42, 'row_id', 'row_c_acctbal')} AS a, {_u(42, 'row_id', 'c0')} AS b, {_g(42, 'row_id', 'h_c_acctbal')} AS g FROM i)
SELECT row_id, round(c_acctbal + g * h, 4) AS c_acctbal, s.v AS c_mktsegment FROM u JOIN r ON r.k = floor(a * n), h, s WHERE b > s.low AND b <= s.p""")
def kde_sample(t):
    return synth.kde(t("customer"), ["c_acctbal"], ["c_mktsegment"], 1000, "c_custkey")


@query()
def copula_sample(t):
    return synth.copula(t("lineitem"), L4, ["l_returnflag"], 5000)


@query()
def copula_spearman(t):
    return synth.copula(t("orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus"], 5000, method="spearman", rid="o_orderkey")


@query()
def bayes_sample(t):
    return synth.bayes_network(t("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"], 2000)


@query(f"""WITH w AS (SELECT max(s_acctbal) - min(s_acctbal) AS a, max(s_nationkey) - min(s_nationkey) AS b FROM supplier), r AS (SELECT s_suppkey, s_acctbal, s_nationkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier),
i AS (SELECT unnest(range(500)) AS row_id), d AS (SELECT row_id, r.s_suppkey AS s, r.s_acctbal AS x, r.s_nationkey AS y, floor({_u(42, 'row_id', '1')} * 5) + 1 AS rank, {_u(42, 'row_id', '2')} AS al FROM i JOIN r ON r.k = floor({_u(42, 'row_id', '0')} * n)),
nb AS (SELECT p.s_suppkey AS s, q.s_acctbal AS x2, q.s_nationkey AS y2, row_number() OVER (PARTITION BY p.s_suppkey ORDER BY sqrt((p.s_acctbal / w.a - q.s_acctbal / w.a) ** 2 + (p.s_nationkey / w.b - q.s_nationkey / w.b) ** 2), q.s_suppkey) AS rank FROM r p, r q, w WHERE p.s_suppkey <> q.s_suppkey)
SELECT row_id, round(x + al * (x2 - x), 4) AS s_acctbal, round(y + al * (y2 - y), 4) AS s_nationkey FROM d JOIN nb ON nb.s = d.s AND nb.rank = d.rank""")
def interpolated_sample(t):
    return synth.interpolate(t("supplier"), ["s_acctbal", "s_nationkey"], 500, "s_suppkey")


@query()
def autoencoder_sample(t):
    return synth.autoencoder(t("lineitem"), L4, 1000)


@query("SELECT x, round(CASE WHEN k = n THEN 1.0 ELSE k / (n + 1) END, 9) AS client, round(least(0.9999, greatest(1e-4, (k - c + 0.5) / n)), 9) AS service FROM (SELECT l_quantity AS x, count(*) AS c, sum(count(*)) OVER (ORDER BY l_quantity) AS k, sum(count(*)) OVER () AS n FROM lineitem GROUP BY 1)")
def empirical_distribution(t):
    d = t("lineitem")
    a, b = (synth.ecdf(d, ["l_quantity"], p).select("x", F.round("u", 9).alias(p)) for p in ("client", "service"))
    return a.join(b, "x")


@query()
def synthetic_quality(t):
    d = t("customer")
    new = augment.inject_noise(d.where(F.col("c_custkey") % 20 == 0), "c_custkey", ["c_acctbal"])
    return augment.synthetic_quality(d, new, "c_custkey", "c_custkey", ["c_acctbal"], ["c_nationkey"])


# Evaluation --------------------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, k <= greatest(1, floor(n * 0.25 + 0.5)) AS is_test FROM r")
def stratified_split(t):
    return evaluate.stratified_split(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", "is_test")


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, k <= greatest(floor(n * 0.25), 2) AS is_test FROM r")
def shuffled_split(t):
    return evaluate.shuffled_split(t("orders").select("o_orderkey"), "o_orderkey")


_PRED = "p AS (SELECT o_orderpriority AS actual, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority WHEN o_custkey % 3 = 1 THEN '1-URGENT' ELSE '5-LOW' END AS predicted FROM orders)"
_LABS = "k AS (SELECT DISTINCT unnest([actual, predicted]) AS label FROM p)"


def _predictions(t) -> DataFrame:
    m = F.col("o_custkey") % 3
    return t("orders").select(F.col("o_orderpriority").alias("actual"), F.when(m == 0, F.col("o_orderpriority")).when(m == 1, "1-URGENT").otherwise("5-LOW").alias("predicted"))


@query(f"WITH {_PRED}, {_LABS}, c AS (SELECT a.label AS actual, b.label AS predicted, count(p.actual) AS n FROM k a CROSS JOIN k b LEFT JOIN p ON p.actual = a.label AND p.predicted = b.label GROUP BY 1, 2) SELECT actual, predicted, n, coalesce(round(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 4), 0.0) AS share FROM c")
def confusion_matrix(t):
    return evaluate.confusion(_predictions(t))


_CM = f"{_PRED}, {_LABS}, q AS (SELECT label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (actual <> label AND predicted = label) AS fp, count(*) FILTER (actual = label AND predicted <> label) AS fn, count(*) FILTER (actual <> label AND predicted <> label) AS tn FROM p, k GROUP BY label), r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM q), f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM r)"


@query(f"WITH {_CM} SELECT label, tp, fp, fn, tn, round(pr, 4) AS precision, round(rc, 4) AS recall, round(f1, 4) AS f1, tp + fn AS support, round(coalesce(tn / nullif(tn + fp, 0), 0), 4) AS specificity FROM f")
def class_metrics(t):
    return evaluate.class_metrics(_predictions(t))


@query(f"WITH {_CM} SELECT (SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 4) FROM p) AS accuracy, round(avg(round(pr, 4)), 4) AS precision, round(avg(round(rc, 4)), 4) AS recall, round(avg(round(f1, 4)), 4) AS f1 FROM f")
def summary_metrics(t):
    return evaluate.summary_metrics(_predictions(t))


@query()
def tstr_knn(t):
    d = t("embeddings")
    return evaluate.tstr(d.where("vec_id % 2 = 0"), d.where("vec_id % 2 = 1"), "vec_id", "label", "embedding")


@query("WITH d AS (SELECT l_extendedprice * l_tax - l_extendedprice * l_discount AS d FROM lineitem), s AS (SELECT count(d) AS n, avg(d) AS m, stddev_samp(d) AS s FROM d), t AS (SELECT n, m / (s / sqrt(n)) AS t FROM s), z AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM t) SELECT n, round(t, 6) AS t, n - 1 AS df, round(2 * 0.3989422804014327 * exp(-t * t / 2) * k * (0.3193815 + k * (-0.3565638 + k * (1.781478 + k * (-1.821256 + 1.330274 * k)))), 6) AS p, 2 * 0.3989422804014327 * exp(-t * t / 2) * k * (0.3193815 + k * (-0.3565638 + k * (1.781478 + k * (-1.821256 + 1.330274 * k)))) < 0.05 AS significant FROM z")
def paired_t_test(t):
    return evaluate.paired_t(t("lineitem").select((F.col("l_extendedprice") * F.col("l_tax")).alias("a"), (F.col("l_extendedprice") * F.col("l_discount")).alias("b")), "a", "b")


def _experiment(t) -> DataFrame:
    """On all churn rows with a risk and their numbers: three runs of the baseline and of two amounts of oversampling."""
    more = lambda ratio: lambda x, s: augment.oversample(x, "churn_risk", "row_id", CHURN, ratio, seed=s)
    return evaluate.controlled_evaluation(_labelled(t), "row_id", "churn_risk", CHURN, {"baseline": None, "oversampling": more(1.0), "oversampling_half": more(0.5)})


@query()
def experiment_runs(t):
    return _experiment(t)


@query()
def experiment_verdict(t):
    return evaluate.recommendations(_experiment(t))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) > floor(count(*) OVER () * 0.75) AS is_test FROM orders")
def sequential_split(t):
    return evaluate.sequential_split(t("orders").select("o_orderkey"), "o_orderkey")


@query(f"""WITH s AS (SELECT quantile_cont(b, 0.5) AS q, avg(b) AS m, stddev_samp(b) AS d FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS b FROM customer)), k AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY c_mktsegment) - 1 AS i FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey % 3 <> 0)),
o AS (SELECT c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT c_custkey, round((coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, q) - m) / d, 8) AS e0, {', '.join(f"CASE WHEN (SELECT v FROM k WHERE i = {i}) = CASE WHEN c_custkey % 3 = 0 THEN (SELECT v FROM o) ELSE c_mktsegment END THEN 1.0 ELSE 0.0 END AS e{i + 1}" for i in range(5))} FROM customer, s""")
def encoded_features(t):
    d = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"))
    e = evaluate.fit_encoder(d, ["bal"], ["seg"])
    return evaluate.encode(d, e, ["c_custkey"]).withColumn("e0", F.round("e0", 8))


_RUNS = "p AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'other' END AS strategy, o_orderkey % 3 AS run, o_orderpriority AS actual, CASE WHEN o_custkey % 3 = 0 OR (o_orderkey % 2 = 1 AND o_custkey % 3 = 1) THEN o_orderpriority WHEN o_custkey % 3 = 1 THEN '1-URGENT' ELSE '5-LOW' END AS predicted FROM orders)"


def _experiment_predictions(t) -> DataFrame:
    k, m = F.col("o_orderkey"), F.col("o_custkey") % 3
    right = (m == 0) | ((k % 2 == 1) & (m == 1))
    return t("orders").select(F.when(k % 2 == 0, "baseline").otherwise("other").alias("strategy"), (k % 3).alias("run"), F.col("o_orderpriority").alias("actual"), F.when(right, F.col("o_orderpriority")).when(m == 1, "1-URGENT").otherwise("5-LOW").alias("predicted"))


@query(f"WITH {_RUNS} SELECT strategy, actual, predicted, round(count(*) / 3.0, 2) AS n FROM p GROUP BY ALL")
def averaged_confusion(t):
    return evaluate.averaged_confusion(_experiment_predictions(t))


_RECALL = "r AS (SELECT strategy, run, actual AS label, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS r FROM p GROUP BY ALL), g AS (SELECT strategy, label, sum(r) / 3 AS r FROM r GROUP BY ALL)"


@query(f"WITH {_RUNS}, {_RECALL}, d AS (SELECT g.strategy, g.label, g.r - b.r AS d FROM g JOIN g b ON b.label = g.label AND b.strategy = 'baseline' WHERE g.strategy <> 'baseline') SELECT strategy, label, round(100 * d, 1) AS delta, CASE WHEN d > 0.03 THEN 'improved' WHEN d < -0.03 THEN 'degraded' ELSE 'unchanged' END AS impact FROM d")
def recall_impact(t):
    return evaluate.recall_impact(_experiment_predictions(t))


_GROUPED = """k AS (SELECT DISTINCT strategy, run, unnest([actual, predicted]) AS label FROM p), q AS (SELECT k.strategy, k.run, label, count(*) FILTER (actual = label AND predicted = label) AS tp, count(*) FILTER (predicted = label) AS said, count(*) FILTER (actual = label) AS own FROM k JOIN p ON p.strategy = k.strategy AND p.run = k.run GROUP BY ALL),
m AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS pr, coalesce(tp / nullif(own, 0), 0) AS rc FROM q), e AS (SELECT strategy, run, round(sum(tp) / sum(own), 4) AS accuracy, round(avg(round(pr, 4)), 4) AS precision, round(avg(round(rc, 4)), 4) AS recall, round(avg(round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 4)), 4) AS f1 FROM m GROUP BY ALL)"""


@query(f"WITH {_RUNS}, {_GROUPED} SELECT * FROM e")
def grouped_metrics(t):
    return evaluate.grouped_metrics(_experiment_predictions(t), ["strategy", "run"])


@query(f"WITH {_RUNS}, {_GROUPED} SELECT strategy, count(*) AS runs, round(avg(f1), 4) AS f1_mean, round(stddev_samp(f1), 4) AS f1_std, round(avg(accuracy), 4) AS accuracy_mean, round(avg(precision), 4) AS precision_mean, round(avg(recall), 4) AS recall_mean FROM e GROUP BY strategy")
def experiment_metrics(t):
    runs = evaluate.grouped_metrics(_experiment_predictions(t), ["strategy", "run"])
    return evaluate.metrics_table(runs, "orders", "rule").select("strategy", "runs", "f1_mean", "f1_std", "accuracy_mean", "precision_mean", "recall_mean")


_ORD = ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"]


@query("""SELECT 'o_orderkey' AS column_name, 'numeric' AS data_type, count(*) - count(o_orderkey) AS null_count, count(DISTINCT o_orderkey) AS unique_count, CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max, round(avg(o_orderkey), 6) AS mean, round(stddev_samp(o_orderkey), 6) AS std FROM orders
UNION ALL SELECT 'o_totalprice', 'numeric', count(*) - count(o_totalprice), count(DISTINCT o_totalprice), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 6), round(stddev_samp(o_totalprice), 6) FROM orders
UNION ALL SELECT 'o_orderstatus', 'categorical', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'o_orderdate', 'datetime', count(*) - count(o_orderdate), count(DISTINCT o_orderdate), epoch_ms(min(o_orderdate)), epoch_ms(max(o_orderdate)), NULL, NULL FROM orders""")
def table_profile(t):
    return describe.dataset_profile(t("orders").select(*_ORD))[0].select("column_name", "data_type", "null_count", "unique_count", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("SELECT count(*) AS rows, 4 AS columns, 2 AS numeric_columns, 1 AS categorical_columns, 1 AS datetime_columns, count(*) * 4 AS cells, 0 AS missing, 0.0 AS missing_pct FROM orders")
def table_summary(t):
    return describe.dataset_profile(t("orders").select(*_ORD))[1]


@query("SELECT CASE WHEN count(DISTINCT o_totalprice) > 10 THEN 'regression' ELSE 'classification' END AS task FROM orders")
def task_type(t):
    return evaluate.task_type(t("orders"), "o_totalprice")


@query("SELECT l_linenumber, round(x, 6) AS rank FROM (SELECT l_linenumber, avg(k) AS x FROM (SELECT o_orderkey % 7 AS l_linenumber, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM orders) GROUP BY 1)")
def ordinal_ranks(t):
    r = relations.ordinal_ranks(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey")
    return r.groupBy((F.col("o_orderkey") % 7).alias("l_linenumber")).agg(F.round(F.avg("rank"), 6).alias("rank"))


@query("SELECT c_mktsegment AS value, round(sum(n) OVER (ORDER BY c_mktsegment) / sum(n) OVER (), 9) AS share FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1)")
def cumulative_shares(t):
    return synth.category_shares(t("customer"), "c_mktsegment").select("value", F.round("share", 9).alias("share"))


@query("SELECT row_id, account_id FROM churn_rows ORDER BY row_id LIMIT 20 OFFSET 40")
def preview_page(t):
    from tabweave.sources.catalog import page

    return page(t("churn_rows").select("row_id", "account_id"), ["row_id"], 40, 20)


@query("SELECT record_id FROM raw_records WHERE trim(raw_text, ' \t\r\n') <> ''")
def drop_blank_rows(t):
    d = t("raw_records").withColumn("raw_text", F.btrim("raw_text", F.lit(" \t\r\n")))
    return clean.drop_blank_rows(d, ["raw_text"]).select("record_id")


@query("WITH m AS (SELECT n_nationkey % 5 AS i, n_regionkey AS j, CAST(sum(n_nationkey) AS DOUBLE) AS v FROM nation GROUP BY ALL) SELECT a.i, b.j, sum(a.v * b.v) AS value FROM m a JOIN m b ON a.j = b.i GROUP BY ALL")
def matrix_product(t):
    m = t("nation").groupBy((F.col("n_nationkey") % 5).alias("i"), F.col("n_regionkey").alias("j")).agg(F.sum("n_nationkey").cast("double").alias("value"))
    return evaluate.matrix_product(m, m)


#: Training rows that model_knn keeps as its model; the other models are fitted on all training rows, and all of them score all test rows.
KNN_FIT_ROWS = 5_000


def _labelled(t) -> DataFrame:
    """(row_id, churn_risk, numbers) of all churn rows with a risk: labels trimmed and in lower case, missing numbers null."""
    d = t("churn_rows").where(~text_missing(F.col("churn_risk")))
    return d.select("row_id", bare(F.col("churn_risk")).alias("churn_risk"), *[F.when(~number_missing(F.col(c)), F.col(c)).alias(c) for c in CHURN], F.when(~text_missing(F.col("contract_type")), bare(F.col("contract_type"))).alias("contract_type"))


def _predicted(t, kind: str) -> DataFrame:
    """(row_id, actual, predicted) of all test rows, a quarter of each class; the numbers and the contract are encoded by what the
    training rows say."""
    s = materialize(evaluate.stratified_split(_labelled(t), "churn_risk", "row_id"), "split")
    e = evaluate.fit_encoder(s.where("NOT is_test"), CHURN, ["contract_type"])
    train, test = (evaluate.encode(s.where(w), e, ["row_id", "churn_risk"]) for w in ("NOT is_test", "is_test"))
    return materialize(evaluate.fit_predict(train, test, "row_id", "churn_risk", e.columns, kind, fit_rows=KNN_FIT_ROWS), "predicted")


def _model(t, kind: str) -> DataFrame:
    return evaluate.summary_metrics(_predicted(t, kind))


@query()
def model_tree(t):
    return _model(t, "decision_tree")


@query()
def model_logistic(t):
    return _model(t, "logistic_regression")


@query()
def model_forest(t):
    return _model(t, "random_forest")


@query()
def model_knn(t):
    return _model(t, "knn")


# Export, sets, paging, stream --------------------------------------------------------------------------------------------


@query("""SELECT CAST(c_custkey AS VARCHAR) || ',' || CASE WHEN regexp_matches(n, '[",\\r\\n]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END || ',' || coalesce(CAST(c_nationkey AS VARCHAR), '') AS line FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN c_name || ', "x"' ELSE c_name END AS n FROM customer)""")
def csv_lines(t):
    d = t("customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(', "x"'))).otherwise(F.col("c_name")))
    return export.csv_lines(d, ["c_custkey", "c_name", "c_nationkey"])


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS line FROM nation""")
def json_lines(t):
    return export.json_lines(t("nation").select("n_nationkey", "n_name"))


@query("""SELECT '(' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ' || CASE WHEN c_custkey % 5 = 0 THEN 'NULL' ELSE '''' || c_mktsegment || '''' END || ')' AS values_text FROM customer""")
def sql_literals(t):
    return export.sql_rows(t("customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))), ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT unnest(['l_orderkey', 'l_quantity', 'l_discount', 'l_returnflag', 'l_shipdate']) AS column_name, unnest(['BIGINT', 'BIGINT', 'NUMERIC(14, 4)', 'VARCHAR(255)', 'TIMESTAMP']) AS sql_type")
def sql_type_infer(t):
    return export.sql_types(t("lineitem"), ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"], None)


@query()
def sql_inserts(t):
    return export.sql_inserts(t("customer"), "customer", "c_custkey")


@query("SELECT DISTINCT n_name AS k FROM nation UNION SELECT r_name FROM region")
def union_distinct(t):
    return evaluate.label_union(t("nation").select("n_name"), t("region").select("r_name"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def exclude_rows(t):
    return clean.exclude(t("customer"), t("orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclude_orders(t):
    return clean.exclude(t("orders"), t("lineitem").where("l_returnflag = 'R'"), "o_orderkey", "l_orderkey").select("o_orderkey")


@query("SELECT dataset_id, load_no, dataset_name, created_by FROM datasets WHERE contains(lower(dataset_name), 'panel') ORDER BY created_at DESC, dataset_id, load_no LIMIT 20 OFFSET 20")
def catalog_page(t):
    from tabweave.sources.catalog import page, search

    d = search(t("datasets"), "panel", "dataset_name")
    return page(d, [F.desc("created_at"), "dataset_id", "load_no"], 20, 20).select("dataset_id", "load_no", "dataset_name", "created_by")


@query("SELECT count(*) AS datasets, sum(row_count) AS rows, max(size_bytes) AS largest FROM datasets")
def catalog_rollup(t):
    from tabweave.sources.catalog import rollup

    return rollup(t("datasets"), "row_count", "size_bytes")


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY b DESC NULLS LAST, s_suppkey) AS place FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS b FROM supplier) ORDER BY place LIMIT 10")
def sorted_table(t):
    from pyspark.sql import Window

    top = t("supplier").withColumn("b", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal"))).orderBy(F.desc_nulls_last("b"), "s_suppkey").limit(10)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("b"), "s_suppkey")).cast("bigint")).select("s_suppkey", "s_name", "place")


@query("SELECT s_suppkey, s_name, row_number() OVER (ORDER BY b DESC NULLS LAST, s_suppkey) AS place FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS b FROM supplier)")
def sorted_rows(t):
    d = t("supplier").withColumn("b", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")))
    return clean.sort_rows(d, [F.desc_nulls_last("b")], "s_suppkey").select("s_suppkey", "s_name", "place")


@query("SELECT (SELECT count(*) FROM customer) AS rows, TRUE AS bounded, TRUE AS named")
def sql_insert_rows(t):
    """Rows in the statements of sql_inserts, whether none has more than 100, and whether all name the same columns."""
    s = export.sql_inserts(t("customer"), "customer", "c_custkey")
    n = F.size(F.split("statement", r"\n  \("))  - 1
    return s.agg(F.sum(n).alias("rows"), (F.max(n) <= 100).alias("bounded"), (F.count_distinct(F.substring_index("statement", " VALUES", 1)) == 1).alias("named"))


@query("""SELECT 0 AS place, '{"metadata":{"filename":"nation.json","exportedAt":"2024-01-01T00:00:00.000Z","rowCount":' || count(*) || ',"columnCount":2,"headers":["n_nationkey","n_name"]},"records":[' AS line FROM nation
UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' || CASE WHEN row_number() OVER (ORDER BY n_nationkey DESC) = 1 THEN '' ELSE ',' END FROM nation UNION ALL SELECT count(*) + 1, ']}' FROM nation""")
def json_structured(t):
    return export.json_structured(t("nation").select("n_nationkey", "n_name"), "n_nationkey", "nation.json", "2024-01-01T00:00:00.000Z")


_DISPLAY = ["smote", "combined", "other", "noise_injection"]


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CASE o_orderkey % 4 WHEN 0 THEN 'SMOTE' WHEN 1 THEN 'Combined Strategy' WHEN 2 THEN 'other' ELSE 'Noise Injection' END AS strategy, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 604800 THEN s // 86400 || 'd ago' ELSE strftime(o_orderdate, '%b %-d, %Y') END AS ago FROM (SELECT *, (epoch_ms((SELECT max(o_orderdate) FROM orders)) - epoch_ms(o_orderdate)) // 1000 AS s FROM orders)")
def display_texts(t):
    d = t("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"))
    now = one_row(d.agg(F.max("at").alias("m")))["m"]
    name = F.get(F.array(*[F.lit(x) for x in _DISPLAY]), (F.col("o_orderkey") % 4).cast("int"))
    return d.select("o_orderkey", scalars.iso_date(F.col("at")).alias("iso"), scalars.labelled(name, scalars.STRATEGY_LABELS).alias("strategy"), scalars.relative_time(F.col("at"), now).alias("ago"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_days(t):
    return None


def stream_moments(spark: SparkSession, sf: str) -> DataFrame:
    """windowed_moments() of the events, run as a stream to its end: all windows, those still open at the end too, over all events
    with a time, however late. The stream runs in complete mode and the result of its last batch is kept."""
    import uuid

    path = f"{sf}/events.parquet"
    base, schema = f"{shared_dir(spark)}/tabweave/stream-{uuid.uuid4().hex}", spark.read.parquet(path).schema
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    out = windowed_moments(stream, "ts", "value", "event_type")
    last: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        last[:] = [f"{base}/out/batch={number}"]

    q = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(*last) if last else spark.createDataFrame([], out.schema)


def _stream_days(spark: SparkSession, sf: str) -> DataFrame:
    """stream_moments() with days as text."""
    return stream_moments(spark, sf).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


QUERIES["stream_moments"] = stream_moments
QUERIES["stream_days"] = _stream_days
