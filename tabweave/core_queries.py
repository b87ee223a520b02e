"""Queries of the general problems, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.missing import ALL_TOKENS, bare, number_missing, text_missing
from tabweave.operators.impute import filled_cells, impute
from tabweave.operators.quality import Layout, column_defects, column_profile
from tabweave.operators.records import SEPARATORS, parse_records
from tabweave.operators.timestamps import DICTIONARY, VERSION, normalize_timestamps
from tabweave.plans.physical import materialize, shared_dir


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


#: Every column of churn_rows but the key of its loads. Labels may be spelled with outer blanks and in any case.
PANEL = Layout(
    codes=("account_id", "plan_code", "site_code"),
    numbers=("account_age_months", "monthly_charges", "usage_hours", "support_tickets", "row_no", "row_id"),
    signed=("row_no", "row_id"),
    times=("observed_at", "ingested_at"),
    patterns={
        "account_id": "[A-Z]{2}-[0-9]{8}", "plan_code": "[A-Z][0-9]{2}-[A-Z]{2}", "site_code": "[A-Z][0-9]{2}",
        "contract_type": r"(?i)[ \t]*(?:month-to-month|one-year|two-year)[ \t]*", "churn_risk": r"(?i)[ \t]*(?:low|medium|high)[ \t]*"})

#: The columns whose defects p1_found reports, with their patterns.
FOUND = Layout(patterns={k: v for k, v in PANEL.patterns.items() if k != "site_code"})


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return column_defects(_read(spark, sf, "churn_rows"), _read(spark, sf, "column_profiles"), FOUND).select("dataset_id", "load_no", "column_name", "issue")


def p1_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The whole profile, its figures at digits in which two ways of adding up doubles agree."""
    digits = {"missing_share": 9, "missing_shift": 9, "min": 3, "max": 3, "mean": 7, "std": 6, "skew": 7, "kurtosis": 6, "mean_shift": 7}
    t = column_profile(_read(spark, sf, "churn_rows"), PANEL).withColumns({c: F.round(c, d) for c, d in digits.items()})
    return t.withColumn("mean", F.when(F.col("column_name").isin(*PANEL.times), F.round("mean", 5)).otherwise(F.col("mean")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return parse_records(_read(spark, sf, "raw_records")).where(F.col("reason").isNotNull()).select("record_id", "reason")


def p2_parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_records(_read(spark, sf, "raw_records")).where(F.col("reason").isNull()).drop("reason", "reason_column", "raw_kept", "raw_text")


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """p2_parsed() with its date as text."""
    t = p2_parsed(spark, sf)
    return t.select("record_id", *[F.round(c, 9).alias(c) for c in ("annual_income", "credit_score", "debt_ratio")], F.col("applied_on").cast("string").alias("applied_on"), "applicant_id", "applicant_name", "loan_approved")


_FILLED = ["account_age_months", "monthly_charges", "usage_hours", "support_tickets", "contract_type"]
_DECIMALS = {"account_age_months": 0, "monthly_charges": 2, "usage_hours": 1, "support_tickets": 0}


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    done = impute(_read(spark, sf, "churn_rows"), decimals=_DECIMALS, keep=["row_id"])
    return filled_cells(done, "row_id", _FILLED).where(F.col("source") == "group").select("row_id", "column_name")


def p3_filled(spark: SparkSession, sf: str) -> DataFrame:
    return impute(_read(spark, sf, "churn_rows"), decimals=_DECIMALS)


def p3_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One row a column: cells, missing ones, and whether all present values are kept, all missing ones are filled and marked, and those
    filled from their group lie within what it has."""
    rows = _read(spark, sf, "churn_rows")
    t = impute(rows, decimals=_DECIMALS)
    keys = ["dataset_id", "load_no", "site_code"]
    number = {c: F.when(~number_missing(F.col(c)), F.col(c)) for c in _FILLED[:4]}
    ends = rows.groupBy(*keys).agg(*[e for c, x in number.items() for e in (F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}"))])
    t = t.join(ends, keys, "left")
    parts = []
    for c in _FILLED:
        gone = number_missing(F.col(c)) if c in number else text_missing(F.col(c))
        own = F.col(f"{c}_filled") == F.col(c) if c in number else bare(F.col(f"{c}_filled")) == bare(F.col(c))
        step = 0.5 * 10.0 ** -_DECIMALS.get(c, 0)
        inside = F.col(f"{c}_filled").between(F.col(f"lo_{c}") - step, F.col(f"hi_{c}") + step) if c in number else F.lit(True)
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("cells"), F.count_if(gone).alias("missing"), (F.count_if(~gone & ~F.coalesce(own, F.lit(False))) == 0).alias("kept"),
                              (F.count_if(gone & (F.col(f"{c}_filled").isNull() | F.col(f"{c}_source").isNull())) + F.count_if(~gone & F.col(f"{c}_source").isNotNull()) == 0).alias("marked"), (F.count_if(gone & (F.col(f"{c}_source") == "group") & ~inside) == 0).alias("inside")))
    return t.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("e")).select("e.*")


_STAMP_SOURCE = ("dataset_id", "column_name")


def _stamps(spark: SparkSession, rows: DataFrame, dictionary: str) -> DataFrame:
    return normalize_timestamps(rows, "raw_value", "zone_name", dictionary, source=_STAMP_SOURCE)


def _new_dictionary(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tabweave/instants-{uuid.uuid4().hex}"


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _stamps(spark, _read(spark, sf, "stamp_cells"), _new_dictionary(spark)).where(F.col("status") == "read").select("stamp_id", "outcome")


def p5_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return _stamps(spark, _read(spark, sf, "stamp_cells"), _new_dictionary(spark))


def p5_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell with what it denotes, in microseconds too."""
    return p5_normalized(spark, sf).select("stamp_id", "outcome", "micros", "status")


def p5_increments(spark: SparkSession, sf: str) -> DataFrame:
    """(step, rows, words): the dictionary after the cells received in the first half of the time, and after all of them."""
    cells, path, out = _read(spark, sf, "stamp_cells"), _new_dictionary(spark), None
    ends = cells.agg(F.min("received_at").alias("a"), F.max("received_at").alias("b")).first()
    half = F.coalesce(F.col("received_at") <= F.lit(ends.a + (ends.b - ends.a) / 2), F.lit(True)) if ends.a else F.lit(True)
    for step, part in enumerate((cells.where(half), cells), 1):
        rows = _stamps(spark, part, path).where(F.col("outcome").isNotNull() | (F.col("status") == "missing")).agg(F.count(F.lit(1)).alias("rows"))
        words = materialize(spark.read.schema(DICTIONARY).parquet(f"{path}/version={VERSION}").agg(F.count(F.lit(1)).alias("words")), "words")
        one = materialize(rows, "rows").select(F.lit(step).cast("bigint").alias("step"), "rows").crossJoin(words)
        out = one if out is None else out.unionByName(one)
    return out


def p1_moments(spark: SparkSession, sf: str) -> DataFrame:
    figures = [F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")]
    return column_profile(_read(spark, sf, "churn_rows")).select("dataset_id", "load_no", "column_name", "rows", "missing", "distinct", *figures)


QUERIES = {"p1_found": p1_found, "p1_profile": p1_profile, "p1_moments": p1_moments, "p2_found": p2_found, "p2_parsed": p2_parsed, "p2_values": p2_values, "p3_found": p3_found, "p3_filled": p3_filled, "p3_kept": p3_kept, "p5_found": p5_found, "p5_normalized": p5_normalized, "p5_increments": p5_increments, "p5_outcomes": p5_outcomes}

# The tokens and the reading of missing values are those of tabweave.functions.missing.
_TOKENS = "(" + ",".join(f"'{t}'" for t in ALL_TOKENS) + ")"
_NUM = "account_age_months monthly_charges usage_hours support_tickets".split()
_TXT = "account_id plan_code contract_type churn_risk".split()
_CELLS = " UNION ALL ".join(
    [f"SELECT row_id, dataset_id, load_no, '{c}' AS column_name, CASE WHEN isnan({c}) OR {c} < 0 THEN NULL ELSE {c} END AS x, CAST(NULL AS VARCHAR) AS t, site_code FROM churn_rows" for c in _NUM]
    + [f"SELECT row_id, dataset_id, load_no, '{c}', CAST(NULL AS DOUBLE), CASE WHEN lower(trim({c}, ' \t')) IN {_TOKENS} THEN NULL ELSE {c} END, site_code FROM churn_rows" for c in _TXT]
)

_P1_FOUND = f"""
WITH cells AS ({_CELLS}),
s AS (SELECT dataset_id, load_no, column_name, count(*) AS n, count(x) + count(t) AS m, min(x) AS lo, max(x) AS hi FROM cells GROUP BY ALL),
p AS (SELECT *, lag(load_no) OVER w AS l0, lag(n) OVER w AS n0, lag(m) OVER w AS m0, lag(hi) OVER w AS hi0 FROM s WINDOW w AS (PARTITION BY dataset_id, column_name ORDER BY load_no)),
forms AS (SELECT dataset_id, load_no, column_name, regexp_replace(regexp_replace(regexp_replace(t, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS f, count(*) AS k
  FROM cells WHERE t IS NOT NULL AND column_name IN ('account_id', 'plan_code') GROUP BY ALL),
tops AS (SELECT dataset_id, load_no, column_name, max(k) AS top, sum(k) AS m FROM forms GROUP BY ALL),
both_ AS (
  SELECT p.dataset_id, p.load_no, p.column_name, c.x, lower(trim(c.t, ' \t')) AS t, 1 AS own, p.m, p.m0 FROM p JOIN cells c ON c.dataset_id = p.dataset_id AND c.load_no = p.load_no AND c.column_name = p.column_name WHERE p.m > 0 AND p.m0 > 0
  UNION ALL
  SELECT p.dataset_id, p.load_no, p.column_name, c.x, lower(trim(c.t, ' \t')), 0, p.m, p.m0 FROM p JOIN cells c ON c.dataset_id = p.dataset_id AND c.load_no = p.l0 AND c.column_name = p.column_name WHERE p.m > 0 AND p.m0 > 0),
vals AS (SELECT dataset_id, load_no, column_name, x, sum(own) / any_value(m) AS a, sum(1 - own) / any_value(m0) AS b FROM both_ WHERE x IS NOT NULL GROUP BY dataset_id, load_no, column_name, x),
cdf AS (SELECT dataset_id, load_no, column_name, abs(sum(a) OVER w - sum(b) OVER w) AS d FROM vals WINDOW w AS (PARTITION BY dataset_id, load_no, column_name ORDER BY x)),
lab AS (SELECT dataset_id, load_no, column_name, t, abs(sum(own) / any_value(m) - sum(1 - own) / any_value(m0)) AS d FROM both_ WHERE t IS NOT NULL AND column_name IN ('contract_type', 'churn_risk') GROUP BY dataset_id, load_no, column_name, t)
SELECT dataset_id, load_no, column_name, 'nulls' AS issue FROM p WHERE abs((n - m) / n - (n0 - m0) / n0) > 0.101
UNION ALL SELECT dataset_id, load_no, column_name, 'range' FROM p WHERE hi > 5.001 * hi0
UNION ALL SELECT dataset_id, load_no, column_name, 'drift' FROM cdf GROUP BY ALL HAVING max(d) > 0.301
UNION ALL SELECT dataset_id, load_no, column_name, 'drift' FROM lab GROUP BY ALL HAVING sum(d) / 2 > 0.201
UNION ALL SELECT dataset_id, load_no, column_name, 'shape' FROM tops WHERE (m - top) / m > 0.0101
UNION ALL SELECT DISTINCT s.dataset_id, s.load_no, s.column_name, 'stored' FROM s JOIN column_profiles q ON q.dataset_id = s.dataset_id AND q.load_no = s.load_no AND q.column_name = s.column_name
  WHERE q.null_count IS DISTINCT FROM s.n - s.m OR q.min_value IS DISTINCT FROM s.lo OR q.max_value IS DISTINCT FROM s.hi
"""



def _p2_ctes() -> str:
    names = "('annual_income', 'credit_score', 'debt_ratio', 'applied_on')"
    parts = []
    for sep in SEPARATORS:
        s = "\\t" if sep == "\t" else "\\|" if sep == "|" else sep
        item = f'("(?:[^"]|"")*"|[^"{s}][^{s}]*|)'
        parts.append(f"""SELECT record_id, names, NOT regexp_full_match(raw_text, '(?s)(?:{item}{s})*{item}') AS broken,
          list_transform(regexp_extract_all(raw_text || chr({ord(sep)}), '(?s){item}{s}', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS fields
          FROM body WHERE sep = chr({ord(sep)})""")
    number = r"[+-]?(?:[0-9]+\.?[0-9]*|[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
    return f"""
WITH h0 AS (SELECT upload_id, ltrim(raw_text, chr(65279)) AS h FROM raw_records WHERE record_no = 1),
h1 AS (SELECT upload_id, h, [{", ".join(f"length(regexp_replace(h, '[^{chr(92) + 't' if x == chr(9) else x}]', '', 'g'))" for x in SEPARATORS)}] AS k FROM h0),
heads AS (SELECT upload_id, [{", ".join(f"chr({ord(x)})" for x in SEPARATORS)}][list_position(k, list_max(k))] AS sep, h FROM h1),
named AS (SELECT upload_id, sep, list_transform(string_split(h, sep), lambda x: trim(x, ' "')) AS names FROM heads),
body AS (SELECT r.record_id, r.raw_text, n.sep, n.names FROM raw_records r JOIN named n USING (upload_id) WHERE r.record_no > 1 AND trim(r.raw_text, ' 	
') <> ''),
cut AS ({" UNION ALL ".join(parts)}),
cells AS (SELECT record_id, unnest(names) AS name, trim(unnest(fields), ' 	') AS v FROM cut WHERE NOT broken AND len(names) = len(fields)),
bare AS (SELECT record_id, name, v, regexp_replace(regexp_replace(regexp_replace(v, '(?s)^\\((.*)\\)$', '\\1'), '^[$€]', ''), '%$', '') AS b FROM cells WHERE name IN {names} AND lower(v) NOT IN {_TOKENS}),
bad AS (SELECT DISTINCT record_id FROM bare WHERE CASE WHEN name = 'applied_on' THEN NOT regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast(v AS DATE) IS NULL ELSE NOT regexp_full_match(b, '{number}') END)
"""


_P2_FOUND = _p2_ctes() + """SELECT record_id, 'broken_quoting' AS reason FROM cut WHERE broken
UNION ALL SELECT record_id, 'column_count' FROM cut WHERE NOT broken AND len(names) <> len(fields)
UNION ALL SELECT record_id, 'invalid_value' FROM bad
"""


def _p2_values() -> str:
    number = lambda c: f"CASE WHEN {c}_b IS NULL THEN NULL ELSE (CASE WHEN starts_with({c}_t, '(') THEN -1 ELSE 1 END) * CAST(replace({c}_b, ',', '') AS DOUBLE) / (CASE WHEN regexp_full_match({c}_t, '(?s).*%[)]?') THEN 100 ELSE 1 END) END"
    names = ("annual_income", "credit_score", "debt_ratio", "applied_on", "applicant_id", "applicant_name", "loan_approved")
    raw = ", ".join(f"fields[list_position(names, '{c}')] AS {c}_r" for c in names)
    there = lambda c: f"lower(trim({c}_r, ' \t')) NOT IN {_TOKENS}"
    bare_ = lambda c: f"regexp_replace(regexp_replace(regexp_replace(trim({c}_r, ' \t'), '(?s)^\\((.*)\\)$', '\\1'), '^[$€]', ''), '%$', '')"
    return _p2_ctes().rstrip() + f""",
good AS (SELECT c.record_id, {raw} FROM cut c WHERE NOT broken AND len(names) = len(fields) AND record_id NOT IN (SELECT record_id FROM bad)),
w AS (SELECT record_id, {", ".join(f"trim({c}_r, ' \t') AS {c}_t, CASE WHEN {there(c)} THEN {bare_(c)} END AS {c}_b" for c in names[:3])}, {", ".join(f"CASE WHEN {there(c)} THEN {c}_r END AS {c}" for c in names[3:])} FROM good)
SELECT record_id, {", ".join(f"round({number(c)}, 9) AS {c}" for c in names[:3])}, trim(applied_on, ' \t') AS applied_on, applicant_id, applicant_name, loan_approved FROM w"""




_P1_MOMENTS = f"""
WITH cells AS ({_CELLS})
SELECT dataset_id, load_no, column_name, count(*) AS rows, count(*) - count(x) - count(t) AS missing, count(DISTINCT x) + count(DISTINCT t) AS "distinct",
  round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std FROM cells GROUP BY ALL
"""

def _p1_profile() -> str:
    """Two passes: means first, then sums of powers of the distance from them."""
    parts = []
    for c in PANEL.columns:
        if c in PANEL.numbers:
            x = f"CASE WHEN {c} IS NULL OR isnan(CAST({c} AS DOUBLE)){'' if c in PANEL.signed else f' OR {c} < 0'} THEN NULL ELSE CAST({c} AS DOUBLE) END"
            parts.append(f"SELECT dataset_id, load_no, '{c}' AS column_name, {x} AS x, CAST(NULL AS VARCHAR) AS t, CAST(NULL AS VARCHAR) AS f, FALSE AS wrong, FALSE AS is_time FROM churn_rows")
        else:
            t = f"CASE WHEN lower(trim({c}, ' \t')) IN {_TOKENS} THEN NULL ELSE {c} END"
            f = f"lower(trim({c}, ' \t'))" if c in PANEL.labels else f"regexp_replace(regexp_replace(regexp_replace({c}, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g')"
            parts.append(f"SELECT dataset_id, load_no, '{c}', CAST(NULL AS DOUBLE), {t}, CASE WHEN ({t}) IS NOT NULL THEN {f} END, NOT regexp_full_match(({t}), '{PANEL.patterns[c]}'), FALSE FROM churn_rows")
    for c in PANEL.times:
        parts.append(f"SELECT dataset_id, load_no, '{c}', epoch_us({c}) / 1e6 - 1.7e9, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), FALSE, TRUE FROM churn_rows")
    return f"""
WITH cells(dataset_id, load_no, column_name, x, t, f, wrong, is_time) AS ({" UNION ALL ".join(parts)}),
a AS (SELECT dataset_id, load_no, column_name, count(*) AS rows, count(*) - count(x) - count(t) AS missing, count(DISTINCT x) + count(DISTINCT t) AS d, count(x) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS m,
  count(*) FILTER (wrong) AS violations, count(*) FILTER (NOT is_time AND (abs(x) >= 1e12 OR round(x * 1e6) / 1e6 <> x)) AS inexact, any_value(CASE WHEN is_time THEN 1.7e9 ELSE 0 END) AS origin FROM cells GROUP BY dataset_id, load_no, column_name),
p AS (SELECT c.dataset_id, c.load_no, c.column_name, sum((x - m) ** 2) AS m2, sum((x - m) ** 3) AS m3, sum((x - m) ** 4) AS m4 FROM cells c JOIN a ON a.dataset_id = c.dataset_id AND a.load_no = c.load_no AND a.column_name = c.column_name GROUP BY ALL),
forms AS (SELECT dataset_id, load_no, column_name, f, count(*) AS k FROM cells WHERE f IS NOT NULL GROUP BY ALL),
tops AS (SELECT dataset_id, load_no, column_name, f AS top_form, k AS top_count FROM forms QUALIFY row_number() OVER (PARTITION BY dataset_id, load_no, column_name ORDER BY k DESC, f DESC) = 1),
s AS (SELECT a.*, m2, m3, m4, CASE WHEN n >= 2 THEN CASE WHEN lo = hi THEN 0.0 ELSE sqrt(m2 / (n - 1)) END END AS std FROM a JOIN p USING (dataset_id, load_no, column_name)),
b AS (SELECT *, lag(m) OVER w AS b_m, lag(std) OVER w AS b_std, lag(n) OVER w AS b_n, lag(missing / rows) OVER w AS b_gap FROM s WINDOW w AS (PARTITION BY dataset_id, column_name ORDER BY load_no))
SELECT dataset_id, load_no, column_name, rows, missing, round(missing / rows, 9) AS missing_share, round(missing / rows - b_gap, 9) AS missing_shift, d AS "distinct", round(lo + origin, 3) AS min, round(hi + origin, 3) AS max,
  CASE WHEN origin > 0 THEN round(m + origin, 5) ELSE round(m, 7) END AS mean, round(std, 6) AS std, round(CASE WHEN n >= 3 THEN CASE WHEN lo = hi THEN 0.0 ELSE sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / (m2 / n) ** 1.5 END END, 7) AS skew,
  round(CASE WHEN n >= 4 THEN CASE WHEN lo = hi THEN 0.0 ELSE (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * ((m4 / n) / (m2 / n) ** 2 - 3) + 6) END END, 6) AS kurtosis,
  round(CASE WHEN n >= 2 AND b_n >= 2 THEN (m - b_m) / nullif(sqrt((std ** 2 * (n - 1) + b_std ** 2 * (b_n - 1)) / (n + b_n - 2)), 0) END, 7) AS mean_shift, top_form, top_count, violations, inexact
FROM b LEFT JOIN tops USING (dataset_id, load_no, column_name)"""


_P3_FOUND = f"""
WITH cells AS ({_CELLS}),
s AS (SELECT dataset_id, load_no, site_code, column_name, count(x) + count(t) AS n FROM cells WHERE lower(trim(site_code, ' \t')) NOT IN {_TOKENS} AND column_name NOT IN ('account_id', 'plan_code', 'churn_risk') GROUP BY ALL)
SELECT c.row_id, c.column_name FROM cells c JOIN s USING (dataset_id, load_no, site_code, column_name) WHERE c.x IS NULL AND c.t IS NULL AND s.n > 0
"""

_P3_KEPT = f"""
WITH cells AS ({_CELLS})
SELECT column_name, count(*) AS cells, count(*) - count(x) - count(t) AS missing, TRUE AS kept, TRUE AS marked, TRUE AS "inside" FROM cells WHERE column_name NOT IN ('account_id', 'plan_code', 'churn_risk') GROUP BY column_name"""

_P5_INCREMENTS = f"""
WITH m AS (SELECT min(received_at) AS a, max(received_at) AS b FROM stamp_cells),
c AS (SELECT dataset_id, column_name, received_at, trim(raw_value, ' \t') AS raw, CASE WHEN zone_name IS NULL OR lower(trim(zone_name, ' \t')) IN {_TOKENS} THEN '' ELSE trim(zone_name, ' \t') END AS zone,
  raw_value IS NULL OR lower(trim(raw_value, ' \t')) IN {_TOKENS} AS gone, regexp_full_match(coalesce(raw_value, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\.[0-9]{{6}}Z') AND try_cast(raw_value AS TIMESTAMP) IS NOT NULL AS fine FROM stamp_cells),
s AS (SELECT 1 AS step, c.* FROM c, m WHERE received_at <= a + (b - a) / 2 UNION ALL SELECT 2, c.* FROM c)
SELECT step, count(*) AS rows, count(DISTINCT CASE WHEN NOT gone AND NOT fine THEN (dataset_id, column_name, raw, zone) END) AS words FROM s GROUP BY step"""

def _instants() -> str:
    """SQL of read_instant(): stamp_cells as c with `wall`, `off` (minutes) or `named` (a zone), and from those `outcome` of each text."""
    time = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
    zone = r"(?:\s*(?:([+-]\d{2}(?::?\d{2})?)|([A-Za-z]{1,5})))?(\s*\[[^\[\]]*\])?"
    when = rf"(?:(?:[Tt]|,?\s+){time})?{zone}"
    tail = ["h", "mi", "s", "f", "ap", "off", "abbr", "zone"]
    forms = {
        "a": (rf"(\d{{4}})([-/.])(\d{{1,2}})([-/.])(\d{{1,2}}){when}", ["y", "s1", "m", "s2", "d", *tail]),
        "b": (rf"(\d{{1,2}})([-/.])(\d{{1,2}})([-/.])(\d{{4}}){when}", ["d", "s1", "m", "s2", "y", *tail]),
        "c": (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d+))?)?)?{zone}", ["y", "m", "d", "h", "mi", "s", "f", "off", "abbr", "zone"]),
        "d": (rf"(?:([A-Za-z]{{3,9}}),?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+([A-Za-z]{{3,9}})\.?,?[\s-]+(\d{{4}}){when}", ["wd", "d", "mon", "y", *tail]),
        "e": (rf"(?:([A-Za-z]{{3,9}}),?\s+)?([A-Za-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){when}", ["wd", "mon", "d", "y", *tail])}
    fits = {k: f"regexp_full_match(t, '{rx}')" + (f" AND regexp_extract(t, '^{rx}$', 2) = regexp_extract(t, '^{rx}$', 4)" if k in "ab" else "") for k, (rx, _) in forms.items()}
    part = lambda name: "coalesce(CASE form " + " ".join(f"WHEN '{k}' THEN x{k}.{name}_" for k, (_, names) in forms.items() if name in names) + " END, '')"
    taken = ", ".join(f"CASE WHEN form = '{k}' THEN regexp_extract(t, '^{rx}$', {[n + '_' for n in names]}) END AS x{k}" for k, (rx, names) in forms.items())
    months = "['january','february','march','april','may','june','july','august','september','october','november','december']"
    date = lambda y, m, d: f"try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE)"
    return f"""
t0 AS (SELECT *, trim(raw_value, ' \t\r\n') AS t, raw_value IS NULL OR lower(trim(raw_value, ' \t')) IN {_TOKENS} AS gone,
  regexp_full_match(coalesce(raw_value, ''), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\.[0-9]{{6}}Z') AND try_cast(raw_value AS TIMESTAMP) IS NOT NULL AS fine FROM stamp_cells),
t1 AS (SELECT *, CASE WHEN gone OR fine THEN NULL WHEN regexp_full_match(t, '[0-9]+') AND length(t) IN (10, 13, 16) THEN 'epoch' {" ".join(f"WHEN {e} THEN '{k}'" for k, e in fits.items())} END AS form FROM t0),
tx AS (SELECT *, {taken} FROM t1),
t2 AS (SELECT *, {", ".join(f"{part(n)} AS g_{n}" for n in ("y", "m", "d", "mon", "wd", *tail))} FROM tx),
t3 AS (SELECT *, TRY_CAST(g_y AS INT) AS y, TRY_CAST(g_d AS INT) AS d, CASE WHEN g_mon <> '' THEN CASE WHEN lower(g_mon) = 'sept' THEN 9 ELSE list_position(list_transform({months}, lambda x: x = lower(g_mon) OR x[1:3] = lower(g_mon)), TRUE) END ELSE TRY_CAST(g_m AS INT) END AS m,
  coalesce(TRY_CAST(g_h AS INT), 0) AS h0, coalesce(TRY_CAST(g_mi AS INT), 0) AS mi, coalesce(TRY_CAST(g_s AS INT), 0) AS s, CAST(rpad(substr(g_f, 1, 6), 6, '0') AS INT) AS us FROM t2),
t4 AS (SELECT *, CASE WHEN y IS NULL OR y = 0 OR m IS NULL OR m = 0 THEN NULL WHEN form = 'b' THEN coalesce({date("y", "m", "d")}, {date("y", "d", "m")}) ELSE {date("y", "m", "d")} END AS day,
  CASE WHEN g_ap = '' THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN lower(g_ap) = 'p' THEN 12 ELSE 0 END ELSE 99 END AS h,
  CASE WHEN g_off <> '' THEN (CASE WHEN g_off[1] = '-' THEN -1 ELSE 1 END) * (CAST(g_off[2:3] AS INT) * 60 + coalesce(TRY_CAST(replace(g_off[4:], ':', '') AS INT), 0)) WHEN g_abbr <> '' THEN CASE upper(g_abbr) WHEN 'Z' THEN 0 WHEN 'UTC' THEN 0 WHEN 'GMT' THEN 0 WHEN 'EST' THEN -300 WHEN 'EDT' THEN -240 WHEN 'CET' THEN 60 WHEN 'CEST' THEN 120 ELSE 9999 END END AS off,
  CASE WHEN trim(g_zone) <> '' THEN trim(trim(g_zone)[2:-2]) WHEN zone_name IS NULL OR lower(trim(zone_name, ' \t')) IN {_TOKENS} THEN 'UTC' ELSE trim(zone_name, ' \t') END AS named FROM t3),
t5 AS (SELECT *, form IS NOT NULL AND form <> 'epoch' AND day IS NOT NULL AND h <= 23 AND mi <= 59 AND s <= 59 AND (g_wd = '' OR starts_with(lower(dayname(day)), lower(g_wd)))
  AND (off IS NULL OR (off BETWEEN -720 AND 840 AND coalesce(TRY_CAST(replace(g_off[4:], ':', '') AS INT), 0) <= 59)) AND (off IS NOT NULL OR named IN (SELECT name FROM pg_timezone_names()) OR upper(named) IN ('Z', 'UTC', 'GMT')) AS ok FROM t4),
t6 AS (SELECT *, CASE WHEN ok THEN CAST(day AS TIMESTAMP) + to_hours(h) + to_minutes(mi) + to_microseconds(s * 1000000 + us) END AS wall, CASE WHEN upper(named) IN ('Z', 'UTC', 'GMT') OR NOT ok THEN 'UTC' ELSE named END AS z FROM t5),
t7 AS (SELECT *, CASE WHEN wall IS NOT NULL AND off IS NULL THEN timezone(z, wall) END AS probe FROM t6),
t8 AS (SELECT *, CASE WHEN probe IS NOT NULL THEN list_distinct(list_filter([probe - to_minutes(60), probe - to_minutes(30), probe, probe + to_minutes(30), probe + to_minutes(60)], lambda u: timezone(z, u) = wall)) END AS found FROM t7),
c AS (SELECT *, CASE WHEN form = 'epoch' THEN make_timestamp(CAST(t AS BIGINT) * CASE length(t) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END) WHEN wall IS NULL THEN NULL WHEN off IS NOT NULL THEN wall - to_minutes(off) WHEN len(found) = 1 THEN timezone('UTC', found[1]) END AS instant FROM t8),
o AS (SELECT *, CASE WHEN gone THEN NULL WHEN fine THEN raw_value WHEN instant IS NOT NULL THEN strftime(instant, '%Y-%m-%dT%H:%M:%S.%fZ') WHEN wall IS NULL THEN 'invalid' WHEN len(found) = 0 THEN 'nonexistent' ELSE 'ambiguous' END AS outcome FROM c)"""


_P5_FOUND = f"WITH {_instants()} SELECT stamp_id, outcome FROM o WHERE NOT gone AND NOT fine"

_P5_OUTCOMES = f"WITH {_instants()} SELECT stamp_id, outcome, CASE WHEN gone THEN NULL WHEN fine THEN epoch_us(CAST(raw_value AS TIMESTAMP)) ELSE epoch_us(instant) END AS micros, CASE WHEN gone THEN 'missing' WHEN fine THEN 'canonical' ELSE 'read' END AS status FROM o"

ORACLES = {"p5_found": _P5_FOUND, "p3_kept": _P3_KEPT, "p5_increments": _P5_INCREMENTS, "p1_found": _P1_FOUND, "p1_profile": _p1_profile(), "p1_moments": _P1_MOMENTS, "p3_found": _P3_FOUND, "p2_found": _P2_FOUND, "p2_values": _p2_values(), "p5_outcomes": _P5_OUTCOMES}
