"""Queries of the language-model problems, with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions.missing import ALL_TOKENS
from tabweave.llm.leakage import leak_report, leaked_items
from tabweave.llm.packing import pack_documents
from tabweave.llm.quotas import draw_sample, label_of, quotas, sample_report, shortfalls
from tabweave.llm.splitting import split_documents
from tabweave.llm.tokens import count_tokens


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return shortfalls(quotas(_read(spark, sf, "churn_rows"), _read(spark, sf, "sample_targets"))).select("request_id", "class_label")


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    return draw_sample(_read(spark, sf, "churn_rows"), _read(spark, sf, "sample_targets"), keep_size=True)


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """What each class of each request asked for, has and got, and its share of the sample."""
    t = sample_report(quotas(_read(spark, sf, "churn_rows"), _read(spark, sf, "sample_targets"), keep_size=True))
    return t.select("request_id", "class_label", "need", "have", "got", "short", "given_up", F.round("share", 9).alias("share"), "over")


def p4_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One row a request: what p4_sample keeps of its promises, counted on the drawn rows themselves."""
    rows, targets = _read(spark, sf, "churn_rows"), _read(spark, sf, "sample_targets")
    drawn = draw_sample(rows, targets, keep_size=True)
    own = rows.select("row_id", "dataset_id", "load_no", "row_no", label_of(F.col("churn_risk")).alias("own"))
    d = drawn.join(own, ["row_id", "dataset_id", "load_no", "row_no"], "left").withColumn("right", F.coalesce(F.col("own") == label_of(F.col("class_label")), F.lit(False)))
    by = d.groupBy("request_id", "class_label").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("right"))
    whole = d.groupBy("request_id").agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("row_no").alias("rows"))
    t = targets.select("request_id", "class_label", "sample_size", "min_per_class").join(by, ["request_id", "class_label"], "left")
    have = _report_have(rows, targets)
    t = t.join(have, ["request_id", "class_label"]).groupBy("request_id").agg(
        F.max("sample_size").alias("size"), F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("right", F.lit(0))).alias("right"), F.sum(F.least("min_per_class", "have")).alias("floors"),
        F.min(F.coalesce("n", F.lit(0)) >= F.least("min_per_class", "have")).alias("minima"), F.sum(F.least("need", "have")).alias("asked"))
    t = t.join(whole, "request_id", "left")
    # As many rows as asked for and there are, or the size, or the minima where they are more.
    full = F.greatest(F.least("size", "asked"), "floors") == F.col("n")
    return t.select("request_id", F.col("n").alias("drawn"), (F.coalesce("rows", F.lit(0)) == F.col("n")).alias("distinct"), (F.col("right") == F.col("n")).alias("of_class"), "minima", full.alias("full"))


def _report_have(rows: DataFrame, targets: DataFrame) -> DataFrame:
    return sample_report(quotas(rows, targets)).select("request_id", "class_label", "need", "have")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_packing(spark, sf).where(F.col("parts") > 1).select("doc_id").distinct()


def p6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(_read(spark, sf, "documents"), _read(spark, sf, "token_limits"))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, their length and what is in them, by source."""
    bins = p6_packing(spark, sf).where(F.col("container").isNotNull()).select("source", "container", "container_length", "container_used").distinct()
    return bins.groupBy("source").agg(F.count(F.lit(1)).alias("containers"), F.sum("container_length").alias("room"), F.sum("container_used").alias("used"))


def p6_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One row a source: its documents and tokens, and whether every document is placed once and whole, every container holds what it
    says and no more than its length, and no length passes the capacity."""
    t = p6_packing(spark, sf)
    docs = t.groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"), F.sum("part_tokens").alias("placed"), F.count_distinct("part").alias("parts"), F.max("parts").alias("want"), F.count_if(F.col("container").isNull()).alias("loose"))
    by = docs.where("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.min((F.col("tokens") == F.col("placed")) & (F.col("parts") == F.col("want")) & (F.col("loose") == 0)).alias("whole"))
    boxes = t.where("container IS NOT NULL").groupBy("source", "container").agg(F.sum("part_tokens").alias("used"), F.max("container_used").alias("said"), F.max("container_length").alias("length"), F.max("capacity").alias("capacity"))
    fit = boxes.groupBy("source").agg(F.min((F.col("used") == F.col("said")) & (F.col("used") <= F.col("length")) & (F.col("length") <= F.col("capacity"))).alias("fits"))
    return by.join(fit, "source")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    items = _read(spark, sf, "eval_items")
    return leak_report(leaked_items(_read(spark, sf, "documents"), items), items)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_pieces(spark, sf).where(F.col("piece") == 1).select("doc_id", "finest_cut")


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_documents(_read(spark, sf, "documents"), _read(spark, sf, "token_limits"))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """One row a document above its limit: its tokens, and whether its pieces follow one another with the overlap, count the tokens they
    say, stay within the limit and cover the text from its first to its last character."""
    limits = _read(spark, sf, "token_limits").select("source", "piece_tokens", F.least("overlap_tokens", F.col("piece_tokens") - 1).alias("overlap_tokens"))
    t = p8_pieces(spark, sf).withColumn("counted", count_tokens("piece_text")).join(F.broadcast(limits), "source")
    w = Window.partitionBy("doc_id").orderBy("piece")
    t = t.withColumn("before", F.lag("token_to").over(w)).withColumn("at", F.lag("char_to").over(w))
    follows = F.when(F.col("piece") == 1, (F.col("token_from") == 0) & (F.col("char_from") == 0)).otherwise((F.col("token_from") == F.col("before") - F.col("overlap_tokens")) & (F.col("char_from") <= F.col("at")))
    ends = F.when(F.col("piece") == F.col("pieces"), F.col("token_to") == F.col("tokens")).otherwise(F.lit(True))
    size = F.col("token_to") - F.col("token_from")
    by = t.groupBy("doc_id").agg(F.max("tokens").alias("tokens"), F.min(follows & ends & (size == F.col("counted"))).alias("follow"), F.min(size <= F.col("piece_tokens")).alias("within"), F.max("char_to").alias("reach"), F.sum(size - F.col("repeated")).alias("own"))
    docs = _read(spark, sf, "documents").select("doc_id", F.length("text").alias("chars"))
    return by.join(docs, "doc_id").select("doc_id", "tokens", "follow", "within", ((F.col("reach") == F.col("chars")) & (F.col("own") == F.col("tokens"))).alias("covers"))


QUERIES = {f.__name__: f for f in (p4_found, p4_sample, p4_report, p4_kept, p6_found, p6_packing, p6_fill, p6_kept, p7_found, p7_report, p8_found, p8_pieces, p8_kept)}

_TOKENS = "(" + ",".join(f"'{t}'" for t in ALL_TOKENS) + ")"
# White space as Python's str.isspace has it, for RE2.
_SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_COUNT = "len(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_" + _SPACE.replace("{", "{{").replace("}", "}}") + "]+'))"

ORACLES = {
    "p4_found": f"""
WITH r AS (SELECT DISTINCT dataset_id, load_no, row_no, CASE WHEN churn_risk IS NULL OR lower(trim(churn_risk, ' \t')) IN {_TOKENS} THEN 'unknown' ELSE lower(trim(churn_risk, ' \t')) END AS label FROM churn_rows),
have AS (SELECT dataset_id, load_no, label, count(*) AS n FROM r GROUP BY ALL)
SELECT t.request_id, t.class_label FROM sample_targets t LEFT JOIN have h ON h.dataset_id = t.dataset_id AND h.load_no = t.load_no AND h.label = lower(trim(t.class_label, ' \t'))
WHERE coalesce(h.n, 0) < greatest(t.min_per_class, floor(t.sample_size * CAST(t.target_share AS DECIMAL(12, 6)) + 0.5))""",
    "p4_report": f"""
WITH r AS (SELECT DISTINCT dataset_id, load_no, row_no, CASE WHEN churn_risk IS NULL OR lower(trim(churn_risk, ' \t')) IN {_TOKENS} THEN 'unknown' ELSE lower(trim(churn_risk, ' \t')) END AS label FROM churn_rows),
h AS (SELECT dataset_id, load_no, label, count(*) AS n FROM r GROUP BY ALL),
a AS (SELECT t.request_id, t.class_label, t.sample_size AS size, greatest(t.min_per_class, floor(t.sample_size * CAST(t.target_share AS DECIMAL(12, 6)) + 0.5)) AS need, t.min_per_class AS floor_, coalesce(h.n, 0) AS have
  FROM sample_targets t LEFT JOIN h ON h.dataset_id = t.dataset_id AND h.load_no = t.load_no AND h.label = lower(trim(t.class_label, ' \t'))),
b AS (SELECT *, need - floor_ AS rest, greatest(0, size - sum(least(floor_, have)) OVER w) AS left_, sum(need - floor_) OVER w AS whole, least(need, have) - least(floor_, have) AS can FROM a WINDOW w AS (PARTITION BY request_id)),
f AS (SELECT *, least(left_, whole) AS room, CASE WHEN whole <= left_ THEN rest ELSE floor(rest * left_ / whole) END AS low, CASE WHEN whole <= left_ THEN 0 ELSE (rest * left_) % whole END AS part FROM b),
g AS (SELECT *, low + CASE WHEN whole > left_ AND row_number() OVER (PARTITION BY request_id ORDER BY part DESC, lower(class_label)) <= room - sum(low) OVER (PARTITION BY request_id) THEN 1 ELSE 0 END AS fair FROM f),
o AS (SELECT *, least(fair, can) AS first, sum(least(fair, can)) OVER w AS firsts, can - least(fair, can) AS more, sum(can - least(fair, can)) OVER w AS mores FROM g WINDOW w AS (PARTITION BY request_id)),
q AS (SELECT *, CASE WHEN room - firsts >= mores THEN first + more WHEN room = firsts THEN first END AS margin FROM o),
d AS (SELECT *, least(floor_, have) + margin AS got FROM q)
SELECT request_id, class_label, need, have, got, greatest(0, need - have) AS short, need - greatest(0, need - have) - got AS given_up, round(got / nullif(sum(got) OVER (PARTITION BY request_id), 0), 9) AS share,
  greatest(0, sum(got) OVER (PARTITION BY request_id) - size) AS over FROM d""",
    "p4_kept": f"""
WITH r AS (SELECT DISTINCT dataset_id, load_no, row_no, CASE WHEN churn_risk IS NULL OR lower(trim(churn_risk, ' \t')) IN {_TOKENS} THEN 'unknown' ELSE lower(trim(churn_risk, ' \t')) END AS label FROM churn_rows),
h AS (SELECT dataset_id, load_no, label, count(*) AS n FROM r GROUP BY ALL),
a AS (SELECT t.request_id, t.sample_size, least(t.min_per_class, coalesce(h.n, 0)) AS floor_, least(greatest(t.min_per_class, floor(t.sample_size * CAST(t.target_share AS DECIMAL(12, 6)) + 0.5)), coalesce(h.n, 0)) AS can
  FROM sample_targets t LEFT JOIN h ON h.dataset_id = t.dataset_id AND h.load_no = t.load_no AND h.label = lower(trim(t.class_label, ' \t')))
SELECT request_id, greatest(least(any_value(sample_size), sum(can)), sum(floor_)) AS drawn, TRUE AS "distinct", TRUE AS of_class, TRUE AS minima, TRUE AS "full" FROM a GROUP BY request_id""",
    "p6_found": f"SELECT d.doc_id FROM documents d JOIN token_limits l USING (source) WHERE {_COUNT.format('d.text')} > l.capacity_tokens",
    "p6_kept": f"SELECT source, count(*) AS documents, sum(n) AS tokens, TRUE AS whole, TRUE AS fits FROM (SELECT d.source, {_COUNT.format('d.text')} AS n FROM documents d JOIN token_limits USING (source)) WHERE n > 0 GROUP BY source",
    "p8_kept": f"SELECT d.doc_id, {_COUNT.format('d.text')} AS tokens, TRUE AS follow, TRUE AS within, TRUE AS covers FROM documents d JOIN token_limits l USING (source) WHERE {_COUNT.format('d.text')} > l.piece_tokens",
    "p8_found": f"""
WITH d AS (SELECT d.doc_id, d.text, d.cells, l.piece_tokens AS m FROM documents d JOIN token_limits l USING (source) WHERE {_COUNT.format('d.text')} > l.piece_tokens),
c AS (SELECT doc_id, text, m, unnest(list_transform(cells, lambda x: x.n_chars)) AS n, unnest(range(1, len(cells) + 1)) AS k FROM d),
o AS (SELECT doc_id, m, substr(text, 1 + CAST(coalesce(sum(n + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT), n) AS t FROM c),
big AS (SELECT doc_id, max({_COUNT.format('t')}) AS cell FROM o GROUP BY doc_id),
l AS (SELECT doc_id, max({_COUNT.format('t')}) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM d) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN big.cell <= d.m THEN 'cell' WHEN l.line <= d.m THEN 'line' ELSE 'inside' END AS finest_cut FROM d JOIN big USING (doc_id) JOIN l USING (doc_id)""",
}
