"""Small tables for trying things out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rng import gaussian, uniform


def churn_sample(spark: SparkSession, n: int = 280, seed: int = 42) -> DataFrame:
    """n accounts with four numbers, a contract and an imbalanced three-class risk (about 70, 20 and 10 %) that the numbers explain; two planted outliers."""
    u = uniform(seed, F.col("id"), "class")
    risk = F.when(u < 0.7, "Low").when(u < 0.9, "Medium").otherwise("High")
    base = spark.range(n).withColumn("churn_risk", risk)
    level = F.when(F.col("churn_risk") == "Low", 0).when(F.col("churn_risk") == "Medium", 1).otherwise(2)
    number = lambda name, mean, step, sd, digits: F.round(F.greatest(F.lit(0.0), mean + step * level + sd * gaussian(seed, F.col("id"), name)), digits)
    charges = F.when(F.col("id") == 12, 245.0).otherwise(number("charges", 65.0, 18.0, 12.0, 2))
    tickets = F.when(F.col("id") == 55, 14.0).otherwise(number("tickets", 1.0, 1.8, 0.9, 0))
    contract = F.when(uniform(seed, F.col("id"), "contract") < 0.35 + 0.25 * level, "Month-to-Month").when(uniform(seed, F.col("id"), "term") < 0.6, "One-Year").otherwise("Two-Year")
    return base.select("id", number("age", 40.0, -13.0, 9.0, 0).alias("account_age_months"), charges.alias("monthly_charges"), number("hours", 80.0, -20.0, 15.0, 1).alias("usage_hours"), tickets.alias("support_tickets"), contract.alias("contract_type"), "churn_risk")


def benchmark_table(spark: SparkSession, n: int = 280) -> DataFrame:
    """Classes of 10, 20 and 70 % whose numbers are constant within a class: the degenerate case of no spread."""
    i = F.col("id")
    risk = F.when(i < n // 10, "High").when(i < n // 10 + n // 5, "Medium").otherwise("Low")
    pick = lambda a, b, c: F.when(i < n // 10, a).when(i < n // 10 + n // 5, b).otherwise(c)
    return spark.range(n).select("id", pick(3.0, 12.0, 36.0).alias("account_age_months"), pick(120.0, 90.0, 60.0).alias("monthly_charges"), pick(10.0, 45.0, 90.0).alias("usage_hours"), pick(6.0, 3.0, 0.0).alias("support_tickets"), risk.alias("churn_risk"))
