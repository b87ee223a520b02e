"""Reading tables from files, and a small catalog of stored ones."""

from tabweave.sources.catalog import ActionLog, Catalog
from tabweave.sources.readers import normalize_headers, read_csv, read_json, sniff
from tabweave.sources.samples import benchmark_table, churn_sample

__all__ = ["ActionLog", "Catalog", "benchmark_table", "churn_sample", "normalize_headers", "read_csv", "read_json", "sniff"]
