"""Spark-native analytics for messy tables: profiling, cleaning, synthesis, audit and evaluation."""

from tabweave.session import build_session

__all__ = ["build_session"]
