"""Physical helpers shared by the operators."""

from tabweave.plans.physical import Veil, dense_rank_within, free_name, materialize, one_row, pin, running_sums, scope, small_side

__all__ = ["Veil", "dense_rank_within", "free_name", "materialize", "one_row", "pin", "running_sums", "scope", "small_side"]
