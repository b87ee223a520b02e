"""Operators for language-model training data: sampling to quotas, packing, leakage search and splitting."""
