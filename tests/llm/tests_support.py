"""Brute-force versions that several tests use."""

from test_mixing import brute as brute_mix
from test_simhash import brute_duplicates

__all__ = ["brute_duplicates", "brute_mix"]
