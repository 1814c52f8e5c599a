"""Incremental runs."""

from dosequant.streaming.monthly import accumulate_latest_squs, accumulate_squ_pairs, latest_squs

__all__ = ["accumulate_latest_squs", "accumulate_squ_pairs", "latest_squs"]
