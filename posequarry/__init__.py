"""Spark-native analytics over simulated binding poses and measured affinities.

Every public function takes and returns DataFrames or Columns and builds a lazy
plan.  Only sinks, iterative fits and the checks that pick a strategy run jobs.
"""

from posequarry.session import build_session, materialize, scratch_path

__all__ = ["build_session", "materialize", "scratch_path"]
