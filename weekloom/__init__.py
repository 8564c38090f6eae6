"""Weekly advertising analytics as set-oriented Spark jobs.

Every table carries the bundle key ``(bundle_id, market, period_start, period_end)``;
operators are plain functions from DataFrames to DataFrames.
"""

KEY = ["bundle_id", "market", "period_start", "period_end"]
