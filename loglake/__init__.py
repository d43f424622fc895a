"""loglake: a Spark-native log lake.

Compressed log envelopes (batch or stream) become one ``logs`` table
partitioned by domain and event date; on it sit pruned SQL, ready-made log
queries, one-scan threshold alerts, scan-cost accounting, a short-lived result
cache and retention plans. Everything is a DataFrame / Spark SQL /
Structured Streaming plan.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Ship loglake's UDFs and partition functions to Python workers by value, so
# executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from loglake.session import build_session, ensure_utc, scratch_path  # noqa: E402

__all__ = ["build_session", "ensure_utc", "scratch_path"]
