"""Operators of a training-data pipeline, and their registered queries."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from millrace.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

# functions travel to tasks with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
