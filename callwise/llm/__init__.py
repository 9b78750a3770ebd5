"""Operators for training-data pipelines. Functions used inside tasks travel by value, so executors need no copy of the package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
