"""Column functions. Modules that hold Arrow functions travel to the workers by value, so a cluster
needs nothing installed besides PySpark, pandas and PyArrow."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_by_value(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
