"""Send the package's Python functions to executors by value."""

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Pickle the functions of ``module`` with their code, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
