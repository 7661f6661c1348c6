"""pagelake: web-content analytics as Spark DataFrame jobs."""

import sys as _sys

# Python workers receive the package's functions (state functions, pandas
# UDFs) by value, so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 -- older cloudpickle: ship the package with --py-files instead
    pass
