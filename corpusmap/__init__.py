"""corpusmap: document-map analytics as composable Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Python helpers that run inside tasks (stemming, block arithmetic, bisection)
# are shipped by value, so executors need no copy of this package installed.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
