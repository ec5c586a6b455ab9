"""seqframe: corpus curation and embedding-set evaluation on Spark."""

import sys as _sys

# Executor-side Python (pandas kernels, the batched model UDF) is defined in
# this package.  Pickling it by value ships the code with each task, so
# executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with addPyFile instead
    pass
