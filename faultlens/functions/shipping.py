"""Ship worker-side helpers with the task instead of installing the package.

Functions handed to ``applyInPandas`` / ``mapInPandas`` are pickled by
cloudpickle. Registering their module "by value" makes executors receive the
code itself, so no copy of this package has to exist on the cluster nodes.
"""

from __future__ import annotations

import sys


def ship_by_value(module_name: str) -> None:
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    mod = sys.modules.get(module_name)
    if mod is not None:
        cloudpickle.register_pickle_by_value(mod)
