"""tallyloom: profile, reconcile and migrate messy tables with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Helpers that run in tasks travel with their code: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tallyloom.ask import Answer, ask  # noqa: E402
from tallyloom.session import build_session, scratch_dir  # noqa: E402

__all__ = ["Answer", "ask", "build_session", "scratch_dir"]
