"""Operators of a training-data pipeline: chats, near copies, tokens, search, packing, mixing."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_ROOT = Path(__file__).resolve().parents[2]
_SEEN_BY_WORKERS = [Path.cwd(), *map(Path, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
if _ROOT not in [p.resolve() for p in _SEEN_BY_WORKERS]:
    # Workers that can't import the package get its functions whole.
    cloudpickle.register_pickle_by_value(sys.modules["tillcast"])
