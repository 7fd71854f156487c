"""Training-data operators. Nothing outside this subpackage imports it."""

import os

# Spark's tasks are the parallelism: the small matrix products within them run on one thread.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
os.environ.setdefault("OMP_NUM_THREADS", "1")
