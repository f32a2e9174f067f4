"""jikjo: a Spark-first engine for building, mining, profiling and scoring text corpora."""

__version__ = "0.1.0"
