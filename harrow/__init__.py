"""Spark-native analytics over recorded web-sensor requests.

Subpackages: ``sources`` (readers and writers), ``functions`` (column
expressions), ``operators`` (DataFrame operators), ``plans`` (whole jobs built
from operators) and ``streaming`` (Structured Streaming twins and merges).
"""

__version__ = "0.1.0"
