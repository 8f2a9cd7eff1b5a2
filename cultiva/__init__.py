"""Spark-native analytics for predicting how microbes can be cultivated.

Sub-packages
------------
``functions``  column expressions (no shuffles, no Python UDFs)
``sources``    scans and sinks
``operators``  DataFrame-to-DataFrame operators
``plans``      multi-step jobs: training, benchmarking, serving
``streaming``  incremental forms of the batch jobs
"""

__version__ = "0.1.0"
