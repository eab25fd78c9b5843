"""tickflow: market-data and event-sourced analytics on PySpark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark
expressions (``tickflow.operators``); ``tickflow.sources`` reads and derives
the input tables, ``tickflow.streaming`` runs the live operators on
Structured Streaming, and ``tickflow.plans`` registers the named queries.
"""

__version__ = "0.1.0"
