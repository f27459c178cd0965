"""eventspark: event-stream analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from built-in
Spark expressions, so the same code runs in batch jobs and inside
Structured Streaming micro-batches.
"""

__version__ = "0.1.0"
