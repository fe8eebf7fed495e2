"""vigil — operations telemetry and event analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` that runs over all
projects at once.  Sub-packages:

* ``vigil.sources``   – readers / writers and the driver-table adapters
* ``vigil.functions`` – column expressions (levels, flags, parsers, maps)
* ``vigil.operators`` – filters, joins, aggregates, windows, ML
* ``vigil.plans``     – whole-table composites and the query registry
* ``vigil.streaming`` – Structured Streaming jobs
"""

from vigil.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
