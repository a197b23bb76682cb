"""parkops: parking-operations analytics on Spark.

Modules
-------
``sources``    readers for the input tables, the parking-model views, scans, sinks, JSON documents, streams
``functions``  column expressions (minutes, percentages, billing formulas, countdown text)
``operators``  the operators: ``reports``, ``lookups``, ``billing``, ``lifecycle``, ``bookings``,
               ``imports``, ``changes``, ``seeds``
``plans``      Spark building blocks (bucketed ordered look-ups, pointer doubling, dense numbering,
               materialisation) and the query catalog with its DuckDB oracles
``streaming``  live jobs, bounded runner and production wiring

Run a registered query from the shell::

    python -m parkops list
    python -m parkops run zone_occupancy --data /path/to/tables [--out /path/to/results]
"""

__version__ = "0.1.0"
