"""botlog: access-log bot detection as Spark jobs.

Subpackages
-----------
sources    scans and sinks (raw log text, typed request table, score tables)
functions  column expressions (log-format parsing, request traits)
operators  DataFrame -> DataFrame operators (parsing, reports, features, marts,
           evaluation, isolation forest, random forest)
plans      end-to-end jobs wiring the operators together
streaming  Structured Streaming form of the parse + traffic-over-time job
"""

__all__ = ["sources", "functions", "operators", "plans", "streaming"]
