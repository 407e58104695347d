"""fieldsense: windowed sensor measurement analytics on PySpark.

Layout:
  sources/    document scan and parse, the measurements table (read, create, append)
  operators/  validation, flattening, de-duplication, lookups, filters
  functions/  column expressions (time, labels, colours, texts)
  plans/      the analytic queries and series built from the operators
  streaming/  Structured Streaming ingest and the streaming aggregate

The query, series and operator functions map DataFrames to lazy DataFrames,
collect nothing and take "now" and ranges as arguments. The ingest functions
bring only one-row counters (and at most 100 error texts) to the driver.
"""

__version__ = "0.1.0"
