"""A Spark-first analytics engine: small SQL grammar, typed columns, durable key-value log, streaming ingest."""

__version__ = "0.1.0"
