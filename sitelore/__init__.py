"""sitelore: crawl-to-knowledge tables as Spark DataFrame, SQL and Structured Streaming jobs.

Every operator takes DataFrames and returns DataFrames; every per-site step is keyed by
``course_id`` so all sites are processed at once.
"""

__version__ = "0.1.0"
