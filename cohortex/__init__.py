"""cohortex: audience expansion as Spark DataFrame / ML / Structured Streaming jobs.

Layout
------
sources/    table bindings, JSON-lines / CSV / Parquet scans and sinks
functions/  fixed code maps and lenient parsers as Column expressions
operators/  features, interactions, merchants, quality, drift, similarity, ranking
streaming/  idempotent micro-batch ingest, manifest, version commit
plans/      query registry, DuckDB oracle SQL, offline pipeline
"""

from cohortex.session import checkpoint_dir, get_session  # noqa: F401
