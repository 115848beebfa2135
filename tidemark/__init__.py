"""Event analytics as Spark jobs: ingest, profiles, metrics, checks, migration."""
