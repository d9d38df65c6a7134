"""Curation of large media and document collections as Spark jobs."""
