"""Plotmark: address-scoped document indexing and search as Spark DataFrame jobs."""
