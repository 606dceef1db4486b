"""Offer quality engine: check, repair and enrich product offers as Spark jobs."""
