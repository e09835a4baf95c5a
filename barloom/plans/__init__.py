"""Whole dataflows: the driver queries and the ingestion engine."""
