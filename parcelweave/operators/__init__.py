"""Distributed operators: joins, upserts, matching, aggregation."""
