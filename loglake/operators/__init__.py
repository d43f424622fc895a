"""Operators: log queries, ingest, alerts, connections, cost, retention."""
