"""Adapters from the given tables to event records, and the registered checks."""
