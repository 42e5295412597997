"""Distributed operators: retrieval, ordering, graphs, splits, audits, features."""
