"""Shared plan fragments, the bindings to the given tables and the registered queries."""
