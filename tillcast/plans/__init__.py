"""Composed jobs: the forecast-to-order chain, the query registry and its SQL checks."""
