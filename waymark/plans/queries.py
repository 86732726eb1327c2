"""Imports every module that registers queries."""

from waymark.plans import queries_fits, queries_jobs, queries_metrics, queries_models, queries_sources, queries_vectors, queries_windows  # noqa: F401
