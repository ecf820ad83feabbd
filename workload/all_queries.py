"""Imports every query module, which registers its queries."""

from workload import catalogue, curation, feeds, people, runs, tracking  # noqa: F401
