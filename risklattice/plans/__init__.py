"""Registered queries: every operator bound to the driver tables, with an equivalent SQL where SQL can say it."""

from risklattice.plans.base import ORACLES, QUERIES
from risklattice.plans import chain, evidence, landing, measures, modelling, panels, streams, tables, texts  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
