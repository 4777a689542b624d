"""Imports every query module so that the registry is complete."""

from formloom.plans import queries_ranges  # noqa: F401
from formloom.plans import queries_grid  # noqa: F401
from formloom.plans import queries_match  # noqa: F401
from formloom.plans import queries_audit  # noqa: F401
from formloom.plans import queries_repair  # noqa: F401
from formloom.plans import queries_evidence  # noqa: F401
from formloom.plans import queries_replies  # noqa: F401
from formloom.plans import queries_layout  # noqa: F401
from formloom.plans import queries_corpus  # noqa: F401
from formloom.plans.registry import ORACLES, QUERIES  # noqa: F401
