"""Queries by subject; importing the package registers all of them."""

from . import approvals, inspection, placement, quality, registry, reporting, review, rollups, truth  # noqa: F401
