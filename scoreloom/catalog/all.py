"""Importing this module fills the catalog."""

from scoreloom.catalog import alignments, inputs, labels, reports, resampling, scoring  # noqa: F401
from scoreloom.catalog.base import CATALOG  # noqa: F401
