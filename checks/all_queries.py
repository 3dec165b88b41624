"""Imports every module that registers queries."""

from . import q_catalog, q_edits, q_judging, q_rewrites, q_run, q_sources, q_text  # noqa: F401
from .q_run import flagship  # noqa: F401
