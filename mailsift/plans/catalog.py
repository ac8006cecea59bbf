"""Imports every query module so the registry is complete."""

from mailsift.plans import q_clean, q_evaluate, q_extract, q_io, q_gazetteer, q_segment, q_signature, q_spans, q_split, q_stream  # noqa: F401
from mailsift.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
