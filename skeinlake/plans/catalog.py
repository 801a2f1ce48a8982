"""Imports every module that registers queries."""

from __future__ import annotations

from . import q_analytic, q_lookup, q_more, q_retrieval, q_scalar, q_scale, q_state, q_support  # noqa: F401
from .registry import ORACLES, QUERIES


def all_queries():
    return dict(QUERIES), dict(ORACLES)
