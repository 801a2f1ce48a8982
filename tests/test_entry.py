"""The entry point without what some queries need."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
from skeinlake.plans.catalog import all_queries


def test_a_missing_library_costs_only_its_queries(monkeypatch):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("skeinlake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skeinlake.llm.queries", None)
    monkeypatch.setitem(sys.modules, "skeinlake.llm", None)
    assert set(entry.queries()) == set(all_queries()[0])
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_what_is_broken_is_warned_of(monkeypatch):
    import builtins

    real = builtins.__import__

    def broken(name, *args, **kwargs):
        if name.startswith("skeinlake.llm"):
            raise ImportError("No module named 'lib'", name="lib")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.warns(UserWarning, match="lib"):
        assert entry._llm() == ({}, {})


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
