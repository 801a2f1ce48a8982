"""Reachability over the whole table of links against a plain walk."""

from __future__ import annotations

from skeinlake.plans.bindings import Bound
from skeinlake.plans.catalog import all_queries


def test_neighbours_over_all_links(spark, data_dir):
    near: dict = {}
    for r in Bound(spark, data_dir).links.collect():
        near.setdefault(r.from_entity, set()).add(r.to_entity)
        near.setdefault(r.to_entity, set()).add(r.from_entity)
    want, frontier = {8: 0}, {8}
    for hop in (1, 2):
        frontier = {b for a in frontier for b in near.get(a, ()) if b is not None} - set(want)
        want |= dict.fromkeys(frontier, hop)
    for name in ("neighbours_whole_R10", "neighbours_R10"):
        got = all_queries()[0][name](spark, data_dir).collect()
        assert len(got) == len(want) and {r.id: r.hop for r in got} == want
