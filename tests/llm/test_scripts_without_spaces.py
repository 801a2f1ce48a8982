"""Benchmark items in scripts without spaces are matched by their letters."""

from __future__ import annotations

import pytest

from skeinlake.llm import decontaminate

ITEMS = ["今天天气很好我们一起去公园散步吧", "きょうはとてもいいてんきですね", "วันนี้อากาศดีมากเราไปเดินเล่นกัน"]


@pytest.mark.parametrize("item", ITEMS)
def test_letters_are_tokens(item):
    assert len(decontaminate.tokens(item)) > 10
    assert decontaminate.tokens("A_b1 cé " + item[:2])[:3] == ["a", "b1", "cé"]


def test_copies_inside_a_clause_are_leaks(spark):
    bench = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"前{t}後") for i, t in enumerate(ITEMS)] + [(9, "完全不同的一句话没有任何关系")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == [(0, 0), (1, 1), (2, 2)]
