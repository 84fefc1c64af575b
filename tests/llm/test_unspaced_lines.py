"""Repeated units with few runs between white space: scripts without spaces, and long runs."""

import pytest

from plumbline.llm import lines


@pytest.mark.parametrize("unit, border", [("line", "\n"), ("paragraph", "\n\n")])
@pytest.mark.parametrize("repeated", ["今日は天気がいいから散歩しましょう。" * 40, "你好世界上", "วันนี้อากาศดี", "ဒီနေ့ရာသီဥတု", "ថ្ងៃនេះអាកាស", "x1" * 40])
def test_repeated_unspaced_unit(spark, unit, border, repeated):
    docs = spark.createDataFrame([(i, f"{repeated}{border}own {i}") for i in (1, 2, 3)], "doc_id long, text string")
    found = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.line_dedup(docs, unit=unit).collect()}
    assert found == {1: (f"{repeated}{border}own 1", 0), 2: ("own 2", 1), 3: ("own 3", 1)}


@pytest.mark.parametrize("stays", ["你好", "Grüße an alle", "ждите нас там скоро", "좋은 아침입니다 여러분"])
def test_few_words_stay(spark, stays):
    docs = spark.createDataFrame([(i, f"{stays}\nown {i}") for i in (1, 2)], "doc_id long, text string")
    assert [r["n_removed"] for r in lines.line_dedup(docs).collect()] == [0, 0]
