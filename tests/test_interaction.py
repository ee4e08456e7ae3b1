"""Moved, lost and merged clicks, and every way a row of controls can move."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import interaction as I


def c(text, run=None, **more):
    return {"text": text, **({"clickEvent": {"action": "run_command", "value": run}} if run else {}), **more}


YES, NO = c("► Yes ", "/yes"), c("No", "/no")
CASES = {
    "same": ([YES, NO], [c("► 是 ", "/yes"), c("否", "/no")], []),
    "free_prose": (["Some\nwords\n", "\n", NO], ["字\n多的\n", "\n", c("否", "/no")], []),
    "moved": ([YES, NO], [c("► 是 ", "/no"), c("否", "/yes")], [(0, "click"), (1, "click")]),
    "lost": ([YES, NO], [c("► 是 ", "/yes"), c("否")], [(1, "click")]),
    "merged": ([YES, NO], [c("► 是 否", "/yes")], [(None, "leaf_count")]),
    "declared_elsewhere": ([{"text": "", "extra": ["a"], "clickEvent": {"action": "x"}}], [{"text": "", "extra": [c("a") | {"clickEvent": {"action": "x"}}]}], [(0, "click"), (1, "click")]),
    "inherited": ([c("a", "/x", extra=["b", c("d", "/y")])], [c("甲", "/x", extra=["乙", c("丙", "/y")])], []),
    "added": (["plain"], [c("plain", "/x")], [(None, "added_click")]),
    "no_clicks": (["a", "b"], ["ab"], []),
    "break_lost": (["Pick one\nof these\n", YES], ["选一个\n", c("► 是 ", "/yes")], [(1, "line_offset")]),
    "blank_moved": (["a\n\nb\n", YES], ["a\nb\n\n", c("► 是 ", "/yes")], [(1, "line_offset")]),
    "fill": (["a\n   ", YES], ["a\n ", c("► 是 ", "/yes")], [(1, "fill")]),
    "marks_alone": (["►  ", NO], ["► ", c("否", "/no")], [(0, "marks_changed")]),
    "emptied": ([NO], [c(" ", "/no")], [(0, "line_offset"), (0, "emptied"), (0, "fill"), (0, "padding")]),
    "padding": ([YES], [c("► 是", "/yes")], [(0, "padding")]),
    "controls": ([YES], [c("▶ 是 ", "/yes")], [(0, "controls")]),
    "live": ([{"selector": "@p"}, NO], ["人", c("否", "/no")], [(0, "drawn_from"), (1, "line_offset"), (1, "fill")]),
    "fallback": ([{"translate": "k", "fallback": "a", "with": [NO]}], [{"translate": "k", "fallback": "甲", "with": [c("否", "/no")]}], []),
    "text_list": ([{"text": ["a", NO]}], [{"text": ["甲", c("否", "/no")]}], []),
    "divider": (["a\n====\n", NO], ["a\n===\n", c("否", "/no")], [(None, "divider")]),
    "divider_without_clicks": (["a\n======\nb"], ["a ====== b"], [(None, "divider")]),
    "shown_in_a_click": (
        [{"text": "a", "clickEvent": {"action": "show", "contents": {"text": "x"}}}],
        [{"text": "甲", "clickEvent": {"action": "show", "contents": {"text": "y"}}}],
        [],
    ),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, json.dumps(a), json.dumps(b)) for k, (a, b, _) in CASES.items()]
    rows += [("broken", json.dumps([YES]), "[{"), ("broken_source", '[{"clickEvent":', "[]"), ("broken_plain", "[", "x"), ("nulls", None, None), ("deep", json.dumps([NO]), "[" * 5000)]
    df = spark.createDataFrame(rows, "id string, source string, target string")
    for x in ("a", "b", "n", "p", "x", "y", "whole", "open", "problem"):
        df = df.withColumn(x, F.lit(1))
    got = {}
    for r in I.changes(df, "id", "source", "target").collect():
        got.setdefault(r.id, []).append((r.n, r.problem))
    return got, {r.id: r.interaction for r in I.interaction_gate(df, "id", "source", "target").collect()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_changes(found, name):
    want = set(CASES[name][2])
    assert set(found[0].get(name, [])) == want
    assert found[1][name] == ("layout" if want else None)


def test_unreadable(found):
    got, gate = found
    assert {k: gate[k] for k in ("broken", "broken_source", "broken_plain", "nulls", "deep")} == {"broken": "unverifiable", "broken_source": "unverifiable", "broken_plain": None, "nulls": None, "deep": "unverifiable"}
    assert got["broken"] == [(None, "unreadable")]


def test_leaves_are_drawn_in_order():
    tree = c("a", "/x", extra=["b", {"keybind": "k"}, {"text": ["d", {"text": "e"}]}], **{"with": ["w"]})
    assert [(t, len(k), p) for t, k, p in I.leaves(tree)] == [("a", 1, ""), ("w", 1, "/with/0"), ("b", 1, "/extra/0"), (None, 1, "/extra/1"), ("d", 1, "/extra/2/text/0"), ("e", 1, "/extra/2/text/1")]
