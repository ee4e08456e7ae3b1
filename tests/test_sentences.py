"""Replies cut back into members, against all cuts."""

import itertools

import pytest

from millrace.operators.sentences import split_back

MEMBER = "passage int, place int, kind string, term string, marks string, tagged boolean, extra int"


def cut(spark, cases):
    """(members, plain, tagged) each: what comes of them."""
    rows = [(k, place, *x) for k, (ms, _, _) in enumerate(cases) for place, x in enumerate(ms)]
    members = spark.createDataFrame([(*r, 1) for r in rows], MEMBER)
    replies = spark.createDataFrame([(k, p, t) for k, (_, p, t) in enumerate(cases)], "passage int, plain string, tagged string")
    got = {r.passage: r for r in split_back(members, replies).collect()}
    return [(got[k].mode, got[k].reason, None if got[k].shares is None else [x.share for x in got[k].shares]) for k in range(len(cases))]


free, fixed = ("free", None, None, False), ("fixed", None, None, False)
name = lambda t, marks=None: ("name", t, marks, True)
tagged = ("free", None, None, True)
CASES = [  # members, plain, tagged; mode, reason, shares
    ([free, name("安娜"), free], "你好安娜再见", None, "anchors", None, ["你好", "安娜", "再见"]),
    ([free, name("An na"), free], "hi A nna bye", None, "anchors", None, ["hi ", "A nna", " bye"]),
    ([free, name("安娜", ","), free], "你好安娜，再见", None, "anchors", None, ["你好", "安娜，", "再见"]),
    ([free, name("安娜"), free], "安娜你好安娜再见", None, "anchors", "anchor_missing", None),
    ([free, name("aa"), free], "xaaay", None, "anchors", "anchor_missing", None),  # two places that overlap
    ([free, name("甲"), name("乙")], "x乙甲", None, "anchors", "anchor_order", None),
    ([name("甲"), name("乙")], "甲，乙。", None, "anchors", None, ["甲", "乙"]),
    ([name("甲"), name("乙")], "甲和乙", None, "anchors", "orphan_text", None),
    ([free, free], "你好", None, "anchors", "multi_owner_gap", None),
    ([free, name("甲")], " 甲", None, "anchors", "empty_share", None),
    ([free], "你好", None, "anchors", None, ["你好"]),
    ([free], None, None, "anchors", "no_reply", None),
    ([free], "  ", "", "anchors", "no_reply", None),
    ([tagged, free], "你好", "<x0>你</x0>好", "tags", None, ["你", "好"]),
    ([tagged, name("甲")], "坏", "<x0>你</x0>和<x1>甲。</x1>", "tags", None, ["你和", "甲。"]),
    ([name("甲"), tagged], "坏", "<x0>甲</x0>和<x1>你</x1>", "tags", None, ["甲", "和你"]),
    ([tagged, free], None, "<x0>你</x0>好<x0>你</x0>", "tags", "tags_lost_or_duplicated", None),
    ([tagged, free], None, "<x0>你好", "tags", "tags_lost_or_duplicated", None),
    ([tagged, free, tagged], None, "<x2>你</x2>好<x0>你</x0>", "tags", "anchor_order", None),
    ([tagged, free], None, "<x0> </x0>好", "tags", "empty_anchor", None),
    ([name("甲"), free], "坏", "<x0>乙</x0>好", "tags", "term_not_kept", None),
    ([free, name("")], "好", None, "anchors", "anchor_missing", None),
    ([fixed, name("😀"), free], "a😀" + "b" * 20000, None, "anchors", None, ["a", "😀", "b" * 20000]),
]


@pytest.fixture(scope="module")
def results(spark):
    return cut(spark, [c[:3] for c in CASES])


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(results, k):
    assert results[k] == CASES[k][3:]


def all_cuts(members, reply):
    """Every way to cut a reply into as many pieces, anchors as their terms and all others not empty."""
    out = []
    for at in itertools.combinations(range(1, len(reply)), len(members) - 1):
        pieces = [reply[a:b] for a, b in zip((0, *at), (*at, len(reply)), strict=True)]
        if all(x[0] == "free" or p == x[1] for x, p in zip(members, pieces, strict=True)):
            out.append(pieces)
    return out


def test_against_all_cuts(spark):
    """A reply is cut if and only if there is one cut, and it is that; terms that stand twice are refused though they may fit."""
    shapes = [[free, name("a"), free], [name("a"), free, name("bc")], [free, name("ab"), free, name("c")], [name("b"), free]]
    cases = [(m, "".join(r), None) for m in shapes for n in (2, 3, 4, 5) for r in itertools.product("abc", repeat=n)]
    for (m, reply, _), (_, reason, shares) in zip(cases, cut(spark, cases), strict=True):
        found = all_cuts(m, reply)
        terms = [x[1] for x in m if x[0] == "name"]
        once = all(sum(reply.startswith(t, i) for i in range(len(reply))) == 1 for t in terms)
        if once and found:
            assert len(found) == 1 and reason is None and shares == found[0], (m, reply)
        else:
            assert reason is not None and shares is None, (m, reply)


def test_none_and_no_rows(spark):
    members = spark.createDataFrame([(1, 0, None, None, None, None, 1)], MEMBER)
    replies = spark.createDataFrame([(1, "x", None), (2, "y", None)], "passage int, plain string, tagged string")
    (row,) = split_back(members, replies).collect()
    assert (row.reason, [x.share for x in row.shares]) == (None, ["x"])
    assert split_back(members.limit(0), replies).count() == 0
