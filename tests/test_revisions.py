"""The gate of passages by literal rows and by a walk over characters; adoption and rollback by going through one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.operators import revisions as R

A, B = "a", "b"
CASES = {
    # members: (source, target, style)
    "kept": ([("One line\nof two", None, A)], None),
    "moved": ([("One line\nof two", "一行二\n 字。", A)], "between_hanzi"),
    "legal": ([("One line\nof two", "一行，\n二字。", A)], None),
    "lead_lost": ([("\nOne", "一", A)], "fixed_edge"),
    "trail_lost": ([("One\n", "一", A)], "fixed_edge"),
    "trail_spaces": ([("One  \n", "一 \n", A)], None),
    "divider_end": ([("One\n====", "一\n====", A)], None),
    "divider_lost": ([("One\n====", "一\n===", A)], "fixed_edge"),
    "divider_first": ([("====\nOne", "====\n一", A)], None),
    "divider_moved": ([("====\nOne", "一\n====", A)], "inner_fixed_row"),
    "blank_inside": ([("One two\nthree\nfour", "一\n \n二，三", A)], "inner_fixed_row"),
    "count": ([("One\ntwo", "一二", A)], "break_count"),
    "count_over_members": ([("One\ntwo ", "一二。", A), ("three four", "三，\n四", A)], None),
    "empty": ([("One\ntwo ", "一。", A), ("three", "\n三", A)], None),
    "twice": ([("One\ntwo\nthree", "一。\n", A), ("four", "\n四", A)], "empty_row"),
    "first_empty": ([("One\ntwo", "\n一二", A)], "empty_row"),
    "starts": ([("One\ntwo", "一二\n。", A)], "punctuation"),
    "ends": ([("One\ntwo", "一（\n二）", A)], "punctuation"),
    "in_word": ([("One\ntwo", "Wo", A), ("three", "\nrd", A)], "in_word"),
    "style_cuts": ([("One\ntwo", "Wo", A), ("three", "\nrd", B)], None),
    "words_inside": ([("One\ntwo", "Wo\nrd", A)], None),
    "hanzi_styles": ([("One\ntwo", "一", A), ("three", "\n二", B)], None),
    "hanzi_null_style": ([("One\ntwo", "一", None), ("three", "\n二", None)], "between_hanzi"),
    "emptied_between": ([("One\ntwo", "一", A), ("x", "", B), ("three", "\n二", A)], "between_hanzi"),
}


def walk(members):
    """The same by characters and owners."""
    stream, owner, cuts, was, now = [], [], [], 0, 0
    for k, (source, target, style) in enumerate(members):
        t = source if target is None else target
        lead = re.match(r"\s*", source).group()
        core, trail = source[len(lead) :], ""
        while True:
            before = core
            core = core.rstrip()
            if m := re.search(r"\n[ \t]*={3,}$", core):
                core = core[: m.start()]
            if core == before:
                break
        trail = source[len(lead) + len(core) :]
        if "\n" not in lead:
            core, lead = lead + core, ""
        if not re.search("[\n=]", trail):
            core, trail = core + trail, ""
        end = ""
        if trail:
            m = re.search(r"[ \t]*" + re.escape(trail.lstrip(" \t")) + r"\Z", t)
            if not m:
                return "fixed_edge"
            end = m.group()
        if not t.startswith(lead) or len(lead) + len(end) > len(t):
            return "fixed_edge"
        new = t[len(lead) : len(t) - len(end)]
        dividers = lambda c: [(i if i == 0 else i - len(c.split("\n")), x) for i, x in enumerate(c.split("\n")) if re.fullmatch(r"[ \t]*={3,}[ \t]*", x)]
        if re.search(R.INNER_FIXED, new) or dividers(core) != dividers(new):
            return "inner_fixed_row"
        was, now = was + core.count("\n"), now + new.count("\n")
        for i, piece in enumerate(re.split(r"[ \t]*\n[ \t]*", new)):
            if i:
                cuts.append(len(stream))
            stream += piece
            owner += [(k, style)] * len(piece)
    if was != now:
        return "break_count"
    if len(set(cuts)) < len(cuts) or any(not 0 < c < len(stream) for c in cuts):
        return "empty_row"
    for c in cuts:
        a, b = stream[c - 1], stream[c]
        crosses = owner[c - 1][0] != owner[c][0]
        styled = crosses and owner[c - 1][1] != owner[c][1]
        if re.match(R.HAN.replace("x{", "u").replace("}", ""), a) and re.match(R.HAN.replace("x{", "u").replace("}", ""), b) and not styled:
            return "between_hanzi"
        if b in R.NO_ROW_START or a in R.NO_ROW_END:
            return "punctuation"
        if a.isascii() and a.isalnum() and b.isascii() and b.isalnum() and crosses and not styled:
            return "in_word"
    return None


def gate(spark, passages):
    rows = [(p, k, *m) for p, own in passages.items() for k, m in enumerate(own)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "passage string, place int, source string, target string, style string")
    for c in ("lead", "core", "trail", "t", "edge", "new", "m", "rows"):
        df = df.withColumn(c, F.lit(1))
    return {r.passage: r.reason for r in R.passage_gate(df).collect()}


def test_gate(spark):
    got = gate(spark, {k: v[0] for k, v in CASES.items()})
    assert got == {k: v[1] for k, v in CASES.items()}


def test_gate_against_a_walk(spark):
    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice(["a", "b ", "一", "二", "，", "（", "\n", "\n", " ", "===", "\n===", "x"]) for _ in range(rng.randint(1, n)))
    passages = {}
    for k in range(1500):
        own = []
        for _ in range(rng.randint(1, 3)):
            s = piece(6)
            own.append((s, rng.choice([None, s.replace("a", "一"), s.replace("b ", "，"), piece(6)]), rng.choice(["p", "p", "q", None])))
        passages[str(k)] = own
    want = {k: walk(v) for k, v in passages.items()}
    got = gate(spark, passages)
    assert [(k, passages[k], got[k], want[k]) for k in want if got[k] != want[k]] == []
    assert len(set(want.values())) >= 7


def test_claims_against_one_by_one(spark):
    rng = random.Random(8)
    members = {f"p{k}": rng.sample(range(14), rng.randint(1, 3)) for k in range(30)}
    ranks = dict(zip(members, rng.sample(range(100), 30), strict=True))
    bad = {p: "edge" if rng.random() < 0.2 else None for p in members}
    bound, want = set(), {}
    for p in sorted(members, key=ranks.get):
        want[p] = bad[p] or ("already_bound" if bound & set(members[p]) else None)
        if want[p] is None:
            bound |= set(members[p])
    df = spark.createDataFrame([(p, ranks[p], u, bad[p]) for p in members for u in members[p]], "passage string, rank int, unit int, reason string")
    got = {r.passage: r.reason for r in R.claimed(df).collect()}
    assert got == want and set(want.values()) == {None, "edge", "already_bound"}
    assert R.claimed(df.limit(0)).count() == 0


def test_one_failure_of_a_chain_leaves_the_store_as_it_was(spark):
    judged = spark.createDataFrame([("a", None), ("b", "break_count"), ("c", None), ("d", None), ("e", None), ("f", None), ("g", None)], "passage string, reason string")
    chains = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c"), (2, "d"), (3, "e"), (3, "f"), (4, "g"), (4, "not proposed")], "chain int, passage string")
    after = R.settled(judged, chains)
    got = {r.passage: r.reason for r in after.collect()}
    assert got == {"a": "chain_incomplete", "b": "break_count", "c": "chain_incomplete", "d": "chain_incomplete", "e": None, "f": None, "g": "chain_incomplete"}
    units = spark.createDataFrame([(k, "old", "x") for k in "abcdefgz"] + [("n", None, "x")], "unit string, target string, passage string")
    new = spark.createDataFrame([(k, k, "new") for k in "abcdefg"], "passage string, unit string, target string")
    out = {r.unit: (r.target, r.passage) for r in R.adopted_targets(units, new, after).collect()}
    assert out == {k: ("new", k) if k in "ef" else ("old", None) for k in "abcdefgz"} | {"n": (None, None)}


def test_islands(spark):
    rows = [("m", "a", 0, 1), ("m", "b", 2, 2), ("m", "c", 4, 5), ("k", "d", 3, 3), ("m", "e", 6, 6)]
    got = {r.passage: r.chain for r in R.islands(spark.createDataFrame(rows, "message string, passage string, first int, last int")).collect()}
    assert got["a"] == got["b"] != got["c"] == got["e"] and got["d"].startswith("k")


@pytest.mark.parametrize("text", ["\n a \n====\n b\n\n===", "a", "  ", "\n", "====", "a ===", "a\n==="])
def test_edges_make_the_text(spark, text):
    lead, core, trail = R.fixed_edges(F.col("t"))
    r = spark.createDataFrame([(text,)], "t string").select(F.concat(lead, core, trail).alias("x")).first()
    assert r.x == text
