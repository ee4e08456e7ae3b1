"""Every proof of a dropped fragment has a row that only it refuses."""

from pyspark.sql import functions as F

from millrace.operators.merges import merge_proofs

UNITS = "file_path string, locator string, source_text string, final_target string"


def run(spark, units, passages, written):
    df = spark.createDataFrame(units, UNITS)
    for c in ("text_", "members_", "unit_", "read_", "passage", "text"):
        df = df.withColumn(c, F.lit(1))
    p = spark.createDataFrame(passages, "file_path string, locator string, passage array<string>").withColumn("source_text", F.lit("x"))
    w = spark.createDataFrame(written, "file_path string, locator string, text string").withColumn("final_target", F.lit("x"))
    return {(r.file_path, r.locator): (r.reason, r.not_units) for r in merge_proofs(df, p, w).collect()}


def test_each_proof_has_a_row_that_only_it_refuses(spark):
    units, passages, written, want = [], [], [], {}

    def case(name, fragment, target, others, passage, result, read=()):
        units.append((name, "f", fragment, target))
        units.extend((name, k, s, t) for k, s, t in others)
        if passage is not None:
            passages.append((name, "f", passage))
        written.extend((name, k, t) for k, t in read)
        if result:
            want[name, "f"] = result

    good = [("a", "Take the", "拿走"), ("b", "sword", "剑")]
    case("holds", "of", "", good, ["a", "f", "b"], (None, 0))
    case("empty", "of", "", good, [], ("no_passage", 0))
    case("null_passage", "of", "", good, None, None)
    case("not_dropped", "of", "的", good, ["a", "f"], None)
    case("no_target", "of", None, good, ["a", "f"], None)
    case("nested!/x", "of", "", good, [], None)
    case("gone", "of", "", good, ["a", "f", "z"], ("unproven_member", 1))
    case("emptied", "of", "", good, ["a", "f", "z"], ("unproven_member", 1), [("z", " \n")])
    case("covered", "of", "", good, ["a", "f", "z"], (None, 1), [("z", "剑")])
    case("blank", "of", " ", [("a", "Take", " "), ("b", "it", "")], ["a", "f", "b"], ("no_text", 0))
    case("same", "of", "", [("a", "Take the", "Take the"), ("b", "sword", "sword")], ["a", "f", "b"], ("untranslated", 0))
    case("one_is_enough", "of", "", [("a", "Take the", "Take the"), ("b", "sword", "剑")], ["a", "f", "b"], (None, 0))
    case("no_others", "of", "", [], ["f", "z"], (None, 1), [("z", "剑")])
    case("left", "of", "", [("a", "Take", "拿走of剑")], ["a", "f"], ("word_left", 0))
    case("left_read", " of\n", "\n", [("a", "Take", "拿走")], ["a", "f", "z"], ("word_left", 1), [("z", "of it")])
    case("inside", "of", "", [("a", "Take", "拿走 often")], ["a", "f"], (None, 0))
    case("marks", "a.b\\E(", "", [("a", "Take", "axb a.b\\E)")], ["a", "f"], (None, 0))
    case("marks_left", "a.b\\E(", "", [("a", "Take", "拿a.b\\E(")], ["a", "f"], ("word_left", 0))
    case("untargeted", "of", "", [("a", "Take", None)], ["a", "f"], (None, 0))
    case("breaks", "of\n", "", good, ["a", "f", "b"], ("breaks_lost", 0))
    case("breaks_kept", "of\n", "\n", good, ["a", "f", "b"], (None, 0))
    got = run(spark, units, passages, written)
    assert got == want
    assert {r for r, _ in want.values()} == {None, "no_passage", "unproven_member", "no_text", "untranslated", "word_left", "breaks_lost"}


def test_no_rows(spark):
    assert run(spark, [], [], []) == {}
