from pyspark.sql import functions as F

from millrace.functions import lines as L


def test_term_occurs_overlapping(spark):
    """The first place of a term may lie inside a word and overlap the next one, which is whole."""
    cases = [("a a", "ba a a", True), ("t", "to at", False), ("t", "to_t t", True), ("t", "t", True), ("it's", "Is it's\n", True), ("", "a", False), ("é", "née", True), ("x\\E(", "x\\E(", True), (".", "a", False)]
    rows = spark.createDataFrame(cases, "term string, text string, want boolean")
    assert rows.where(L.term_occurs(F.col("term"), F.col("text")) != F.col("want")).isEmpty()


def test_term_occurs_in_one_pass(spark):
    """No step goes over the text again for each place of the term: such a step is a lambda over the places."""
    plan = spark.range(1).select(L.term_occurs(F.lit("t"), F.repeat(F.lit("the tent to "), F.col("id").cast("int") + 5)).alias("found"))
    assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.collect()[0]["found"] is False
