"""What an operator keeps in a Python worker goes when the worker serves another one."""

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import bloom, bpe, common, registry


def test_two_things_are_held_at_most():
    common.let_go()
    made = []
    for name in ("a", "b", "a", "c", "b", "a"):
        common.held(name, lambda name=name: made.append(name) or name)
    assert made == ["a", "b", "c", "a"] and list(common._held) == ["c", "a"]
    next(common.parts(iter([pa.RecordBatch.from_arrays([pa.array(["x"])], names=["text"])])))
    assert common._held == {}


def test_codec_goes_with_the_next_operator(spark):
    """The vocabulary's tables stood beside all later stages: the pipeline's executors took more than 3000 MB."""
    def held(ids: pa.Array) -> pa.Array:
        return pa.array([len(common._held)] * len(ids), pa.int32())

    def lengths(texts: list) -> pa.Array:
        return pa.array([len(t) for t in texts], pa.int64())

    def through(batches):
        for piece, _ in common.parts(batches):
            yield piece

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text")).coalesce(1)
    count = F.arrow_udf(held, "int")
    kept = lambda: spark.range(1).coalesce(1).select(count("id").alias("n")).first().n
    tokenizer = bpe.Tokenizer(spark, registry.tokenizer_path())
    others = [
        lambda: docs.select(common.text_function("long", lengths)(F.col("text")).alias("n")),
        lambda: docs.mapInArrow(through, docs.schema),
        lambda: docs.select(bloom.may_hold(docs, "doc_id", F.col("doc_id")).alias("may")),
    ]
    for other in others:
        assert bpe.with_tokens(docs, tokenizer).where(F.size("token_ids") > 0).count() == 40
        assert kept() == 1
        assert len(other().collect()) == 40
        assert kept() == 0
