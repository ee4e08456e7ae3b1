"""The pipeline's stages against brute force: each on what the one before kept, with nulls, repeated rows and clashing names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_clusters, brute_hits, brute_lines, brute_toxic

from millrace.llm import near_dedup, registry, toxicity

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)


def some_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 3000")
    more = [(None, "a text of no name at all", "en", "x", 24), (70_001, None, "en", "x", None), (70_002, "", "de", None, 0), (70_003, " \n ", None, "x", 3)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(docs.where("doc_id % 40 = 3"))


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = some_documents(spark)
    columns, counts = docs.columns, [docs.count()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]

    def next_of(name):
        stages[name](spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        counts.append(out.count())
        return out

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    grammar = toxicity.fit(docs, labels)
    now = next_of("toxicity")
    assert now.columns == columns
    assert rows_of(now) == sorted((x for x in rows_of(docs) if brute_toxic(x[1], grammar.words, grammar.stems) < 0.3), key=str)

    docs, before = now, [(r.doc_id, r.text, r.n_chars) for r in now.collect()]
    now = next_of("line_dedup")
    drop = brute_lines([(i, t) for i, t, _ in before])
    want = []
    for i, t, n in before:
        left = "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in drop) if t else t
        if left == t:
            want.append((i, t, n))
        elif left.strip():
            want.append((i, left, len(left)))
    assert rows_of(now) == sorted(want, key=str) and len(drop) > 5 and now.columns == columns

    docs, before = now, [(r.doc_id, r.text, r.n_chars) for r in now.collect()]
    now = next_of("near_dedup")
    _, comp = brute_clusters(sorted({(i, t) for i, t, _ in before if i is not None}, key=str), 5)
    assert rows_of(now) == sorted((x for x in before if x[0] is None or comp[x[0]] == x[0]), key=str) and now.columns == columns

    docs, before = now, [(r.doc_id, r.text, r.n_chars) for r in now.collect()]
    now = next_of("decontamination")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert rows_of(now) == sorted((x for x in before if not brute_hits(x[1], items)[1]), key=str) and now.columns == columns

    docs = now
    coded = next_of("bpe")
    library = Tokenizer.from_file(registry.tokenizer_path())
    text = {r.doc_id: r.text for r in docs.collect()}
    assert coded.columns == ["doc_id", "token_ids", "n_tokens"]
    for r in coded.collect():
        assert list(r.token_ids) == library.encode(text[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_on_no_rows_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = some_documents(spark).limit(30)
    for c in ("row", "score", "may", "h", "leaf", "line", "left", "gone", "node", "comp", "bucket", "ids", "k1", "word", "n_hit"):
        docs = docs.withColumn(c, F.lit("kept"))
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns and out.where("row <> 'kept' OR h <> 'kept'").count() == 0 and out.count() > 0
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 100 and len(registry.QUERIES) == 13 and set(registry.ORACLES) <= set(registry.QUERIES)
    assert near_dedup.BANDS == 32
