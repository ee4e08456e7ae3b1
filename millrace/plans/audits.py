"""Queries over audits: an output made from documents is held against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import PLACEHOLDER
from millrace.operators import audit as A
from millrace.operators import references as R
from millrace.plans.base import query, quoted, read

OUT = """out AS (SELECT doc_id, text AS src, lang, CASE WHEN doc_id % 9 = 0 THEN text || '!' WHEN doc_id % 10 = 0 THEN replace(text, chr(10), ' ')
  WHEN doc_id % 17 = 0 THEN NULL ELSE text END AS tgt FROM documents)"""


def output(spark, d):
    k, text = F.col("doc_id"), F.col("text")
    tgt = F.when(k % 9 == 0, F.concat(text, F.lit("!"))).when(k % 10 == 0, F.replace(text, F.lit("\n"), F.lit(" "))).when(k % 17 == 0, None).otherwise(text)
    return read(spark, d, "documents").select("doc_id", text.alias("src"), "lang", tgt.alias("tgt"))


def immutable(spark, d):
    official = read(spark, d, "documents").where("doc_id % 18 = 0").select(F.col("text").alias("source"), F.concat("text", F.lit("!")).alias("target"))
    return A.immutable_changed(output(spark, d), "doc_id", F.col("lang") == "de", "src", "tgt", official)


@query(
    f"""WITH {OUT} SELECT 'error' AS level, 'immutable' AS category, CAST(doc_id AS VARCHAR) AS key, 'changed' AS message FROM out o
    WHERE lang = 'de' AND tgt IS DISTINCT FROM src AND NOT EXISTS (SELECT 1 FROM documents f WHERE f.doc_id % 18 = 0 AND f.text = o.src AND f.text || '!' = o.tgt)"""
)
def audit_immutable(spark, d):
    return immutable(spark, d)


@query(
    f"""WITH {OUT}, n AS (SELECT doc_id, len(regexp_extract_all(src, '\\n')) AS a, len(regexp_extract_all(tgt, '\\n')) AS b, src, tgt FROM out WHERE tgt IS NOT NULL)
    SELECT 'error' AS level, 'book' AS category, CAST(doc_id AS VARCHAR) AS key, CASE WHEN a <> b THEN 'line_count' ELSE 'edge_break' END AS message
    FROM n WHERE a <> b OR (starts_with(src, chr(10)) <> starts_with(tgt, chr(10))) OR (suffix(src, chr(10)) <> suffix(tgt, chr(10)))"""
)
def audit_books(spark, d):
    return A.book_layout(output(spark, d), "doc_id", "src", "tgt")


@query(
    f"""SELECT 'error' AS level, 'tokens' AS category, CAST(page_id AS VARCHAR) AS key, 'placeholder' AS message FROM pages
    WHERE list_sort(regexp_extract_all(html, {quoted(PLACEHOLDER)})) <> list_sort(regexp_extract_all(left(html, 60), {quoted(PLACEHOLDER)}))"""
)
def audit_tokens(spark, d):
    pages = read(spark, d, "pages").withColumn("cut", F.left("html", F.lit(60)))
    return A.token_issues(pages, "page_id", "html", "cut", PLACEHOLDER, "placeholder")


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'missing' ELSE 'differs' END AS reason FROM events WHERE event_id % 7 = 0 OR event_id % 5 = 0"""
)
def audit_readback(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("props").alias("value"))
    got = e.where("event_id % 7 <> 0").withColumn("value", F.when(F.col("event_id") % 5 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    return A.read_back(e, got, ["event_id"])


@query(
    """WITH b AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN left(props, 4) ELSE props END AS t FROM events),
    a AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN left(props, 4) ELSE props END AS t FROM events)
    SELECT CASE WHEN event_id % 6 = 0 THEN 'warning' ELSE 'error' END AS level, 'json' AS category, CAST(event_id AS VARCHAR) AS key, 'unparseable' AS message
    FROM a WHERE NOT json_valid(t)"""
)
def audit_parseable(spark, d):
    e = read(spark, d, "events")
    cut = lambda k: e.select("event_id", F.when(F.col("event_id") % k == 0, F.left("props", F.lit(4))).otherwise(F.col("props")).alias("t"))
    return A.parse_regression(cut(6), cut(4), "event_id", "t")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'gone' ELSE 'changed' END AS state FROM documents
    WHERE (doc_id % 5 = 0 AND doc_id % 3 <> 0) OR (doc_id % 3 = 0 AND doc_id % 5 <> 0) OR (doc_id % 15 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 = 0)"""
)
def audit_content_diff(spark, d):
    docs = read(spark, d, "documents")
    after = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return A.content_changed(docs.where("doc_id % 5 <> 0"), after, "doc_id", "text")


@query(
    """WITH b AS (SELECT l_orderkey AS f, l_linenumber AS a, l_quantity AS v FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) = 1),
    c AS (SELECT f, a, CASE WHEN a = 2 THEN v + 1 ELSE v END AS v FROM b WHERE a <> 4)
    SELECT f, a FROM b FULL JOIN c USING (f, a) WHERE b.v IS DISTINCT FROM c.v AND f % 2 = 0"""
)
def audit_arguments(spark, d):
    from millrace.operators.lookup import first_by

    li = read(spark, d, "lineitem")
    b = first_by(li, ["l_orderkey", "l_linenumber"], F.col("l_partkey")).select(
        F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("value")
    )
    after = b.where("a <> 4").withColumn("value", F.when(F.col("a") == 2, F.col("value") + 1).otherwise(F.col("value")))
    return A.arguments_changed(b, after, ["f", "a"], b.where("f % 2 = 1"))


@query(
    """SELECT u.o_orderkey FROM orders u WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT c_nationkey % 5 AS ns, c_custkey AS id FROM customer WHERE c_acctbal > 0) k
      WHERE k.id = u.o_custkey AND k.ns = u.o_orderkey % 5)"""
)
def audit_resources(spark, d):
    known = read(spark, d, "customer").where("c_acctbal > 0").select((F.col("c_nationkey") % 5).cast("long").alias("ns"), F.col("c_custkey").alias("o_custkey")).distinct()
    uses = read(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5).alias("ns"))
    return uses.join(known, ["ns", "o_custkey"], "left_anti").select("o_orderkey")


@query(
    f"""WITH {OUT}, i AS (SELECT count(*) AS n FROM out o WHERE lang = 'de' AND tgt IS DISTINCT FROM src
      AND NOT EXISTS (SELECT 1 FROM documents f WHERE f.doc_id % 18 = 0 AND f.text = o.src AND f.text || '!' = o.tgt)),
    k AS (SELECT count(*) AS n FROM out WHERE tgt IS NOT NULL AND (len(regexp_extract_all(src, '\\n')) <> len(regexp_extract_all(tgt, '\\n'))
      OR starts_with(src, chr(10)) <> starts_with(tgt, chr(10)) OR suffix(src, chr(10)) <> suffix(tgt, chr(10)))),
    a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0),
    g AS (SELECT count(*) AS n FROM (SELECT v FROM a EXCEPT SELECT v FROM b)), w AS (SELECT count(*) AS n FROM (SELECT v FROM b EXCEPT SELECT v FROM a))
    SELECT i.n + k.n + least(g.n, 20) + CASE WHEN g.n > 20 THEN 1 ELSE 0 END AS errors, least(w.n, 10) AS warnings, true AS blocked FROM i, k, g, w"""
)
def audit_summary(spark, d):
    o = read(spark, d, "orders")
    pick = lambda k: o.where(f"o_orderkey % {k} = 0").select(F.col("o_custkey").alias("v"))
    return A.summary([immutable(spark, d), A.book_layout(output(spark, d), "doc_id", "src", "tgt"), R.set_difference(pick(2), pick(3))])
