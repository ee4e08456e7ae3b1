"""Queries over lookups, references and locks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import lookup as L
from millrace.operators import references as R
from millrace.plans.base import UNITS, query, read, units


@query(
    f"""WITH {UNITS}, s AS (SELECT seq, source_text, format, final_target AS target FROM units WHERE final_target <> source_text)
    SELECT u.seq, CASE WHEN policy = 'TRANSLATABLE_DISPLAY' THEN md5(s.target) END AS target
    FROM units u LEFT JOIN s USING (seq, source_text, format)"""
)
def seed_join(spark, d):
    u = units(spark, d)
    seeds = u.select("seq", "source_text", "format", F.col("final_target").alias("target"))
    return L.seed_join(u, seeds, ["seq", "source_text", "format"]).select("seq", F.md5("target").alias("target"))


MEMORY = """m AS (SELECT p_brand AS namespace, p_name AS source, p_type AS context, min(p_type || '!') AS target, min(p_partkey) AS updated_at
  FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2, 3)"""


def memory(spark, d):
    m = read(spark, d, "part").where("p_size % 2 = 0")
    m = m.select(F.col("p_brand").alias("namespace"), F.col("p_name").alias("source"), F.col("p_type").alias("context"), "p_partkey")
    return m.groupBy("namespace", "source", "context").agg(
        F.min(F.concat("context", F.lit("!"))).alias("target"), F.min("p_partkey").alias("updated_at")
    )


@query(
    f"""WITH {MEMORY}, l AS (SELECT *, row_number() OVER (PARTITION BY namespace, source ORDER BY updated_at DESC, context) AS r FROM m)
    SELECT p_partkey, coalesce(m.target, l.target) AS target FROM part
    LEFT JOIN m ON m.namespace = p_brand AND m.source = p_name AND m.context = p_type
    LEFT JOIN l ON l.namespace = p_brand AND l.source = p_name AND l.r = 1"""
)
def memory_lookup(spark, d):
    u = read(spark, d, "part").select("p_partkey", F.col("p_brand").alias("namespace"), F.col("p_name").alias("source"), F.col("p_type").alias("context"))
    return L.memory_join(u, memory(spark, d), fallback=True).select("p_partkey", "target")


@query(
    """WITH m AS (SELECT DISTINCT 'c' || (o_custkey % 40) AS context, 'T' || (o_custkey % 40) AS target FROM orders)
    SELECT c_custkey, coalesce(a.target, b.target) AS target FROM customer LEFT JOIN m a ON a.context = 'c' || (c_custkey % 80)
    LEFT JOIN m b ON b.context = 'c' || (c_custkey % 60)"""
)
def alias_join(spark, d):
    n = (F.col("o_custkey") % 40).cast("string")
    m = read(spark, d, "orders").select(F.concat(F.lit("c"), n).alias("context"), F.concat(F.lit("T"), n).alias("target")).distinct()
    key = lambda k: F.concat(F.lit("c"), (F.col("c_custkey") % k).cast("string"))
    u = read(spark, d, "customer").select("c_custkey", key(80).alias("context"))
    return L.alias_join(u, m, key(60)).select("c_custkey", "target")


@query(
    """WITH a AS (SELECT c_custkey AS k, c_name AS target FROM customer WHERE c_custkey % 3 = 0),
    b AS (SELECT c_custkey AS k, c_mktsegment AS target FROM customer WHERE c_custkey % 2 = 0)
    SELECT o_orderkey, coalesce(a.target, b.target) AS target,
      CASE WHEN a.target IS NOT NULL THEN 'seed' WHEN b.target IS NOT NULL THEN 'memory' END AS origin
    FROM orders LEFT JOIN a ON a.k = o_custkey LEFT JOIN b ON b.k = o_custkey"""
)
def lookup_cascade(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey")
    a = c.where("o_custkey % 3 = 0").select("o_custkey", F.col("c_name").alias("target"))
    b = c.where("o_custkey % 2 = 0").select("o_custkey", F.col("c_mktsegment").alias("target"))
    u = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return L.cascade(u, [("seed", a, ["o_custkey"]), ("memory", b, ["o_custkey"])]).select("o_orderkey", "target", "origin")


@query(
    """WITH g AS (SELECT lower(p_brand) AS k, p_type AS target, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_size DESC, p_partkey DESC) AS r FROM part)
    SELECT p_partkey, target FROM part LEFT JOIN g ON k = lower(p_brand) AND r = 1"""
)
def glossary_priority(spark, d):
    p = read(spark, d, "part")
    g = p.select(F.concat(F.lit(" "), "p_brand").alias("source"), F.col("p_type").alias("target"), F.col("p_size").alias("priority"), F.col("p_partkey").alias("ord"))
    return L.glossary_exact(p.select("p_partkey", "p_brand"), g, "p_brand").select("p_partkey", "target")


@query(
    """SELECT p_name, p_brand, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS target, count(DISTINCT p_type) > 1 AS conflict
    FROM part GROUP BY 1, 2"""
)
def official_exact(spark, d):
    return L.official_exact(read(spark, d, "part").withColumnRenamed("p_type", "target"), ["p_name", "p_brand"])


@query(
    """WITH t AS (SELECT DISTINCT lower(p_name) AS source, CASE WHEN lower(p_name) < 'c' THEN p_brand ELSE 'T:' || lower(p_name) END AS target, p_size AS priority FROM part WHERE p_partkey % 4 = 0),
    k AS (SELECT source, min(target) AS target, max(priority) AS priority, count(DISTINCT target) > 1 AS amb FROM t GROUP BY 1),
    u AS (SELECT p_partkey AS unit, ' ' || trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) || ' ' AS text FROM part),
    m AS (SELECT unit, source, target, priority, amb, max(amb) OVER (PARTITION BY unit) AS void,
      row_number() OVER (PARTITION BY unit ORDER BY priority DESC, source) AS rank FROM u JOIN k ON contains(text, ' ' || source || ' '))
    SELECT unit, source, target, rank FROM m WHERE NOT void AND rank <= 16"""
)
def term_containment(spark, d):
    p = read(spark, d, "part")
    terms = p.where("p_partkey % 4 = 0").select(F.lower("p_name").alias("source"), F.when(F.lower("p_name") < "c", F.col("p_brand")).otherwise(F.concat(F.lit("T:"), F.lower("p_name"))).alias("target"), F.col("p_size").alias("priority")).distinct()
    return L.term_containment(p.select(F.col("p_partkey").alias("unit"), F.concat_ws(" ", "p_name", "p_type").alias("text")), terms)


SPANS = "SELECT l_partkey AS k, l_orderkey % 100 AS s, l_orderkey % 100 + l_linenumber * 3 AS e FROM lineitem"


def spans(spark, d):
    s = F.col("l_orderkey") % 100
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), s.alias("start"), (s + F.col("l_linenumber") * 3).alias("end"))


@query(
    f"""WITH x AS ({SPANS}) SELECT a.k, a.s AS start, a.e AS "end" FROM x a WHERE NOT EXISTS (
      SELECT 1 FROM x b WHERE b.k = a.k AND b.s <= a.s AND b.e >= a.e AND b.e - b.s > a.e - a.s)"""
)
def maximal_span(spark, d):
    return L.maximal_spans(spans(spark, d), ["k"])


@query(
    """WITH e AS (SELECT p_brand AS modid, p_size AS hash, CASE WHEN p_partkey % 5 = 0 THEN 'local' ELSE p_type END AS source, p_partkey FROM part),
    b AS (SELECT *, row_number() OVER (PARTITION BY modid, hash ORDER BY source <> 'local', source, p_partkey) AS r FROM e)
    SELECT w.modid, w.hash, b.source FROM (SELECT DISTINCT p_brand AS modid, p_size + 1 AS hash FROM part) w LEFT JOIN b ON b.modid = w.modid AND b.hash = w.hash AND r = 1"""
)
def asset_full_match(spark, d):
    p = read(spark, d, "part")
    src = F.when(F.col("p_partkey") % 5 == 0, "local").otherwise(F.col("p_type"))
    entries = p.select(F.col("p_brand").alias("modid"), F.col("p_size").alias("hash"), src.alias("source"))
    return L.asset_full(entries, p.select(F.col("p_brand").alias("modid"), (F.col("p_size") + 1).alias("hash")).distinct()).select("modid", "hash", "source")


@query(
    """WITH e AS (SELECT p_brand AS modid, p_size AS key, p_name AS value, p_type AS source, min(p_type || '*') AS target FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY modid, key, value ORDER BY source) AS r FROM e)
    SELECT p_partkey, b.target FROM part LEFT JOIN b ON modid = p_brand AND key = p_size AND value = p_name AND r = 1"""
)
def asset_partial_match(spark, d):
    p = read(spark, d, "part")
    named = p.select("p_partkey", F.col("p_brand").alias("modid"), F.col("p_size").alias("key"), F.col("p_name").alias("value"), F.col("p_type").alias("source"))
    entries = named.where("p_partkey % 3 = 0").withColumn("target", F.concat("source", F.lit("*")))
    return L.asset_partial(entries, named.drop("source")).select("p_partkey", "target")


@query(
    """WITH z AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN text WHEN 3 THEN '译' || text ELSE 'x' END AS t, text FROM documents)
    SELECT CASE WHEN t IS NULL THEN 'missing' WHEN trim(t) = '' THEN 'empty' WHEN t = text THEN 'same_as_english' WHEN t LIKE '译%' THEN 'valid' ELSE 'invalid' END AS status,
      count(*) AS keys FROM z GROUP BY 1"""
)
def coverage_status(spark, d):
    m, text = F.col("doc_id") % 5, F.col("text")
    t = F.when(m == 1, " ").when(m == 2, text).when(m == 3, F.concat(F.lit("译"), text)).when(m == 4, "x")
    docs = read(spark, d, "documents").select(text, t.alias("t"))
    status = L.coverage_status(text, F.col("t"), F.col("t").startswith("译"))
    return docs.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("keys"))


@query(
    """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'skip' WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'manual'
      WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'keep' ELSE 'automatic' END AS choice FROM documents"""
)
def user_choice(spark, d):
    lab = read(spark, d, "labels")
    keep = read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    tables = [("skip", lab.where("toxic = 1"), "doc_id"), ("manual", lab.where("quality = 0"), "doc_id"), ("keep", keep, "doc_id")]
    return L.user_choice(read(spark, d, "documents").select("doc_id"), tables)


REFS = """refs AS (SELECT l_partkey AS object_key, 's' || l_suppkey AS value, CASE WHEN l_returnflag = 'N' THEN 'definition' ELSE 'use' END AS role,
  CASE WHEN l_linestatus = 'F' THEN 'display' ELSE 'match' END AS kind, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"""


def refs(spark, d):
    return read(spark, d, "lineitem").select(
        F.col("l_partkey").alias("object_key"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("value"),
        F.when(F.col("l_returnflag") == "N", "definition").otherwise("use").alias("role"),
        F.when(F.col("l_linestatus") == "F", "display").otherwise("match").alias("kind"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


@query(
    f"""WITH {REFS} SELECT object_key, arg_min(kind, seq) AS kind, count(*) FILTER (role <> 'use') AS definitions, count(*) FILTER (role = 'use') AS uses,
      coalesce(array_to_string(list_sort(list(seq) FILTER (role = 'use'))[1:12], ','), '') AS first_uses FROM refs GROUP BY object_key"""
)
def reference_index(spark, d):
    out = R.reference_index(refs(spark, d))
    return out.withColumn("first_uses", F.array_join(F.col("first_uses").cast("array<string>"), ","))


@query(f"WITH {REFS} SELECT value, count(DISTINCT object_key) AS objects FROM refs GROUP BY 1 HAVING count(DISTINCT object_key) > 1 ORDER BY value LIMIT 80")
def ambiguous_values(spark, d):
    return R.ambiguous_values(refs(spark, d))


@query("SELECT o_custkey AS k, count(*) AS uses FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY 1")
def unresolved_refs(spark, d):
    uses = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return R.unresolved(uses, read(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query(
    """WITH r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
    SELECT CASE WHEN c_custkey IN (SELECT k FROM r) AND c_mktsegment <> 'BUILDING' THEN 'locked' ELSE 'kept' END AS state, c_custkey AS k FROM customer"""
)
def semi_lock(spark, d):
    c = read(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    r = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    kept, locked = R.lock_split(c, r, "k", F.col("c_mktsegment") == "BUILDING")
    return kept.select(F.lit("kept").alias("state"), "k").unionByName(locked.select(F.lit("locked").alias("state"), "k"))


@query(
    """SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT l_suppkey FROM lineitem"""
)
def selector_leftover(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return R.leftover(c, o, read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")), "k")


@query("SELECT doc_id FROM documents WHERE trim(source) NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def player_name_lock(spark, d):
    names = read(spark, d, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return read(spark, d, "documents").join(names, "source", "left_anti").select("doc_id")


@query(
    """SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'locked'
      WHEN (SELECT count(*) FROM part WHERE p_size > 49) > 0 THEN 'unknown' ELSE 'promoted' END AS state FROM customer"""
)
def entity_names(spark, d):
    coverage = read(spark, d, "part").agg((F.count_if(F.col("p_size") > 49) == 0).alias("complete"))
    used = read(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return R.finalize_names(read(spark, d, "customer").select(F.col("c_custkey").alias("k")), used, coverage, "k")


@query(
    f"""WITH {REFS}, p AS (SELECT value, count(DISTINCT object_key) FILTER (kind = 'display') AS nd, count(DISTINCT object_key) FILTER (kind = 'match') AS nm,
      min(object_key) FILTER (kind = 'display') AS d1, min(object_key) FILTER (kind = 'match') AS m1 FROM refs GROUP BY value)
    SELECT s_suppkey, coalesce(CASE WHEN nd = 1 THEN d1 WHEN nd = 0 AND nm = 1 THEN m1 END, -1) AS object_key,
      CASE WHEN nd > 1 THEN 'ambiguous' WHEN nd = 1 OR (nd = 0 AND nm = 1) THEN 'bound' ELSE 'free' END AS status
    FROM supplier LEFT JOIN p ON value = 's' || s_suppkey"""
)
def reference_binding(spark, d):
    u = read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("value"))
    return R.bind(u, refs(spark, d), "value").select("s_suppkey", F.coalesce("object_key", F.lit(-1)).alias("object_key"), "status")


OPS = """CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' ELSE 'use' END"""


@query(
    f"""WITH e AS (SELECT event_id, user_id, {OPS} AS op FROM events),
    s AS (SELECT *, last_value(CASE WHEN op <> 'use' THEN op END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM e)
    SELECT event_id FROM s WHERE op = 'use' AND coalesce(st, 'remove') = 'remove'"""
)
def define_before_use(spark, d):
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("use")
    return R.define_before_use(read(spark, d, "events"), "user_id", "event_id", op).select("event_id")


@query(
    """WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_orderkey % 3 = 0),
    g AS (SELECT v FROM a EXCEPT SELECT v FROM b), n AS (SELECT v FROM b EXCEPT SELECT v FROM a)
    SELECT 'error' AS level, CAST(v AS VARCHAR) AS value FROM (SELECT v FROM g ORDER BY v LIMIT 20)
    UNION ALL SELECT 'error', 'and ' || (n - 20) || ' more' FROM (SELECT count(*) AS n FROM g) WHERE n > 20
    UNION ALL SELECT 'warning', CAST(v AS VARCHAR) FROM (SELECT v FROM n ORDER BY v LIMIT 10)"""
)
def ref_set_diff(spark, d):
    o = read(spark, d, "orders")
    pick = lambda k: o.where(f"o_orderkey % {k} = 0").select(F.col("o_custkey").alias("v"))
    return R.set_difference(pick(2), pick(3))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def ref_set_union(spark, d):
    c = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return c.union(read(spark, d, "supplier").select("s_nationkey")).distinct()


@query(
    """SELECT k, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM (SELECT l_partkey AS k, count(*) AS n_a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    FULL JOIN (SELECT l_partkey AS k, count(*) AS n_b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) USING (k) WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)"""
)
def multiset_diff(spark, d):
    li = read(spark, d, "lineitem")
    pick = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return R.multiset_difference(pick("R"), pick("A"), "k")


@query(
    """SELECT kind, count(*) AS n, count(seq) AS with_seq, count(message) AS with_message FROM (SELECT 'unit' AS kind, doc_id AS seq, NULL AS message FROM documents
      UNION ALL SELECT 'filtered', event_id, NULL FROM events WHERE event_type = 'view' UNION ALL SELECT 'warning', NULL, props FROM events WHERE event_type = 'error') GROUP BY 1"""
)
def record_concat(spark, d):
    e = read(spark, d, "events")
    rows = L.union_all([
        read(spark, d, "documents").select(F.lit("unit").alias("kind"), F.col("doc_id").alias("seq")),
        e.where("event_type = 'view'").select(F.lit("filtered").alias("kind"), F.col("event_id").alias("seq")),
        e.where("event_type = 'error'").select(F.lit("warning").alias("kind"), F.col("props").alias("message")),
    ])
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count("seq").alias("with_seq"), F.count("message").alias("with_message"))


@query(
    """SELECT m.modid, CASE WHEN source IS NOT NULL THEN 'full' ELSE 'none' END AS state, source FROM (SELECT DISTINCT p_type AS modid FROM part) m
    LEFT JOIN (SELECT p_type AS modid, arg_min(p_brand, p_partkey) AS source FROM part WHERE p_size < 5 GROUP BY 1) USING (modid)"""
)
def mod_coverage(spark, d):
    p = read(spark, d, "part").withColumnRenamed("p_type", "modid")
    entries = p.where("p_size < 5").select("modid", F.col("p_partkey").alias("ord"), F.col("p_brand").alias("source"))
    return L.mod_coverage(entries, p)


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_totalprice > 1000 GROUP BY 1""".replace(
        "(o_orderdate, o_orderkey)", "row(o_orderdate, o_orderkey)"
    )
)
def newest_report(spark, d):
    r = read(spark, d, "orders").withColumn("mtime", F.col("o_orderdate")).withColumn("path", F.col("o_orderkey"))
    return L.newest_report(r, ["o_custkey"], F.col("o_totalprice") > 1000).select("o_custkey", "o_orderkey")


@query(
    """WITH h AS (SELECT source, list(DISTINCT doc_id) AS have FROM documents GROUP BY 1)
    SELECT doc_id FROM documents JOIN h USING (source) WHERE doc_id % 2 = 0 AND lang <> 'de' AND list_has_all(have, [doc_id, doc_id + 20])"""
)
def fragment_allowlist(spark, d):
    u = read(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.col("doc_id").alias("locator"), F.col("lang").alias("source"))
    allow = u.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("source") != "de", F.col("source")).alias("source"), F.array(F.col("doc_id"), F.col("doc_id") + 20).alias("passage"))
    return L.allowed_fragments(u, allow, ["doc_id"], "file").select("doc_id")


@query(
    """WITH g AS (SELECT l_orderkey AS grp, l_orderkey % 50 AS chain, list_sort(list(DISTINCT l_linenumber)) AS now,
      list_sort(list(DISTINCT l_linenumber)) = range(1, 4) OR l_orderkey % 3 > 0 AS ok FROM lineitem GROUP BY 1)
    SELECT grp AS "group", chain, CASE WHEN bool_and(ok) OVER (PARTITION BY chain) THEN 'kept' ELSE 'rolled_back' END AS state FROM g"""
)
def member_sets(spark, d):
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("member"))
    own = F.array_sort(F.collect_set("member"))
    stored = li.groupBy("group").agg(own.alias("own")).select(
        "group", (F.col("group") % 50).alias("chain"), F.when(F.col("group") % 3 > 0, F.col("own")).otherwise(F.expr("sequence(1, 3)")).alias("stored")
    )
    return L.member_sets(li, stored)


@query(
    """SELECT doc_id, array_to_string(list_sort(list_filter(['ß', 'é', 'ñ', 'ü'], lambda c: contains(text, c) AND NOT contains(source || lang || left(text, 40), c))), '') AS glyphs FROM documents"""
)
def glyph_membership(spark, d):
    docs = read(spark, d, "documents")
    before = F.concat("source", "lang", F.left("text", F.lit(40)))
    return docs.select("doc_id", F.array_join(L.new_glyphs(before, F.col("text"), ["ß", "é", "ñ", "ü"]), "").alias("glyphs"))
