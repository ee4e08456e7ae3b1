"""Queries over candidates, skeletons and how units are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import skeleton as K
from millrace.functions import wrap as W
from millrace.operators import account as A
from millrace.operators import candidates as C
from millrace.operators import packing
from millrace.operators import references as R
from millrace.plans.base import query, read
from millrace.sources import snbt

CASES = "doc_id % 8"


@query("""WITH u AS (SELECT doc_id, text AS source, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '译' || text WHEN 2 THEN ' ' WHEN 3 THEN text || ' %s' WHEN 4 THEN replace(text, chr(10), ' ')
    WHEN 5 THEN text || repeat(chr(10) || 'x', 4) WHEN 6 THEN replace(text, chr(10), '\\n') ELSE text END AS target, CASE WHEN lang = 'de' THEN 'nbt-text' ELSE 'mcfunction' END AS form,
    source = 'src1' AS layout, source = 'src2' AS puzzle, length(text) - length(replace(text, chr(10), '')) AS breaks FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> '')
SELECT doc_id, CASE WHEN target IS NULL THEN 'no_candidate' WHEN puzzle AND target <> source THEN 'puzzle_content'
  WHEN doc_id % 8 = 2 THEN CASE WHEN NOT layout THEN 'empty_candidate' END
  WHEN doc_id % 8 = 3 THEN 'structural_token'
  WHEN doc_id % 8 = 4 AND len(regexp_extract_all(target, '\\*\\*[^*\\n]+\\*\\*|__[^_\\n]+__')) > len(regexp_extract_all(source, '\\*\\*[^*\\n]+\\*\\*|__[^_\\n]+__')) THEN 'model_scaffolding'
  WHEN doc_id % 8 = 4 AND NOT layout AND breaks > 0 AND (form = 'nbt-text' OR starts_with(source, chr(10)) OR ends_with(source, chr(10)) OR contains(source, chr(10) || chr(10)) OR regexp_matches(source, '\\n[ \\t]+$')) THEN 'newline_structure'
  WHEN doc_id % 8 = 5 AND NOT layout AND ((form = 'nbt-text' AND breaks > 0) OR (breaks > 0 AND (starts_with(source, chr(10)) OR ends_with(source, chr(10)) OR contains(source, chr(10) || chr(10)) OR regexp_matches(source, '\\n[ \\t]+$')))) THEN 'newline_structure'
  WHEN doc_id % 8 = 5 THEN 'unexpected_expansion'
  WHEN doc_id % 8 = 6 AND breaks > 0 AND NOT (layout OR (form <> 'nbt-text' AND (starts_with(source, chr(10)) OR ends_with(source, chr(10)) OR contains(source, chr(10) || chr(10)) OR regexp_matches(source, '\\n[ \\t]+$')))) THEN 'structural_token'
  END AS reason FROM u""")
def reuse_gate(spark, sf_dir):
    """Q1: candidates of every kind through the one gate."""
    k, t = F.col("doc_id") % 8, F.col("text")
    target = (
        F.when(k == 0, None).when(k == 1, F.concat(F.lit("译"), t)).when(k == 2, " ").when(k == 3, F.concat(t, F.lit(" %s"))).when(k == 4, F.replace(t, F.lit("\n"), F.lit(" ")))
        .when(k == 5, F.concat(t, F.lit("\nx" * 4))).when(k == 6, F.replace(t, F.lit("\n"), F.lit("\\n"))).otherwise(t)
    )
    rows = read(spark, sf_dir, "documents").where(F.trim(t, F.lit(" \n\t")) != "")
    units = rows.select(
        "doc_id", target.alias("target"), F.when(F.col("lang") == "de", "nbt-text").otherwise("mcfunction").alias("form"), (F.col("source") == "src1").alias("layout"),
        (F.col("source") == "src2").alias("puzzle"), F.lit(False).alias("before_click"), t.alias("source"),
    )
    return C.reuse_gate(units).select("doc_id", "reason")


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 1 THEN 'skeleton' WHEN 2 THEN 'skeleton' WHEN 3 THEN 'unparseable' WHEN 5 THEN 'skeleton' END AS issue FROM customer""")
def payload_skeletons(spark, sf_dir):
    """Payloads whose mechanism moved: a color, a score's text, a lost bracket, an attribute of an encoded component."""
    k = F.col("c_custkey") % 6
    body = lambda text, color, score, more: F.concat(
        F.lit('{"text":"'), text, F.lit('","color":"'), color, F.lit('","score":{"text":"'), score, F.lit('"},"raw":"{\\"text\\":\\"a\\",\\"bold\\":'), more, F.lit('}","extra":[{"text":"x"},{"hoverEvent":{"contents":"y"}}]}')
    )
    plain = body(F.col("c_name"), F.lit("red"), F.lit("s"), F.lit("true"))
    after = body(F.lit("译文"), F.when(k == 1, "blue").otherwise("red"), F.when(k == 2, "译").otherwise("s"), F.when(k == 5, "false").otherwise("true"))
    after = F.when(k == 3, F.concat(after, F.lit("]"))).otherwise(after)
    rows = read(spark, sf_dir, "customer").select("c_custkey", plain.alias("a"), after.alias("b"))
    return rows.select("c_custkey", K.payload_issue(F.col("a"), F.col("b")).alias("issue"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 1 THEN 'shell' WHEN 2 THEN 'skeleton' WHEN 3 THEN 'tokens' END AS issue FROM customer""")
def embedded_commands(spark, sf_dir):
    """Embedded commands whose words, skeleton or tokens changed."""
    k, n = F.col("c_custkey") % 5, F.col("c_name")
    before = F.concat(F.lit('tellraw @a {"text":"'), n, F.lit(' %s","color":"red"}'))
    after = F.concat(F.when(k == 1, "tellraw @p ").otherwise("tellraw  @a "), F.lit('{"text":"译'), F.when(k == 3, "").otherwise(" %s"), F.lit('","color":"'), F.when(k == 2, "blue").otherwise("red"), F.lit('"}'))
    rows = read(spark, sf_dir, "customer").select("c_custkey", before.alias("a"), after.alias("b"))
    return rows.select("c_custkey", K.command_issue(F.col("a"), F.col("b")).alias("issue"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'divider' WHEN doc_id % 3 = 1 AND contains(text, chr(10)) THEN 'line_count' END AS issue FROM documents""")
def layout_rows(spark, sf_dir):
    """X11: rows of dividers and the number of line breaks."""
    k, t = F.col("doc_id") % 3, F.col("text")
    after = F.when(k == 0, F.concat(t, F.lit("\n====="))).when(k == 1, F.replace(t, F.lit("\n"), F.lit(" "))).otherwise(F.concat(F.lit("译"), t))
    return read(spark, sf_dir, "documents").select("doc_id", K.layout_issue(t, after).alias("issue"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'model_scaffolding' WHEN 2 THEN 'instruction_negation' END AS reason FROM conversations WHERE turn % 4 IN (1, 2)""")
def display_content(spark, sf_dir):
    """Written texts that read wrong against their sources."""
    k = F.col("turn") % 4
    rows = read(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("key"), k.alias("k"), "text")
    source = F.when(F.col("k") == 2, "Do not press it").otherwise(F.col("text"))
    target = F.when(F.col("k") == 1, F.concat(F.lit("@@1@@ 译"), "text")).when(F.col("k") == 2, "按下它").otherwise(F.concat(F.lit("译"), "text"))
    before, after = rows.select("key", source.alias("text")), rows.select("key", target.alias("text"))
    return C.display_content(before, after, "key", "text").select("key.*", "reason")


@query("""WITH u AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'json-lang' WHEN 1 THEN 'mcfunction' WHEN 2 THEN 'nbt-text' ELSE 'generic-json' END AS form,
  CASE doc_id % 5 WHEN 0 THEN 'written' WHEN 1 THEN 'pending' WHEN 2 THEN 'mechanism_locked' WHEN 3 THEN 'candidate_rejected' ELSE 'writeback_failed' END AS outcome, lang <> 'de' AS free,
  CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS target, trim(text, ' ' || chr(10) || chr(9)) = '' AS blank FROM documents)
SELECT doc_id, CASE form WHEN 'json-lang' THEN 'language' WHEN 'mcfunction' THEN 'command' WHEN 'nbt-text' THEN 'world' ELSE 'document' END AS role,
  CASE outcome WHEN 'written' THEN 'done' WHEN 'pending' THEN 'open' WHEN 'mechanism_locked' THEN 'kept' ELSE 'problem' END AS tag, free AND outcome NOT IN ('mechanism_locked', 'writeback_failed') AS editable,
  CASE outcome WHEN 'candidate_rejected' THEN 'rejected' WHEN 'writeback_failed' THEN 'not written' WHEN 'written' THEN CASE WHEN doc_id % 3 = 0 OR blank THEN 'empty' END END AS issue FROM u""")
def presented_units(spark, sf_dir):
    """The rows in which units are shown."""
    d = F.col("doc_id")
    form = F.when(d % 4 == 0, "json-lang").when(d % 4 == 1, "mcfunction").when(d % 4 == 2, "nbt-text").otherwise("generic-json")
    outcome = F.when(d % 5 == 0, "written").when(d % 5 == 1, "pending").when(d % 5 == 2, "mechanism_locked").when(d % 5 == 3, "candidate_rejected").otherwise("writeback_failed")
    policy = F.when(F.col("lang") != "de", "TRANSLATABLE_DISPLAY").otherwise("IMMUTABLE_ID")
    target = F.when(d % 3 == 0, " ").otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", *C.presentation(policy, outcome, form, target))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'a/b' WHEN 1 THEN source WHEN 2 THEN 'be/' || source WHEN 3 THEN '' || doc_id ELSE 'x/y' END AS owner,
  CASE doc_id % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'book' WHEN 2 THEN 'sign' WHEN 3 THEN 'command' ELSE 'object' END AS container FROM documents""")
def unit_owners(spark, sf_dir):
    """What units belong to, by format and path."""
    d, s = F.col("doc_id"), F.col("source")
    path = (
        F.when(d % 5 == 0, F.array(F.lit("a"), F.lit("b"))).when(d % 5 == 1, F.array(s, F.lit("pages"), F.lit("[0]"))).when(d % 5 == 2, F.array(F.lit("be"), s, F.lit("front_text"), F.lit("messages"), F.lit("[1]")))
        .when(d % 5 == 3, F.array(F.lit("q"))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    )
    form = F.when(d % 5 == 0, "json-lang").when(d % 5 == 3, "mcfunction").otherwise("nbt-text")
    return read(spark, sf_dir, "documents").select("doc_id", C.semantic_owner(form, d, path).alias("o")).select("doc_id", "o.*")


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'U' END AS candidate, CASE WHEN turn % 7 = 3 THEN 'failed' WHEN role = 'user' THEN 'new' ELSE 'none' END AS state
FROM (SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN NULL ELSE role END AS role FROM conversations)""")
def provided_candidates(spark, sf_dir):
    """Candidates from a provider that fails on some texts, asked again by themselves."""

    def provider(texts: list[str]) -> list[str | None]:
        if "bad" in texts:
            raise OSError("no answer")
        return C.glossary_provider({" User": "U"})(texts)

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 7 == 3, "bad").otherwise(F.col("role")).alias("source"))
    return C.provided(rows, provider, workers=3).select("conv_id", "turn", "candidate", "state")


@query("""SELECT c_custkey, 'display/Name' AS keys, 'display' AS decision, c_name AS value FROM customer WHERE c_custkey % 7 > 0
UNION ALL SELECT c_custkey, 'id', 'mechanism_locked', 'minecraft:book' FROM customer WHERE c_custkey % 7 > 0
UNION ALL SELECT c_custkey, 'pages/[0]', 'display', c_mktsegment FROM customer WHERE c_custkey % 7 > 0
UNION ALL SELECT c_custkey, 'Name', 'unparsed_mechanism', c_name FROM customer WHERE c_custkey % 7 = 0""")
def structure_values(spark, sf_dir):
    """Values of the structures in commands, and what becomes of them."""
    whole = F.concat(F.lit("give @p[tag=x] book{display:{Name:'"), "c_name", F.lit("'},id:\"minecraft:book\",n:1b,pages:[\""), "c_mktsegment", F.lit('"]'))
    line = F.when(F.col("c_custkey") % 7 == 0, whole).otherwise(F.concat(whole, F.lit("} 1")))
    rows = read(spark, sf_dir, "customer").select("c_custkey", line.alias("line"))
    found = snbt.decisions(snbt.structures(rows, "c_custkey", "line"), F.lit(False)).where("decision IS NOT NULL")
    return found.select("c_custkey", F.array_join("keys", "/").alias("keys"), "decision", "value")


@query("""WITH r AS (SELECT DISTINCT c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END AS value, c_nationkey AS k FROM customer WHERE c_custkey % 3 > 0),
b AS (SELECT value, k FROM r UNION SELECT trim(value), k FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY k) AS i FROM b)
SELECT value, count(*) AS n, string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (WHERE i <= 12) AS keys FROM n GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 80""")
def ambiguous_keys(spark, sf_dir):
    """A4: values that name several objects, as they are and without their edges' white space."""
    k = F.col("c_custkey")
    refs = read(spark, sf_dir, "customer").select(
        F.concat("c_mktsegment", F.when(k % 2 == 0, " ").otherwise("")).alias("value"), F.col("c_nationkey").alias("object_key"), F.when(k % 3 == 0, "display").when(k % 3 == 1, "id").otherwise("match").alias("kind")
    )
    return R.ambiguous_keys(refs).select("value", "n", F.array_join("keys", ",").alias("keys"))


@query("""WITH r AS (SELECT l_suppkey AS object_key, count(*) FILTER (l_returnflag <> 'N') AS uses FROM lineitem GROUP BY 1)
SELECT object_key, uses, (SELECT count(*) FROM r) AS total FROM r ORDER BY 1 LIMIT 400""")
def reference_report(spark, sf_dir):
    """A report's first objects, and how many there are."""
    refs = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("object_key"), F.lit("v").alias("value"), F.when(F.col("l_returnflag") == "N", "definition").otherwise("use").alias("role"), F.lit("match").alias("kind"), F.col("l_orderkey").alias("seq")
    )
    return R.reference_report(refs)[0].select("object_key", "uses", "total")


@query("""SELECT conv_id, turn, 3 AS lines, true AS same FROM conversations WHERE len(string_split(trim(text), ' ')) >= 8 AND length(text) <= 400""")
def wrapped_texts(spark, sf_dir):
    """Texts laid over three lines: as many lines as asked, and the same words in the same order."""
    rows = read(spark, sf_dir, "conversations").where((F.size(F.split(F.trim("text"), " ")) >= 8) & (F.length("text") <= 400))
    made = rows.withColumn("w", W.wrapped(F.col("text"), F.lit(3)))
    plain = lambda c: F.regexp_replace(c, r"\s+", "")
    return made.select("conv_id", "turn", F.size(F.split("w", "\n")).alias("lines"), (plain(F.col("w")) == plain(F.col("text"))).alias("same"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 7 + 3) % 500 AS dst FROM part WHERE p_partkey % 3 > 0),
r(root, node, step) AS (SELECT DISTINCT s_suppkey, s_suppkey, 0 FROM supplier UNION SELECT r.root, e.dst, r.step + 1 FROM r JOIN e ON e.src = r.node WHERE r.step < 4),
m AS (SELECT root, node, min(step) AS step FROM r GROUP BY 1, 2),
k AS (SELECT *, node % 4 = 1 AS bad, CASE WHEN node % 4 < 3 THEN node % 4 IN (0, 2) END AS good, node IN (SELECT src FROM e) AS goes FROM m)
SELECT root AS node, CASE WHEN bool_or(bad) THEN 'mechanism' WHEN bool_and(coalesce(good, true) AND NOT ((good IS NULL AND NOT goes) OR (goes AND step = 4))) AND bool_or(coalesce(good, false)) THEN 'display' ELSE 'unknown' END AS verdict
FROM k GROUP BY 1""")
def resolved_parameters(spark, sf_dir):
    """The verdict of parameters by what they are passed on to."""
    key = F.col("p_partkey")
    passes = read(spark, sf_dir, "part").where(key % 3 > 0).select(key.alias("src"), ((key * 7 + 3) % 500).alias("dst"))
    nodes = read(spark, sf_dir, "part").select(key.alias("node")).unionByName(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"))).unionByName(passes.select(F.col("dst").alias("node"))).distinct()
    sinks = nodes.where("node % 4 < 3").withColumn("kind", F.when(F.col("node") % 4 == 1, "mechanism").otherwise("display"))
    return A.resolved(passes, sinks, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")))


@query("""WITH RECURSIVE s AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS o, CAST(o_totalprice // 100 AS BIGINT) AS size FROM orders),
r(k, i, o, batch, n, total) AS (SELECT k, i, o, 0, 1, size FROM s WHERE i = 1
  UNION ALL SELECT s.k, s.i, s.o, CASE WHEN cut THEN r.batch + 1 ELSE r.batch END, CASE WHEN cut THEN 1 ELSE r.n + 1 END, CASE WHEN cut THEN s.size ELSE r.total + s.size END
  FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1, LATERAL (SELECT r.n + 1 > 12 OR r.total + s.size > 3000 OR s.o - r.o > 400 AS cut))
SELECT k, o, CAST(batch AS INTEGER) AS batch FROM r""")
def gap_packing(spark, sf_dir):
    """Batches that also end at gaps."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.rint(F.col("o_totalprice") / 100).cast("long").alias("size"))  # the SQL's cast rounds, half to even
    return packing.pack(rows, "k", "o", "size", line="o", gap=400)
