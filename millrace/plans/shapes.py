"""Queries over shapes of texts: rows restored, dropped fragments, rendered leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import shape as S
from millrace.operators import interaction as I
from millrace.operators import merges as M
from millrace.operators import revisions as R
from millrace.operators import sentences as SE
from millrace.plans.base import query, read

#: Pages as rows: a row for every tag. The candidate has runs of rows in one.
_ROWS = r"<[^>]*>"


def _facts(text):
    """n_rows, blank_rows, fixed (digest of the rows without a letter, with their places) and letters (digest without space)."""
    rows = F.split(text, "\n", -1)
    numbered = F.transform(rows, lambda x, k: F.struct(k.alias("k"), x.alias("x")))
    blank = F.array_join(F.transform(F.filter(numbered, lambda r: r["x"] == ""), lambda r: r["k"].cast("string")), ",")
    fixed = F.transform(F.filter(numbered, lambda r: ~r["x"].rlike(r"\p{L}")), lambda r: F.concat(r["k"].cast("string"), F.lit(":"), r["x"]))
    return (
        F.size(rows).cast("long").alias("n_rows"), F.md5(blank).alias("blank_rows"), F.md5(F.array_join(fixed, "|")).alias("fixed"),
        F.md5(F.regexp_replace(text, r"\s", "")).alias("letters"),
    )


_FACTS = """len(rows) AS n_rows,
  md5(array_to_string([k - 1 for k in range(1, len(rows) + 1) if rows[k] = ''], ',')) AS blank_rows,
  md5(array_to_string([(k - 1) || ':' || rows[k] for k in range(1, len(rows) + 1) if NOT regexp_matches(rows[k], '\\pL')], '|')) AS fixed,
  md5(regexp_replace(source, '\\s', '', 'g')) AS letters"""


@query(rf"""WITH s AS (SELECT page_id, regexp_replace(html, '{_ROWS}', chr(10), 'g') AS source FROM pages)
SELECT page_id, {_FACTS} FROM (SELECT page_id, source, string_split(source, chr(10)) AS rows FROM s)""")
def restored_rows(spark, sf_dir):
    """Q4: pages whose runs of rows flowed into one row each come back in their rows; all that SQL can say of them."""
    source = F.regexp_replace("html", _ROWS, "\n")
    flowed = F.regexp_replace(source, r"(?<=[^\n])\n(?=[^\n])", " ")
    return read(spark, sf_dir, "pages").select("page_id", S.shape_restored(source, flowed).alias("text")).select("page_id", *_facts(F.col("text")))


@query(rf"""SELECT conv_id, turn, {_FACTS} FROM (
  SELECT conv_id, turn, source, string_split(source, chr(10)) AS rows FROM (
    SELECT conv_id, turn, '• ' || regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '[.] +', '.' || chr(10) || '• ', 'g') AS source FROM conversations))""")
def restored_bullets(spark, sf_dir):
    """Q5: sentences as a list of bullets, whose candidate lost its indents."""
    flat = F.regexp_replace("text", r"\s+", " ")
    source = F.concat(F.lit("• "), F.regexp_replace(flat, r"[.] +", ".\n• "))
    target = F.concat(F.lit("  •  "), F.regexp_replace(flat, r"[.] +", ".\n  •   "))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.shape_restored(source, target).alias("text")).select("conv_id", "turn", *_facts(F.col("text")))


@query(r"""WITH s AS (SELECT conv_id, turn, repeat(' ', (turn % 3)::INT) || text || repeat(' ', (length(text) % 4)::INT) AS source,
  replace(text, 'e', 'x') AS target, role = 'user' AS click, length(text) % 2 = 0 AS gap FROM conversations),
e AS (SELECT *, regexp_extract(source, '[ \t]*$') AS pad, regexp_extract(source, '^[ \t]*') AS lead FROM s),
p AS (SELECT *, CASE WHEN regexp_extract(target, '[ \t]*$') <> pad AND trim(string_split(target, chr(10))[-1]) <> '' THEN regexp_replace(target, '[ \t]+$', '') || pad ELSE target END AS padded FROM e)
SELECT conv_id, turn, CASE WHEN NOT click OR regexp_replace(target, '\s', '', 'g') = '' THEN target WHEN gap THEN lead || regexp_replace(padded, '^[ \t]+', '') ELSE padded END AS text FROM p""")
def click_padding(spark, sf_dir):
    """Q6: labels that can be clicked, with their row's own padding."""
    source = F.concat(F.repeat(F.lit(" "), (F.col("turn") % 3).cast("int")), F.col("text"), F.repeat(F.lit(" "), F.length("text") % 4))
    out = S.click_restored(source, F.replace("text", F.lit("e"), F.lit("x")), F.col("role") == "user", F.length("text") % 2 == 0)
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", out.alias("text"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(rows))) AS i, unnest(rows) AS line, len(rows) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS rows FROM documents)),
u AS (SELECT doc_id, i, n, line, line || CASE WHEN i + 1 < n THEN chr(10) ELSE '' END AS src,
  CASE WHEN length(line) >= 40 THEN replace(line, 'q', 'k') WHEN line LIKE '%.' THEN chr(10) ELSE '' END AS tgt, length(line) < 40 OR line LIKE '%,%' AS is_unit,
  CASE WHEN length(line) > 400 THEN ' ' ELSE line END AS read FROM l),
f AS (SELECT * FROM u WHERE length(line) < 40),
m AS (SELECT f.doc_id, f.i, o.i AS j, coalesce(o.is_unit, false) AS is_unit, o.src, o.tgt, o.read, trim(o.read) <> '' AS shows
  FROM f, unnest([x for x in [f.i - 1, f.i, f.i + 1] if x >= 0 AND f.n > 1]) AS p(j) LEFT JOIN u o ON o.doc_id = f.doc_id AND o.i = p.j),
a AS (SELECT doc_id, i, count(*) FILTER (NOT is_unit) AS not_units, count(*) FILTER (NOT is_unit AND NOT coalesce(shows, false)) AS unproven,
  count(*) FILTER (is_unit AND j <> i) AS others, count(*) FILTER (is_unit AND j <> i AND tgt <> src) AS translated,
  coalesce(string_agg(CASE WHEN is_unit THEN tgt WHEN shows THEN read END, '' ORDER BY is_unit, j), '') AS text FROM m GROUP BY ALL)
SELECT f.doc_id::VARCHAR AS file_path, f.i::VARCHAR AS locator, CASE WHEN a.i IS NULL THEN 'no_passage' WHEN unproven > 0 THEN 'unproven_member'
  WHEN trim(text, ' ' || chr(10)) = '' THEN 'no_text' WHEN others > 0 AND translated = 0 THEN 'untranslated'
  WHEN trim(f.src, ' ' || chr(10)) <> '' AND regexp_matches(text, '(^|[^A-Za-z])' || regexp_escape(trim(f.src, ' ' || chr(10))) || '([^A-Za-z]|$)') THEN 'word_left'
  WHEN f.i + 1 < f.n AND f.tgt = '' THEN 'breaks_lost' END AS reason, coalesce(not_units, 0) AS not_units
FROM f LEFT JOIN a ON a.doc_id = f.doc_id AND a.i = f.i""")
def fragment_merges(spark, sf_dir):
    """Short lines as dropped fragments of the lines round them."""
    rows = F.split("text", "\n", -1)
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.size(rows).alias("n"), F.posexplode(rows).alias("i", "line"))
    end = F.when(F.col("i") + 1 < F.col("n"), "\n").otherwise("")
    short = F.length("line") < 40
    target = F.when(~short, F.replace("line", F.lit("q"), F.lit("k"))).when(F.col("line").endswith("."), "\n").otherwise("")
    own = lines.select("file_path", F.col("i").cast("string").alias("locator"), F.concat("line", end).alias("source_text"), target.alias("final_target"), "line", "n", "i", short.alias("short"))
    units = own.where(F.col("short") | F.col("line").contains(","))
    near = F.filter(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1), lambda x: (x >= 0) & (F.col("n") > 1))
    passages = own.where("short").select("file_path", "locator", F.transform(near, lambda x: x.cast("string")).alias("passage"))
    written = own.select("file_path", "locator", F.when(F.length("line") > 400, " ").otherwise(F.col("line")).alias("text"))
    return M.merge_proofs(units, passages, written)


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS labels FROM pages),
k AS (SELECT page_id, unnest(range(len(hrefs))) AS i, unnest(hrefs) AS href, unnest(labels) AS label FROM l),
f AS (SELECT *, ends_with(label, ',') AS lost, length(label) % 3 = 0 AS bare, length(href) % 2 = 0 AS joined FROM k),
w AS (SELECT *, sum(joined::INT) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS missing, lag(joined) OVER (PARTITION BY page_id ORDER BY i) AS last FROM f)
SELECT page_id, 2 * i AS n, 'click' AS problem FROM w WHERE lost UNION ALL SELECT page_id, 2 * i, 'padding' FROM w WHERE bare
UNION ALL SELECT page_id, 2 * i, 'line_offset' FROM w WHERE missing > 0 UNION ALL SELECT page_id, 2 * i, 'fill' FROM w WHERE last
UNION ALL SELECT page_id, 2 * i + 1, 'marks_changed' FROM w WHERE joined""")
def interaction_changes(spark, sf_dir):
    """Q11 and X11: the links of a page as a menu of clicks; some lose their click, their padding or the break behind them."""
    link = r'<a href="([^"]*)">([^<]*)</a>'
    links = F.arrays_zip(F.regexp_extract_all("html", F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(link), F.lit(2)).alias("label"))
    event = lambda x: F.struct(F.lit("run_command").alias("action"), x["href"].alias("value"))
    row = lambda text, own: F.struct(text.alias("text"), own.alias("clickEvent"))
    none = F.lit(None).cast("struct<action:string,value:string>")
    before = F.transform(links, lambda x: F.array(row(F.concat(x["label"], F.lit(" ")), event(x)), row(F.lit("\n"), none)))
    label = lambda x: F.concat(F.replace(x["label"], F.lit("e"), F.lit("x")), F.when(F.length(x["label"]) % 3 == 0, "").otherwise(" "))
    after = F.transform(links, lambda x: F.array(row(label(x), F.when(~x["label"].endswith(","), event(x))), row(F.when(F.length(x["href"]) % 2 == 0, " ").otherwise("\n"), none)))
    menus = read(spark, sf_dir, "pages").select("page_id", F.to_json(F.flatten(before)).alias("source"), F.to_json(F.flatten(after)).alias("target"))
    return I.changes(menus, "page_id", "source", "target").select("page_id", F.col("n").cast("long").alias("n"), "problem")


@query(r"""WITH m AS (SELECT conv_id, text, replace(text, '. ', '.' || chr(10)) AS source, length(text) % 4 AS k FROM conversations),
t AS (SELECT *, CASE k WHEN 2 THEN replace(text, '. ', chr(10) || '.') WHEN 3 THEN replace(text, ', ', ',' || chr(10)) ELSE source END AS target FROM m)
SELECT conv_id, CASE WHEN sum(length(source) - length(replace(source, chr(10), ''))) <> sum(length(target) - length(replace(target, chr(10), ''))) THEN 'break_count'
  WHEN bool_or(k = 2 AND contains(text, '. ')) THEN 'punctuation' END AS reason FROM t GROUP BY conv_id""")
def passage_gate(spark, sf_dir):
    """Q7: conversations as passages whose members break at other places than their sources."""
    text = F.col("text")
    source = F.replace(text, F.lit(". "), F.lit(".\n"))
    kind = F.length(text) % 4
    target = F.when(kind == 2, F.replace(text, F.lit(". "), F.lit("\n."))).when(kind == 3, F.replace(text, F.lit(", "), F.lit(",\n"))).when(kind == 1, source)
    members = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("passage"), F.col("turn").alias("place"), source.alias("source"), target.alias("target"), F.col("role").alias("style"))
    return R.passage_gate(members).withColumnRenamed("passage", "conv_id")


@query(r"""WITH RECURSIVE p AS (SELECT conv_id, list(DISTINCT string_split(text, ' ')[1]) AS units, bool_or(length(text) > 1500) AS long_, row_number() OVER (ORDER BY conv_id) AS k FROM conversations GROUP BY conv_id),
s AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS bound, NULL::BIGINT AS conv_id, NULL::VARCHAR AS reason
  UNION ALL SELECT p.k, CASE WHEN p.long_ OR list_has_any(s.bound, p.units) THEN s.bound ELSE list_concat(s.bound, p.units) END, p.conv_id,
    CASE WHEN p.long_ THEN 'too long' WHEN list_has_any(s.bound, p.units) THEN 'already_bound' END FROM s JOIN p ON p.k = s.k + 1)
SELECT conv_id, reason FROM s WHERE k > 0""")
def passage_claims(spark, sf_dir):
    """Conversations adopt the first words of their turns, in order; a word that is bound refuses all later ones."""
    c = read(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").alias("passage"), F.col("conv_id").alias("rank"), F.get(F.split("text", " ", -1), 0).alias("unit"), F.when(F.length("text") > 1500, "too long").alias("reason"))
    return R.claimed(rows).select(F.col("passage").alias("conv_id"), "reason")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) // 60 AS slot, CASE WHEN o_orderstatus = 'P' THEN 'partly' END AS reason FROM orders),
g AS (SELECT *, coalesce((slot > lag(slot) OVER (PARTITION BY o_custkey ORDER BY slot) + 1)::INT, 1) AS gap FROM o),
r AS (SELECT *, sum(gap) OVER (PARTITION BY o_custkey ORDER BY slot, gap DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
SELECT o_orderkey, coalesce(reason, CASE WHEN bool_or(reason IS NOT NULL) OVER (PARTITION BY o_custkey, run) THEN 'chain_incomplete' END) AS reason FROM r""")
def passage_rollback(spark, sf_dir):
    """A customer's orders that follow each other are one chain; one that is partly done undoes it."""
    days = F.floor(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")) / 60)
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("message"), F.col("o_orderkey").alias("passage"), days.alias("first"), days.alias("last"), F.when(F.col("o_orderstatus") == "P", "partly").alias("reason"))
    return R.settled(orders.select("passage", "reason"), R.islands(orders)).withColumnRenamed("passage", "o_orderkey")


@query(r"""WITH w AS (SELECT conv_id, turn, text, string_split(text, ' ') AS w, regexp_replace(text, '\s', '', 'g') AS flat FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, text, flat, w[5] AS word, regexp_replace(coalesce(w[5], ''), '\s', '', 'g') AS term, regexp_replace(array_to_string(w[:4], ''), '\s', '', 'g') AS before, regexp_replace(array_to_string(w[6:], ''), '\s', '', 'g') AS after FROM w),
o AS (SELECT *, term <> '' AND position(term IN flat) > 0 AND position(term IN substr(flat, position(term IN flat) + 1)) = 0 AS once FROM p)
SELECT conv_id, turn, CASE WHEN flat = '' OR word IS NULL OR (once AND before <> '' AND after <> '') THEN 'anchors' ELSE 'tags' END AS mode,
  CASE WHEN flat = '' THEN CASE WHEN word IS NULL THEN 'no_reply' ELSE 'empty_anchor' END WHEN word IS NULL THEN 'anchor_missing' WHEN term = '' THEN 'empty_anchor' WHEN before = '' OR after = '' THEN 'empty_share' END AS reason,
  CASE WHEN term <> '' AND before <> '' AND after <> '' THEN md5(before || '|' || term || '|' || after) END AS shares FROM o""")
def split_replies(spark, sf_dir):
    """Q10: each message as the reply to a passage of three members, of which the middle one, its fifth word, is known: cut by that
    word where it stands once, else by tags."""
    rows = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.struct("conv_id", "turn").alias("passage"), "text")
    w = F.split("text", " ", -1)
    head, tail = F.array_join(F.slice(w, 1, 4), " "), F.array_join(F.slice(w, F.lit(6), F.greatest(F.size(w) - 5, F.lit(0))), " ")
    word = F.get(w, 4)
    tagged = F.concat(head, F.lit(" <x1>"), word, F.lit("</x1> "), tail)
    kinds = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(kind).alias("kind"), F.lit(kind == "locked").alias("tagged")) for k, kind in enumerate(("free", "locked", "free"))))
    members = rows.select("passage", word.alias("term"), F.explode(kinds).alias("x")).select("passage", "x.*", "term", F.lit(None).cast("string").alias("marks"))
    shares = F.array_join(F.transform("shares", lambda x: F.regexp_replace(x["share"], r"\s", "")), "|")
    cut = SE.split_back(members, rows.select("passage", F.col("text").alias("plain"), tagged.alias("tagged")))
    return cut.select("passage.*", "mode", "reason", F.md5(shares).alias("shares"))
