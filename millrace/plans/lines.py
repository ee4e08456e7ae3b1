"""Queries over lines, commands and replies. Commands are dealt out of the customers' names by their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import lines as L
from millrace.operators import paths as P
from millrace.operators.policy import suspected_containers
from millrace.plans.base import query, quoted, read

TEMPLATES = [
    "say {n} met \"old {k}\" at 'dawn'",
    "execute as @e[name={n},tag=!seen,tag=\"t{k}\"] run tellraw @a {{\"text\":\"{n}\"}}",
    "execute if data block 1 2 3 Lock run execute at @p[tag=k{m}] run clear @a stick",
    "/give @a[name=!{n}] book{{title:'{n} \\'s'}} 1",
    "clear @p[NAME='{n}'] stone {k}",
    "scoreboard players set run run \"open {n}",
    "tag @e[ tag = a{m} , name = {n} ] add  x",
    "execute unless items entity @s hotbar.0 stone run  say  run {k}",
]


def _command(template: str, k: str, m: str, n: str) -> str:
    parts = []
    for x in template.replace("{{", "\x01").replace("}}", "\x02").replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        parts.append({"{k}": k, "{m}": m, "{n}": n}.get(x) or quoted(x.replace("\x01", "{").replace("\x02", "}")))
    return "concat(" + ", ".join(parts) + ")"


def commands_sql(modulo: str, text: str) -> str:
    return "CASE " + " ".join(f"WHEN {modulo} = {i} THEN {_command(t, f'CAST(c_custkey AS {text})', f'CAST(c_custkey % 5 AS {text})', 'c_name')}" for i, t in enumerate(TEMPLATES)) + " END"


def commands(spark, sf_dir):
    """c_custkey and line of every customer."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("millrace_customers")
    return spark.sql(f"SELECT c_custkey, {commands_sql('c_custkey % 8', 'STRING')} AS line FROM millrace_customers".replace("\\", "\\\\"))


COMMANDS = f"lines AS (SELECT c_custkey, {commands_sql('c_custkey % 8', 'VARCHAR')} AS line FROM customer)"


@query(f"""WITH {COMMANDS}, w AS (SELECT c_custkey, list_filter(list_transform(regexp_extract_all(line, {quoted(L.PIECE)}),
  lambda x: regexp_replace(x, {quoted(L.QUOTED)}, '\\1\\2', 'g')), lambda x: x <> '') AS words FROM lines)
SELECT c_custkey, len(words) AS n, array_to_string(words, '|') AS words FROM w""")
def command_words(spark, sf_dir):
    """the words of every command."""
    words = commands(spark, sf_dir).select("c_custkey", L.command_tokens(F.col("line")).alias("words"))
    return words.select("c_custkey", F.size("words").cast("long").alias("n"), F.array_join("words", "|").alias("words"))


@query(f"""WITH RECURSIVE {COMMANDS}, s AS (
  SELECT c_custkey, 0 AS depth, line AS start FROM lines
  UNION ALL
  SELECT c_custkey, depth + 1, regexp_replace(start, '(?s)^.*?\\srun\\s', '') FROM s
  WHERE regexp_matches(start, '\\srun\\s') AND starts_with(lower(ltrim(trim(regexp_extract(start, '(?s)^(.*?)\\srun\\s', 1)), '/')), 'execute '))
SELECT c_custkey, depth, start FROM s""")
def nested_commands(spark, sf_dir):
    """every command with the commands nested in it."""
    return commands(spark, sf_dir).select("c_custkey", F.posexplode(L.command_starts(F.col("line"))).alias("depth", "start"))


@query(f"""WITH {COMMANDS}, a AS (SELECT c_custkey, unnest(regexp_extract_all(line, '@[a-z]\\[([^\\]]*)\\]', 1)) AS inside FROM lines),
b AS (SELECT c_custkey, unnest(regexp_extract_all(inside, '(?i)\\b(?:name|tag)\\s*=\\s*!?\\s*(?:"[^"]*"|''[^'']*''|[^,\\]]+)')) AS part FROM a),
c AS (SELECT c_custkey, lower(regexp_extract(part, '^[A-Za-z]+')) AS kind, trim(regexp_replace(part, '^[A-Za-z]+\\s*=\\s*', '')) AS value FROM b)
SELECT c_custkey, kind, trim(value, '"''') AS value, count(*) AS uses FROM c WHERE NOT starts_with(value, '!') GROUP BY ALL""")
def selector_uses(spark, sf_dir):
    """the names and tags that commands ask for, which feed the reference index."""
    found = commands(spark, sf_dir).select("c_custkey", F.explode(L.selector_references(F.col("line"))).alias("r"))
    return found.groupBy("c_custkey", "r.kind", "r.value").agg(F.count("*").alias("uses"))


@query(f"""WITH {COMMANDS}, a AS (SELECT *, lower(ltrim(trim(line), '/')) AS low FROM lines)
SELECT c_custkey, starts_with(low, 'clear') OR regexp_matches(low, '\\b(if|unless)\\s+(items|data)\\b') AS consumes, regexp_matches(low, '\\b(if|unless)\\s+data\\b') AS compares_data,
  regexp_matches(low, '^(give|item\\s+(replace|modify))\\b') AS produces FROM a""")
def command_roles(spark, sf_dir):
    """Commands that compare items or data, and that make items."""
    c = F.col("line")
    return commands(spark, sf_dir).select("c_custkey", P.consumes(c).alias("consumes"), P.compares_data(c).alias("compares_data"), P.produces_items(c).alias("produces"))


@query("""WITH e AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{"text":"' || c_name || '","clickEvent":{"action":"open_url","value":"HTTPS://a.b/' || c_custkey || '"}}'
    WHEN 1 THEN '{"text":"x","click_event":{"action":"open_url","url":"ftp://a.b"}}' ELSE '{"text":"x","clickEvent":{"action":"run_command","value":"http://x"}}' END AS component FROM customer)
SELECT c_custkey, c_custkey % 3 = 0 AS opens FROM e""")
def address_labels(spark, sf_dir):
    """Components whose click opens an address."""
    key = F.col("c_custkey")
    component = (
        F.when(key % 3 == 0, F.concat(F.lit('{"text":"'), "c_name", F.lit('","clickEvent":{"action":"open_url","value":"HTTPS://a.b/'), key.cast("string"), F.lit('"}}')))
        .when(key % 3 == 1, '{"text":"x","click_event":{"action":"open_url","url":"ftp://a.b"}}')
        .otherwise('{"text":"x","clickEvent":{"action":"run_command","value":"http://x"}}')
    )
    return read(spark, sf_dir, "customer").select(key, P.opens_address(component).alias("opens"))


ESCAPED = "concat(replace(c_name, '#', CASE c_custkey % 6 WHEN 0 THEN '\\u00e9' WHEN 1 THEN '\\n\\t' WHEN 2 THEN '\\x41\\' WHEN 3 THEN '\\U0001F600' WHEN 4 THEN '\\\\u0041' ELSE '\\q\"' END))"


@query("""SELECT c_custkey, replace(c_name, '#', CASE c_custkey % 6 WHEN 0 THEN 'é' WHEN 1 THEN chr(10) || chr(9) WHEN 2 THEN 'A\\' WHEN 3 THEN '😀' WHEN 4 THEN '\\u0041' ELSE '\\q"' END) AS line FROM customer""")
def unescaped_lines(spark, sf_dir):
    """escapes of every kind decoded once."""
    read(spark, sf_dir, "customer").createOrReplaceTempView("millrace_customers")
    rows = spark.sql(f"SELECT c_custkey, {ESCAPED} AS line FROM millrace_customers".replace("\\", "\\\\"))
    return rows.select("c_custkey", L.unescaped(F.col("line")).alias("line"))


PAIR = """t AS (SELECT doc_id, text AS source, CASE doc_id % 4 WHEN 0 THEN replace(trim(text, chr(10) || ' '), chr(10), '\\n') WHEN 1 THEN '译' || text ELSE regexp_replace(text, '(^|\n) +', '\\1', 'g') END AS target,
  chr(10) || '   ' || replace(text, chr(10), chr(10) || '  ') || chr(10) AS padded FROM documents)"""


@query(f"""WITH {PAIR}, e AS (SELECT *, regexp_extract(padded, '^[ \\t\\r\\n]*') AS head, regexp_extract(padded, '[ \\t\\r\\n]*$') AS tail FROM t)
SELECT doc_id, md5(CASE WHEN target = '' THEN target ELSE regexp_replace(head, '[^\\r\\n]', '', 'g') || target || regexp_replace(tail, '[^\\r\\n]', '', 'g') END) AS bounded,
  md5(CASE WHEN contains(source, chr(10)) THEN replace(replace(target, '\\r\\n', chr(10)), '\\n', chr(10)) ELSE target END) AS broken,
  md5(CASE WHEN contains(target, chr(10)) AND len(string_split(padded, chr(10))) = len(string_split(target, chr(10))) THEN
    array_to_string(list_transform(list_zip(string_split(padded, chr(10)), string_split(target, chr(10))), lambda p:
      CASE WHEN length(p[1]) - length(ltrim(p[1])) >= 2 AND trim(p[1]) <> '' AND trim(p[2]) <> '' AND length(p[2]) - length(ltrim(p[2])) < length(p[1]) - length(ltrim(p[1]))
        THEN repeat(' ', length(p[1]) - length(ltrim(p[1]))) || ltrim(p[2]) ELSE p[2] END), chr(10)) ELSE target END) AS indented
FROM e""")
def restored_breaks(spark, sf_dir):
    """boundary breaks, escaped breaks and padding given back to a candidate."""
    t, key = F.col("text"), F.col("doc_id")
    target = (
        F.when(key % 4 == 0, F.replace(F.regexp_replace(t, "^[\n ]+|[\n ]+$", ""), F.lit("\n"), F.lit("\\n"))).when(key % 4 == 1, F.concat(F.lit("译"), t)).otherwise(F.regexp_replace(t, "(^|\n) +", "$1"))
    )
    padded = F.concat(F.lit("\n   "), F.replace(t, F.lit("\n"), F.lit("\n  ")), F.lit("\n"))
    rows = read(spark, sf_dir, "documents").select(key, t.alias("source"), target.alias("target"), padded.alias("padded"))
    s, x, p = F.col("source"), F.col("target"), F.col("padded")
    return rows.select("doc_id", F.md5(L.with_boundary_breaks(p, x)).alias("bounded"), F.md5(L.with_real_breaks(s, x)).alias("broken"), F.md5(L.with_padding(p, x)).alias("indented"))


@query("""SELECT doc_id, length(text) + 2 * 3 + 4 - 1 - 3 AS width FROM documents""")
def display_widths(spark, sf_dir):
    """Columns of every text behind two wide words and a narrow one."""
    return read(spark, sf_dir, "documents").select("doc_id", L.display_width(F.concat(F.lit("中文！"), "text")).cast("long").alias("width"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '.' WHEN 1 THEN '.' WHEN 2 THEN '!' ELSE '"' || lang[1] || CASE WHEN lang[2] <> lang[1] THEN lang[2] ELSE '' END || '.' END AS marks FROM documents""")
def folded_marks(spark, sf_dir):
    """rows of marks by what they mean."""
    key = F.col("doc_id")
    row = F.when(key % 4 == 0, "……").when(key % 4 == 1, ". . .").when(key % 4 == 2, "！!").otherwise(F.concat(F.lit("“"), "lang", F.lit("”。")))
    return read(spark, sf_dir, "documents").select(key, L.marks(row).alias("marks"))


@query("""WITH r AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN '@@0@@ ' || text || ' @@1@@' || role WHEN 1 THEN '@@0@@x@@0@@y@@1@@' WHEN 2 THEN text ELSE '@@1@@a @@0@@ b @@7@@c' END AS reply FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 3 END AS parts, CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN 'duplicate' WHEN 2 THEN 'missing' ELSE 'extra' END AS fault,
  CASE turn % 4 WHEN 0 THEN trim(text) WHEN 1 THEN 'x' WHEN 3 THEN 'a' END AS first_part FROM r""")
def reply_segments(spark, sf_dir):
    """replies taken apart by their marks, and what is wrong with them."""
    turn = F.col("turn")
    reply = (
        F.when(turn % 4 == 0, F.concat(F.lit("@@0@@ "), "text", F.lit(" @@1@@"), "role")).when(turn % 4 == 1, "@@0@@x@@0@@y@@1@@").when(turn % 4 == 2, F.col("text")).otherwise("@@1@@a @@0@@ b @@7@@c")
    )
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", reply.alias("reply"))
    found = L.segments(F.col("reply"))
    return rows.select("conv_id", "turn", F.size(found).alias("parts"), L.segment_fault(F.col("reply"), F.lit(2)).alias("fault"), F.get(found, F.lit(0))["text"].alias("first_part"))


TERMS = ["the", "End", "of", "t", "", "é", "ent to"]


@query("WITH t(term) AS (VALUES " + ", ".join(f"({quoted(t)})" for t in TERMS) + """), g AS (SELECT term, CASE WHEN term = 'End' THEN 'The Dimension' END AS note FROM t)
SELECT term, length(term) >= 2 AND NOT (term = 'End' AND lower(coalesce(note, '')) LIKE '%dimension%') AS injectable, CAST(count_if(term <> '' AND
  CASE WHEN regexp_matches(term, '^[A-Za-z0-9_'' -]+$') THEN regexp_matches(' ' || text || ' ', '[^A-Za-z0-9_]' || term || '[^A-Za-z0-9_]') ELSE contains(text, term) END) AS BIGINT) AS texts
FROM g, documents GROUP BY ALL""")
def term_uses(spark, sf_dir):
    """In how many texts a glossary's terms occur, Latin ones as whole words, and which may be put into a request."""
    terms = spark.createDataFrame([(t, "The Dimension" if t == "End" else None) for t in TERMS], "term string, note string")
    uses = [F.count_if(L.term_occurs(F.lit(t), F.col("text"))).alias(f"t{k}") for k, t in enumerate(TERMS)]
    counts = read(spark, sf_dir, "documents").agg(*uses)  # one pass for all terms
    counts = counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(f"t{k}").alias("texts")) for k, t in enumerate(TERMS)))).alias("r")).select("r.*")
    return terms.join(counts, "term").select("term", L.injectable(F.col("term"), F.col("note")).alias("injectable"), "texts")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(greatest(value, 5.0), 120.0) ELSE least(60.0, 5.0 * pow(2, event_id % 6)) END AS seconds,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events""")
def waits_and_stamps(spark, sf_dir):
    """How long to wait before the next attempt, and time stamps to the second."""
    key = F.col("event_id")
    asked = F.when(key % 3 == 0, F.col("value"))
    return read(spark, sf_dir, "events").select(key, L.retry_seconds(asked, key % 6).alias("seconds"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text || chr(10) || '=====' WHEN 1 THEN chr(10) || text WHEN 2 THEN replace(text, chr(10), ' ') ELSE text END AS source,
  CASE WHEN lang = 'de' THEN 'nbt-text' ELSE 'mcfunction' END AS form, source = 'src1' AS layout, source = 'src2' AS before_click FROM documents)
SELECT doc_id, CASE WHEN layout THEN '-r-' WHEN contains(source, chr(10)) AND regexp_matches(source, '(?m)^[ \\t]*={4,}[ \\t]*$') THEN 'srf'
  WHEN before_click AND contains(source, chr(10)) THEN 'srf' WHEN form = 'nbt-text' THEN 's--'
  WHEN contains(source, chr(10)) AND (starts_with(source, chr(10)) OR ends_with(source, chr(10)) OR contains(source, chr(10) || chr(10)) OR regexp_matches(source, '\\n[ \\t]+$')) THEN 'srf' ELSE '---' END AS rule FROM r""")
def newline_rules(spark, sf_dir):
    """Q3: what each text's line breaks allow."""
    key, t = F.col("doc_id"), F.col("text")
    source = F.when(key % 5 == 0, F.concat(t, F.lit("\n====="))).when(key % 5 == 1, F.concat(F.lit("\n"), t)).when(key % 5 == 2, F.replace(t, F.lit("\n"), F.lit(" "))).otherwise(t)
    rows = read(spark, sf_dir, "documents").select(key, source.alias("text"), F.when(F.col("lang") == "de", "nbt-text").otherwise("mcfunction").alias("form"), "source")
    rule = L.newline_rule(F.col("form"), F.col("text"), F.col("source") == "src1", F.col("source") == "src2")
    flag = lambda c, x: F.when(rule[c], x).otherwise("-")
    return rows.select("doc_id", F.concat(flag("strict", "s"), flag("repair", "r"), flag("reflow", "f")).alias("rule"))


CIPHER = r"""SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN upper(substr(md5(url || i), 1, 0)) || translate(md5(url || i), '0123456789abcdef', 'BCDFGHJKLMNPQRST') || ' ' || translate(md5(i || url), '0123456789abcdef', 'BCDFGHJKLAEIOUST') ELSE url || ' ' || i END AS text"""


@query(f"""WITH u AS ({CIPHER} FROM pages, range(9) t(i)), g AS (
  SELECT page_id, count(*) AS n, string_agg(text, ' ') AS joined FROM u GROUP BY page_id),
w AS (SELECT *, len(regexp_extract_all(joined, '[A-Za-z]')) AS letters, len(regexp_extract_all(joined, '[A-Z]')) AS capitals, list_distinct(regexp_extract_all(joined, '\\b[A-Z]{{6,}}\\b')) AS words FROM g)
SELECT page_id FROM w WHERE n >= 8 AND letters >= 160 AND capitals >= 0.95 * letters AND len(words) >= 8 AND len(list_filter(words, lambda x: regexp_matches(x, '[BCDFGHJKLMNPQRSTVWXZ]{{5,}}'))) >= 4""")
def cipher_containers(spark, sf_dir):
    """Containers of dense, broken capitals, which are reviewed and not translated."""
    read(spark, sf_dir, "pages").createOrReplaceTempView("millrace_pages")
    units = spark.sql(f"SELECT page_id, url, i, text FROM ({CIPHER}, i FROM millrace_pages LATERAL VIEW explode(sequence(0, 8)) t AS i)")
    return suspected_containers(units, "page_id", "text")
