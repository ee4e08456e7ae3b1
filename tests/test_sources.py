"""Sources, sinks and the stream on hand-made files."""

import gzip
import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import gate
from millrace.functions import lines as L_
from millrace.functions import text as X
from millrace.functions import wrap
from millrace.operators import lookup as L
from millrace.operators import account, candidates, dimensions, packing, sequence
from millrace.sources import documents, language, nbt, packs, sinks, snbt
from millrace.streaming import progress


def files(spark, rows):
    return spark.createDataFrame([(p, c if isinstance(c, bytes) else c.encode()) for p, c in rows], "path string, content binary")


def test_json_language(spark):
    body = json.dumps({"a": "Hello there", "n": 1, "b": "minecraft:stone", "argument.id.x": "Kept", "o": {"t": "x y"}})
    units, filtered = language.json_units(files(spark, [("assets/m/lang/en_us.json", "﻿" + body), ("assets/m/lang/de_de.json", body), ("assets/x/lang/en_us.json", "{")]))
    assert [(r.locator, r.source_text) for r in units.collect()] == [("a", "Hello there")]
    assert [r.locator for r in filtered.collect()] == ["argument.id.x"]


def test_legacy_language(spark):
    rows = language.legacy_units(files(spark, [("assets/m/lang/en_US.lang", "# c\nk=Some = text\r\nnone\nx=%s\n")])).collect()
    assert [(r.locator, r.context, r.source_text) for r in rows] == [("1", "k", "Some = text")]


def test_scripts_and_bilingual(spark):
    rows = language.script_lines(files(spark, [("d/f.mcfunction", "say hi\n\n# no\n  clear @a")])).collect()
    assert [(r.line, r.command) for r in rows] == [(0, "say hi"), (3, "  clear @a")]
    both = language.bilingual(files(spark, [("p/lang/en_us.json", '{"a":"A","b":"B"}'), ("p/lang/zh_cn.json", '{"a":"甲","b":""}')]))
    assert [(r.key, r.source, r.target) for r in both.collect()] == [("a", "A", "甲")]


def test_glossary(spark, tmp_path):
    (tmp_path / "g.csv").write_text("source,target,priority\nA,甲,\nB,乙,7\n")
    assert [(r.source, r.priority) for r in language.glossary(spark, str(tmp_path / "g.csv")).orderBy("source").collect()] == [("A", 100), ("B", 7)]
    with pytest.raises(ValueError):
        language.glossary(spark, "g.txt")


def test_line_breaks_do_not_change_a_hash(spark):
    df = files(spark, [("a", "x\ny"), ("b", "﻿x\r\ny")]).select(language.content_hash(F.col("content")).alias("h"))
    assert df.distinct().count() == 1


def tag(kind, name, payload):
    raw = name.encode()
    return struct.pack(">BH", kind, len(raw)) + raw + payload


def document():
    text = lambda s: struct.pack(">H", len(s.encode())) + s.encode()
    pages = struct.pack(">Bi", 8, 2) + text("one") + text("zwei ü")
    inner = tag(9, "pages", pages) + tag(3, "n", struct.pack(">i", 7)) + tag(11, "a", struct.pack(">iii", 2, 1, 2)) + b"\0"
    return tag(10, "", tag(10, "tag", inner) + b"\0")


def test_nbt_leaves(spark):
    region = bytearray(8192 + 4096)
    packed = zlib.compress(document())
    region[0:4] = (2).to_bytes(3, "big") + b"\x01"
    region[8192:8197] = struct.pack(">IB", len(packed) + 1, 2)
    region[8197 : 8197 + len(packed)] = packed
    broken = bytearray(region)
    broken[3] = 0
    rows = [("a.dat", gzip.compress(document())), ("r.mca", bytes(region)), ("b.mca", bytes(broken)), ("e.nbt", b""), ("t.nbt", document()[:-9])]
    df = files(spark, rows)
    found = nbt.leaves(df)
    got = {(r.path, ".".join(r["keys"]), r.value) for r in found.where("error IS NULL").collect()}
    for path in ("a.dat", "r.mca"):
        assert {(path, "tag.pages.0", "one"), (path, "tag.pages.1", "zwei ü"), (path, "tag.n", "7"), (path, "tag.a", "2")} <= got
    assert {r.path for r in found.where("error IS NOT NULL").collect()} == {"b.mca", "e.nbt", "t.nbt"}
    assert [r.path for r in nbt.broken_regions(df, found).collect()] == ["b.mca"]
    assert nbt.modified_utf8(b"a\xc0\x80\xed\xa0\xbd\xed\xb8\x80") == "a\x00😀"


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "x")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.jar", inner.getvalue())
        z.writestr("__MACOSX/._a", "x")
        z.writestr("top.txt", "y")
    got = packs.members(files(spark, [("p.zip", outer.getvalue()), ("plain.txt", "z")])).collect()
    assert {(tuple(r.archives), r.path, r.depth) for r in got} == {(("p.zip", "in.jar"), "deep.txt", 2), (("p.zip",), "top.txt", 1), ((), "plain.txt", 0)}


def test_sinks(spark, tmp_path):
    store = spark.createDataFrame([("a", "1", 1), ("b", "2", 1)], "k string, target string, updated_at int")
    new = spark.createDataFrame([("a", "9", 3), ("a", "8", 2), ("c", "3", 1)], store.schema)
    gone = spark.createDataFrame([("b",)], "k string")
    assert {(r.k, r.target) for r in sinks.upsert(store, new, ["k"], gone).collect()} == {("a", "9"), ("c", "3")}
    (tmp_path / "e.jsonl").write_text('{"schema_version":1,"unit_key":"u","target_text":"t"}\nbad\n{"schema_version":2,"unit_key":"v"}\n')
    good, errors = sinks.manual_edits(spark, str(tmp_path / "e.jsonl"))
    assert (good.count(), errors.count()) == (1, 2)
    old = spark.createDataFrame([("p", "a", "x"), ("p", "b", "y")], "path string, key string, value string")
    units = spark.createDataFrame([("p", "a", 1, "z"), ("p", "a", 2, "x"), ("p", "c", 1, "n")], "path string, key string, seq int, target string")
    assert {(r.key, r.value, r.changed) for r in sinks.language_map(old, units).collect()} == {("a", "x", False), ("b", "y", False), ("c", "n", True)}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"unit": 1, "seq": 2, "state": "done"}, {"unit": 1, "seq": 1, "state": "open"}, {"unit": 2, "seq": 1, "state": "open"}]
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    progress.write_counts(progress.events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert {(r.state, r.units) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("done", 1), ("open", 1)}


def test_gate(spark):
    cases = [
        ("Block %s does not accept '%s' for %s property", "%1$s的%3$s属性不能被设为“%2$s”", True), ("%s %s", "%1$s", False),
        ("%s %d", "%2$s %1$s", False), ("%s {a}", "{a} %1$s", True), ("%s {a}", "%1$s", False), ("plain", "plain", True), ("%1$s", "%s", False),
    ]
    df = spark.createDataFrame(cases, "s string, t string, ok boolean")
    assert df.where(gate.placeholders_match(F.col("s"), F.col("t")) != F.col("ok")).count() == 0


def test_predicates(spark):
    cases = [("minecraft:stone", False), ("log1", False), ("@e[tag=x]", False), ("Beware.", True), (" ab ", True), ("a", False), (None, None)]
    got = spark.createDataFrame(cases, "t string, ok boolean").select(X.translatable(F.col("t")).alias("x"), "ok").collect()
    assert all(r.x == r.ok for r in got)
    one = spark.createDataFrame([("api_key=abc sk-12345678 ok",)], "t string").select(X.redact(F.col("t"), 30).alias("r")).first().r
    assert one == "<redacted> <redacted> ok"
    jump = spark.createDataFrame([("Go 1.5 far", "走1.5")], "a string, b string").select(X.clue_drift(F.col("a"), F.col("b")).alias("r")).first().r
    assert jump == ["clue_jump"]


def test_intervals_and_packing(spark):
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 8)], "k int, s int, e int")
    assert {(r.start, r.end) for r in sequence.merge_intervals(spans, ["k"], "s", "e").collect()} == {(0, 5), (7, 8)}
    for n, want in ((20, 19), (19, None)):
        df = spark.range(1, n + 1).selectExpr("'k' AS k", "id AS v")
        assert sequence.nearest_p90(df, ["k"], "v").first().p90 == want
    rows = spark.createDataFrame([("k", i, s) for i, s in enumerate([1000, 2500, 400, 5000, 1])], "k string, i int, s int")
    assert [r.batch for r in packing.pack(rows, "k", "i", "s").orderBy("i").collect()] == [0, 1, 1, 2, 3]


def test_order_of_rows_does_not_matter(spark):
    df = spark.createDataFrame([("x", "b", 0), ("x", "a", 1)], "k string, t string, seq int")
    from millrace.operators import canonical as C

    for d in (df, df.orderBy(F.desc("seq")), df.repartition(3)):
        assert C.majority(d, "k", "t", "seq").first().winner == "b"
    terms = spark.createDataFrame([("red stone", "红石", 1), ("stone", "石", 5), ("gold", "金", 1), ("gold", "黄金", 1)], "source string, target string, priority int")
    units = spark.createDataFrame([(1, "A Red Stone lamp"), (2, "gold stone")], "unit int, text string")
    got = L.term_containment(units, terms).collect()
    assert [(r.unit, r.source, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "stone", 1), (1, "red stone", 2)]


def test_json_documents(spark):
    from millrace.sources import documents

    body = json.dumps({"title": "A long day", "icon": {"name": "minecraft:stone"}, "pages": ["one two"], "description": ["x y", {"score": {"text": "no no"}}], "a/b": 1})
    units, filtered = documents.units(files(spark, [("q/x.json", body), ("q/bad.json", "{"), ("q/y.txt", "{}")]))
    assert [(r.locator, r.source_text) for r in units.orderBy("seq").collect()] == [("/title", "A long day"), ("/description/0", "x y")]
    assert {r.locator: r.reason for r in filtered.collect()}["/description/1/score/text"] == "below a mechanism object"
    assert documents.lookup({"a/b": [1, {"~": 2}]}, "/a~1b/1/~0") == 2
    with pytest.raises(KeyError):
        documents.lookup({"a": "x"}, "/a/0")


def test_cli(spark, tmp_path, capsys):
    from millrace import cli

    pack = tmp_path / "pack/assets/m/lang"
    pack.mkdir(parents=True)
    (pack / "en_us.json").write_text('{"title.a":"Hello there","b":"x y"}')
    (tmp_path / "pack/q.json").write_text('{"text":"More words","id":"no no"}')
    assert cli.main(["scan", str(tmp_path / "pack")], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["units"], got["high_risk"], got["files"]) == (3, 1, ["assets/m/lang/en_us.json", "q.json"])
    (tmp_path / "g.json").write_text('[{"source":"a","target":"b"}]')
    cli.main(["glossary", str(tmp_path / "g.json"), str(tmp_path / "g")], spark)
    assert spark.read.parquet(str(tmp_path / "g")).first().priority == 100


def test_folders_within_folders_of_one_name(spark, tmp_path):
    root = tmp_path / "it's a pack"
    (root / "a" / "it's a pack").mkdir(parents=True)
    (root / "a" / "it's a pack" / "b.json").write_text("{}")
    (root / "c.json").write_text("[]")
    assert {r.path for r in packs.folder(spark, str(root)).collect()} == {"a/it's a pack/b.json", "c.json"}


def region(*documents):
    data = bytearray(8192 + 4096 * len(documents))
    for k, raw in documents_at(documents):
        data[4 * k : 4 * k + 4] = (2 + k).to_bytes(3, "big") + b"\x01"
        packed = zlib.compress(raw)
        at = 8192 + 4096 * k
        data[at : at + 5] = struct.pack(">IB", len(packed) + 1, 2)
        data[at + 5 : at + 5 + len(packed)] = packed
        data[4096 + 4 * k : 4100 + 4 * k] = struct.pack(">I", 1000 + k)
    return bytes(data)


def documents_at(documents):
    return list(enumerate(documents))


def test_tags_are_written_and_read_back(spark):
    mca = region(document(), document())
    df = files(spark, [("a.dat", gzip.compress(document())), ("r.mca", mca), ("n.nbt", document()), ("same.nbt", document()), ("bad.nbt", document())])
    edits = [
        ("a.dat", None, ["tag", "pages", "0"], "eins 😀\x00"), ("r.mca", 1, ["tag", "pages", "1"], "zwei"), ("n.nbt", None, ["tag", "pages", "1"], ""),
        ("same.nbt", None, ["tag", "pages", "0"], "one"), ("bad.nbt", None, ["tag", "pages", "7"], "x"), ("bad.nbt", None, ["tag", "pages", "0"], "y"),
    ]
    out = nbt.rewritten(df, spark.createDataFrame(edits, "path string, chunk int, keys array<string>, value string"))
    rows = {r.path: r for r in out.collect()}
    assert {p: r.changed for p, r in rows.items()} == {"a.dat": 1, "r.mca": 1, "n.nbt": 1, "same.nbt": 0, "bad.nbt": 0}
    assert rows["bad.nbt"].error and bytes(rows["bad.nbt"].content) == document() and bytes(rows["same.nbt"].content) == document()
    before = {(r.path, r.chunk, ".".join(r["keys"])): r.value for r in nbt.leaves(df).collect()}
    after = {(r.path, r.chunk, ".".join(r["keys"])): r.value for r in nbt.leaves(out.select("path", "content")).collect()}
    changed = {k: v for k, v in after.items() if before[k] != v}
    assert changed == {("a.dat", None, "tag.pages.0"): "eins 😀\x00", ("r.mca", 1, "tag.pages.1"): "zwei", ("n.nbt", None, "tag.pages.1"): ""}
    assert set(before) == set(after)
    new = bytes(rows["r.mca"].content)
    assert new[4096:8192] == mca[4096:8192] and new[8192:12288] == mca[8192:12288]
    with pytest.raises(ValueError):
        nbt.with_chunks(mca, {0: bytes(__import__("random").Random(1).randbytes(2_000_000))})


def test_units_of_tags(spark):
    rows = [
        ("w/a.dat", ["Data", "LastOutput"], "done"), ("w/a.dat", ["Entities", "0", "CustomName"], "Steve_1"), ("w/a.dat", ["Entities", "0", "CustomName"], "Old Man"),
        ("w/a.dat", ["Entities", "1", "CustomName"], "mob_7"), ("w/a.dat", ["tag", "display", "Name"], "Sword"), ("w/a.dat", ["tag", "pages", "0"], "Once"),
        ("w/a.dat", ["tag", "author"], "Me"), ("w/a.dat", ["x", "y"], "?"), ("w/a.dat", ["x", "text"], "  "), ("w/a.dat", ["plugin", "text"], "maybe"),
        ("g/structures/a.nbt", ["plugin", "text"], "maybe"),
    ]
    df = spark.createDataFrame([(p, None, k, nbt.STRING, v, None) for p, k, v in rows], nbt.LEAVES)
    got = {(r.path[0], ".".join(r["keys"]), r.value): (r.policy, r.reason) for r in nbt.tag_units(df).collect()}
    assert len(got) == len(rows) - 1
    assert got["w", "Data.LastOutput", "done"] == ("IMMUTABLE_MATCH_VALUE", "command feedback")
    assert [got["w", "Entities.0.CustomName", n][1] for n in ("Steve_1", "Old Man")] == ["player name", "entity name"]
    assert got["w", "Entities.1.CustomName", "mob_7"][0] == "IMMUTABLE_MATCH_VALUE" and got["w", "tag.author", "Me"][1] == "author"
    assert got["w", "tag.display.Name", "Sword"][0] == got["w", "tag.pages.0", "Once"][0] == got["g", "plugin.text", "maybe"][0] == "TRANSLATABLE_DISPLAY"
    assert got["w", "plugin.text", "maybe"] == ("UNKNOWN_REVIEW", "no safe path") and got["w", "x.y", "?"][0] == "UNKNOWN_REVIEW"


def test_json_is_written_by_pointer(spark):
    body = '{"a~/b": ["x", {"t": "y"}],\n "n": 1}'
    df = files(spark, [("a.json", body), ("same.json", body), ("bad.json", body), ("broken.json", "{")])
    edits = [("a.json", "/a~0~1b/1/t", "甲"), ("same.json", "/a~0~1b/0", "x"), ("bad.json", "/a~0~1b/0", "z"), ("bad.json", "/q", "z"), ("broken.json", "/q", "z")]
    rows = {r.path: r for r in documents.rewritten(df, spark.createDataFrame(edits, "path string, pointer string, value string")).collect()}
    assert json.loads(rows["a.json"].content) == {"a~/b": ["x", {"t": "甲"}], "n": 1} and rows["a.json"].changed == 1
    assert all(rows[p].content.decode() == body for p in ("same.json", "bad.json")) and rows["bad.json"].error and rows["broken.json"].error


def test_reports_and_stores(spark, tmp_path):
    store = spark.createDataFrame([("p1", "h", "old"), ("p9", "h", "old")], "passage_id string, source_hash string, members string")
    runs = spark.createDataFrame([("p1", "h", "new", True), ("p2", "h", "new", True), ("p3", "h", "new", False), ("p9", "h", "new", True)], "passage_id string, source_hash string, members string, published boolean")
    members = spark.createDataFrame([("p1", True), ("p1", True), ("p2", True), ("p2", False), ("p3", True), ("p9", None)], "passage_id string, written boolean")
    assert {(r.passage_id, r.members) for r in sinks.put_passages(store, runs, members).collect()} == {("p1", "new")}
    edits = spark.createDataFrame([("u", "s", "t", "ok")], "unit_key string, source_text string, target_text string, status string")
    sinks.append_manual_edit(spark, str(tmp_path / "e"), edits)
    sinks.append_manual_edit(spark, str(tmp_path / "e"), edits)
    good, errors = sinks.manual_edits(spark, str(tmp_path / "e"))
    assert (good.count(), errors.count()) == (2, 0)
    with pytest.raises(ValueError):
        sinks.append_manual_edit(spark, str(tmp_path / "e"), edits.withColumn("source_text", F.lit(" ")))
    page = sinks.html_report("<run>", {"units": spark.range(100).select("id", F.lit("<b>").alias("t"))})
    assert page.count("<tr>") == 1 + sinks.SHOWN and "(100)" in page and "<b>" not in page and "&lt;run&gt;" in page
    sinks.write_json(str(tmp_path / "m.json"), {"a": "é"})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": "é"} and not list(tmp_path.glob("*.part"))
    assert "hunter22" not in open(sinks.failure_log(str(tmp_path / "f.log"), ValueError("password=hunter22"), "x")).read()
    assert sinks.failure_log(str(tmp_path / "no/f.log"), ValueError("x"), "x") is None
    paths = ["assets/m/lang/zh_cn.json", "a.lang", "x/lang/a.lang", "q.json", "f.mcfunction", "r.MCA", "z.png"]
    routed = {r.path: r.writer for r in sinks.routed(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert [routed[p] for p in paths] == ["language", None, "legacy", "json", "script", "tags", None]
    rows = spark.createDataFrame([("r", None, "t", "s"), (None, "e", "t", "s"), (None, None, "s", "s"), (None, None, None, "s"), (None, None, "t", "s")], "gated string, failed string, target string, source string")
    got = rows.select(sinks.write_status(*(F.col(c) for c in rows.columns)).alias("s")).collect()
    assert [r.s for r in got] == ["blocked", "failed", "unchanged", "unchanged", "changed"]


def test_allow_lists_fail_closed(spark, tmp_path):
    schema = "file string, locator string"
    assert dimensions.allow_list(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "a.json").write_text('{"file":"f","locator":"l"}\nbroken\n{"file":"g"}\n')
    assert [tuple(r) for r in dimensions.allow_list(spark, str(tmp_path / "a.json"), schema).collect()] == [("f", "l")]
    (tmp_path / "n.json").write_text('{"format":"names-1","input_fingerprint":"x",\n"names":{"Bob":"鲍勃"}}')
    assert [tuple(r) for r in dimensions.name_config(spark, str(tmp_path / "n.json"), "names-1", "x").collect()] == [("Bob", "鲍勃")]
    for form, mark in (("names-2", "x"), ("names-1", "y")):
        with pytest.raises(ValueError):
            dimensions.name_config(spark, str(tmp_path / "n.json"), form, mark)


def test_event_sink(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"unit":1,"seq":2,"state":"done"}\n')
    for _ in range(2):  # what was written is not written again
        progress.write_events(progress.events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_lines_of_commands(spark):
    row = lambda s: spark.createDataFrame([(s,)], "c string").select(
        L_.command_tokens(F.col("c")).alias("w"), L_.command_starts(F.col("c")).alias("s"), L_.unescaped(F.col("c")).alias("u"), L_.selector_references(F.col("c")).alias("r")
    ).first()
    got = row("execute as @e[name=\"A b\",tag=!x] run say 'it\\'s' \"open")
    assert got.w == ["execute", "as", "@e[name=A b,tag=!x]", "run", "say", "it\\'s", "open"]
    assert got.s[1:] == ["say 'it\\'s' \"open"] and [tuple(r) for r in got.r] == [("name", "A b")]
    assert row("tag run run x").s == ["tag run run x"] and row("").w == []
    assert row("a\\u00e9\\n\\q\\x4\\\\u0041").u == "aé\n\\q\\x4\\u0041"


def test_structures_in_commands(spark):
    text = """/give @p[tag=x] book{display:{Name:'{"text":"It\\'s"}',Lore:["a","b"]},tag:{id:"minecraft:x",n:1b,I:[I;1,2]},text: "Hi \\"you\\"",plugin:"p"} 1"""
    found, whole = snbt.spans(text)
    got = {"/".join(k): snbt.decoded(text[a:e]) for k, a, e, _ in found}
    assert whole and got["display/Lore/[1]"] == "b" and got["text"] == 'Hi "you"' and got["tag/n"] == "1b" and got["tag/I/[1]"] == "2"
    for broken in ("give @p x{a:", "x{a:1,b}", "x{a b:1}", "x{[}]"):
        assert not snbt.spans(broken)[1]
    assert snbt.spans("say hi") == ([], True) and snbt.spans("@a[name=x]") == ([], True)
    assert [k for k, *_ in snbt.spans('{text:"a",extra:[{"text":"b"}]}')[0]] == [["text"], ["extra", "[0]", "text"]]
    rows = spark.createDataFrame([(1, text), (2, "give @p x{a:"), (3, None), (4, "clear @p stone{display:{Name:'A'}}")], "k long, c string")
    out = snbt.decisions(snbt.structures(rows, "k", "c"), F.col("k") == 4)
    decided = {(r.k, "/".join(r["keys"] or [])): r.decision for r in out.collect()}
    assert decided[1, "display/Name"] == decided[1, "display/Lore/[0]"] == decided[1, "text"] == "display" or decided[1, "display/Lore/[0]"] == "unknown_mechanism_field"
    assert decided[1, "tag/id"] == "mechanism_locked" and decided[1, "plugin"] == "unknown_mechanism_field" and decided[1, "tag/n"] is None
    assert decided[2, ""] == "unparsed_mechanism" and decided[4, "display/Name"] == "mechanism_locked"
    texts = {(r.pointer, r.text) for r in snbt.display_texts(out, "k").collect()}
    assert {("/text", "It's"), ("", 'Hi "you"')} <= texts


def test_game_version(spark):
    rows = [("a/b/level.dat", ["Data", "Version", "Name"], "deep"), ("w/level.dat", ["Data", "version"], "19133"), ("w/x.dat", ["Data", "Version", "Name"], "no")]
    df = spark.createDataFrame([(p, None, k, 8, v, None) for p, k, v in rows], nbt.LEAVES)
    assert [r.version for r in candidates.game_version(df).collect()] == ["<=1.8"]
    assert candidates.game_version(df.where("path = 'w/x.dat'")).count() == 0


def test_layouts_against_all_breaks():
    """The least sum of faults over all ways to break, for small texts; what was laid out comes out again."""
    import itertools

    for text, lines in (("the old man went home at last", 3), ("他说：“你好，世界！”然后走了。", 3), ("one", 1), ("%s of %1$d and https://a.b/c now", 2), ("ab cd", 2)):
        points = [0, *wrap.breaks(text), len(text)]

        def cost(cuts):
            own = [text[a:b].strip() for a, b in zip(cuts, cuts[1:])]
            aim = wrap.width(text) / lines
            ends = sum(wrap.INSIDE for c in cuts[1:-1] if text[c - 1] not in wrap.CLOSING + " ")
            return sum((wrap.width(x) - aim) ** 2 for x in own) + ends if all(own) else float("inf")

        best = min(cost([0, *c, len(text)]) for c in itertools.combinations(points[1:-1], lines - 1))
        got = wrap.laid(text, lines)
        at, cuts = 0, [0]
        for x in got:
            at = text.index(x, at) + len(x)
            cuts.append(at if at == len(text) else next(p for p in points if p >= at))
        assert len(got) == lines and cost(cuts) == best and wrap.laid(" ".join(got), lines) == got or not text.isascii()
    assert wrap.laid("word", 2) is None and wrap.laid("", 1) == [""] and wrap.laid("a b", 0) is None
    assert not set(wrap.breaks("%1$s ok")) & {1, 2, 3}


def test_packing_by_lines_and_wholes(spark):
    import random

    rng, rows = random.Random(5), []
    for key in range(6):
        line = 0
        for order in range(40):
            line += rng.choice([1, 1, 2, 7])
            rows.append((key, order, rng.choice([None, 10, 200, 900, 4000]), None if order % 11 == 5 else line, f"p{order // 3}" if key % 2 else None))
    df = spark.createDataFrame(rows, "key long, ord long, size long, line long, page string").repartition(3).withColumn("batch", F.lit(9))
    want = set()
    for key in range(6):
        batch, n, total, at, held = 0, 0, 0, None, None
        own = [r for r in rows if r[0] == key]
        for r in own:
            same = [x for x in own if x[4] == r[4]] if r[4] else [r]
            need, size = sum(x[2] or 0 for x in same), r[2] or 0
            far = at is not None and r[3] is not None and r[3] - at > 4
            if n and not (r[4] and r[4] == held) and (n + len(same) > 12 or total + need > 3000 or far):
                batch, n, total = batch + 1, 0, 0
            n, total, held, at = n + 1, total + size, r[4], r[3] if r[3] is not None else at
            want.add((key, r[1], batch))
    got = {tuple(r) for r in packing.pack(df, "key", "ord", "size", line="line", whole="page").collect()}
    assert got == want and packing.pack(df.limit(0), "key", "ord", "size").count() == 0


def test_parameters_are_resolved(spark):
    passes = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("d", "c"), ("f", "f"), ("g", "b"), ("g", "h"), ("x1", "x2"), ("x2", "x3"), ("x3", "x4"), ("x4", "x5"), ("x5", "x6")], "src string, dst string")
    sinks = spark.createDataFrame([("c", "display"), ("e", "display"), ("h", "mechanism"), ("x6", "display"), ("i", "display"), ("i", "other")], "node string, kind string")
    roots = spark.createDataFrame([(x,) for x in "a d f g i z x1 x3".split()], "node string")
    got = {r.node: r.verdict for r in account.resolved(passes, sinks, roots).collect()}
    assert got == {"a": "display", "d": "display", "f": "unknown", "g": "mechanism", "i": "unknown", "z": "unknown", "x1": "unknown", "x3": "display"}
