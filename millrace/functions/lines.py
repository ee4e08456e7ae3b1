"""Scalar functions over lines and commands: tokens, references, escapes, breaks, widths and marks. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import CJK, strip, tokens

# A command's words, where a quoted part may hold spaces; a backslash keeps the character after it there.
PIECE = r"""(?:[^\s'"]|"(?:\\.|[^"\\])*(?:"|$)|'(?:\\.|[^'\\])*(?:'|$))+"""
QUOTED = r""""((?:\\.|[^"\\])*)(?:"|$)|'((?:\\.|[^'\\])*)(?:'|$)"""
SELECTOR = r"@[a-z]\[([^\]]*)\]"
SELECTOR_PART = r"(?i)\b(name|tag)\s*=\s*(!?)\s*(\"[^\"]*\"|'[^']*'|[^,\]]+)"
ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|x[0-9A-Fa-f]{2}|[nrtbf'\"\\/])|[\s\S]"
SIMPLE = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
#: East Asian characters two columns wide (the wide and full-width blocks).
WIDE = (
    r"[\x{1100}-\x{115f}\x{231a}-\x{231b}\x{2e80}-\x{303e}\x{3041}-\x{33ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{a000}-\x{a4cf}"
    r"\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff01}-\x{ff60}\x{ffe0}-\x{ffe6}\x{1f300}-\x{1f64f}\x{20000}-\x{3fffd}]"
)
#: Marks of the Chinese script and the Latin ones that draw the same row.
MARKS, AS_MARKS = "。、“”‘’「」『』《》〈〉【】—…", "..\"\"''\"\"\"\"<><>[]-."
FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = "".join(map(chr, range(0x21, 0x7F)))


def command_tokens(line: Column) -> Column:
    """Words of a command; quotes join what they hold and go, and an open quote holds the rest. Empty words go."""
    words = F.transform(tokens(line, PIECE), lambda x: F.regexp_replace(x, QUOTED, "$1$2"))
    return F.filter(words, lambda x: x != "")


def command_starts(line: Column) -> Column:
    """The line, and every command nested in it behind ``execute … run``."""
    nests = lambda x: F.lower(F.regexp_replace(F.trim(F.regexp_extract(x, r"(?s)^(.*?)\srun\s", 1)), "^/+", "")).startswith("execute ")
    rest = lambda x: F.regexp_replace(x, r"(?s)^.*?\srun\s", "")
    return F.aggregate(
        F.sequence(F.lit(0), F.regexp_count(line, F.lit(r"\srun\s"))),
        F.array(line),
        lambda acc, _: F.when(F.element_at(acc, -1).rlike(r"\srun\s") & nests(F.element_at(acc, -1)), F.concat(acc, F.array(rest(F.element_at(acc, -1))))).otherwise(acc),
    )


def selector_references(line: Column) -> Column:
    """array<struct<kind, value>> of the names and tags that a command's selectors ask for; negated ones are no uses."""
    inside = F.flatten(F.transform(F.regexp_extract_all(line, F.lit(SELECTOR), F.lit(1)), lambda x: tokens(x, SELECTOR_PART)))
    part = lambda x, k: F.regexp_extract(x, SELECTOR_PART, k)
    value = lambda x: F.regexp_replace(F.trim(part(x, 3)), "^[\"']+|[\"']+$", "")
    found = F.transform(F.filter(inside, lambda x: part(x, 2) == ""), lambda x: F.struct(F.lower(part(x, 1)).alias("kind"), value(x).alias("value")))
    return F.filter(found, lambda x: x["value"] != "")


def unescaped(line: Column) -> Column:
    """Escapes decoded once, from the left: \\uXXXX, \\UXXXXXXXX, \\xXX and the simple ones. Others stay as they are."""
    def one(x: Column) -> Column:
        kind, digits = F.substring(x, 2, 1), F.substring(x, 3, 8)
        out = F.when(~x.startswith("\\") | (F.length(x) < 2), x)
        out = out.when(kind.isin("u"), F.decode(F.unhex(digits), "UTF-16BE"))
        out = out.when(kind == "U", F.decode(F.unhex(digits), "UTF-32"))
        out = out.when(kind == "x", F.decode(F.unhex(digits), "ISO-8859-1"))
        for k, v in SIMPLE.items():
            out = out.when(kind == k, v)
        return out.otherwise(kind)

    return F.array_join(F.transform(tokens(line, ESCAPE), one), "")


def with_boundary_breaks(source: Column, target: Column) -> Column:
    """The target between the line breaks that the source begins and ends with."""
    edge = lambda p: F.regexp_replace(F.regexp_extract(source, p, 0), "[^\r\n]", "")
    return F.when(target == "", target).otherwise(F.concat(edge("^[ \t\r\n]*"), target, edge(r"[ \t\r\n]*\z")))


def with_real_breaks(source: Column, target: Column) -> Column:
    """Escaped breaks of the target as real ones, where the source has several lines."""
    changed = F.replace(F.replace(target, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return F.when(source.contains("\n"), changed).otherwise(target)


def with_padding(source: Column, target: Column) -> Column:
    """The target with the source's leading spaces, of lines with two of them or more, where both have as many lines."""
    a, b = F.split(source, "\n", -1), F.split(target, "\n", -1)
    lead = lambda x: F.length(x) - F.length(F.ltrim(x))
    padded = F.zip_with(
        a, b,
        lambda x, y: F.when((lead(x) >= 2) & (strip(x) != "") & (strip(y) != "") & (lead(y) < lead(x)), F.concat(F.repeat(F.lit(" "), lead(x)), F.ltrim(y))).otherwise(y),
    )
    many = source.contains("\n") & target.contains("\n") & (F.size(a) == F.size(b))
    return F.when(many, F.array_join(padded, "\n")).otherwise(target)


def display_width(text: Column) -> Column:
    """Columns: two for a wide character, one for any other."""
    return F.length(text) + F.regexp_count(text, F.lit(WIDE))


def marks(line: Column) -> Column:
    """The distinct characters of a row, folded, in order, without white space: rows of marks that mean the same agree."""
    folded = F.translate(F.translate(line, FULL, HALF), MARKS, AS_MARKS)
    return F.array_join(F.array_distinct(F.filter(F.split(folded, ""), lambda x: (x != "") & ~x.rlike(r"\s"))), "")


def segments(reply: Column) -> Column:
    """array<struct<n, text>> of a reply whose parts follow ``@@n@@`` marks."""
    numbers = F.regexp_extract_all(reply, F.lit(r"@@(\d+)@@"), F.lit(1))
    texts = F.transform(F.slice(F.split(reply, r"@@\d+@@", -1), 2, F.greatest(F.size(numbers), F.lit(1))), strip)
    return F.when(F.size(numbers) == 0, F.array().cast("array<struct<n:int,text:string>>")).otherwise(
        F.zip_with(numbers, texts, lambda n, t: F.struct(n.cast("int").alias("n"), t.alias("text")))
    )


def segment_fault(reply: Column, expected: Column) -> Column:
    """Why a reply does not hold each of the parts 0 to expected - 1 once, or null."""
    n = F.transform(segments(reply), lambda x: x["n"])
    want = F.when(expected > 0, F.sequence(F.lit(0), expected - 1)).otherwise(F.array().cast("array<int>"))
    return (
        F.when(F.size(F.array_except(want, n)) > 0, "missing")
        .when(F.size(F.array_distinct(n)) < F.size(n), "duplicate")
        .when(F.size(F.array_except(n, want)) > 0, "extra")
    )


def term_occurs(term: Column, text: Column) -> Column:
    """A Latin term as a whole word, any other as it stands. An empty term occurs nowhere.

    Whole words come from one pass over the text, of which most texts are spared by looking for the bare term first.
    """
    latin = r"^[A-Za-z0-9_'\- ]+\z"
    bare = F.when(term.rlike(latin), term).otherwise("")  # no other term becomes a pattern
    whole = F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), bare, F.lit(r"(?![A-Za-z0-9_])")))
    found = F.when(term.rlike(latin), F.contains(text, term) & whole).otherwise(F.contains(text, term))
    return (term != "") & F.coalesce(found, F.lit(False))


def injectable(term: Column, note: Column) -> Column:
    """Terms of two characters and more, but for the dimension ``End``, which is a common word too."""
    return (F.length(term) >= 2) & ~((term == "End") & F.lower(F.coalesce(note, F.lit(""))).contains("dimension"))


def retry_seconds(asked: Column, attempt: Column) -> Column:
    """How long to wait before another attempt (from 0): what the server asks, 5 to 120 seconds, else 5 doubling up to 60."""
    asked_for = F.when(asked.isNotNull(), F.least(F.greatest(asked.cast("double"), F.lit(5.0)), F.lit(120.0)))
    return F.coalesce(asked_for, F.least(F.lit(60.0), 5.0 * F.pow(F.lit(2.0), attempt)))


def newline_rule(form: Column, source: Column, layout: Column, before_click: Column) -> Column:
    """struct<strict, repair, reflow>: what a text's line breaks allow, by its container and its own breaks."""
    rule = lambda s, r, f: F.struct(F.lit(s).alias("strict"), F.lit(r).alias("repair"), F.lit(f).alias("reflow"))
    divider = source.contains("====") & source.contains("\n") & source.rlike(r"(?m)^[ \t]*={4,}[ \t]*$")
    blank_end = F.rtrim(source, F.lit(" \t")).endswith("\n")
    padding = source.contains("\n") & (source.startswith("\n") | blank_end | source.contains("\n\n"))
    return (
        F.when(layout, rule(False, True, False))
        .when(divider, rule(True, True, True))
        .when(before_click & source.contains("\n"), rule(True, True, True))
        .when(form == "nbt-text", rule(True, False, False))
        .when(padding, rule(True, True, True))
        .otherwise(rule(False, False, False))
    )


def chinese(text: Column) -> Column:
    return text.rlike(CJK)
