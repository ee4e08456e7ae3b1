"""Text predicates and scalar functions as column expressions: all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ``str.strip`` sees it.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Token grammars of the formats.
PLACEHOLDER = (
    r"%\d+\$[sdif]|%[sdif]|\{[A-Za-z0-9_.:-]+\}|\$\{[^}]+\}|§[0-9A-FK-ORa-fk-or]"
    r"|\$\$\([^)]*\)|\$\([A-Za-z_][A-Za-z0-9_]*\)|\\N\{[^}]*\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}"
    r"|\\u[0-9A-Fa-f]{0,3}|\\x[0-9A-Fa-f]{0,1}|\\[nrtbf'\"\\]|\\[A-Za-z]"
)
URL = r"(?i)https?://[^\s\"']+"
COMMAND = r"(?i)/(?<![A-Za-z0-9_]/)[a-z][a-z0-9:_-]*"
FORMAT_CODE = r"§[0-9A-FK-ORa-fk-or]"
#: What every token of a grammar holds. A text without it is not searched for tokens.
HOLDS = {URL: ("://",), COMMAND: ("/",), FORMAT_CODE: ("§",), PLACEHOLDER: ("%", "{", "$", "§", "\\")}
SELECTOR = r"^@[praesn](\[[^\]]*\])?$"
DIGIT_TOKEN = r"^[A-Za-z0-9_]*\d[A-Za-z0-9_]*$"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"
SECRET = (
    r"(?i)(?:api[_-]?key|authorization|bearer|secret|token|password)(?:[\"']?\s*[:=]\s*)([^\s\"']+)"
    r"|sk-[A-Za-z0-9]{8,}|Bearer\s+[A-Za-z0-9._\-]+"
)
RISK_MARKERS = ("command", "tellraw", "title", "execute", "function")
CJK = r"[\x{4e00}-\x{9fff}]"
KANA = r"[\x{3040}-\x{30ff}]"
PRIVATE_USE = r"[\x{e000}-\x{f8ff}\x{f0000}-\x{ffffd}\x{100000}-\x{10fffd}]"


#: The characters of ``SPACE``.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def holds(c: Column, marks: tuple[str, ...]) -> Column:
    """Whether a text holds any of some marks: a search over bytes, without a regex."""
    found = c.contains(marks[0])
    for m in marks[1:]:
        found = found | c.contains(m)
    return found


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def tokens(c: Column, pattern: str) -> Column:
    """All whole matches, in order."""
    if pattern == PLACEHOLDER:  # one look at a character spares its fourteen branches
        pattern = rf"(?=[%{{$§\\])(?:{PLACEHOLDER})"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def glyph_art(c: Column) -> Column:
    """Three private-use characters or more, and no fewer than letters (half as many will do over several lines)."""
    private, letters = count(c, PRIVATE_USE), count(c, r"\p{L}")
    return (private >= 3) & ((private >= letters) | (c.contains("\n") & (private * 2 >= letters)))


def translatable(c: Column) -> Column:
    """Whether a text is language: long enough, no identifier, selector, address or art, and with letters of its own."""
    s = strip(c)
    bare = F.regexp_replace(F.lower(s), r"[.!?,;:]+$", "")
    identifier = bare.rlike(r"^[a-z0-9_.:/-]+$") & bare.rlike(r"[._:/-]")
    free = strip(F.regexp_replace(s, PLACEHOLDER, ""))
    western, cjk = count(free, r"[A-Za-z\x{400}-\x{4ff}]"), count(s, CJK)
    return (
        (F.length(s) >= 2)
        & ~glyph_art(s)
        & ~s.rlike(r"^(https?://|minecraft:|#)")
        & ~s.rlike(SELECTOR)
        & ~s.rlike(DIGIT_TOKEN)
        & ~identifier
        & (free != "")
        & ~((cjk > 0) & (western == 0))
        & (cjk <= F.greatest(F.lit(12), western * 2))
        & free.rlike(r"\p{L}")
    )


def risk(text: Column, context: Column) -> Column:
    marked = F.lower(context).rlike("|".join(RISK_MARKERS))
    return F.when(marked, "high").when(text.rlike(PLACEHOLDER), "medium").otherwise("low")


def chinese_output(c: Column) -> Column:
    cjk, kana, letters = count(c, CJK), count(c, KANA), count(c, r"\p{L}")
    return (cjk > 0) & (kana <= F.greatest(F.lit(2), F.floor(cjk / 3))) & ((letters == 0) | (cjk >= letters * 0.1))


def literal_lock(c: Column) -> Column:
    """A text that is wholly a number, true, false, null or none."""
    s = F.lower(strip(c))
    return s.isin("true", "false", "null", "none") | s.rlike(NUMBER)


def peel(c: Column) -> Column:
    """struct<head, body, tail>: white space and formatting codes split off both ends. A text of edges alone stays whole."""
    edge = rf"(?:{SPACE}|{FORMAT_CODE})"
    head = F.regexp_extract(c, f"^{edge}*", 0)
    rest = F.substring(c, F.length(head) + 1, F.length(c))
    tail = F.regexp_extract(rest, f"{edge}*$", 0)
    body = F.substring(rest, F.lit(1), F.length(rest) - F.length(tail))
    whole = F.length(rest) == 0
    return F.struct(
        F.when(whole, "").otherwise(head).alias("head"),
        F.when(whole, c).otherwise(body).alias("body"),
        F.when(whole, "").otherwise(tail).alias("tail"),
    )


def short_label(c: Column) -> Column:
    """A label that may stay as it is: few letters in one word, a bracketed token, or a long word without vowels."""
    s = strip(peel(strip(c))["body"])
    shape = (
        s.rlike(r"^[A-Za-z]{1,8}$")
        | s.rlike(r"^(\[[A-Z0-9_]+\]|\{[A-Z0-9_]+\}|<[A-Z0-9_]+>)$")
        | (s.rlike(r"^[A-Za-z]{6,}$") & ~s.rlike(r"[aeiouyAEIOUY]"))
    )
    return (s != "") & ~c.contains("\n") & ~s.contains(" ") & shape


def fragment(c: Column) -> Column:
    s = strip(c)
    return (F.length(s) <= 24) & (F.size(F.split(s, r"\s+")) <= 3) & ~s.rlike(r"[.!?。！？…]$") & (s != "")


def redact(c: Column, limit: int = 400) -> Column:
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), SECRET, "<redacted>")
    return F.when(F.length(clean) > limit, F.concat(F.left(clean, F.lit(limit)), F.lit("…"))).otherwise(clean)


def same_tokens(a: Column, b: Column, pattern: str) -> Column:
    """Equal multisets of matches. Equal texts have them, and so have two texts without any mark of the grammar."""
    same = F.array_sort(tokens(a, pattern)) == F.array_sort(tokens(b, pattern))
    bare = a == b
    if pattern in HOLDS:
        bare = bare | ~(holds(a, HOLDS[pattern]) | holds(b, HOLDS[pattern]))
    return F.when(bare, True).otherwise(same)


def clue_drift(source: Column, target: Column) -> Column:
    number, jump = r"\d+(?:\.\d+)?", r"\b\d+\.\d+\b"
    negated = F.lower(source).rlike(r" not |n't|unless|without") & ~target.rlike("不|未|非|没有")
    reasons = F.array(
        F.when(~same_tokens(source, target, number), "clue_number"),
        F.when(~same_tokens(source, target, jump), "clue_jump"),
        F.when(negated, "clue_negation"),
    )
    return F.filter(reasons, lambda x: x.isNotNull())


# Marks of a model's scaffolding, and phrases that forbid.
ARTIFACTS = (r"@@(?:\d+|OK)@@", r"\[page=(?:\d+|未知)\]", "```", r"\*\*[^*\n]+\*\*|__[^_\n]+__")
#: What every match of an artifact's pattern holds.
ARTIFACT_MARKS = (("@@",), ("[page=",), ("```",), ("**", "__"))
FORBIDS = (
    r"(?i)^\s*(?:please\s+)?(?:do\s+not|don't|never)\s+"
    r"(?:press|click|push|pull|open|close|break|destroy|place|enter|leave|use|touch|activate)\b"
)
FORBIDS_TARGET = "不|勿|别|禁止|切忌|避免|无需|不能"


def content_reason(source: Column, target: Column) -> Column:
    more = [F.when(holds(target, m), count(target, p) > count(source, p)) for p, m in zip(ARTIFACTS, ARTIFACT_MARKS, strict=True)]
    scaffolding = more[0] | more[1] | more[2] | more[3]
    lost = source.rlike(FORBIDS) & target.rlike(CJK) & ~target.rlike(FORBIDS_TARGET)
    return F.when(source == target, None).when(scaffolding, "model_scaffolding").when(lost, "instruction_negation")


def context_gate(source: Column, target: Column, strict: bool | Column = False) -> Column:
    """Why a candidate must not replace its source, or null; ``strict`` asks for the source's line breaks too. Conversions by
    index count as their plain spelling in order; for the full proof see ``functions.gate``."""
    structure = same_tokens(source, target, URL) & same_tokens(source, target, COMMAND)
    structure = structure & same_tokens(source, target, PLACEHOLDER) & same_tokens(source, target, FORMAT_CODE)
    breaks_s, breaks_t = count(source, "\n"), count(target, "\n")
    blank = lambda c: F.filter(
        F.transform(F.split(c, "\n", -1), lambda x, i: F.when(x == "", i)), lambda x: x.isNotNull()
    )
    layout = (breaks_s > 0) & ((breaks_s != breaks_t) | (blank(source) != blank(target)))
    grown = F.length(strip(target)) > F.greatest(F.lit(80), F.length(strip(source)) * 4 + 16)
    strict = strict if isinstance(strict, Column) else F.lit(strict)
    rest = F.when(strict & layout, "newline_structure").when((breaks_t > breaks_s + 1) | grown, "unexpected_expansion")
    return F.when(~structure, "structural_token").otherwise(F.coalesce(content_reason(source, target), rest))


def stable_id(*parts: Column) -> Column:
    """sha1 over the parts, each followed by a NUL."""
    nul = F.lit("\x00")
    return F.sha1(F.concat(*(x for p in parts for x in (p, nul))).cast("binary"))


def unit_key(*parts: Column) -> Column:
    """sha256 of a compact JSON array of texts."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def residue(source: Column, target: Column) -> Column:
    """Lower-case Latin words glued to Chinese characters in the target that also begin or end a word of the source, first
    seen first."""
    # Words of units, and markup.
    skip = "kg cm mm km hp xp fps id ui ms mb gb kb hz px pm am".split()
    markup = r"§[0-9a-fk-orA-FK-OR]|\{[^{}]*\}|%(?:\d+\$)?[sdf]|https?://\S+"
    s, t = F.lower(F.regexp_replace(source, markup, " ")), F.regexp_replace(target, markup, " ")
    glued = rf"(?<![A-Za-z])[a-z]{{2,}}(?={CJK})|(?<={CJK})[a-z]{{2,}}(?![A-Za-z])"
    stands = lambda w: F.rlike(s, F.concat(F.lit("(?<![a-z])"), w, F.lit("|"), w, F.lit("(?![a-z])")))
    found = F.filter(F.array_distinct(tokens(t, glued)), lambda w: ~w.isin(skip) & stands(w))
    return F.when(F.ltrim(source).startswith("/") | ~target.rlike(CJK), F.array().cast("array<string>")).otherwise(found)


def duration(ms: Column) -> Column:
    seconds = F.floor(ms / 1000)
    return F.when(ms < 1000, F.concat(F.floor(ms).cast("string"), F.lit(" ms"))).otherwise(
        F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s"))
    )
