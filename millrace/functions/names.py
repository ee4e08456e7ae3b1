"""Names of people in texts, masked as ``{termN}`` and put back: column expressions that stay in the JVM.

A text is cut into words that may be names (runs of ASCII letters, digits and ``_``) and the gaps round them. A word is a name if it stands in a
list after a cue of credits, or if it is written like a player's tag. Known words are never names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import SPACE, holds

# Cues, separators of a list of names, and words that are no names.
CUES = (
    "created by", "made by", "map by", "built by", "tested by", "programmed by", "designed by", "developed by",
    "hecho por", "creado por", "special thanks to", "thanks to", "gracias a",
)
HEADINGS = ("credits", "special thanks", "agradecimientos", "authors?", "autor", "builders?", "designers?", "developers?")
BETWEEN = ("[,&+]", r"\band\b", r"\by\b")
NO_NAMES = (
    "the hand me myself note notes name unknown anonymous everyone all you your team our people this that these those his "
    "her their some many for and with from playing reading watching helping testing using everybody"
).split()
COUNTED = (
    "level room stage part floor chapter phase area zone house point key door task step test day round wave team player boss "
    "sector nivel sala piso fase parte zona puerta capitulo paso page quest world map spawn base checkpoint lobby arena button "
    "lever chest sign"
).split()
CODES = "0-9a-fk-or"

#: A word that may be a name: it begins with a capital or holds a digit, a ``_`` or a capital after a small letter. All
#: others stay in the gaps, so that what is done word by word is done for few.
WORD = "(?<![A-Za-z0-9_])(?=[A-Z]|[A-Za-z0-9]*(?:_|[0-9]|[a-z][A-Z]))[A-Za-z0-9_]{3,}+"
CREDITED = (
    rf"(?:(?i:\b(?:{'|'.join(CUES)}|(?:{'|'.join(HEADINGS)}){SPACE}*[:\-–])){SPACE}*"
    rf"|\G(?!\A){SPACE}*(?:{'|'.join(BETWEEN)}){SPACE}*)(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9_]{{2,}}+"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is made once; written out in a lambda it would be made for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def tag_shaped(word: Column) -> Column:
    """Whether a word of four characters or more is written like a player's tag: parts joined by ``_``, a capital after a small
    letter, or digits at the end of a word that is not usually counted. A color code before a plain word makes no tag."""
    parts = ~F.concat(F.lit("_"), word, F.lit("_")).contains("__") & word.rlike("[A-Z0-9]") & word.rlike("[a-z]")
    stem = F.regexp_extract(word, r"\A([A-Za-z]{3,})[0-9]{1,4}\z", 1)
    numbered = stem.rlike("[a-z]") & ~F.lower(stem).isin(COUNTED)
    shaped = F.when(word.contains("_"), parts).otherwise(word.rlike("[a-z][A-Z]") | numbered)
    return (F.length(word) >= 4) & ~word.rlike(rf"\A[{CODES}](?:[A-Z][a-z]+|[A-Z]+)\z") & shaped


def _credited(text: Column) -> Column:
    """Places of credited names among the text's words, ascending."""
    gaps, found = F.split(text, CREDITED, -1), F.regexp_extract_all(text, F.lit(CREDITED), F.lit(0))
    steps = F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("name")),
        lambda x: F.regexp_count(F.concat(x["gap"], x["name"]), F.lit(WORD)),
    )
    last = lambda done: F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(-1))
    none = F.lit([]).cast("array<int>")
    places = F.aggregate(steps, none, lambda done, n: F.concat(done, F.array(last(done) + n)))
    # most texts have no cue at all, which a search over bytes tells
    return F.when(holds(F.lower(text), (*CUES, *(h.removesuffix("s?") for h in HEADINGS))), places).otherwise(none)


def _names(text: Column, known: Callable[[Column], Column]) -> Column:
    """struct<words, end> of array<struct<word, before, at, name>> of the text's words and the gap after the last; ``name``: it is
    one."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD, -1)

    def judged(v: Column) -> Column:
        n = F.size(v["words"])
        rows = F.arrays_zip(v["words"].alias("word"), F.slice(v["gaps"], F.lit(1), n).alias("before"), F.slice(v["gaps"], F.lit(2), n).alias("after"))

        def row(x: Column, at: Column) -> Column:
            word = x["word"]
            credited = F.array_contains(v["credited"], at) & ~F.lower(word).isin(NO_NAMES)
            joined = F.right(x["before"], F.lit(1)).isin(*"§.:/{%$@#-") | x["after"].rlike(rf"\A(?:\}}|[\\\"']*{SPACE}*[:=])")
            return F.struct(word.alias("word"), x["before"].alias("before"), at.alias("at"), ((credited | (~joined & tag_shaped(word))) & ~known(word)).alias("name"))

        return F.struct(F.transform(rows, row).alias("words"), F.element_at(v["gaps"], -1).alias("end"))

    return let(F.struct(words.alias("words"), gaps.alias("gaps"), _credited(text).alias("credited")), judged)


def masked_names(text: Column, known: Callable[[Column], Column] = lambda word: F.lit(False)) -> Column:
    """struct<text, names, marks>: the text with its names as ``{termN}``, the names in order, and the mark of each.

    N counts from 0 and passes over the marks that the text has itself, so that ``unmasked_names`` gives any text back.
    ``known`` says of a word whether it is a term with a translation of its own. Null gives null; a name that stands
    twice has two marks.
    """
    own = F.transform(F.regexp_extract_all(text, F.lit(r"\{term(0|[1-9][0-9]{0,8})\}"), F.lit(1)), lambda x: x.cast("int"))

    def laid(v: Column) -> Column:
        hits = F.filter(v["found"]["words"], lambda x: x["name"])
        free = F.array_except(F.sequence(F.lit(0), F.size(hits) + F.size(v["own"])), v["own"])
        found = v["found"]
        return let(F.struct(found["words"].alias("words"), found["end"].alias("end"), hits.alias("hits"), free.alias("free")), written)

    def written(v: Column) -> Column:
        at = F.transform(v["hits"], lambda x: x["at"])
        mark = lambda k: F.concat(F.lit("{term"), k.cast("string"), F.lit("}"))
        marks = F.transform(F.slice(v["free"], F.lit(1), F.size(v["hits"])), mark)

        def joined(u: Column) -> Column:
            piece = lambda x: F.concat(x["before"], F.when(x["name"], F.get(u["marks"], (F.array_position(u["at"], x["at"]) - 1).cast("int"))).otherwise(x["word"]))
            out = F.concat(F.array_join(F.transform(v["words"], piece), ""), v["end"])
            return F.struct(out.alias("text"), F.transform(v["hits"], lambda x: x["word"]).alias("names"), u["marks"].alias("marks"))

        return let(F.struct(at.alias("at"), marks.alias("marks")), joined)

    return F.when(text.isNotNull(), let(F.struct(_names(text, known).alias("found"), own.alias("own")), laid))


def unmasked_names(masked: Column) -> Column:
    """The text with each mark's name in its place. Marks are unique in what ``masked_names`` made, and none is part of another."""
    pairs = F.arrays_zip(masked["marks"].alias("mark"), masked["names"].alias("name"))
    return F.aggregate(pairs, masked["text"], lambda out, x: F.replace(out, x["mark"], x["name"]))
