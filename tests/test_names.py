"""Names by cues and by their shape, masks that never collide, and texts given back."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import names as N

CASES = [  # text, names in order
    (None, None),
    ("", []),
    ("no names here", []),
    ("Created by Anna", ["Anna"]),
    ("MAP BY Anna, Bob & Carl and Dora", ["Anna", "Bob", "Carl", "Dora"]),
    ("hecho por Anna y Bob", ["Anna", "Bob"]),
    ("made by anna", []),  # no capital
    ("made by Al", []),  # too short
    ("Credits: Anna", ["Anna"]),
    ("credits Anna", []),  # a heading needs its mark
    ("Builders - Anna + Bob", ["Anna", "Bob"]),
    ("thanks to Everyone and Anna", ["Anna"]),  # no name, but the list goes on
    ("thanks to Anna. And Bob", ["Anna"]),
    ("unmade by Anna", []),  # a cue begins a word
    (", Anna", []),  # no list without a cue
    ("xX_Slayer_Xx won", ["xX_Slayer_Xx"]),
    ("MAX_VALUE and _ab1 and a__B1", []),
    ("snake_case", []),
    ("_Ab1 Ab1_ a_1 " + "a" * 3000 + "_B" * 3000, ["a" * 3000 + "_B" * 3000]),  # whatever a word's length
    ("BlockMaster", ["BlockMaster"]),
    ("cRed eSTOP", []),  # a color code before a word
    ("Steve123 in Room12, level3, ABC123, ab12", ["Steve123"]),
    ("Steve12345", []),
    ("@BlockMaster #BlockMaster a.BlockMaster {BlockMaster} %BlockMaster", []),
    ("BlockMaster: x BlockMaster =x 'BlockMaster' : x BlockMaster", ["BlockMaster"]),
    ("made by BlockMaster: BlockMaster", ["BlockMaster", "BlockMaster"]),  # credited in spite of its colon
    ("made by Anna {term0} {term2} and BlockMaster Steve123", ["Anna", "BlockMaster", "Steve123"]),
    ("made by Knownword and Anna", ["Anna"]),
    ("héBlockMaster\nmade by\u00a0Anna\n", ["BlockMaster", "Anna"]),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, text string")
    m = df.select("k", "text", N.masked_names(F.col("text"), lambda w: F.lower(w) == "knownword").alias("m"))
    return {r.k: r for r in m.select("k", "text", "m", N.unmasked_names(F.col("m")).alias("back")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_names(rows, k):
    text, want = CASES[k]
    r = rows[k]
    assert r.back == text
    if text is None:
        assert r.m is None
        return
    assert r.m.names == want
    assert len(set(r.m.marks)) == len(want) and not any(x in text for x in r.m.marks)
    assert all(r.m.text.count(x) == 1 for x in r.m.marks)


def test_marks_pass_over_those_of_the_text(rows):
    (k,) = (k for k, (t, _) in enumerate(CASES) if t and "{term2}" in t)
    assert rows[k].m.text == "made by {term1} {term0} {term2} and {term3} {term4}"


def test_long_text(spark):
    text = "made by Anna and BlockMaster " * 2000
    r = spark.createDataFrame([(text,)], "text string").select(N.masked_names(F.col("text")).alias("m"))
    r = r.select("m", N.unmasked_names(F.col("m")).alias("back")).first()
    assert r.back == text and r.m.names == ["Anna", "BlockMaster"] * 2000
