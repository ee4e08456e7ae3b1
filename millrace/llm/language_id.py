"""Language identification by compression.

For each language a sample of its texts becomes a zstandard raw-content dictionary. A text is compressed with each
dictionary, and the language whose dictionary gives the fewest bytes wins. Where the runner-up comes close the result
is marked as rejected. A text is compressed whole, as its words in lower case, in blocks that each start from the
dictionary: else a long text's own beginning would soon say more than the dictionary.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from millrace.llm.common import fold, text_function

#: Fit parameters: labelled texts sampled per language, each taken whole, and the lengths of texts that are taken first.
TEXTS, LENGTHS = 96, (200, 20_000)
LEVEL, BLOCK = 6, 2048
#: Rejected: the runner-up is within this share of the winner's bytes.
MARGIN = 0.02
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = re.compile(r"[\W\d_]+")
RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
        T.StructField("margin", T.DoubleType()),
    ]
)


def normal(text: str) -> bytes:
    """The words of a text (runs of letters in lower case), with one space between them."""
    return " ".join(NOT_LETTERS.sub(" ", text.lower()).split()).encode("utf-8", "replace")


class Classifier:
    def __init__(self, samples: dict[str, bytes]):
        self.langs = list(samples)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(samples[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def one(self, text: str | None) -> tuple[str, float, bool, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, True, 0.0
        raw = normal(text) or text.encode("utf-8", "replace")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        best = min(sizes)
        k = sizes.index(best)
        scale = 1.0 + 0.01 * best
        score = 1.0 / sum(math.exp(min(50.0, (best - s) / scale)) for s in sizes)
        rest = min((s for i, s in enumerate(sizes) if i != k), default=2 * best)
        margin = (rest - best) / best
        return self.langs[k], score, margin < MARGIN, margin


def fit(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary's content per language, from texts outside the held-out fold.

    Each language gives at most TEXTS texts, those of LENGTHS first, then by a hash of id and text: every task passes on so
    many of a language at most. The languages come in order of their training rows, most first.
    """
    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    other = ~F.length("text").between(*LENGTHS)
    rows = train.where(F.col("text").rlike(r"\p{L}")).select("lang", other.alias("other"), F.xxhash64("doc_id", "text").alias("h"), "text")
    order = Window.partitionBy("lang").orderBy("other", "h")
    chosen = rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= TEXTS).collect()
    content: dict[str, list] = defaultdict(list)
    for r in sorted(chosen, key=lambda r: (r.lang, r.k)):
        content[r.lang].append(normal(r.text))
    rows_of = {r.lang: r["count"] for r in train.groupBy("lang").count().collect()}
    common = sorted(content, key=lambda lang: (-rows_of.get(lang, 0), lang))
    return {lang: b" ".join(content[lang]).ljust(8) for lang in common}  # a dictionary has eight bytes at least


def predictor(samples: dict[str, bytes]):
    """A column function: lang, score, rejected and margin of a text."""
    made: list[Classifier] = []

    def work(texts: list[str | None]) -> pa.Array:
        if not made:
            made.append(Classifier(samples))
        rows = [made[0].one(t) for t in texts]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.float64(), pa.bool_(), pa.float64())
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang", "score", "rejected", "margin"]
        )

    return text_function(RESULT, work)


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and margin of every document.

    Null texts, texts without a letter, and all texts where nothing was learned are ``und`` with score 0. Equal sizes go
    to the language with more training rows.
    """
    found = docs.select(
        "doc_id",
        (fold(F.col("doc_id"), 3) == 1).alias("held_out"),
        predictor(fit(docs))(F.col("text")).alias("r"),
    )
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.rejected", "r.margin")
