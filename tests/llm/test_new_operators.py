"""Quality, manifest and spelling variants against brute force: nulls, empty and long texts, ties, repeated rows, empty
tables and columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import manifest, quality, spelling

RNG = random.Random(5)
CLASHES = ("lang_", "tree_", "part", "here", "copy", "place", "total", "leaf", "word", "n", "half", "salt", "score", "x", "good", "token")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- 11


def prose(n, words=("the", "mar", "ondel", "riva", "sen", "tolu", "a", "pinor", "of", "keld")):
    return " ".join(RNG.choice(words) + RNG.choice(["", "", "", ".", ","]) for _ in range(n)).capitalize()


def poor(k, n):
    if k == 0:
        return " ".join(w + RNG.choice(["%%%", "###"]) for w in prose(n).split())
    if k == 1:
        return prose(n).upper()
    return " ".join([RNG.choice(["mar", "riva"])] * n)


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(i, poor(i % 3, 30 + i % 40) if i % 4 == 0 else prose(30 + i % 40), int(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (1001, ""), (1002, " \n"), (1003, prose(60_000)), rows[1][:2]], "doc_id long, text string")
    for c in CLASHES:
        docs = docs.withColumn(c, F.lit(1))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (3, None), (None, 0)], "doc_id long, quality int")
    return rows, docs, labels


def test_quality_on_the_held_out_fold(spark, rated):
    rows, docs, labels = rated
    got = {}
    for r in quality.classify(docs, labels).collect():
        assert got.setdefault(r.doc_id, r) == r and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
    assert len(got) == 404 and got[1001].score == got[1002].score == got[None].score
    own = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(own) > 60 and np.mean([p == y for p, y in own]) > 0.95
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_without_labels_or_rows(spark, rated):
    _, docs, labels = rated
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.classify(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_contexts_and_pools_against_plain_sums():
    import pyarrow as pa

    texts = [prose(40) + " WORD word word 12 123456 !!! x_y", "", None, "one", "a b"]
    vocabulary = frozenset(["the", "mar", "word", quality.AGAIN])
    want = defaultdict(lambda: np.zeros(quality.SIZE))
    for t in texts:
        keys = [k if k in vocabulary else quality.shape(k) for k in quality.stream(t or "")]
        for i, k in enumerate(keys):
            want[k] += 0
            for j in range(max(0, i - quality.WINDOW), min(len(keys), i + quality.WINDOW + 1)):
                if i != j:
                    want[k] += np.roll(quality.index_vector(keys[j]), i - j)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    rows = [(k, v) for b in quality.contexts(vocabulary)(iter([batch])) for k, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    got = dict(rows)
    assert set(want) == set(got) and all(np.allclose(want[k], got[k]) for k in want)
    for t in texts:
        assert Counter(quality.stream(t or "")) == quality.bag(t or "")
    v = quality.Vectors({k: np.array(x, np.float32) for k, x in got.items()})
    tokens = quality.stream(texts[0])
    key = {t: t if t in v.learned else quality.shape(t) for t in tokens}
    mean = np.mean([v.vector(key[t]) for t in tokens], axis=0)
    assert np.allclose(v.pool(texts[0])[: 2 * quality.SIZE], mean, atol=1e-5)
    assert int(np.abs(quality.index_vector("the")).sum()) == quality.NONZERO


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    n = quality.Network(0.5)
    n.train(x[:300], y[:300], np.ones(300))
    n.layers[2], n.layers[3] = 4 * n.layers[2], 4 * n.layers[3]  # far too sure
    z = n.logits(x[300:])

    def loss(heat):
        p = 1 / (1 + np.exp(-z / heat))
        return -np.sum(y[300:] * np.log(p) + (1 - y[300:]) * np.log(1 - p))

    n.calibrate(x[300:], y[300:], np.ones(300))
    assert loss(n.heat) <= min(loss(1.0), loss(n.heat * 1.1), loss(n.heat / 1.1)) + 1e-9 and n.heat > 2


# ---- 12


def line(values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(level):
    """All levels of one tree."""
    out = [level]
    while len(level) > 1:
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        out.append(level)
    return out


def brute_manifest(rows):
    by = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = sha(line((doc_id, source, lang, n_chars, text)))
        touched = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 0
        by[lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, sha(line((doc_id, source, lang, n_chars, lower(text)))) if touched else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: climb([r[2] for r in sorted(by[x], key=lambda r: r[0])]) for x in langs}
    over = climb([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, doc_id, leaf, h) in enumerate(sorted(by[x], key=lambda r: r[0])):
            proof = ""
            for levels, at in ((trees[x], i), (over, k)):
                for level in levels[:-1]:
                    run = level[at // 8 * 8 : at // 8 * 8 + 8]
                    proof += "".join(run[: at % 8] + run[at % 8 + 1 :])
                    h = sha("".join(run[: at % 8]) + h + "".join(run[at % 8 + 1 :]))
                    at //= 8
            out.append((doc_id, leaf, trees[x][-1][0], over[-1][0], sha(proof), h, h == over[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, str(x)) for x in r))


@pytest.mark.parametrize("langs", [["en"], ["en", None, "", "é", "z"], [f"l{k}" for k in range(19)]])
def test_manifest_against_brute_force(spark, langs):
    rows = [(i, f"s{i % 3}" if i % 5 else None, langs[min(i % 40, len(langs) - 1)], i if i % 7 else None, RNG.choice(["Some Text", "é", "", None, "low", "A" * 5000])) for i in range(150)]
    rows += [(None, None, None if None in langs else "en", None, None)] * 2 + [rows[3]] * 90 + [(7, "other", rows[7][2], 1, "B")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(1))
    got = [tuple(r) for r in manifest.report(df).collect()]
    assert plain(got) == plain(brute_manifest(rows)) and {r[-1] for r in got} == {True, False}


def test_manifest_of_few_rows(spark):
    df = spark.createDataFrame([(5, "s", "en", 3, "abc")], SCHEMA)
    assert [tuple(r) for r in manifest.report(df).collect()] == brute_manifest([(5, "s", "en", 3, "abc")])
    assert manifest.report(df.limit(0)).count() == 0
    assert manifest.report(df.select("doc_id", "text")).count() == 1
    for n in (8, 9, 64, 65):
        rows = [(i, None, "en" if i else "de", i, "Text") for i in range(n)]
        assert plain(map(tuple, manifest.report(spark.createDataFrame(rows, SCHEMA)).collect())) == plain(brute_manifest(rows))


def test_stored_proofs_verify_and_find_tampering(spark):
    rows = [(i, "s", ["en", "de"][i % 2], i, f"Text {i}") for i in range(40)]
    found = manifest.verified(manifest.proofs(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(found) == 40 and all(r.verified == (r.folded is None or r.folded == r.leaf) for r in found)
    assert {len(r.proof) for r in found} == {3}


# ---- 13


def brute_words(rows):
    c = Counter()
    for i, t in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(m)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            c[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    return {w: n for w, n in c.items() if n >= 3 and len(w) >= 5}


def brute_variants(rows):
    v = brute_words(rows)
    near = {w: [x for x in v if distance(w, x) == 1] for w in v}
    form = {}
    for w in v:
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        if best and v[best] >= 2 * v[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), v[w], len(near[w]), v[form[w]] if w in form else -1) for w in v)


def distance(a, b):
    """By the table of all prefixes; 2 stands for more."""
    if abs(len(a) - len(b)) > 1:
        return 2
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("hot", "shard"), [(1000, 20_000), (5, 60), (1, 7)])
def test_variants_against_brute_force(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(spelling, "HOT", hot)
    monkeypatch.setattr(spelling, "SHARD", shard)
    rng = random.Random(3)
    stems = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "prefixed", "Prefixes"]
    pool = [w for s in stems for w in [s] * rng.choice([1, 3, 8]) + [s[:k] + rng.choice("abxé") + s[k + rng.randint(0, 1) :] for k in (0, 2, len(s) // 2)]]
    texts = [" ".join(rng.choice(pool) for _ in range(60)) + rng.choice([".", " 1x×÷", "ÀB"]) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, None), (4, ""), (5, "12 !"), (0, texts[0]), (6, "Lengthy " * 20_000 + "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASHES:
        df = df.withColumn(c, F.lit(1))
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.variants(df).collect())
    assert got == brute_variants(rows) and any(r[1] and r[1] != r[2] for r in got)
    assert spelling.variants(df.limit(0)).count() == 0


def test_one_edit_is_distance_one():
    rng = random.Random(9)
    for _ in range(4000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)


def test_a_hot_half_is_dealt_out(spark, monkeypatch):
    """Half of all words begin alike: no shard holds many times the mean."""
    from millrace.llm.common import Scratch

    monkeypatch.setattr(spelling, "SHARD", 400)
    monkeypatch.setattr(spelling, "HOT", 50)
    rng = random.Random(2)
    known = {("preposter" if k % 2 else "") + "".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for k in range(4000)}
    df = spark.createDataFrame([(w, 3) for w in known], "word string, n long")
    sizes = [r["count"] for r in spelling.dealt(spelling.halves(df), Scratch(spark)).groupBy("shard").count().collect()]
    assert max(sizes) < 6 * sum(sizes) / len(sizes)
