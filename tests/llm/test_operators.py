"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns whose names clash."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bloom, bpe, decontaminate, graph, language_id, licenses, line_dedup, lm, near_dedup, sharding, topk, toxicity
from millrace.llm.common import Scratch, alnum_words, space_words
from millrace.llm.registry import tokenizer_path

RNG = random.Random(7)
SYLLABLES = "ka to mi re so lun ver da pim ost que ñar él über".split()


def word():
    return "".join(RNG.choice(SYLLABLES) for _ in range(RNG.randint(1, 3)))


def prose(n):
    return " ".join(word() for _ in range(n))


BASE = [prose(60) for _ in range(12)]
TEXTS = (
    BASE
    + [BASE[0], BASE[0].replace(" ", "\n", 3), BASE[1] + " one more", BASE[1] + " two more", " ".join(BASE[2].split()[:58])]
    + [None, "", "   \n", "x", "a b", "a b", "!!!", prose(5000), "Ünï <|endoftext|> ok", "\x00 nul", "a" * 3000]
    + ["SHARED line of many words\n" + prose(20) for _ in range(5)]
)


def documents(spark, texts=TEXTS, extra=True):
    rows = [(None if i == 3 else i, t, ["en", "de", None][i % 3], i) for i, t in enumerate(texts)]
    rows.append(rows[0])  # a row that stands twice
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    if extra:
        for c in ("word", "node", "rid", "score", "k1", "leaf", "row", "ids", "source", "n_chars"):
            df = df.withColumn(c, F.lit(1))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n long")


# ---- 1


def brute_templates(lines, docs):
    """For each line (tokens) of a leaf the templates that it shares, by the rule as it is stated. docs: of each line."""
    shared = {t: set() for t in lines}

    def group(own, depth, name):
        total = sum(docs[t] for t in own)
        if depth > line_dedup.SPLITS or len(own) < 2 or total < line_dedup.GENERAL:
            return
        counts = []
        for p in range(len(own[0])):
            c = Counter()
            for t in own:
                c[t[p]] += docs[t]
            counts.append(c)
        fixed, uneven = {}, []
        for p, c in enumerate(counts):
            token, n = max(c.items(), key=lambda x: (x[1], x[0] != line_dedup.WILD))
            if n >= line_dedup.FIXED * total and token != line_dedup.WILD:
                fixed[p] = token
            elif max((v for k, v in c.items() if k != line_dedup.WILD), default=0) >= line_dedup.GENERAL:
                uneven.append((sum(v * v for k, v in c.items() if k != line_dedup.WILD), -p))
        if len(fixed) >= line_dedup.SIMILAR * len(own[0]):
            rest = [t for t in own if any(t[p] != x for p, x in fixed.items())]
            for t in own:
                if t not in rest:
                    shared[t].add((name, depth))
            group(rest, depth + 1, (name, "rest"))
        elif uneven:
            p = -max(uneven)[1]
            for token in {t[p] for t in own}:
                group([t for t in own if t[p] == token], depth + 1, (name, p, token))

    leaves = {}
    for t in lines:
        leaves.setdefault((len(t), t[: line_dedup.LEADING]), []).append(t)
    for leaf, own in leaves.items():
        group(own, 0, leaf)
    return shared


def brute_lines(rows, least=line_dedup.DOCUMENTS):
    """Lines to drop: (doc_id, line)."""
    where, short = {}, {}
    for i, t in sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0)):
        for j, x in enumerate(t.split("\n")):
            if found := line_dedup.line_keys(x):
                where.setdefault(tuple(found[0]), []).append((i, j))
                short[tuple(found[0])] = found[1]
    docs = {t: len({i for i, _ in places}) for t, places in where.items()}
    drop = set()
    for t, places in where.items():
        if docs[t] >= (line_dedup.GENERAL if short[t] else least):
            drop |= set(places[1:])
    finals = {}
    for t, names in brute_templates(list(where), docs).items():
        for name in names:
            finals.setdefault(name, []).extend(where[t])
    for places in finals.values():
        if len({i for i, _ in places}) >= line_dedup.GENERAL:
            drop |= set(sorted(places, key=lambda x: (x[0] is None, x))[1:])
    return drop


def test_lines_against_brute_force(spark):
    df = documents(spark)
    drop = brute_lines([(r.doc_id, r.text) for r in df.collect()])
    for r in line_dedup.report(df).collect():
        want = next(t for i, t in [(x.doc_id, x.text) for x in df.collect()] if i == r.doc_id)
        if want is not None:
            kept = [x for j, x in enumerate(want.split("\n")) if (r.doc_id, j) not in drop]
            assert r.text == "\n".join(kept) and r.n_dropped == want.count("\n") + 1 - len(kept)
        else:
            assert r.text is None and r.n_lines == 0
    assert len(drop) >= 4
    kept = line_dedup.drop_lines(df)
    assert kept.columns == df.columns and kept.count() <= df.count()
    assert line_dedup.report(empty(spark)).count() == 0


def test_lines_with_variable_fields(spark):
    rows = [(i, f"login of user {n} from host alpha at noon today\nown line {word()} {word()} of {i}x") for i, n in enumerate("ann bob cid dan eve".split())]
    rows += [(9, "login of user went home and never came back again"), (10, f"order 77{1} was sent"), (11, "order 8 was sent"), (12, "order 9 was sent")]
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_dropped for i in range(5)] == [0, 1, 1, 1, 1]
    assert got[9].n_dropped == 0
    assert [got[i].n_dropped for i in (10, 11, 12)] == [0, 1, 1]


def test_leaves_of_several_templates(spark):
    """Two templates, noise, short lines and repeated rows in one leaf, against the rule in plain Python."""
    rng, lines = random.Random(3), []
    for k in range(40):
        lines.append(f"user session of {word()}q{'abcdefgh'[k % 8]} was opened on host alpha")
        lines.append(f"user session of {word()}r then closed by the {word()}s timer")
        lines.append("user session of " + " ".join(word() + "abcdefghij"[k % 10] for _ in range(6)))
        lines.append(f"user session of job {k} was opened on host {k}")
    lines += ["and so on", "and so on", "}", "}", "}", "", "  ", "one two three four", "one two three four", "go now", "go now", "go now"]
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[4 * i : 4 * i + 4])) for i in range(len(lines) // 4)]
    rows += [rows[0], (None, lines[0]), (1, "another text of the same id\n" + lines[9])]
    drop = brute_lines(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("lines", F.lit(1)).withColumn("first", F.lit(2))
    got = {(r.doc_id, r.lines): r.n for r in line_dedup.repeated_lines(df).selectExpr("doc_id", "explode(lines) AS lines", "1 AS n").collect()}
    assert set(got) == drop and 60 < len(drop) < len(lines)
    kept = [x for r in line_dedup.report(df.dropDuplicates()).collect() for x in r.text.split("\n")]
    assert sum("was opened on host alpha" in x for x in kept) == 1 and kept.count("and so on") == 2 and kept.count("}") == 1


def test_lines_of_two_documents_and_of_scripts_without_spaces(spark):
    long, han, thai = prose(60), "本网站的所有内容均受版权保护未经许可不得转载", "สงวนลิขสิทธิ์ตามกฎหมายห้ามคัดลอก"
    shared = f"{long}\n{han}\n{thai}\n目录"
    rows = [(1, f"{shared}\n{prose(9)}"), (2, f"{prose(9)}\n{shared}"), (3, "本网站的内容由读者提供如有错误请来信告知我们")]
    got = {r.doc_id: r for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_dropped for i in (1, 2, 3)] == [0, 3, 0]
    assert got[2].text == rows[1][1].split("\n")[0] + "\n目录" and got[1].text == rows[0][1]


# ---- 2


def brute_clusters(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = space_words(t or "")
        n = min(k, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    comp = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return sets, comp


def test_near_copies_against_brute_force(spark):
    df = documents(spark)
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    # a chain whose ends are no longer similar, and a group of near copies
    chain = [BASE[5].split()]
    for _ in range(6):
        chain.append(chain[-1][2:] + [word() + "z", word() + "y"])
    group = [" ".join(w if k != j else "changed" for k, w in enumerate(prose_words)) for j, prose_words in enumerate([BASE[6].split()] * 30)]
    more = [(100 + i, " ".join(c)) for i, c in enumerate(chain)] + [(200 + i, t) for i, t in enumerate(group)]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    sets, comp = brute_clusters(rows + more, 4)
    for r in near_dedup.report(df).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id), r
    kept = near_dedup.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert near_dedup.report(empty(spark)).count() == 0


def test_min_max_estimates(spark):
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    mix = lambda x: (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ ((x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7))
    same = (near_dedup.signature(mix(a)) == near_dedup.signature(mix(b))).mean()
    assert abs(same - 800 / 1200) < 0.15


def test_bloom_filters(spark, monkeypatch):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    found = spark.range(20_000).where(bloom.may_hold(keys, "h", F.xxhash64("id")))
    assert found.where("id < 5000").count() == 5000 and found.count() < 5600
    rows = spark.range(100).select("id", F.lit("x").alias("h"), F.lit(1).alias("may"))
    gone = spark.range(0, 100, 3).select(F.xxhash64("id").alias("gone"))
    left = bloom.without(rows, gone, "gone", F.xxhash64("id"))
    assert left.columns == rows.columns and {r.id for r in left.collect()} == {i for i in range(100) if i % 3}
    assert bloom.without(rows, gone.limit(0), "gone", F.xxhash64("id")).count() == 100
    assert bloom.without(rows.limit(0), gone, "gone", F.xxhash64("id")).count() == 0
    monkeypatch.setattr(bloom, "MOST", 1000)  # too many keys for a filter
    assert bloom.build(keys, "h") is None and spark.range(9).where(bloom.may_hold(keys, "h", F.xxhash64("id"))).count() == 9
    assert {r.id for r in bloom.without(rows, gone.unionByName(keys.select(F.lit(1).cast("long").alias("gone"))), "gone", F.xxhash64("id")).collect()} == {i for i in range(100) if i % 3}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    scratch = Scratch(spark)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 500, 700, 3000, 60_000):
        for share in (0.0, 0.05, 0.1, 0.2, 0.5):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            y = np.unique(np.concatenate([x[int(share * n) :], rng.integers(0, 1 << 63, int(share * n) + n // 9, dtype=np.uint64)]))
            x = np.unique(x)
            both = len(np.intersect1d(x, y))
            a, b = near_dedup.bitmap(x)[None], near_dedup.bitmap(y)[None]
            while a.shape[1] < b.shape[1]:
                b = near_dedup.halved(b)
            ok, far = near_dedup.may_link(a, np.array([len(x)]), b, np.array([len(y)]), 80)
            assert ok[0, 0] or 100 * both < 80 * (len(x) + len(y) - both)
            assert far[0, 0] <= (len(x) + len(y) - 2 * both) / (len(x) + len(y))


def test_recall_of_the_buckets():
    """Pairs at similarity 0.8 that share no bucket: 3 in a million by the module's own permutations."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(2000):
        x = rng.integers(0, 1 << 63, 270, dtype=np.uint64)
        a, b = near_dedup.bands(near_dedup.signature(x[:243])), near_dedup.bands(near_dedup.signature(x[27:]))
        assert len(set(x[:243].tolist()) & set(x[27:].tolist())) / 270 == 0.8
        missed += not set(a.tolist()) & set(b.tolist())
    assert missed <= 1


def test_large_buckets_lose_no_link(spark):
    """More members than a block, of which each is near a few others only: blocks, passes and the cut of pairs."""
    base = [f"w{k}" for k in range(200)]
    rows, rng = [], random.Random(11)
    for c in range(40):
        own = list(base)
        for p in rng.sample(range(200), 11):
            own[p] = f"c{c}x{p}"
        for k in range(9):
            now = list(own)
            for p in rng.sample(range(200), k // 3):
                now[p] = f"c{c}k{k}x{p}"
            rows.append((1000 * c + k, " ".join(now)))
    rows += [(-5, rows[7][1]), (-5, rows[7][1]), (70_000, None), (70_001, "")]
    sets, comp = brute_clusters(dict(rows).items(), 4)
    got = near_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == comp
    assert len(set(comp.values())) > 20


# ---- 3


def test_sharding(spark):
    df = documents(spark)
    rows = sharding.shard_documents(df, shards=4, slots=64).collect()
    assert len(rows) == df.count()
    text = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_slot_map_against_greedy(spark):
    many = spark.range(5000).selectExpr("id AS doc_id", "repeat('x', cast(pmod(hash(id), 400) AS int)) AS text")
    hot = many.selectExpr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 7 ELSE doc_id END AS doc_id", "concat(text, doc_id) AS text")
    load = sharding.shard_documents(hot, shards=8, slots=512).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(load) == 8 and max(r.n for r in load) < 1.02 * min(r.n for r in load)
    sizes = sharding.slot_sizes(many, slots=512)
    first = sharding.build_map(sizes, 8)
    loads, want = [0] * 8, {}
    for r in sorted(sizes.collect(), key=lambda r: (-r.bytes, r.vslot)):
        k = loads.index(min(loads))
        loads[k] += r.bytes
        want[r.vslot] = k
    got = {r.vslot: r.shard for r in first.collect()}
    assert got == want and max(loads) < 1.02 * min(loads)
    grown = {r.vslot: (r.shard, r.version) for r in sharding.add_shard(first, 8).collect()}
    assert all(s in (got[v], 8) and version == 2 for v, (s, version) in grown.items())
    new = sum(r.bytes for r in sizes.collect() if grown[r.vslot][0] == 8)
    assert 0.9 < new / (sum(loads) / 9) < 1.1


def test_stored_maps(spark, tmp_path):
    folder = str(tmp_path / "map")
    rows = sharding.shard_documents(documents(spark), shards=4, slots=64, folder=folder).collect()
    one, two = ({r.vslot: r.shard for r in sharding.stored_map(spark, folder, v).collect()} for v in (1, 2))
    assert all((r.shard, r.next_shard, r.map_version) == (one[r.vslot], two[r.vslot], 1) for r in rows)
    assert set(one) == set(two) and all(two[v] in (one[v], 4) for v in one)
    # a later run goes on from the newest map, with one more shard and more rows
    more = documents(spark).select("doc_id", "text").unionByName(spark.range(900, 1000).selectExpr("id AS doc_id", "'later' AS text"))
    again = sharding.shard_documents(more, shards=5, slots=64, folder=folder).collect()
    assert {r.map_version for r in again} == {3} and all(r.shard == two.get(r.vslot, r.vslot % 5) for r in again) and len(again) == len(rows) + 100
    for s in range(5):
        assert sorted(r.slot for r in again if r.shard == s) == list(range(sum(r.shard == s for r in again)))
    assert {r.version for r in sharding.newest_map(spark, folder).collect()} == {4} and sharding.newest_map(spark, folder + "x") is None


def test_a_row_that_is_repeated_without_end(spark):
    """One row 100,000 times among others: shards within 2 % of the mean, and one more shard takes its share of both."""
    one = spark.range(100_000).selectExpr("7L AS doc_id", "'the same text each time' AS text")
    others = spark.range(3000).selectExpr("id AS doc_id", "concat(repeat('x', cast(pmod(hash(id), 40) AS int)), id) AS text")
    got = sharding.shard_documents(one.unionByName(others).repartition(7))
    load = got.groupBy("shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots")).collect()
    mean = sum(r["size"] for r in load) / 40
    assert len(load) == 40 and all(abs(r["size"] - mean) < 0.02 * mean and r.n == r.slots == r.last + 1 for r in load)
    moved = got.where("next_shard <> shard").agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    assert moved["size"] < 0.035 * 40 * mean and moved.n < 0.035 * 103_000 and moved["size"] > 0.02 * 40 * mean
    assert got.where("next_shard NOT IN (shard, 40)").isEmpty()


# ---- 4


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    df = documents(spark)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    tok = bpe.Tokenizer(spark, tokenizer_path())
    rows = bpe.digests(df, tok).collect()
    assert len(rows) == df.count()
    for r in rows:
        ids = reference.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.with_tokens(df.select("doc_id", "text"), tok).select("text", tok.decode(F.col("token_ids")).alias("t"))
    assert all((r.text or "") == r.t for r in back.collect())
    assert bpe.digests(empty(spark), tok).count() == 0


def test_bpe_on_random_bytes():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), "rb") as f:
        c = bpe.Codec(f.read())
    alphabet = "aabbthe nn  \n\t.,'s12!é漢😀\x85\x1c "
    for _ in range(3000):
        s = "".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 40)))
        assert np.frombuffer(c.encode(s), np.int32).tolist() == reference.encode(s, add_special_tokens=False).ids, repr(s)


# ---- 5


def test_lm_columns_and_gain(spark):
    df = documents(spark)
    tokens = [(r.doc_id, space_words(r.text or "") + [b""]) for r in df.collect()]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for i, ws in tokens if not fold(i) for w in ws)
    total, distinct = sum(seen.values()), len(seen)
    want = {i: (fold(i), len(w), sum(seen[x] > 0 for x in w), sum(math.log10((seen[x] + 1) / (total + distinct + 1)) for x in w)) for i, w in tokens}
    rows = lm.score(df).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        held, n, known, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert r.n_bytes == len(b" ".join(dict(tokens)[r.doc_id])) + 1
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes)
    assert lm.score(empty(spark)).count() == 0
    assert lm.score(spark.createDataFrame([(None, None)], "doc_id long, text string")).first().n_tokens == 1


def test_tree_is_a_distribution():
    words = [b"ka", b"kato", b"to", b"mi", b"mika"] * 3
    parts = [lm.context_counts(lm.rest_places(words), np.ones(len(words), np.int64)), lm.context_counts(lm.head_places(lm.text_heads([words])[1]), np.ones(len(words) + 1, np.int64))]
    levels = [lm.summed(np.concatenate([p[d][0] for p in parts]), np.concatenate([p[d][1] for p in parts])) for d in range(lm.DEPTH + 1)]
    tree = lm.Tree.fit(levels)
    for full, deep in ((0x20, 1), (int.from_bytes(b" ka"[-3:], "big"), 3), (0, 0), (0xFFFF, 2)):
        at = lm.Places(np.arange(256), np.arange(256, dtype=np.uint64), np.full(256, full, np.uint64), np.full(256, deep))
        assert (10 ** tree.log10(at, 256)).sum() == pytest.approx(1.0)


def brute_ctw(coded, query):
    """log10 probability of the query's bytes from a context tree of the coded ones, by recursion over dictionaries. Both are
    lists of (byte, context from the nearest byte on)."""
    counts = Counter()
    for byte, context in coded:
        for d in range(len(context) + 1):
            for k in range(8):
                counts[context[:d], (1 << k) | byte >> (8 - k), byte >> (7 - k) & 1] += 1
    nodes = {(c, x) for c, x, _ in counts}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    children = {}
    for c, x in nodes:
        if c:
            children.setdefault((c[:-1], x), []).append((c, x))
    of = lambda n: (counts[n[0], n[1], 0], counts[n[0], n[1], 1])

    def under(n):
        rest = [v - sum(of(c)[i] for c in children[n]) for i, v in enumerate(of(n))]
        return sum(weighted(c) for c in children[n]) + (kt(*rest) if sum(rest) else 0.0), rest

    def weighted(n):
        return math.log(0.5 * math.exp(kt(*of(n))) + 0.5 * math.exp(under(n)[0])) if n in children else kt(*of(n))

    def one(n, context):
        a, b = of(n)
        own = (b + 0.5) / (a + b + 1)
        if n not in children:
            return own
        below, rest = under(n)
        stop = 1 / (1 + math.exp(below - kt(a, b)))
        child = (context[: len(n[0]) + 1], n[1])
        if len(context) > len(n[0]) and child in nodes:
            return stop * own + (1 - stop) * one(child, context)
        return stop * own + (1 - stop) * ((rest[1] + 0.5) / (sum(rest) + 1) if sum(rest) else own)

    total = 0.0
    for byte, context in query:
        for k in range(8):
            n = (b"", (1 << k) | byte >> (8 - k))
            p = one(n, context) if n in nodes else 0.5
            total += math.log10(p if byte >> (7 - k) & 1 else 1 - p)
    return total


def coded_bytes(words):
    """(byte, context) of a text: a token's first HEAD bytes see the space and two bytes before it, later ones the token."""
    out, tokens = [], [w + b" " for w in words] + [b"\n"]
    before = b"\n\n"
    for t in tokens:
        for k, byte in enumerate(t):
            seen = before[-2:] + b" " + t[:k] if k < lm.HEAD else b" " + t[:k]
            out.append((byte, seen[::-1][: lm.DEPTH]))
        before = before + b" " + t[:-1]
    return out


def test_tree_against_recursion(spark):
    rows = [(i, t) for i, t in enumerate(["ka kato mi", "kato kato ka", "mi re mika", "", "kamito so", "ka ka ka", "to mi", "kato mi ka", None])]
    split = {i: space_words(t or "") for i, t in rows}
    train = [x for i, w in split.items() if zlib.crc32(str(i).encode()) % 7 != 2 for x in coded_bytes(w)]
    for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.score == pytest.approx(brute_ctw(train, coded_bytes(split[r.doc_id])))


def test_score_keeps_every_context(spark):
    # so long that a bar by a share of the bytes would drop contexts seen once or twice
    rows = [(i, prose(9000)) for i in range(14)] + [(50, "qyzx wqyzxv qyzx"), (51, "qyzx wqyzxv"), (52, None)]
    split = {i: space_words(t or "") for i, t in rows}
    held = {i for i in split if zlib.crc32(str(i).encode()) % 7 == 2}
    train = [w for i, w in split.items() if i not in held]
    heads, words = lm.head_places(lm.text_heads(train)[1]), lm.rest_places([x for w in train for x in w])
    parts = [lm.context_counts(at, np.ones(at.item.max() + 1, np.int64)) for at in (heads, words)]
    tree = lm.Tree.fit([lm.summed(*(np.concatenate(x) for x in zip(*d))) for d in zip(*parts)])
    assert held and parts[0][0][1].sum() + parts[1][0][1].sum() > 2 << 18
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, w in split.items():
        want = tree.log10(lm.head_places(lm.text_heads([w])[1]), len(w) + 1).sum() + tree.log10(lm.rest_places(w), len(w)).sum()
        assert got[i] == pytest.approx(want)


def test_log_kt_matches_its_product():
    for a, b in ((0, 0), (3, 0), (2, 5), (100, 1)):
        p = n0 = n1 = 0
        for bit in [0] * a + [1] * b:
            p += math.log(((n1 if bit else n0) + 0.5) / (n0 + n1 + 1))
            n1, n0 = n1 + bit, n0 + 1 - bit
        assert lm.log_kt(np.array([a], float), np.array([b], float))[0] == pytest.approx(p, abs=1e-9)


# ---- 6


def brute_hits(text, items, window=10):
    w, hit, held = alnum_words(text or ""), set(), set()
    for name, t in items:
        b = alnum_words(t or "")
        n = min(window, len(b))
        grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1 if n else 0):
            if tuple(w[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                held.add(name)
    return len(w), len(hit), {str(x) for x in held if x is not None}


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_WINDOWS, 3])
def test_decontamination_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    items = [(1, BASE[0]), (2, "one MORE"), (3, None), (4, ""), (None, BASE[4]), (5, " ".join(BASE[0].split()[5:30])), (1, BASE[0]), (6, BASE[7].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = documents(spark)
    text = {r.doc_id: r.text for r in df.collect()}
    rows = decontaminate.report(df, bench).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, hit, held = brute_hits(text[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(held), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
    assert sum(r.contaminated for r in rows) >= 5
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not r.contaminated for r in rows)
    assert decontaminate.report(empty(spark), bench).count() == 0
    assert decontaminate.report(df, bench.limit(0)).where("contaminated").count() == 0


# ---- 7, 8, 10


def test_language(spark):
    letters = {"en": "th ing er and of to".split(), "fr": "eau eux oir que ent é".split()}
    rows = []
    for i in range(300):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join("".join(RNG.choice(letters[lang]) for _ in range(3)) for _ in range(40)), lang))
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !!", None), (903, "x", None), (None, "thing", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {r.doc_id: r for r in language_id.predict(df).collect()}
    assert len(got) == len(rows)
    held = [(i, lang) for i, _, lang in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97 and all(got[i].held_out for i, _ in held)
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language_id.predict(empty(spark)).count() == 0
    assert language_id.predict(empty(spark).union(spark.createDataFrame([(1, "abc", None, 1)], empty(spark).schema))).first().lang_pred == "und"


def test_toxicity(spark):
    rows = [(i, prose(30) + (" vileword" + word() if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, "")], "doc_id long, text string").withColumn("toxic", F.lit(0))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    held = [(i, x) for i, _, x in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == x for i, x in held]) > 0.97 and all(got[i].held_out for i, _ in held)
    assert got[None].score == got[900].score == toxicity.BASE
    assert toxicity.classify(empty(spark), labels.limit(0)).count() == 0
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({}, {})
    s = g.score
    assert s("you idiot") > s("she said the word idiot here") > s("nothing here") and s("you idiot") > s("you are not an idiot")
    assert s("I will kill time") < 0.3 <= s("you will die, I kill you idiot") and s("you idiot. you moron!") > s("you idiot")
    assert s(None) == s("") == toxicity.BASE


def test_a_threat_counts_before_its_target():
    s = toxicity.Grammar({}, {}).score
    assert s("I will kill you") == s("you I will kill") >= 0.3 > s("I will kill time")
    assert s("I will kill time, you know") < 0.3 and s("I will never kill you") < 0.3 and s("I will kill time. You know") < 0.3
    assert s("she said I will kill you") < s("I will kill you")


@pytest.mark.parametrize(
    ("text", "toxic"),
    [
        ("He said you are an idiot", 0), ("She wrote that they are stupid.", 0), ("They beat the eggs", 0), ("Hang the picture for her", 0),
        ("He will kill the lights", 0), ("They burn wood to heat their homes", 0), ("He said they will kill you. She said you are an idiot. They wrote he is stupid.", 0),
        ("You are an idiot", 1), ("They are stupid", 1), ("I will kill them", 1), ("We must hang all of them", 1), ("They beat everyone", 1), ("He said nothing. You idiot", 1), ("I will hurt you", 1),
    ],
)
def test_targets_are_objects_and_reports_do_not_count(text, toxic):
    assert (toxicity.Grammar({"idiot": 0.99, "stupid": 0.99, "kill": 0.99, "beat": 0.99}, {}).score(text) >= 0.3) == toxic
    assert (toxicity.Grammar({}, {}).score(text) >= 0.3) == toxic


def test_letters_decide_what_has_a_language(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the thing of it"] * 20)] + [(100 + i, t, None) for i, t in enumerate(["½ ²", "Ⅷ", "１２", "ª", "ß", "中", "\n\t", "x" * 5_000_000])]
    rows += [rows[0], (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1)).withColumn("h", F.lit(1)).withColumn("other", F.lit(1))
    got = language_id.predict(df).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id or 0) if (r.doc_id or 0) >= 100] == ["und"] * 3 + ["en"] * 3 + ["und", "en"]


def test_language_against_brute_force(spark):
    """The whole text in blocks with each language's dictionary: fewest bytes, ties to more rows."""
    import zstandard

    letters = {"en": "th ing er and of to".split(), "fr": "eau eux oir que ent é".split()}
    rows = [(i, " ".join("".join(RNG.choice(letters[("en", "fr")[i % 2]]) for _ in range(3)) for _ in range(10 + 90 * (i % 7))), ("en", "fr")[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.fit(df)
    assert all(len(v) > 5000 for v in samples.values())
    for r in language_id.predict(df).collect():
        raw = language_id.normal(rows[r.doc_id][1])
        sizes = {}
        for lang, content in samples.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(raw[k : k + language_id.BLOCK])) for k in range(0, len(raw), language_id.BLOCK))
        assert sizes[r.lang_pred] <= min(sizes.values()) * 1.01 and r.rejected == (r.margin < language_id.MARGIN)


def brute_toxic(text, words, stems):
    """A text's score, clause by clause: no machines, no early exit."""
    import re

    if not text:
        return toxicity.BASE
    tokens = re.findall(r"[^\W_]+(?:'[^\W_]+)*|[.!?\n,;:]", text.lower().replace("’", "'"))
    clean, at, said = 1.0, 0, 0.0
    reported = False
    while at < len(tokens):
        end = at
        while end < len(tokens) and tokens[end] not in ".!?\n,;:":
            end += 1
        clause, best = tokens[at:end], 0.0
        for k, t in enumerate(clause):
            kind, p = words.get(t, (None, 0.0))
            if kind is None:
                for n in (6, 5, 4):
                    if len(t) > n and t[:n] in stems:
                        kind, p = toxicity.INSULT, stems[t[:n]]
                        break
            if kind == toxicity.REPORT:
                reported = True
            if kind in (toxicity.INSULT, toxicity.THREAT):
                kinds = [words.get(x, (0,))[0] for x in clause]
                named = [x == toxicity.TARGET for x in kinds]
                after = [x for x in kinds[k + 1 :]]
                while after and after[0] == toxicity.FILLER:
                    after.pop(0)
                w = p
                if any(words.get(x, (0,))[0] == toxicity.NEGATION for x in clause[max(0, k - 3) : k]):
                    w *= 0.15
                if kind == toxicity.INSULT:
                    w *= 1.0 if any(named[:k]) else 0.9
                else:
                    w *= 1.0 if any(named) or after[:1] == [toxicity.OBJECT] else 0.1
                if reported:
                    said = max(said, toxicity.REPORTED * w)
                else:
                    best = max(best, w)
        clean *= 1 - best
        if end < len(tokens) and tokens[end] in ".!?\n":
            reported = False
        at = end + 1
    return max(toxicity.BASE, said, 1 - clean)


def test_toxicity_against_brute_force(spark):
    words = ["you", "idiot", "kill", "not", "said", "grum7x", "grumble", "gru", "them", "the", "all", "they", "of", "vileword", "don't", "don’t", "stupid", "hurt", "ok", "x9"]
    learned, stems = {"vileword": 0.95, "kill": 0.7}, {"grum": 0.97, "vilew": 0.92}
    g = toxicity.Grammar(learned, stems)
    for k in range(3000):
        t = "".join(RNG.choice(words) + RNG.choice([" ", " ", " ", " ", ". ", ", ", "\n", "! ", " - "]) for _ in range(RNG.randint(1, 14)))
        assert g.score(t) == pytest.approx(brute_toxic(t, g.words, stems)), t
    assert g.score("you grum7x") >= 0.3
    assert g.score("fine words here. " * 300_000 + "you idiot") > 0.5


def test_toxic_words_are_learned_as_counted(spark):
    rows = [(i, prose(12) + (f" vilest{i % 5} grimword" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumn("toxic", F.lit("x")).withColumn("feature", F.lit(1))
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(0, 0), (8, None)], "doc_id long, toxic int")
    g = toxicity.fit(docs, labels)
    train = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    hit = sum("grimword" in t for t, x in train)
    assert g.words["grimword"] == (toxicity.INSULT, pytest.approx((hit + 0.5) / (hit + 1))) and "viles" in g.stems
    twice = docs.unionByName(docs.limit(7))
    assert toxicity.classify(twice, labels).count() == 307


#: Compiled once: they are more than the cache of ``re`` holds.
LICENSE_RULES = licenses.rules()


def brute_licenses(text):
    """All rules over the whole text, and each detection against all kept ones."""
    joined = b" " + b" ".join(alnum_words(text)) + b" "
    found = [(m.start(), m.end(), r.priority, k) for k, r in enumerate(LICENSE_RULES) for m in r.pattern.finditer(joined)]
    kept = []
    for a, b, p, k in sorted(found, key=lambda x: (-x[2], x[0], -x[1], x[3])):
        over = any(q > p and c < b and a < d for c, d, q, _ in kept)
        inside = any(q == p and c <= a and b <= d for c, d, q, _ in kept)
        if not over and not inside:
            kept.append((a, b, p, k))
    return sorted((joined.count(b" ", 0, a) - 1, joined.count(b" ", 0, b), p, LICENSE_RULES[k].label) for a, b, p, k in kept)


def test_licenses_against_brute_force():
    vocabulary = (
        "the mit license apache general public gnu gpl lgpl version 2 3 0 1 licensed released under terms of bsd clause new asl cc by nc sa 4 "
        "spdx identifier all rights reserved isc is permission creative commons attribution mozilla software x11 expat v3 you may"
    ).split()
    s = licenses.Scanner()
    texts = [" ".join(RNG.choice(vocabulary) for _ in range(RNG.randint(1, 60))) for _ in range(250)]
    texts += ["Licensed under the ASL 2.0", f"{prose(300)} mit license {prose(300)} apache license 2.0", *(x for _, _, x in licenses.SINGLE)]
    for t in texts:
        got = sorted((x[0], x[1], x[2], x[3]) for x in s.scan(t)["spans"])
        assert got == brute_licenses(t), t
    assert s.scan("Licensed under the ASL 2.0")["spans"][0][3] == "apache-2.0"


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Apache License, Version 2.0", {"apache-2.0"}), ("Apache License", {"apache"}), ("apache license 20", {"apache"}), ("GNU General Public License v3", {"gpl-3.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}), ("GNU Affero General Public Licence, version 3", {"agpl-3.0"}), ("MPL 2.0", {"mpl-2.0"}), ("GPLv2", {"gpl-2.0"}),
        ("CC BY-NC 4.0", {"cc-by-nc"}), ("CC BY-NC-SA 4.0", {"cc-by-nc-sa"}), ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", {"cc-by-nc-sa"}),
        ("general public license 30 years", {"gpl"}), ("Licensed to apache 2 horses", set()), ("cc by the way", set()),
    ],
)
def test_versioned_names_outrank_the_bare(text, labels):
    assert {x[3] for x in licenses.Scanner().scan(text)["spans"]} == labels
    assert len(licenses.SINGLE) == len({x for _, _, x in licenses.SINGLE})


def test_licenses_of_very_long_and_repeated_texts(spark):
    texts = ["mit LICENSE " * 40_000, "words of a text " * 300_000, "Released under the MIT License."] * 2
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None), (2, texts[2])], "doc_id long, text string")
    for c in ("labels", "n_words", "base", "r", "spans"):
        df = df.withColumn(c, F.lit(1))
    got = licenses.report(df).collect()
    assert len(got) == 8 and sorted(r.n_base for r in got) == [0, 0, 0, 1, 1, 1, 40_000, 40_000]
    assert [r.last_word for r in got if r.n_base > 1] == [79_998] * 2


def brute_base(text):
    w = [x.decode() for x in alnum_words(text or "")]
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), found


def test_licenses(spark):
    texts = [
        "Released under the MIT License.", "MIT license mit-license general public license", "Licensed under CC BY-NC 4.0.", None, "", "permit licenses",
        "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "mit LICENSE " * 2000,
        "apache\nlicense", "All rights reserved.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in licenses.report(df).collect()}
    for i, t in enumerate(texts):
        n, found = brute_base(t)
        r = got[i]
        own = ",".join(sorted({label for _, label in found}))
        first, last = (min(found)[0], max(found)[0]) if found else (None, None)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(found), first, last, own)
        assert set(own.split(",")) <= set(r.labels.split(",")) or not own
        assert 0 <= r.score <= 1
    assert got[2].labels == "cc-by-nc" and got[6].labels == "gpl,gpl-3.0" and got[7].labels == "apache-2.0"
    assert len(licenses.rules()) > 300 and licenses.report(df.limit(0)).count() == 0


# ---- 9


def brute_top(rows, k=20):
    z = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(z):
        if i % 20 == 0:
            s = sorted((-sum(x * y for x, y in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(z) if b != a)
            out += [(i, r + 1, j, -m) for r, (m, j) in enumerate(s[:k])]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 380)]  # ties
    rows += [(400, None), (420, [float("nan")] * 8), (440, [None] * 8), (None, [1.0] * 8), (460, [float("inf")] * 8), (20, rows[20][1]), (500, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, block=64, pivots=8)
    assert sorted(map(tuple, got.collect())) == brute_top(stored)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(few.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1e-3, 2e6, 2e7, 1e12, 3e30])
def test_top_k_of_any_size(spark, size):
    """Components whose products no float sums exactly, copies in many blocks, repeated rows and ids."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * size]) for i in range(150)]
    rows += [(i, rows[5][1]) for i in range(1000, 1100)] + [rows[40], (60, rows[7][1]), (None, rows[0][1]), (1020, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("k1", F.lit(1)).withColumn("z", F.lit(2))
    want = brute_top(rows)
    limit = (1 << 63) - 1
    want = sorted((q, r, v, max(-limit - 1, min(limit, s))) for q, r, v, s in want)
    assert sorted(map(tuple, topk.top_k(df, block=16, pivots=4).collect())) == want
