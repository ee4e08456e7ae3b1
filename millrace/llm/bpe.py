"""BPE encoding and decoding by dynamic programming over prefixes.

Each pre-token's encoding is found without replaying merges. A suffix automaton reports every vocabulary entry that
ends at each byte. For every prefix exactly one of them can be the last token of the prefix's encoding: the one whose
predecessor (the last token of the shorter prefix) makes a compatible pair with it. That token is kept per prefix;
following the kept tokens back from the end gives the ids that merging in rank order would give. The work is linear
in the length, however long a pre-token is. What a slice of texts has of short pre-tokens not seen before is read together, a
byte of each at a time (``Codec.short``); ``Codec.piece`` reads a long one by itself.

A pair of tokens is compatible when merging their joined bytes leaves just those two tokens. ``Codec.compatible``
finds this by undoing the latest merge on either side of the boundary, looking at each step for a merge across it
that would have come first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import held, text_function

#: The pre-token pattern of byte-level BPE vocabularies (a fixed value of the format).
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Unicode white space, as a character class. A single white space between two other characters stands alone or leads
#: the word after it, so words between single spaces can be coded one by one; ``plain`` finds what breaks that rule.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
OTHER_SPACE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bounds of what a Python worker keeps: words and pre-tokens (each twice, see Recent), pairs of long pre-tokens, characters of a
#: kept word.
CACHE_WORDS, CACHE_PAIRS, CACHE_BYTES = 120_000, 50_000, 48
#: Places (as powers of two) for pairs and for moves of short pre-tokens, and how many of these are read together.
PAIR_BITS, MOVE_BITS, TOGETHER = 20, 17, 16_384
#: ASCII marks that make a pre-token of their own behind a word.
MARKS = frozenset(".,;:!?")


class Recent(dict):
    """Makes missing values, and keeps at most the last two generations of ``size`` of them."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > CACHE_BYTES:
                return found
        self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def known(self, keys: set[str]) -> dict[str, bytes]:
        """The values there are of the keys."""
        new, old = keys & self.keys(), self.old.keys() & keys
        found = {k: self.old[k] for k in old} | {k: self[k] for k in new}
        for k in old - new:
            self.put(k, found[k])
        return found


class Slots:
    """Values of arrays of 64-bit keys from 0, made one by one where they are missing. Each key has one place; of two keys of
    one place the later stays, so memory is fixed."""

    def __init__(self, make, bits: int, kind: type):
        self.make, self.shift = make, np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, kind)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        out, missing = self.values[at], np.flatnonzero(self.keys[at] != keys)
        if len(missing):
            new, back = np.unique(keys[missing], return_inverse=True)
            made = np.array([self.make(k) for k in new.tolist()], self.values.dtype)
            at = self._place(new)
            self.keys[at] = new
            held = self.keys[at] == new
            self.values[at[held]] = made[held]
            out[missing] = made[back]
        return out


def plain(text: str) -> bool:
    """Only single spaces and line breaks, each between other characters."""
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
        or OTHER_SPACE.search(text)
    )


def pieces(word: str) -> list[str]:
    """A word's pre-tokens. Plain ones of ASCII letters, with a space before and a mark behind or not, need no pattern."""
    if word.isascii():
        body = word[1:] if word[:1] == " " else word
        if body.isalpha():
            return [word]
        if body[-1:] in MARKS and body[:-1].isalpha():
            return [word[:-1], word[-1]]
    return PIECES.findall(word)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies (fixed by the format)."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


#: A suffix, the states after a byte, (length, token) of the tokens that end it, the shortest first, and the state's number.
State = tuple[bytes, dict, list, int]


class Codec:
    """Tables of one vocabulary, and the encoder and decoder over them."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model, chars = spec["model"], byte_characters()
        size = 1 + max([*model["vocab"].values(), *(x["id"] for x in spec["added_tokens"])])
        self.token: list[bytes] = [b""] * size
        for text, k in model["vocab"].items():
            self.token[k] = bytes(chars[c] for c in text)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        for text, k in self.special.items():
            self.token[k] = text.encode()
        self.length = [len(t) for t in self.token]
        self.pair: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size  # a merge's place in the order; bytes come before all merges
        for k, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            made = model["vocab"][left + right]
            a, b = model["vocab"][left], model["vocab"][right]
            self.pair.setdefault((a, b), k)
            if self.halves[made] is None:
                self.halves[made], self.rank[made] = (a, b), k
        self.known: dict[int, bool] = {}  # by a << 32 | b
        special = set(self.special.values())
        self.ids = {t: k for k, t in enumerate(self.token) if t and k not in special and self.whole(k)}
        self.prefixes = {t[:n] for t in self.ids for n in range(len(t) + 1)}
        #: The suffix automaton: a state is the longest suffix read that begins a token. States are filled in as they
        #: are first reached; there are never more than ``prefixes``.
        self.states: dict[bytes, State] = {}
        self.numbered: list[State] = []
        self.start = self._state(b"")
        self.moves = Slots(lambda k: self._reach(self.numbered[k >> 8], k & 255)[3], MOVE_BITS, np.int32)
        self.pairs = Slots(lambda k: self._meets(k >> 32, k & 0xFFFFFFFF, until=float("inf")), PAIR_BITS, np.bool_)
        self.ends = (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        self.lengths, self.table = np.array(self.length, np.int32), pa.array(self.token, pa.large_binary())
        self.pieces, self.leading, self.spaced = (Recent(None, n) for n in (CACHE_WORDS // 6, CACHE_WORDS // 6, CACHE_WORDS))
        self.line_break = np.array(self.piece(b"\n"), dtype=np.int32).tobytes()

    def whole(self, t: int) -> bool:
        """Whether merging the token's own bytes gives the token back."""
        parts = self.halves[t]
        return self.length[t] == 1 if parts is None else self._meets(*parts, until=self.rank[t])

    def _meets(self, a: int, b: int, until: float) -> bool:
        """No merge across the boundary of a and b comes before ``until`` and before the merges that make a and b.

        The boundary's neighbours as they stood at any time are found by undoing merges from the latest: of the two
        neighbours the one made last is taken apart, since it did not yet exist before its own merge. A merge across
        the boundary that precedes the undone merge would have been taken. At equal rank the left one is made first,
        as merges of a rank run from the left.
        """
        limit, left_first = until, False
        while True:
            across = self.pair.get((a, b))
            if across is not None and (across < limit or (across == limit and left_first)):
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left neighbour is the later one
                limit, left_first, a = ra, False, self.halves[a][1]
            else:  # the right neighbour is the later one; an equal merge across, further left, would come before it
                limit, left_first, b = rb, True, self.halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        found = self.known.get(a << 32 | b)
        if found is None:
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            found = self.known[a << 32 | b] = self._meets(a, b, until=float("inf"))
        return found

    def _state(self, suffix: bytes) -> State:
        found = self.states.get(suffix)
        if found is None:
            ends = ((n, self.ids.get(suffix[-n:])) for n in range(1, len(suffix) + 1))
            found = self.states[suffix] = (suffix, {}, [(n, t) for n, t in ends if t is not None], len(self.numbered))
            self.numbered.append(found)
        return found

    def _reach(self, state: State, byte: int) -> State:
        """The state after one more byte."""
        to = state[0] + bytes([byte])
        while to not in self.prefixes:
            to = to[1:]
        found = state[1][byte] = self._state(to)
        return found

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        last: list[int] = []
        known, state = self.known, self.start
        for at, byte in enumerate(raw):
            state = state[1].get(byte) or self._reach(state, byte)
            for n, t in state[2]:
                if n > at:
                    break
                p = last[at - n]
                ok = known.get(p << 32 | t)
                if ok or ok is None and self.compatible(p, t):
                    break
            last.append(t)
        ids, at = [], len(raw) - 1
        while at >= 0:
            t = last[at]
            ids.append(t)
            at -= self.length[t]
        return ids[::-1]

    def _ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all states by number: where the tokens that end each begin (and the last one's end), lengths and tokens, the longest
        first."""
        first, length, token = self.ends
        new = self.numbered[len(first) - 1 :]
        if new:
            more = np.array([e for x in new for e in reversed(x[2])], np.int32).reshape(-1, 2)
            first = np.concatenate([first, first[-1] + np.cumsum([len(x[2]) for x in new])])
            self.ends = first, np.concatenate([length, more[:, 0]]), np.concatenate([token, more[:, 1]])
        return self.ends

    def short(self, raws: list[bytes]) -> list[bytes]:
        """The ids of short pre-tokens, packed: the steps of ``piece``, of all of them at once."""
        out: list[bytes] = [b""] * len(raws)
        order = sorted(range(len(raws)), key=lambda k: -len(raws[k]))
        for at in range(0, len(order), TOGETHER):
            of = order[at : at + TOGETHER]
            for k, ids in zip(of, self._together([raws[k] for k in of]), strict=True):
                out[k] = ids
        return out

    def _together(self, raws: list[bytes]) -> list[bytes]:
        """``short`` of pre-tokens that descend by length, none of them empty."""
        size = np.array([len(x) for x in raws])
        width = int(size[0])
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raws), np.uint8).reshape(len(raws), width)
        last = np.zeros((len(raws), width), np.int32)
        state = np.zeros(len(raws), np.int64)
        for at in range(width):
            n = int(np.searchsorted(-size, -at))  # those that have this byte
            state = self.moves[(state[:n] << 8) | raw[:n, at]].astype(np.int64)
            first, length, token = self._ends()
            begin = first[state]
            count = first[state + 1] - begin
            own = np.repeat(np.arange(n), count)
            end = np.arange(len(own)) + np.repeat(begin - np.cumsum(count) + count, count)
            before = at - length[end]
            ok = before < 0  # the whole prefix
            rest = np.flatnonzero(~ok)
            pair = (last[own[rest], before[rest]].astype(np.int64) << 32) | token[end[rest]]
            ok[rest] = self.pairs[pair]
            last[:n, at] = token[begin]
            last[own[ok], at] = token[end[ok]]  # of several the shortest, which comes last
        ids = np.zeros((len(raws), width), np.int32)
        start, place, open_ = np.full(len(raws), width), size - 1, np.arange(len(raws))
        while len(open_):
            t = last[open_, place[open_]]
            start[open_] -= 1
            ids[open_, start[open_]] = t
            place[open_] -= self.lengths[t]
            open_ = open_[place[open_] >= 0]
        packed = ids.tobytes()
        return [packed[4 * (k * width + a) : 4 * (k + 1) * width] for k, a in enumerate(start.tolist())]

    def _learn(self, words: dict[str, list[str]]) -> dict[str, bytes]:
        """The ids of words, each given by its pre-tokens."""
        own = {p for x in words.values() for p in x}
        made = self.pieces.known(own)
        several = []
        for p in own - made.keys():
            raw = p.encode("utf-8", "replace")
            t = self.ids.get(raw)
            if t is not None:
                made[p] = np.int32(t).tobytes()
            elif len(raw) > CACHE_BYTES:
                made[p] = np.array(self.piece(raw), dtype=np.int32).tobytes()
            else:
                several.append((p, raw))
                continue
            if len(p) <= CACHE_BYTES:
                self.pieces.put(p, made[p])
        for (p, _), ids in zip(several, self.short([raw for _, raw in several]), strict=True):
            made[p] = ids
            self.pieces.put(p, ids)
        return {w: b"".join([made[p] for p in x]) for w, x in words.items()}

    def _known(self, cache: Recent, words: set[str], before: str) -> dict[str, bytes]:
        """The ids of all the words, with ``before`` in front of each; short ones are kept for later texts."""
        found = cache.known(words)
        new = self._learn({w: pieces(before + w) for w in words - found.keys()})
        for w, ids in new.items():
            if len(w) <= CACHE_BYTES:
                cache.put(w, ids)
        return found | new

    def _parts(self, text: str | None) -> list[str]:
        """The text cut at special tokens, which are parts of their own; no part is empty."""
        if not text:
            return []
        if self.split_special and any(s in text for s in self.special):
            return [x for x in self.split_special.split(text) if x]
        return [text]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, as consecutive 32-bit integers; null counts as empty."""
        leading, spaced = set(), set()
        for text in texts:
            for part in self._parts(text):
                if part in self.special:
                    continue
                if plain(part):
                    for line in part.split("\n"):
                        words = line.split(" ")
                        leading.add(words[0])
                        spaced.update(words[1:])
                else:
                    leading.update(WORDS.findall(part))
        first, more = self._known(self.leading, leading, ""), self._known(self.spaced, spaced, " ")
        return [b"".join([self._ids(part, first, more) for part in self._parts(text)]) for text in texts]

    def _ids(self, part: str, leading: dict[str, bytes], spaced: dict[str, bytes]) -> bytes:
        k = self.special.get(part)
        if k is not None:
            return np.int32(k).tobytes()
        if not plain(part):
            return b"".join(map(leading.__getitem__, WORDS.findall(part)))
        out = []
        for line in part.split("\n"):
            words = line.split(" ")
            out += (self.line_break, leading[words[0]], *map(spaced.__getitem__, words[1:]))
        return b"".join(out[1:])

    def encode(self, text: str) -> bytes:
        """The ids of one whole text."""
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes]) -> list[str]:
        """The texts of ids that ``encode_all`` gave."""
        bytes_ = self.table.take(pa.array(np.frombuffer(b"".join(packed), np.int32)))
        ends = np.frombuffer(bytes_.buffers()[1], np.int64)[np.cumsum([0, *(len(p) // 4 for p in packed)])].tolist()
        data = bytes_.buffers()[2] or b""
        return [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary give nothing."""
        n, token = len(self.token), self.token
        return b"".join([token[i] for i in ids if 0 <= i < n]).decode("utf-8", "replace")


def codec(source: bytes) -> Codec:
    """The vocabulary's tables, made once in each Python worker and kept until it serves another operator."""
    return held(("bpe", source), lambda: Codec(source))


class Tokenizer:
    """Column functions of one vocabulary file.

    The driver reads the file; its bytes (1.5 MB for 50,000 entries, whatever the data's size) go to the executors as
    a broadcast, so they need no copy of the file.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self.source = spark.sparkContext.broadcast(f.read())
        source = self.source

        def lists(packed: list[bytes]) -> pa.Array:
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            if packed:
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32), type=pa.int32())
            return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), ids)

        def encode(texts: list[str | None]) -> pa.Array:
            return lists(codec(source.value).encode_all(texts))

        def both(texts: list[str | None]) -> pa.Array:
            c = codec(source.value)
            packed = c.encode_all(texts)
            back = pa.array(c.decode_all(packed), type=pa.string())
            return pa.StructArray.from_arrays([lists(packed), back], ["ids", "decoded"])

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            c = codec(source.value)
            for lists in batches:
                ids, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                out = (c.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(ends[:-1], ends[1:], strict=True))
                yield pa.array(out, type=pa.string())

        self._encode = text_function(T.ArrayType(T.IntegerType()), encode, holds=True)
        pair = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
        self._both = text_function(T.StructType(pair), both, holds=True)
        self._decode = F.arrow_udf(decode, T.StringType())

    def encode(self, text: Column) -> Column:
        """array<int> of a text's ids: those that merging gives. Null and the empty text give an empty array."""
        return self._encode(text)

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids (none of them null). A null and an empty array give the empty text."""
        return self._decode(ids)

    def round_trip(self, text: Column) -> Column:
        """struct<ids, decoded>: ``encode`` and ``decode`` of its ids in one Python worker, which takes half the memory of
        the two in a row."""
        return self._both(text)


def with_tokens(docs: DataFrame, tokenizer: Tokenizer, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """The documents with their ids in a new column (one of that name is replaced). Map-only: no shuffle."""
    return docs.withColumn(ids, tokenizer.encode(F.col(text)))


def digests(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document.

    Null text counts as empty: 0 tokens and the hash of no bytes. Repeated rows each give a row.
    """
    back = docs.select("doc_id", tokenizer.round_trip(F.col("text")).alias("r")).select("doc_id", "r.ids", "r.decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
