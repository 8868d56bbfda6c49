"""Byte-level BPE by prefix-sharing trie traversal.

The last token of the encoding of a prefix is unique, and removing it leaves
the encoding of the shorter prefix. So the encoding of every prefix of a word
is known from one state per position: its last token. The distinct words of a
slice are inserted into a trie, and a depth-first walk propagates these states
along the edges, so a prefix that many words share is encoded once. A word's
ids are read back from its states, and texts are put together from the
encodings of their words.

A token ``t`` that ends a prefix is its last token exactly if ``t`` follows
the last token of the prefix before it without the merges joining the two
differently; that test depends on two tokens only and is remembered.

A null or empty text has no ids and decodes to the empty string. Strings of
special tokens inside a text become their ids, as the tokenizers library does
without ``encode_special_tokens``. Rows are independent.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapflow.llm.text import map_texts

# Fixed value: the split pattern of this kind of vocabulary; {L}, {N} are the
# classes of letters and numbers. Letters, the most frequent case, are tried
# first; no other alternative starts with what they start with.
SPLIT = r" ?[{L}]+| ?[{N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
WORD_CACHE = 400_000  # remembered words of a Python worker; those of the current slice stay when it is full
PAIR_CACHE = 300_000  # remembered token pairs of a Python worker, dropped together when full


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 bytes stand for themselves, the others for the code
    points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Token bytes by id, merge ranks and special tokens of a byte-level BPE
    file in the tokenizers library's JSON format (read on the driver; its
    size is that of the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    byte = byte_alphabet()
    raw = lambda token: bytes(byte[c] for c in token)
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
    special = {}
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token with options: {t['content']}")
        special[t["content"]] = t["id"]
    # A state is a token that its own bytes are encoded as; others never occur.
    whole = {t: i for t, i in vocab.items() if plain_merges(t, ranks) == [t]}
    return {"vocab": whole, "ranks": ranks, "special": special, "newer": newer_characters(),
            "size": 1 + max([*vocab.values(), *special.values()])}


def newer_characters() -> str:
    """Characters that the regex module counts as letters or numbers and the
    tokenizers library does not (its Unicode tables are of another version),
    as the inside of a character class."""
    import regex
    from tokenizers import pre_tokenizers
    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    found = []
    for ch in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))):
        if ord(ch) > 255 and len(split("a" + ch)) > 1 and len(split("1" + ch)) > 1:
            found.append(ord(ch))
    runs = []
    for cp in found:
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def splitter(newer: str):
    """``words(text)``: the words that are encoded apart. Texts within Latin-1
    use the plain classes; others leave out the characters that the library
    does not count as letters or numbers."""
    import regex
    plain = regex.compile(SPLIT.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
    if newer:
        less = lambda c: rf"[\p{{{c}}}--[{newer}]]"
        exact = regex.compile(
            " ?" + less("L") + "+| ?" + less("N") + "+|'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?!" + less("L") + "|" + less("N")
            + r")\S)+|\s+(?!\S)|\s+", regex.V1)
    else:
        exact = plain

    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return exact.findall(text)
        return plain.findall(text)

    return words


def plain_merges(raw: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Plain BPE of a short string: join the lowest-ranked pair, leftmost first."""
    parts = [raw[i:i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, i = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class TrieEncoder:
    """Encodes distinct words; holds the vocabulary and the pair memory.

    Which tokens end at a place is known from an automaton over the vocabulary
    (its state is the longest end of the prefix that some token starts with), so
    no stretch of the word is cut out and looked up. A place of a word costs the
    same in a word of any length."""

    def __init__(self, vocab: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.ranks = ranks
        self.raw = {i: t for t, i in vocab.items()}
        self.size = {i: len(t) for t, i in vocab.items()}
        self.made = {a + b: (r, a, b) for (a, b), r in ranks.items()}
        self.pairs: dict[int, bool] = {}
        self.build(vocab)

    def build(self, vocab: dict[bytes, int]) -> None:
        """States, numbered by growing depth: ``edge`` from state and byte to
        the next state, ``fall`` the state of the longest proper end, ``ends``
        the tokens that end there with their sizes, longest first."""
        self.edge, self.fall, self.ends = {}, [0], [()]
        at = {b"": 0}  # states of the last depth, by prefix
        for depth in range(1, 1 + max(map(len, vocab))):
            tokens = [t for t in vocab if len(t) >= depth]
            before, at = at, {}
            for token in tokens:
                prefix = token[:depth]
                if prefix in at:
                    continue
                parent, byte = before[prefix[:-1]], prefix[-1]
                at[prefix] = state = len(self.fall)
                fall = self.step(self.fall[parent], byte) if depth > 1 else 0
                self.edge[parent << 8 | byte] = state
                self.fall.append(fall)
                own = vocab.get(prefix)
                self.ends.append(self.ends[fall] if own is None else ((own, depth), *self.ends[fall]))

    def step(self, state: int, byte: int) -> int:
        """The state after one more byte."""
        edge = self.edge
        while (after := edge.get(state << 8 | byte)) is None:
            if not state:
                return 0
            state = self.fall[state]
        return after

    def follows(self, first: int, second: int) -> bool:
        """Whether token ``second`` stays whole after ``first``. Undoes the
        merges of both, the later one first, and looks for a pair across the
        border that would have been joined before its sides were used up. Of
        equal ranks the left pair is joined first, hence the two comparisons."""
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        never = (1 << 60, b"", b"")
        left, right, left_used, right_used = self.raw[first], self.raw[second], 1 << 60, 1 << 60
        known = True
        while True:
            rank = self.ranks.get((left, right))
            if rank is not None and rank < left_used and rank <= right_used:
                known = False
                break
            a, b = self.made.get(left, never), self.made.get(right, never)
            if a is never and b is never:
                break
            if b is never or a is not never and a[0] > b[0]:
                left_used, left = a[0], a[2]
            else:
                right_used, right = b[0], b[1]
        self.pairs[first << 32 | second] = known
        return known

    def read_back(self, last: list[int]) -> tuple[int, ...]:
        ids, d, size = [], len(last) - 1, self.size
        while d:
            ids.append(last[d])
            d -= size[last[d]]
        return tuple(reversed(ids))

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words, by one depth-first walk of their trie. The
        trie is held as its depth-first order: the sorted words (code points
        sort as their bytes do), where what a word shares with the one before
        it is the path from the root that is already walked. ``last[d]`` is the
        last token of the path's first ``d`` bytes, ``place[d]`` the state of
        the automaton there."""
        out, last, place, before = {}, [-1], [0], b""
        edge, ends, known_pair = self.edge, self.ends, self.pairs.get
        for word in sorted(words):
            raw = word.encode("utf-8")
            shared = 0
            for x, y in zip(before, raw):
                if x != y:
                    break
                shared += 1
            del last[shared + 1:], place[shared + 1:]
            state = place[shared]
            for n in range(shared, len(raw)):
                byte = raw[n]
                after = edge.get(state << 8 | byte)
                state = self.step(state, byte) if after is None else after
                for token, size in ends[state]:
                    if size > n:  # the whole prefix
                        break
                    first = last[n + 1 - size]
                    ok = known_pair(first << 32 | token)
                    if ok or ok is None and self.follows(first, token):
                        break
                else:
                    raise AssertionError("every byte is a token")
                last.append(token)
                place.append(state)
            out[word] = self.read_back(last)
            before = raw
        return out


class Codec:
    """Texts to ids and back, with a bounded memory of encoded words."""

    def __init__(self, spec: dict):
        import regex
        self.trie = TrieEncoder(spec["vocab"], spec["ranks"])
        self.words = splitter(spec["newer"])
        self.special = spec["special"]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") \
            if self.special else None
        self.bytes = [b""] * spec["size"]
        for token, i in spec["vocab"].items():
            self.bytes[i] = token
        for token, i in self.special.items():
            self.bytes[i] = token.encode("utf-8")
        self.known: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.cut is None or not self.cut.search(text):
            return self.words(text)
        return [w for i, part in enumerate(self.cut.split(text))
                for w in ([part] if i % 2 else self.words(part))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.pieces(t) for t in texts]
        used = set(chain.from_iterable(split))
        new = used.difference(self.known)
        if len(self.known) + len(new) > WORD_CACHE:  # the words of this slice stay
            self.known = {w: self.known[w] for w in used.difference(new)}
        self.known.update(self.trie.encode_words(new.difference(self.special)))
        self.known.update({t: (i,) for t, i in self.special.items()})
        return [list(chain.from_iterable(map(self.known.__getitem__, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True) -> DataFrame:
    """(id, n_tokens, ids, ids_sha256, decoded_sha256) for every row; the ids
    are decoded again and ``decoded_sha256`` is the digest of that text."""
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(load_vocabulary(vocabulary))

    def kernel():
        # The broadcast value lives as long as the Python worker, so later
        # tasks of the worker meet the words of earlier ones.
        if "codec" not in spec.value:
            spec.value["codec"] = Codec(spec.value)
        codec = spec.value["codec"]
        digits = [str(i) for i in range(len(codec.bytes))]

        def run(texts: list[str]) -> list[pa.Array]:
            ids = codec.encode(texts)
            counts = [len(x) for x in ids]
            digests = [hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in ids]
            decoded = [hashlib.sha256(codec.decode(x).encode("utf-8")).hexdigest() for x in ids]
            out = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1]))
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            return out

        return run

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(df, id_col, text_col, fields + [("ids", T.ArrayType(T.IntegerType()))] * with_ids, kernel)
