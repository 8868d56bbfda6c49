"""Token counts of texts, with whole tokens counted by look-up.

Offline, on the driver, every string of the vocabulary is encoded by the merge
rules alone. Those that come out as one token are proven: a piece of a text
that equals such a string is one token, whatever stands around it, because
pieces are encoded apart. Counting then takes a set look-up for nearly every
piece, and only the other pieces are merged. Merging counts the parts that are
left and makes no ids.

Pieces of a few bytes are merged by looking through the ranks of all their
neighbours, longer ones from a heap of (rank, place), so that a piece of n bytes
takes n log n steps, however long it is; both make the same joins. Counts of merged pieces are remembered up to a bound; the memory saves
work and changes no result.

Defined results: a null or empty text has 0 bytes and 0 tokens; strings of
special tokens inside a text are one token each, as the tokenizers library
takes them by default; texts of any length are counted whole; every row has
its own result, repeated rows and null ids included; an empty table gives no
rows; columns other than the id and the text are not read, so their names
never clash.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tapflow.llm.bpe import byte_alphabet, newer_characters, splitter
from tapflow.llm.text import map_texts

LIMIT = 512  # texts with more tokens are over the limit
REMEMBERED = 400_000  # merged pieces a Python worker remembers, dropped together when full
SHORT = 64  # pieces of up to so many bytes are merged by looking through their ranks
NEVER = 1 << 60


class Merges:
    """The merge rules over numbers: a byte is its value, and the token that
    rule r makes is 256 + r."""

    def __init__(self, rules: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(rules):
            # a token that two rules make is one token, whichever made it
            made = number.setdefault(a + b, 256 + r)
            self.rank[number[a] << 32 | number[b]] = r
            if made != 256 + r:
                raise ValueError(f"two rules make the token {a + b!r}")

    def count(self, piece: bytes) -> int:
        """Tokens of a piece: of the neighbours that may be joined, those of
        the lowest rank are, leftmost first."""
        return self.count_short(piece) if len(piece) <= SHORT else self.count_long(piece)

    def count_short(self, piece: bytes) -> int:
        """Looks through the ranks of all neighbours for each join."""
        get = self.rank.get
        parts = list(piece)
        ranks = [get(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NEVER:
                break
            i = ranks.index(rank)
            parts[i] = 256 + rank
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], NEVER)
        return len(parts)

    def count_long(self, piece: bytes) -> int:
        """The same joins from a heap of (rank, place), with links between
        neighbours: n log n steps for n bytes."""
        get, parts, n = self.rank.get, list(piece), len(piece)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << 32 | b)) is not None]
        heapify(heap)
        count = n
        while heap:
            rank, i = heappop(heap)
            j = right[i]
            # a part that was joined away is -1; a grown part has another rank here
            if parts[i] < 0 or j >= n or get(parts[i] << 32 | parts[j]) != rank:
                continue
            parts[i], parts[j] = 256 + rank, -1
            count -= 1
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                if (r := get(parts[i] << 32 | parts[after])) is not None:
                    heappush(heap, (r, i))
            before = left[i]
            if before >= 0 and (r := get(parts[before] << 32 | parts[i])) is not None:
                heappush(heap, (r, before))
        return count


def prove_vocabulary(path: str) -> dict:
    """What counting needs of a byte-level BPE file in the tokenizers
    library's JSON format: ``alone``, the vocabulary strings proven to encode
    as one token, the merge rules, and the special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: added tokens with options")
    byte = byte_alphabet()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = Merges([tuple(bytes(byte[c] for c in side) for side in pair) for pair in pairs])
    special = [t["content"] for t in spec["added_tokens"]]
    alone = set()
    for token in spec["model"]["vocab"].keys() - set(special):
        raw = bytes(byte[c] for c in token)
        if merges.count(raw) == 1:
            try:
                alone.add(raw.decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: no piece of a text equals it
                pass
    return {"alone": frozenset(alone), "merges": merges, "special": special, "newer": newer_characters()}


def piece_counter(proven: dict) -> Callable[[str], int]:
    """The function from a text to its number of tokens."""
    import regex
    words = splitter(proven["newer"])
    alone, merge, special = proven["alone"], proven["merges"].count, proven["special"]
    cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    known: dict[str, int] = {}

    def count(text: str) -> int:
        if cut is not None and (found := len(cut.findall(text))):
            return found + sum(map(count_plain, cut.split(text)))
        return count_plain(text)

    def count_plain(text: str) -> int:
        pieces = words(text)
        n = len(pieces)
        for piece in pieces:
            if piece not in alone:
                tokens = known.get(piece)
                if tokens is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    tokens = known[piece] = merge(piece.encode("utf-8"))
                n += tokens - 1
        return n

    return count


def count_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. The proof runs once,
    on the driver; its outcome, as large as the vocabulary, is broadcast."""
    proven = df.sparkSession.sparkContext.broadcast(prove_vocabulary(vocabulary))

    def kernel():
        # the broadcast value lives as long as the Python worker, and the memory of merged pieces with it
        if "count" not in proven.value:
            proven.value["count"] = piece_counter(proven.value)
        count = proven.value["count"]

        def run(texts: list[str]) -> list[pa.Array]:
            tokens = pa.array([count(t) for t in texts], pa.int64())
            return [pc.binary_length(pa.array(texts, pa.string())).cast(pa.int64()), tokens, pc.greater(tokens, limit)]

        return run

    return map_texts(df, id_col, text_col, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()),
                                            ("over_limit", T.BooleanType())], kernel)
