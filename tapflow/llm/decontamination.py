"""Benchmark decontamination by a broadcast set of normalised n-grams.

Items and documents are lower-cased (A-Z) and cut into words of digits,
letters a-z and non-ASCII characters. A window is ``window`` consecutive item
words; an item of fewer words, but not none, is one window. The distinct
windows are broadcast; every document word position is hashed with the words
after it, the hash is looked up, and hits are verified on the words
themselves. A word inside any occurrence of a window is hit.

The broadcast is bounded: distinct items above ``PASS_BYTES`` of text are dealt
by hash to several passes of at most that size on average (a pass may hold one
large item more), each with its own broadcast, whose hits add up on the rows.

A null text has no words. Items without words have no windows. Items are told
apart by their id as text (a null id is ''); rows that repeat an id add
windows to that item. Repeated documents give equal results, and with no
items nothing is hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.llm.text import strings, text_slices
from tapflow.operators.common import cut_lineage

WINDOW = 13
PASS_BYTES = 2 << 20  # item text whose windows are broadcast at once
SEGMENT_BYTES = 1 << 20  # text hashed at once
FILTER_BITS = 22
# Odd multipliers of the rolling hashes over bytes and over words.
BYTE_BASE, WORD_BASE, MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD

_NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")


class Hasher:
    """Hashes of the words of a lower-cased byte string, vectorised: prefix
    sums of byte x base^position, scaled back by the inverse power."""

    def __init__(self):
        self.word = np.zeros(256, dtype=bool)
        self.word[ord("0"):ord("9") + 1] = self.word[ord("a"):ord("z") + 1] = self.word[128:] = True
        self.powers = self.inverse = np.ones(0, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            up, down = np.full(n, BYTE_BASE, np.uint64), np.full(n, pow(BYTE_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers, self.inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def segment(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of the words of one segment."""
        self.grow(len(raw) + 1)
        buf = np.frombuffer(raw, np.uint8)
        edge = np.diff(np.concatenate([[False], self.word[buf], [False]]).astype(np.int8))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.powers[:len(raw)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
        return h ^ (h >> np.uint64(29)), start, end

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for a string of any length, cut between words."""
        parts, at = [], 0
        while at < len(raw):
            cut = _NOT_WORD.search(raw, at + SEGMENT_BYTES)
            stop = cut.start() if cut else len(raw)
            h, s, e = self.segment(raw[at:stop])
            parts.append((h, s + at, e + at))
            at = stop
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rolling hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(WORD_BASE) + words[k:k + n]
    return out ^ (out >> np.uint64(31))


@dataclass
class Windows:
    """Distinct windows of one size, sorted by hash, with their words and items."""

    size: int
    hashes: np.ndarray
    texts: list[bytes]
    items: list[list[str]]

    def flags(self) -> np.ndarray:
        """Which low hash bits occur: a first filter of document windows."""
        out = np.zeros(1 << FILTER_BITS, bool)
        out[self.hashes & np.uint64((1 << FILTER_BITS) - 1)] = True
        return out


def build_windows(items: list[tuple[str, str]], window: int = WINDOW) -> list[Windows]:
    """Windows by size of the (id, text) items."""
    hasher, by_size = Hasher(), {}
    for item, text in items:
        raw = text.encode("utf-8").lower()
        h, s, e = hasher.words(raw)
        if not len(h):
            continue
        size = min(window, len(h))
        words = [raw[a:b] for a, b in zip(s.tolist(), e.tolist())]
        found = by_size.setdefault(size, {})
        for i, x in enumerate(window_hashes(h, size).tolist()):
            found.setdefault((x, b" ".join(words[i:i + size])), set()).add(item)
    out = []
    for size, found in sorted(by_size.items()):
        keys = sorted(found)
        hashes = np.array([k[0] for k in keys], np.uint64)
        out.append(Windows(size, hashes, [k[1] for k in keys], [sorted(found[k]) for k in keys]))
    return out


class Scanner:
    """Verified hits of a list of texts."""

    def __init__(self, windows: list[Windows]):
        self.windows, self.hasher = [(w, w.flags()) for w in windows], Hasher()

    def scan(self, texts: list[str], spans: list[list[int]], items: list[list[str]]):
        """For each text: its number of words, the hit spans of words (flat
        start, end, ...) and the items; ``spans`` and ``items`` are those of
        earlier passes. Also the byte positions of the words."""
        raws = [t.encode("utf-8").lower() for t in texts]
        raw = b" ".join(raws)
        ends = np.cumsum([len(r) + 1 for r in raws])
        h, start, end = self.hasher.words(raw)
        doc = np.searchsorted(ends, start, side="right")
        first = np.searchsorted(doc, np.arange(len(texts) + 1))
        cover = np.zeros(len(h) + 1, np.int64)
        found: dict[int, set] = {}
        for d, flat in enumerate(spans):
            for a, b in zip(flat[::2], flat[1::2]):
                cover[first[d] + a] += 1
                cover[first[d] + b] -= 1
            if items[d]:
                found[d] = set(items[d])
        for w, flags in self.windows:
            x = window_hashes(h, w.size)
            if not len(x):
                continue
            at = np.flatnonzero(flags[x & np.uint64((1 << FILTER_BITS) - 1)])
            at = at[doc[at] == doc[at + w.size - 1]]
            low = np.searchsorted(w.hashes, x[at], side="left")
            high = np.searchsorted(w.hashes, x[at], side="right")
            for i, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                words = b" ".join([raw[s:e] for s, e in zip(start[i:i + w.size].tolist(),
                                                            end[i:i + w.size].tolist())])
                for k in range(a, b):
                    if w.texts[k] == words:
                        cover[i] += 1
                        cover[i + w.size] -= 1
                        found.setdefault(int(doc[i]), set()).update(w.items[k])
        hit = np.cumsum(cover)[:-1] > 0
        out_spans: list[list[int]] = [[] for _ in texts]
        for d in np.unique(doc[hit]).tolist():
            a, b = first[d], first[d + 1]
            edge = np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8))
            out_spans[d] = np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)]).ravel().tolist()
        counts = np.diff(first)
        return counts, out_spans, [sorted(found.get(d, ())) for d in range(len(texts))], (first, start, end, ends)


def _free_names(df: DataFrame) -> list[str]:
    taken, mark = {c.lower() for c in df.columns}, "ngram"
    while any(f"{mark}_{x}" in taken for x in ("words", "spans", "items")):
        mark += "_"
    return [f"{mark}_words", f"{mark}_spans", f"{mark}_items"]


def benchmark_passes(benchmark: DataFrame, item_col: str, item_text: str, pass_bytes: int) -> Iterator[list[tuple]]:
    """The items of each pass, as (id, text) on the driver."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                             F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    passes = int(max(1, -(-total // pass_bytes)))
    for k in range(passes):
        yield [(r["i"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k).collect()]


def ngram_hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text: str = "text", window: int = WINDOW,
               pass_bytes: int = PASS_BYTES) -> tuple[DataFrame, list[str]]:
    """``df`` with three more columns, and their names: the number of words,
    the hit spans (flat word positions, end exclusive) and the items found."""
    names = _free_names(df)
    empty = F.array().cast("array<long>"), F.array().cast("array<string>")
    out = df.select("*", F.lit(0).cast("long").alias(names[0]), empty[0].alias(names[1]), empty[1].alias(names[2]))
    schema, at = out.schema, df.columns.index(text_col)
    for k, items in enumerate(benchmark_passes(benchmark, item_col, item_text, pass_bytes)):
        windows = df.sparkSession.sparkContext.broadcast(
            [astuple(w) for w in build_windows(items, window)])  # plain values: broadcasts pickle by reference
        if k:
            out = cut_lineage(out)

        def run(batches, windows=windows):
            scanner = Scanner([Windows(*w) for w in windows.value])
            for batch in batches:
                for part in text_slices(batch, at):
                    counts, spans, found, _ = scanner.scan(strings(part.column(at)), part.column(-2).to_pylist(),
                                                           part.column(-1).to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:-3], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())),
                         pa.array(found, pa.list_(pa.string()))], part.schema.names)

        out = out.mapInArrow(run, schema)
    return out, names


def hit_words(spans: str) -> F.Column:
    """Number of words inside flat spans."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                       F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(words: F.Column, hit: F.Column) -> F.Column:
    """At least a twentieth of the words are hit."""
    return (hit > 0) & (20 * hit >= words)


def scan_documents(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   **kw) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, spans, contaminated) for every row."""
    out, (words, spans, items) = ngram_hits(df.select(id_col, text_col), benchmark, text_col, **kw)
    return (out.select(id_col, F.col(words).alias("n_words"), hit_words(spans).alias("n_hit"),
                       F.size(items).cast("long").alias("n_items"), F.array_sort(items).alias("items"),
                       F.col(spans).alias("spans"))
            .withColumn("contaminated", contaminated(F.col("n_words"), F.col("n_hit"))))


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``df`` that are not contaminated, with all their columns."""
    out, (words, spans, _) = ngram_hits(df, benchmark, text_col, **kw)
    return out.filter(~contaminated(F.col(words), hit_words(spans))).drop(words, spans, _)


def remove_spans(df: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """All rows of ``df``; contaminated texts lose the hit words and what
    stands between them."""
    out, names = ngram_hits(df, benchmark, text_col, **kw)
    at, schema = df.columns.index(text_col), df.schema

    def cut(text: str, flat: list[int], hasher: Hasher) -> str:
        raw = text.encode("utf-8")
        n = sum(flat[1::2]) - sum(flat[::2])
        _, s, e = hasher.words(raw.lower())
        if not n or 20 * n < len(s):
            return text
        keep, done = [], 0
        for a, b in zip(flat[::2], flat[1::2]):
            keep.append(raw[done:s[a]])
            done = int(e[b - 1])
        return (b"".join(keep) + raw[done:]).decode("utf-8")

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for part in text_slices(batch, at):
                texts = [t if not f else cut(t, f, hasher)
                         for t, f in zip(part.column(at).to_pylist(), part.column(-2).to_pylist())]
                cols = list(part.columns[:-3])
                cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, part.schema.names[:-3])

    return out.mapInArrow(run, schema)
