"""Quality rules as a short-circuit cascade.

Base statistics are exact counts over the whole text. The rules on top of
them are ordered by rejection per cost, both estimated on a sample: a rule
that rejects many documents for little work runs first, and a document that
one rule rejects is not shown to the later ones. The order changes only the
work: a document is kept exactly if no rule rejects it.

The sample takes different texts of any length by their hash. Each is measured
by the task that reads it; verdicts and seconds alone come to the driver.

A null or empty text has no words, fails the base rules and is not kept. Very
long texts are counted whole. Rows are independent; repeated rows give equal
results. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.llm.text import map_texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HASH_SPAN = 1 << 40  # texts are sampled by their hash modulo this
SAMPLE_ROWS = 2_000  # texts on which costs and selectivities are estimated


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = set(windows)
    if len(seen) == len(windows):
        return 0
    once, twice = set(), set()
    for w in windows:
        (twice if w in once else once).add(w)
    covered, n = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            n += i + 3 - max(covered, i)
            covered = i + 3
    return n


def duplicate_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    worded = [x for x in lines if x.split()]
    return len(worded) - len(set(worded))


def base_stats(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()  # on \\x20 and \\x09-\\x0D
    packed = b"".join(words)
    # Code points are the bytes that do not continue another one.
    chars = len(packed.decode("utf-8"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), chars, symbols, duplicate_lines(raw.split(b"\n")), repeat_words(words)


@dataclass(frozen=True)
class Rule:
    """``rejects(text, stats)`` with the name under which it reports."""

    name: str
    rejects: Any


def _word_length(text, s):
    return not 2 * s[0] <= s[1] <= 14 * s[0]


def _symbols(text, s):
    return 10 * s[2] > s[0]


def _dup_lines(text, s):
    return 10 * s[3] > 3 * (text.count("\n") + 1)


def _repeats(text, s):
    return 5 * s[4] > s[0]


_LETTERS = re.compile(r"[^\W\d_]")


def _few_letters(text, s):
    return 10 * sum(1 for w in text.split() if _LETTERS.search(w)) < 7 * s[0]


def _no_sentences(text, s):
    return s[0] >= 100 and not any(c in text for c in ".!?。؟।")


RULES = (Rule("word_length", _word_length), Rule("symbols", _symbols), Rule("dup_lines", _dup_lines),
         Rule("repeats", _repeats), Rule("few_letters", _few_letters), Rule("no_sentences", _no_sentences))


def base_fails(stats) -> bool:
    return stats[0] < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * stats[0]


Measured = tuple[list[bool], list[float]]


def measure(text: str, rules: tuple[Rule, ...] = RULES) -> Measured | None:
    """What each rule says of a text and the seconds it takes; None for a text
    that fails the base rules, which no rule sees."""
    stats = base_stats(text.encode("utf-8"))
    if base_fails(stats):
        return None
    verdicts, seconds = [], []
    for rule in rules:
        t0 = time.perf_counter()
        verdicts.append(bool(rule.rejects(text, stats)))
        seconds.append(time.perf_counter() - t0)
    return verdicts, seconds


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """``order_measured`` of texts measured here."""
    return order_measured([measure(t, rules) for t in texts], rules)


def order_measured(measured: list[Measured | None], rules: tuple[Rule, ...]) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds a document) by rejection per cost on the
    sample, best first; ties keep the given order. Greedy and conditional:
    share and cost of each next rule are those on what the chosen ones left."""
    rest = [m for m in measured if m is not None]
    left, chosen = list(range(len(rules))), []
    while left:
        n, best = max(1, len(rest)), None
        for i in left:
            share = sum(verdicts[i] for verdicts, _ in rest) / n
            cost = max(sum(seconds[i] for _, seconds in rest) / n, 1e-8)
            if best is None or share / cost > best[1] / best[2]:
                best = (i, share, cost)
        chosen.append((rules[best[0]], *best[1:]))
        left.remove(best[0])
        rest = [m for m in rest if not m[0][best[0]]]
    return chosen


def measured_sample(df: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES,
                    rows: int = SAMPLE_ROWS) -> list[Measured | None]:
    """``measure`` of at most ``rows`` different texts, those with the smallest
    hash. A threshold from the row count leaves about twice as many to measure;
    it and the measuring read texts of any length."""
    total = df.count()
    texts = df.select(F.col(text_col).cast("string").alias("t")).filter("t is not null") \
        .withColumn("k", F.pmod(F.xxhash64("t"), F.lit(HASH_SPAN)))
    if total > 2 * rows:
        texts = texts.filter(F.col("k") < max(1, 2 * rows * HASH_SPAN // total))
    texts = texts.dropDuplicates(["k"])

    def kernel():
        def run(slice_texts: list[str]) -> list[pa.Array]:
            found = [measure(t, rules) or (None, None) for t in slice_texts]
            return [pa.array([v for v, _ in found], pa.list_(pa.bool_())),
                    pa.array([s for _, s in found], pa.list_(pa.float64()))]

        return run

    narrow = map_texts(texts, "k", "t", [("verdicts", T.ArrayType(T.BooleanType())),
                                         ("seconds", T.ArrayType(T.DoubleType()))], kernel)
    return [r["verdicts"] and (r["verdicts"], r["seconds"]) for r in narrow.orderBy("k").limit(rows).collect()]


def quality_cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rejected_by) for every row; ``rejected_by`` is 'base',
    the first rule of the cascade that rejects, or null. Where several rules
    reject a document, which one is named follows the measured order; ``kept``
    does not depend on it."""
    ordered = [r for r, _, _ in order_measured(measured_sample(df, text_col, rules, sample_rows), rules)]

    def kernel():
        def run(texts: list[str]) -> list[pa.Array]:
            stats, failed, by = [], [], []
            for text in texts:
                s = base_stats(text.encode("utf-8"))
                stats.append(s)
                failed.append(base_fails(s))
                by.append("base" if failed[-1] else next((r.name for r in ordered if r.rejects(text, s)), None))
            cols = zip(*stats) if stats else [[]] * 5
            return [*(pa.array(list(c), pa.int64()) for c in cols), pa.array(failed, pa.bool_()),
                    pa.array([x is None for x in by], pa.bool_()), pa.array(by, pa.string())]

        return run

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return map_texts(df, id_col, text_col, [(n, T.LongType()) for n in names]
                     + [("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
                        ("rejected_by", T.StringType())], kernel)
