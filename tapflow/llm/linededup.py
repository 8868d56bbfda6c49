"""Removal of multi-line passages that repeat across the corpus.

Lines are hashed, and boundaries are chosen by content: a window of more than
``min_words`` words (the shortest run of lines from a line, forwards, and to a
line, backwards) rolls over the line hashes, and the line with the least hash
in it is a boundary. The choice depends on the lines of the window alone, so
inserted or deleted lines shift no boundary beyond the window. The windows that
chose a boundary are the chunks around it; a polynomial over the line hashes
gives the digest of each.

Boundaries decide: the corpus counts its boundary lines, and only chunks whose
boundary line is one at several places are compared at all. None is lost by
that, since equal chunks have their least hash in the same line. Every line of
a repeated passage of more than ``min_words`` words lies in a chunk inside the
passage, so no such passage is missed; shorter ones stay.

A chunk that occurs more than once is kept at its first place (smallest id,
then position) and its lines are removed elsewhere, after the bytes of all
its places have been compared; if they differ under one digest, it stays. The
first place of a line is never removed, since an earlier place would have to
hold the same line.

Hashes and digests, not texts, are shuffled to find repeats, with map-side
combining. The texts of repeated chunks alone are compared.

Defined results: a null text stays null, with no lines; texts of up to
``min_words`` words have no chunk; a very long text gives at most two chunks a
line; rows equal in id and text are one document and share its result; null
ids come last in the order; an empty table gives no rows; other columns are
carried along unread, whatever their names.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.llm.text import free_name, text_slices
from tapflow.operators.common import cut_lineage

MIN_WORDS = 50  # a passage has more words than this
BASE, PRIME = 0x9E3779B97F4A7C15F39CC0605CEDC835 % (2 ** 127 - 1), 2 ** 127 - 1
NO_HASH = 1 << 128  # above every line hash: lines without words are no boundaries
# Tables of boundaries and of line places are broadcast up to this size (rows
# and places times their bytes in memory); above it they are shuffled.
BROADCAST_BYTES = 96 << 20
BOUNDARY_BYTES, ROW_BYTES, PLACE_BYTES, SPAN_BYTES = 48, 80, 56, 32


def windows(counts: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs of more than ``min_words`` words from each line with
    words, forwards and backwards, in order; starts and ends never decrease."""
    sums = [0]
    for c in counts:
        sums.append(sums[-1] + c)
    n, runs, j = len(counts), set(), 0
    for i in range(n):
        while j < n and sums[j] - sums[i] <= min_words:
            j += 1
        if sums[j] - sums[i] <= min_words:
            break
        if counts[i]:
            runs.add((i, j))
    i = 0
    for j in range(1, n + 1):
        while sums[j] - sums[i + 1] > min_words:
            i += 1
        if sums[j] - sums[i] > min_words and counts[j - 1]:
            runs.add((i, j))
    return sorted(runs)


def boundaries(hashes: list[int], runs: list[tuple[int, int]]) -> Iterator[int]:
    """The line of least hash (the first of equal ones) in each window."""
    least, k = deque(), 0
    for a, b in runs:
        for k in range(k, b):
            while least and hashes[least[-1]] > hashes[k]:
                least.pop()
            least.append(k)
        k = b
        while least[0] < a:
            least.popleft()
        yield least[0]


def chunks(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """(start line, end line, digest, boundary line, its hash in 63 bits)."""
    import xxhash
    lines = text.encode("utf-8").split(b"\n")
    counts = [len(line.split()) for line in lines]
    if sum(counts) <= min_words:
        return []
    hashes = [xxhash.xxh3_128_intdigest(x) for x in lines]
    prefix, power = [0], [1]
    for h in hashes:
        prefix.append((prefix[-1] * BASE + h) % PRIME)
        power.append(power[-1] * BASE % PRIME)
    runs = windows(counts, min_words)
    order = [h if c else NO_HASH for h, c in zip(hashes, counts)]
    return [(a, b, (prefix[b] - prefix[a] * power[b - a]) % PRIME, at, hashes[at] >> 65)
            for (a, b), at in zip(runs, boundaries(order, runs))]


def document_key(id_col: Column, text_col: Column) -> Column:
    """128 bits that tell documents apart by id and text."""
    ident = F.when(id_col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), id_col.cast("string")))
    whole = F.concat(ident, F.lit("\n"), F.coalesce(text_col.cast("string"), F.lit("")))
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def _places(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(h, b, lead, id, doc, start, stop) of all chunks: digest, hash of the
    boundary line, whether no earlier chunk of the document has this line as
    its boundary, and the place."""
    schema = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("b", T.LongType()),
                           T.StructField("lead", T.BooleanType()),
                           T.StructField("id", df.schema[id_col].dataType), T.StructField("doc", T.BinaryType()),
                           T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2):
                rows, found, lead = [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    last = -1  # boundaries of a document never go back
                    for chunk in chunks(text, min_words) if text else []:
                        rows.append(k)
                        found.append(chunk)
                        lead.append(chunk[3] != last)
                        last = chunk[3]
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[2].to_bytes(16, "big") for x in found], pa.binary()),
                     pa.array([x[4] for x in found], pa.int64()), pa.array(lead, pa.bool_()),
                     part.column(0).take(rows), part.column(1).take(rows),
                     pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32())],
                    ["h", "b", "lead", "id", "doc", "start", "stop"])

    return df.select(F.col(id_col), document_key(F.col(id_col), F.col(text_col)),
                     F.col(text_col).cast("string")).mapInArrow(run, schema)


def _around_repeated_boundaries(places: DataFrame) -> DataFrame:
    """The chunks whose boundary line is a boundary at several places."""
    lines = cut_lineage(places.filter("lead").groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                        .select(F.col("b").alias("rb")))
    if BOUNDARY_BYTES * lines.count() <= BROADCAST_BYTES:
        lines = F.broadcast(lines)
    return cut_lineage(places.join(lines, F.col("b") == F.col("rb"), "left_semi")
                       .select("h", "id", "doc", "start", "stop"))


def _by_document(places: DataFrame, fields: tuple[str, ...], each: int) -> DataFrame:
    """``fields`` of the places gathered for each document (at most twice as
    many as it has lines), marked for broadcast if the table is small."""
    lists = cut_lineage(places.groupBy("doc").agg(F.collect_set(F.struct(*fields)).alias("places")))
    size = lists.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("places")).alias("p")).first()
    small = ROW_BYTES * size["n"] + each * (size["p"] or 0) <= BROADCAST_BYTES
    return F.broadcast(lists) if small else lists


def repeated_places(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, h, start, stop) of the places to remove: documents by key, lines
    from ``start`` to before ``stop``."""
    places = _around_repeated_boundaries(cut_lineage(_places(df, id_col, text_col, min_words)))
    place = F.struct(F.col("id").isNull().alias("x"), "id", "doc", "start")
    repeated = cut_lineage(places.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                           .filter("first <> last")
                           .select(F.col("h").alias("rh"), F.col("first.doc").alias("first_doc"),
                                   F.col("first.start").alias("first_start")))
    found = cut_lineage(places.join(repeated, F.col("h") == F.col("rh"))
                        .select("h", "doc", "start", "stop",
                                ((F.col("doc") == F.col("first_doc"))
                                 & (F.col("start") == F.col("first_start"))).alias("is_first")))

    # Bytes of every place of the repeated chunks.
    keyed = df.select(document_key(F.col(id_col), F.col(text_col)).alias("doc"),
                      F.col(text_col).cast("string").alias("text"))

    def slices(batches):
        for batch in batches:
            for part in text_slices(batch, 0):
                h, out = [], []
                for text, places in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lines = text.split("\n")
                    for p in places:
                        h.append(p["h"])
                        out.append("\n".join(lines[p["start"]:p["stop"]]))
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(out, pa.string())], ["h", "t"])

    texts = keyed.join(_by_document(found, ("h", "start", "stop"), PLACE_BYTES), "doc").select("text", "places").mapInArrow(slices, "h binary, t string")
    same = cut_lineage(texts.groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b"))
                       .filter("a = b").select(F.col("h").alias("same_h")))
    return found.filter("not is_first").join(same, F.col("h") == F.col("same_h"), "left_semi") \
        .select("doc", "h", "start", "stop")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                counts: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the repeated passages taken out of ``text_col``; ``counts``
    names two further columns for the lines before and the lines removed."""
    at, name, key = df.columns.index(text_col), free_name(df, "places"), free_name(df, "places_doc")
    marks = _by_document(repeated_places(df, id_col, text_col, min_words), ("start", "stop"), SPAN_BYTES).select(
        F.col("doc").alias(key), F.col("places").alias(name))
    joined = (df.join(marks, document_key(F.col(id_col), F.col(text_col)) == F.col(key), "left")
              .drop(key))
    fields = [*df.schema.fields, *(T.StructField(c, T.LongType()) for c in counts or ())]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, at):
                texts, before, gone = [], [], []
                for text, places in zip(part.column(at).to_pylist(), part.column(-1).to_pylist()):
                    lines = [] if text is None else text.split("\n")
                    before.append(len(lines))
                    if not places:
                        texts.append(text)
                        gone.append(0)
                        continue
                    keep = np.ones(len(lines), bool)
                    for p in places:
                        keep[p["start"]:p["stop"]] = False
                    texts.append("\n".join([x for x, k in zip(lines, keep.tolist()) if k]))
                    gone.append(len(lines) - int(keep.sum()))
                cols = [*part.columns[:-1]]
                cols[at] = pa.array(texts, cols[at].type)
                if counts:
                    cols += [pa.array(before, pa.int64()), pa.array(gone, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    return joined.mapInArrow(run, T.StructType(fields))
