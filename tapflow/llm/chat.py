"""Chat formatting with minimum-cost role repair.

Legal conversations are: an optional system turn, then user and assistant
turns in alternation, the user first and an assistant last. Dynamic
programming over this automaton repairs a sequence of turns at the least cost:
a turn may be relabelled (cost 3), merged into the turn before it (cost 1), or
empty turns may be inserted (cost 2 each). A turn whose role is none of the
three has to be relabelled. Among repairs of equal cost the one is taken
whose first differing turn comes earlier in the list keep, merge, insert,
relabel, so the result does not depend on how rows are dealt to tasks.

The result has one row for each turn and each inserted one, so a conversation
of any length stays spread over tasks: rows are range-partitioned by
conversation and turn, and where a conversation crosses partitions, each piece
is summed up as a 4 x 4 cost matrix (costs of passing from state to state).
Only these matrices of the first and last piece of each partition reach the
driver, which hands back the cost to go after a piece and its entry state.

Defined results: turns are ordered by turn (nulls last), then role and text;
repeated rows are turns of their own; a null text is empty; a null id is a
conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapflow.operators.common import ensure_checkpoint_dir

MERGE, INSERT, RELABEL = 1, 2, 3
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)  # states: what the last turn was
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
FAR = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _options() -> list[list[list[tuple]]]:
    """For each state and role (1 to 3, 0 for others): the ways to consume a
    turn as (cost, next state, inserted states, action), preferred first."""
    table = []
    for p in range(4):
        row = []
        for r in range(4):
            ways = [(0 if q == r else RELABEL, q, (), "keep" if q == r else "relabel") for q in LEGAL[p]]
            if p != START:
                ways.append((MERGE + (0 if p == r else RELABEL), p, (), "merge"))
            for a in LEGAL[p]:
                ways += [(INSERT + (0 if q == r else RELABEL), q, (a,), "insert") for q in LEGAL[a]]
                for b in LEGAL[a]:
                    ways += [(2 * INSERT + (0 if q == r else RELABEL), q, (a, b), "insert") for q in LEGAL[b]]
            order = ("keep", "merge", "insert", "relabel")
            row.append(sorted(ways, key=lambda w: (order.index(w[3]), w[0], w[1], w[2])))
        table.append(row)
    return table


OPTIONS = _options()
CLOSING = [(0, ()), (2 * INSERT, (USER, ASSISTANT)), (INSERT, (ASSISTANT,)), (0, ())]  # to end after an assistant
MATRIX = [[[min([w[0] for w in OPTIONS[p][r] if w[1] == q], default=FAR) for q in range(4)] for p in range(4)]
          for r in range(4)]


def role_code(role: str | None) -> int:
    return ROLES.index(role) + 1 if role in ROLES else 0


def times(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Costs of two stretches one after the other."""
    return [[min(a[p][k] + b[k][q] for k in range(4)) for q in range(4)] for p in range(4)]


def stretch(roles: list[int]) -> list[list[int]]:
    """Cost matrix of a run of turns."""
    out = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for r in roles:
        out = times(out, MATRIX[r])
    return out


def costs_to_go(roles: list[int], after: list[int]) -> list[list[int]]:
    """For each turn, the least cost from each state after it to the end;
    ``after`` is that of the last one."""
    out = [after]
    for r in reversed(roles[1:]):
        nxt = out[-1]
        out.append([min(MATRIX[r][p][q] + nxt[q] for q in range(4)) for p in range(4)])
    return out[::-1]


def walk(roles: list[int], state: int, to_go: list[list[int]]):
    """The chosen way of each turn, from the entry state."""
    for r, rest in zip(roles, to_go):
        ways = OPTIONS[state][r]
        best = min(w[0] + rest[w[1]] for w in ways)
        way = next(w for w in ways if w[0] + rest[w[1]] == best)
        yield way
        state = way[1]


def repair(roles: list[str | None]) -> list[tuple]:
    """Repaired sequence of a whole conversation: (index of the turn or None,
    role, action, cost)."""
    codes, out = [role_code(r) for r in roles], []
    if not codes:
        return out
    state = START
    for i, (cost, state, inserted, action) in enumerate(
            walk(codes, START, costs_to_go(codes, [c for c, _ in CLOSING]))):
        out += [(None, ROLES[s - 1], "insert", INSERT) for s in inserted]
        if action == "insert":
            action = "keep" if state == codes[i] else "relabel"
        out.append((i, ROLES[state - 1], action, cost - INSERT * len(inserted)))
    return out + [(None, ROLES[s - 1], "insert", INSERT) for s in CLOSING[state][1]]


def rendered(text: str, role: str, merged: bool, first: bool) -> str:
    """One part of the formatted conversation. The mark that ends a turn
    stands before the next one, or after the last part; marks inside a text
    are broken up by a space."""
    text = text.replace(OPEN, "<| im_start|>").replace(CLOSE, "<| im_end|>")
    if merged:
        return "\n" + text
    return ("" if first else CLOSE + "\n") + f"{OPEN}{role}\n{text}"


def _pieces(batches):
    """(which, key, rows) of a partition's runs of equal conversations;
    ``which`` is 'first', 'last' or None for runs that cannot cross a border."""
    rows = [r for b in batches for r in b.to_pylist()]
    runs = [(k, list(g)) for k, g in groupby(rows, key=lambda r: r["key"])]
    for i, (key, run) in enumerate(runs):
        yield ("first" if i == 0 else "last" if i == len(runs) - 1 else None), key, run


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """(conv, part, turn, source_role, role, action, cost, rendered): the
    repaired conversations, one row for each part in order from 0. Joined in
    that order, ``rendered`` is the formatted conversation; ``action`` is
    keep, merge, relabel or insert (turn and source_role null)."""
    ensure_checkpoint_dir(df.sparkSession)
    conv = F.col(conv_col)
    turns = df.select(
        conv.alias("conv"), F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"),
        F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("source_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The row number only lets equal rows be dealt to several partitions.
    order = ["key", F.col("turn").asc_nulls_last(), F.col("source_role"), F.xxhash64("text"), F.col("text")]
    turns = (turns.withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange(*order[:4], "row").sortWithinPartitions(*order, "row").drop("row")
             .checkpoint())

    entries = _enter(turns)
    schema = T.StructType([
        T.StructField(conv_col, df.schema[conv_col].dataType), T.StructField("part", T.LongType()),
        T.StructField("turn", df.schema[turn_col].dataType), T.StructField("source_role", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("action", T.StringType()),
        T.StructField("cost", T.LongType()), T.StructField("rendered", T.StringType())])

    def run(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        for which, _, rows in _pieces(batches):
            state, part, after, last = entries.get((pid, which), (START, 0, [c for c, _ in CLOSING], True))
            codes, out = [role_code(r["source_role"]) for r in rows], []
            conv_id = rows[0]["conv"]

            def put(row, to, action, cost, text, merged=False):
                out.append((conv_id, part + len(out), row and row["turn"], row and row["source_role"], to, action, cost,
                            rendered(text, to, merged, part + len(out) == 0)))

            for row, code, (cost, state, inserted, action) in zip(rows, codes,
                                                                 walk(codes, state, costs_to_go(codes, after))):
                for s in inserted:
                    put(None, ROLES[s - 1], "insert", INSERT, "")
                if action == "insert":
                    action = "keep" if state == code else "relabel"
                put(row, ROLES[state - 1], action, cost - INSERT * len(inserted), row["text"], action == "merge")
            if last:
                for s in CLOSING[state][1]:
                    put(None, ROLES[s - 1], "insert", INSERT, "")
                out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE + "\n")
            yield from _batches(out, schema)

    return turns.mapInArrow(run, schema)


def _batches(rows: list[tuple], schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema
    target = to_arrow_schema(schema)
    for at in range(0, len(rows), 5000):
        cols = zip(*rows[at:at + 5000])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, target)], schema=target)


def _enter(turns: DataFrame) -> dict[tuple[int, str], tuple]:
    """(entry state, parts before, cost to go after, whether it ends the
    conversation) of the pieces of conversations that cross partitions."""
    slim = turns.select("key", "source_role")

    def outer(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        found = [(pid, which, key, sum(stretch([role_code(r["source_role"]) for r in rows]), []))
                 for which, key, rows in _pieces(batches) if which]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)],
                                             ["pid", "which", "key", "costs"])

    pieces = sorted(((r["pid"], r["which"], r["key"], r["costs"]) for r in slim.mapInArrow(
        outer, "pid long, which string, key string, costs array<long>").collect()))
    # 'first' sorts before 'last', so pieces of one conversation are neighbours.
    chains = [c for c in (list(g) for _, g in groupby(pieces, key=lambda p: p[2])) if len(c) > 1]
    after = {}
    for chain in chains:
        rest = [c for c, _ in CLOSING]
        for pid, which, _, flat in reversed(chain):
            after[pid, which] = rest
            rest = [min(flat[4 * p + q] + rest[q] for q in range(4)) for p in range(4)]
    if not after:
        return {}

    def exits(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        found = []
        for which, _, rows in _pieces(batches):
            if (pid, which) not in after:
                continue
            codes = [role_code(r["source_role"]) for r in rows]
            to_go, states, parts = costs_to_go(codes, after[pid, which]), [], []
            for p in range(4):
                n, q = 0, p
                for _, q, inserted, _ in walk(codes, p, to_go):
                    n += 1 + len(inserted)
                states.append(q)
                parts.append(n)
            found.append((pid, which, states, parts))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*found)],
                                             ["pid", "which", "states", "parts"])

    ends = {(r["pid"], r["which"]): (r["states"], r["parts"]) for r in slim.mapInArrow(
        exits, "pid long, which string, states array<long>, parts array<long>").collect()}
    entries = {}
    for chain in chains:
        state, part = START, 0
        for i, (pid, which, *_) in enumerate(chain):
            entries[pid, which] = (state, part, after[pid, which], i == len(chain) - 1)
            states, parts = ends[pid, which]
            state, part = states[state], part + parts[state]
    return entries
