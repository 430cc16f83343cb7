"""Repair of conversation structure by Hirschberg's divide and conquer (operator 13).

A repaired conversation's roles read ``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  Edits: keep
(0), rerole to user or assistant (3), delete (4; required for blank and repeated rows), insert an empty user or assistant
turn (3); a truncated row that stays adds 3.  Of the cheapest edits, those whose initials (D, I, K, R) are least as text win.

``damaged``  the contract's damage, as Spark expressions.
``repair``   1. Rows are range-partitioned by (conversation, turn), so a conversation of any length is cut into blocks, and
                numbered; a row is a repeat if its (conversation, hash of role and text) has a lower number.
             2. Each block becomes a 4 x 4 transfer: from each state, the cheapest cost to each state and the order of the
                four cheapest audits as text.
             3. A conversation's blocks are cut in the middle again and again: the forward vector of costs of the left and the
                backward vector of the right meet, and of the cheapest crossings the one whose audit is least wins.
             4. Each block does the same within itself (``hirschberg``), down to single rows, with two vectors of four at a time.
             5. Audits and texts stream together, in order, through the hash of the repaired conversation.

States: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant turn; a crossing lies directly after a
row's own edit.  At such a point no audit is the beginning of another (each has one D, K or R a row and ends with one), and
audits that lead to different states differ; so the audit with the lesser left part is the lesser one whatever follows.

Only step 5 sees texts in one place, a row at a time: the hash of one conversation is a chain.  The single audit of a conversation
is one value, as the contract has it.

Defined results: null ids, roles and texts; a null turn comes first and takes no part in ``gaps``; a null id is a conversation of its
own; rows of one turn stand in the order of role and text (both as damaged); a role other than those that begin with s, u or
a can only be reroled or deleted, and so can an empty one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgrec.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NEVER = 1 << 60
NEXT = (2, 2, 3, 2)                 # the state after an inserted or reroled turn
TAIL = ("", "II", "I", "")          # what a state needs to end the conversation
ROLE = {2: "user", 3: "assistant"}
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
SEEN = r"[^\x20\x09-\x0D]"

# A row is one character: its role's initial (s, u, a; x for any other), upper case if truncated, "-" if it must go.


def _moves(row: str) -> list[list[tuple[int, str, int]]]:
    """From each state: (cost, audit, next state) of every useful way to deal with one row."""
    extra, initial = (TRUNCATED if row.isupper() else 0), row.lower()
    out = []
    for state in range(4):
        ways, here = [], state
        for inserted in range(3):
            cost, audit = inserted * INSERT, "I" * inserted
            ways.append((cost + DELETE, audit + "D", here))
            if row != "-":
                ways.append((cost + REROLE + extra, audit + "R", NEXT[here]))
                kept = 1 if initial == "s" and here == 0 else NEXT[here] if initial in ("u", "a") and "ua"[NEXT[here] - 2] == initial else None
                if kept is not None:
                    ways.append((cost + KEEP + extra, audit + "K", kept))
            here = NEXT[here]
        best: dict[int, tuple[int, str]] = {}
        for cost, audit, to in ways:
            best[to] = min(best.get(to, (NEVER, "")), (cost, audit))
        out.append([(*best[to], to) for to in sorted(best)])
    return out


MOVES = {row: _moves(row) for row in "suaxSUAX-"}


def forward(rows: str, costs: tuple[int, ...], ranks: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Cheapest costs of the four states after ``rows``, and the order of their least audits."""
    for row in rows:
        best: list[tuple] = [(NEVER, 4, "")] * 4
        moves = MOVES[row]
        for state in range(4):
            if costs[state] < NEVER:
                for cost, audit, to in moves[state]:
                    best[to] = min(best[to], (costs[state] + cost, ranks[state], audit))
        order = sorted(range(4), key=lambda k: best[k][1:])
        costs = tuple(b[0] for b in best)
        ranks = tuple(order.index(k) for k in range(4))
    return costs, ranks


def backward(rows: str, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Cheapest costs from the four states before ``rows`` to an end that costs ``costs``."""
    for row in reversed(rows):
        costs = tuple(min((cost + costs[to] for cost, _, to in ways), default=NEVER) for ways in MOVES[row])
    return costs


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if k == state else NEVER for k in range(4))


def crossing(left: tuple[int, ...], ranks: tuple[int, ...], right: tuple[int, ...]) -> int:
    """The state of the cheapest way through; of those, the one whose audit so far is least."""
    return min(range(4), key=lambda k: (min(left[k] + right[k], NEVER), ranks[k]))


@functools.lru_cache(maxsize=1 << 16)
def _short(rows: str, start: int, end: int) -> str:
    return _meet(rows, start, end)


def _meet(rows: str, start: int, end: int) -> str:
    if not rows:
        return ""
    if len(rows) == 1:
        return next(audit for _, audit, to in MOVES[rows][start] if to == end)
    middle = len(rows) // 2
    state = crossing(*forward(rows[:middle], _only(start), (0, 0, 0, 0)), backward(rows[middle:], _only(end)))
    return hirschberg(rows[:middle], start, state) + hirschberg(rows[middle:], state, end)


def hirschberg(rows: str, start: int, end: int) -> str:
    """The least of the cheapest audits of ``rows`` from one state to another."""
    return (_short if len(rows) <= 32 else _meet)(rows, start, end)


def transfer(rows: str) -> tuple[list[int], list[int]]:
    """Costs and audit orders from each state (4 x 4 each, row by row)."""
    both = [forward(rows, _only(state), (0, 0, 0, 0)) for state in range(4)]
    return [c for costs, _ in both for c in costs], [r for _, ranks in both for r in ranks]


def through(blocks: list[tuple[list[int], list[int]]]) -> tuple[list[int], int]:
    """The states before each block and after the last one, and the cost, of the least cheapest way through all blocks."""
    def ahead(lo: int, hi: int, start: int):
        costs, ranks = _only(start), (0, 0, 0, 0)
        for c, r in blocks[lo:hi]:
            best = [min((costs[s] + c[4 * s + to], ranks[s], r[4 * s + to]) for s in range(4)) for to in range(4)]
            order = sorted(range(4), key=lambda k: best[k][1:])
            costs, ranks = tuple(min(b[0], NEVER) for b in best), tuple(order.index(k) for k in range(4))
        return costs, ranks

    def back(lo: int, hi: int, costs: tuple[int, ...]):
        for c, _ in reversed(blocks[lo:hi]):
            costs = tuple(min(min(c[4 * s + to] + costs[to] for to in range(4)), NEVER) for s in range(4))
        return costs

    def between(lo: int, hi: int, start: int, end: int) -> list[int]:
        if hi - lo <= 1:
            return [start] * (hi - lo)
        middle = (lo + hi) // 2
        state = crossing(*ahead(lo, middle, start), back(middle, hi, _only(end)))
        return between(lo, middle, start, state) + between(middle, hi, state, end)

    tail = tuple(INSERT * len(t) for t in TAIL)
    costs, ranks = ahead(0, len(blocks), 0)
    end = crossing(costs, ranks, tail)
    return [*between(0, len(blocks), 0, end), end], costs[end] + tail[end]


# --- damage -------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` after the contract's damage; nulls in role and text become one space."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"),
        F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


# --- repair -------------------------------------------------------------------------------------------------

def _numbered(rows: DataFrame) -> DataFrame:
    """Rows in order, written with a number ``at`` that rises with it; ``block``: the part of the range that has the row."""
    order = ["conv_id", "turn", "role", "text", "salt"]
    salted = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("salt"))  # equal rows can be cut apart
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = salted.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(ordered.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"),
                                  F.spark_partition_id().alias("block")), "turns")


def repair(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``ids``: gaps, faults, cost, audit and hash of the repaired ``rows``."""
    turns = _numbered(rows)
    said = F.concat("role", F.lit("\n"), "text")  # no two pairs of role and text share it unless a role has a line break
    code = turns.select(
        "conv_id", "turn", "at", "block", F.xxhash64("role", "text").alias("h"), F.xxhash64(F.lit(1), "role", said).alias("g"),
        F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(SEEN)).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    first = code.groupBy("conv_id", "h", "g").agg(F.min("at").alias("first_at"))
    c, f = code.alias("c"), first.alias("f")
    marked = c.join(f, F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("c.h") == F.col("f.h")) & (F.col("c.g") == F.col("f.g"))).select(
        "c.*", (F.col("at") > F.col("first_at")).alias("again"))
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    blank, again = F.col("blank"), F.col("again")
    letter = F.when(blank | again, "-").when(F.col("open"), F.upper(initial)).otherwise(initial)

    def count(which):
        return F.sum(which.cast("bigint"))

    blocks = written(marked.groupBy("conv_id", "block").agg(  # at most the rows of one part of the range
        F.sort_array(F.collect_list(F.struct("at", letter.alias("letter"), initial.alias("initial")))).alias("rows"),
        F.min("at").alias("at"), count(blank).alias("blank"), count(~blank & again).alias("duplicate"),
        count(~blank & ~again & F.col("open")).alias("truncated")).select(
        "conv_id", "block", "at", "blank", "duplicate", "truncated",
        F.concat_ws("", F.transform("rows", lambda r: r["letter"])).alias("letters"),
        F.concat_ws("", F.transform("rows", lambda r: r["initial"])).alias("initials")), "turn-blocks")

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [transfer(v) for v in batch.column(2).to_pylist()]
            wrong = [sum(a + b not in ("su", "ua", "au") for a, b in zip(v, v[1:], strict=False)) for v in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([b[0] for b in both], pa.list_(pa.int64())), pa.array([b[1] for b in both], pa.list_(pa.int64())),
                 pa.array(wrong, pa.int64()), pa.array([v[0] + v[-1] for v in batch.column(3).to_pylist()], pa.string())],
                ["conv_id", "block", "costs", "ranks", "wrong", "ends"])

    parts = blocks.select("conv_id", "block", "letters", "initials").mapInArrow(
        transfers, "conv_id bigint, block int, costs array<bigint>, ranks array<bigint>, wrong bigint, ends string")
    chains = parts.groupBy("conv_id").agg(  # at most a row for each part of the range
        F.sort_array(F.collect_list(F.struct("block", "costs", "ranks", "wrong", "ends"))).alias("parts"))

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, parts_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                way, cost = through([(p["costs"], p["ranks"]) for p in parts_])
                wrong = sum(p["wrong"] for p in parts_) + sum(
                    a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(parts_, parts_[1:], strict=False))
                for k, p in enumerate(parts_):
                    last = k == len(parts_) - 1
                    out.append((conv, p["block"], way[k], way[k + 1], TAIL[way[-1]] if last else "", cost if last else 0, wrong if last else 0))
            conv, *rest = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), *(pa.array(v, t) for v, t in zip(rest, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True))],
                ["conv_id", "block", "start", "end", "tail", "cost", "illegal"])

    ways = chains.mapInArrow(states, "conv_id bigint, block int, start int, end int, tail string, cost bigint, illegal bigint")

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, start, end, tail = (batch.column(c).to_pylist() for c in ("letters", "start", "end", "tail"))
            audit = [hirschberg(*v) + t for *v, t in zip(letters, start, end, tail, strict=True)]
            cols = {c: batch.column(c) for c in batch.schema.names if c not in ("letters", "end", "tail")} | {"audit": pa.array(audit, pa.string())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    b, w = blocks.alias("b"), ways.alias("w")
    met = b.join(w, F.col("b.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("b.block") == F.col("w.block"))).select(
        "b.conv_id", "b.block", "b.at", "b.blank", "b.duplicate", "b.truncated", "b.letters", "w.start", "w.end", "w.tail", "w.cost", "w.illegal")
    edits = written(met.mapInArrow(audits, "conv_id bigint, block int, at bigint, blank bigint, duplicate bigint, truncated bigint, "
                                   "start int, cost bigint, illegal bigint, audit string"), "turn-edits")
    sums = edits.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda r: r["audit"])).alias("audit"))
    spans = turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"))
    hashes = _hashes(turns, edits)

    def facts(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("conv_id", "own_id")

    out = ids.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for table in (sums, spans, hashes):
        out = out.join(facts(table), F.col("conv_id").eqNullSafe(F.col("own_id")), "left").drop("own_id")
    return out.select("conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))


def _hashes(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: a block's audit comes before its rows; each row is hashed as it passes."""
    lines = turns.select("conv_id", "block", "at", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(0).alias("start"))
    plans = edits.select("conv_id", "block", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("string").alias("text"), "audit", "start")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "block", "at"]
    # Whole conversations, spread by a hash; their rows are sorted on disk and stream.
    stream = lines.unionByName(plans).repartition(n, "conv_id").sortWithinPartitions(*order)

    def hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, conv, state, audit, place, first = None, None, 0, "", 0, True
        done: list[tuple[int | None, str]] = []

        def put(role: str, text: str) -> None:
            nonlocal first
            digest.update((("" if first else "\n") + role + ":" + text).encode())
            first = False

        def rest(until_edit: bool) -> None:
            """The inserted turns that come next."""
            nonlocal place, state
            while place < len(audit) and audit[place] == "I":
                state = NEXT[state]
                put(ROLE[state], "")
                place += 1

        for batch in batches:
            for conv_id, _, at, role, text, plan, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at < 0:
                    if digest is not None:
                        rest(False)
                    if digest is None or conv_id != conv:
                        if digest is not None:
                            done.append((conv, digest.hexdigest()))
                        digest, conv, first = hashlib.sha256(), conv_id, True
                    state, audit, place = start, plan, 0
                    continue
                rest(True)
                edit = audit[place]
                place += 1
                if edit == "R":
                    state = NEXT[state]
                    put(ROLE[state], text)
                elif edit == "K":
                    state = 1 if role[0] == "s" else NEXT[state]
                    put(role, text)
            if done:
                yield _digests(done)
                done = []
        if digest is not None:
            rest(False)
            yield _digests([(conv, digest.hexdigest())])

    return stream.select("conv_id", "block", "at", "role", "text", "audit", "start").mapInArrow(hash_lines, "conv_id bigint, repaired_sha256 string")


def _digests(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                      ["conv_id", "repaired_sha256"])
