"""Conversation structure repair: least-cost edits by dynamic programming over runs of equal role and fault symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motionloom.operators.ordered import block_entries
from motionloom.session import staged

from .turns import in_order, turn_key

#: Rows of a conversation that are solved together; longer ones are solved in blocks that are joined by their transitions.
BLOCK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
#: States of the repaired roles: nothing yet, after system, after user, after assistant. Symbols: the role's
#: initial (s, u, a, any other), plus 4 if the text is truncated; DROP for rows that must go.
STATES, FOLLOW, ENDS, DROP = 4, (2, 2, 3, 2), (0, FAR, FAR, 0), 8
ROLE = {2: "user", 3: "assistant"}

Matrix = tuple[tuple[int, ...], ...]


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)) for row in a)


def after(a: Matrix, v: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, v, strict=True)) for row in a)


def insertions() -> Matrix:
    """From state to state by insertions alone: at most two, then a state comes again."""
    rows = []
    for s in range(STATES):
        one, two = FOLLOW[s], FOLLOW[FOLLOW[s]]
        cost = {two: 2 * INSERT} | {one: INSERT} | {s: 0}
        rows.append(tuple(cost.get(t, FAR) for t in range(STATES)))
    return tuple(rows)


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(initial, cost, next state) of what may be done with a row."""
    out = [("D", DELETE, state)]
    if symbol != DROP:
        extra, role = TRUNCATED * (symbol >= 4), symbol % 4 + 1
        if role == FOLLOW[state] or state == 0 and role == 1:
            out.append(("K", KEEP + extra, role))
        out.append(("R", REROLE + extra, FOLLOW[state]))
    return out


@lru_cache(None)
def power(symbol: int, bit: int) -> Matrix:
    """The transition over 2**bit rows of one symbol, insertions before each included."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    step = tuple(tuple(min((c for _, c, t in edits(symbol, s) if t == to), default=FAR) for to in range(STATES)) for s in range(STATES))
    return times(insertions(), step)


def over_run(symbol: int, length: int, v: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go before a run, from those after it, by the binary powers of its transition."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            v = after(power(symbol, bit), v)
    return v


def runs(symbols: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """(symbol, length) of equal neighbours; of a row's copies all but the first must go."""
    flat = []
    for s, n in zip(symbols, counts, strict=True):
        flat += [(s, n)] if s == DROP or n == 1 else [(s, 1), (DROP, n - 1)]
    return [(s, sum(n for _, n in g)) for s, g in groupby(flat, key=lambda x: x[0])]


def transition(symbols: list[int], counts: list[int]) -> Matrix:
    same = tuple(tuple(0 if s == t else FAR for t in range(STATES)) for s in range(STATES))
    whole = same
    for s, n in runs(symbols, counts):
        for bit in range(n.bit_length()):
            if n >> bit & 1:
                whole = times(whole, power(s, bit))
    return whole


FINAL = after(insertions(), ENDS)


def unroll(symbols: list[int], counts: list[int], end: tuple[int, ...], state: int, last: bool) -> tuple[int, str, int, list[tuple[int, list[int], int]], list[int]]:
    """The cheapest edits from ``state`` on whose initials come first in ASCII order.

    Returns their cost, their initials, the state after them, (kept row, states inserted before it, its state) and the
    states inserted after the last row. ``end`` holds the costs to go after these rows. The costs at the ends of the runs
    come from the powers; inside a run they are taken back row by row only while that run is unrolled.
    """
    spans, ahead = runs(symbols, counts), [end]
    for s, n in reversed(spans):
        ahead.append(over_run(s, n, ahead[-1]))
    ahead.reverse()
    cost, audit, kept, before, row = 0, [], [], [], 0
    places = [i for i, s in enumerate(symbols) if s != DROP]
    for r, (s, n) in enumerate(spans):
        steps = [ahead[r + 1]]
        for _ in range(n):
            steps.append(after(power(s, 0), steps[-1]))
        for left in range(n, 0, -1):
            here, then = steps[left], steps[left - 1]
            done = False
            while not done:
                options = [(e, c, t, True) for e, c, t in edits(s, state) if c + then[t] == here[state]]
                if INSERT + here[FOLLOW[state]] == here[state]:
                    options.append(("I", INSERT, FOLLOW[state], False))
                e, c, state, done = min(options)
                cost += c
                audit.append(e)
                if e == "I":
                    before.append(state)
                elif e != "D":
                    kept.append((places[row], before, state if e == "R" else 0))
                    before = []
            row += s != DROP
    tail = before
    while last and ENDS[state]:
        state = FOLLOW[state]
        cost += INSERT
        audit.append("I")
        tail = [*tail, state]
    return cost, "".join(audit), state, kept, tail


def damage(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n): rows dropped, emptied, cut, repeated (n = 2) or given to the user by crc32(`conv_id:turn`) mod 20; nulls are one space."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text, role = name("text"), name("role")
    text = F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(kind == 4, "user").otherwise(role)
    return turns.where(kind != 0).select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))


WORD, STOP = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


def symbols(turns: DataFrame) -> DataFrame:
    """(conv, turn, key, n, sym, blank, first, initial): one row for all equal rows of a turn, their first fault as a symbol.

    Only digests of role and text go on. A row is a duplicate if its conversation holds the same role and text
    earlier: at a smaller turn (null first), or as an earlier copy.
    """
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = turns.select("conv", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), "n", cls.alias("initial"), (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(STOP)).alias("cut"))
    rows = light.groupBy("conv", "turn", "key").agg(F.sum("n").alias("n"), *[F.max(c).alias(c) for c in ("initial", "blank", "cut")])
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    least = rows.groupBy(F.col("conv").alias("c"), F.col("key").alias("k")).agg(F.min(at).alias("least"))
    rows = rows.join(least, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
    first = F.col("least").eqNullSafe(at)
    sym = F.when(F.col("blank") | ~first, DROP).otherwise(F.col("initial") + F.when(F.col("cut"), 4).otherwise(0))
    return rows.select("conv", "turn", "key", "n", sym.alias("sym"), "blank", first.alias("first"), "initial")


BLOCKS = "conv {0}, part int, blk int, whole boolean, turns array<long>, keys array<binary>, syms array<int>, counts array<long>, stats array<long>, steps array<long>"
#: What a block reports: faults, pairs of roles that may not be adjacent, least, greatest and number of turns, and its edges.
STATS = ("blank", "duplicate", "truncated", "illegal", "low", "high", "distinct", "numbered", "first_turn", "last_turn", "first_role", "last_role")
LEGAL = {(0, 1), (1, 2), (2, 1)}


def block_stats(rows: list[dict]) -> list[int]:
    blank = sum(r["n"] for r in rows if r["blank"])
    duplicate = sum(r["n"] - r["first"] for r in rows if not r["blank"])
    truncated = sum(r["sym"] in (4, 5, 6, 7) for r in rows)
    illegal = sum(r["n"] - 1 for r in rows) + sum((a["initial"], b["initial"]) not in LEGAL for a, b in zip(rows, rows[1:]))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    some = [min(turns), max(turns), len(set(turns)), 1, turns[0], turns[-1]] if turns else [0, 0, 0, 0, 0, 0]
    return [blank, duplicate, truncated, illegal, *some, rows[0]["initial"], rows[-1]["initial"]]


def cut_blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted rows of a partition; ``whole`` if the conversation surely has no other block."""
    part, out, blk, start, kind = TaskContext.get().partitionId(), [], 0, True, None

    def block(rows, more, first):
        steps = transition([r["sym"] for r in rows], [r["n"] for r in rows])
        return {"conv": rows[0]["conv"], "part": part, "blk": blk, "whole": blk == 0 and not more and not first, "turns": [r["turn"] for r in rows], "keys": [r["key"] for r in rows],
                "syms": [r["sym"] for r in rows], "counts": [r["n"] for r in rows], "stats": block_stats(rows), "steps": [x for line in steps for x in line]}

    names = ["conv", "part", "blk", "whole", "turns", "keys", "syms", "counts", "stats", "steps"]

    def batch_of(rows):
        types = [kind, pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    held: list[dict] = []
    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if held and held[0]["conv"] != row["conv"]:
                out.append(block(held, False, start))
                held, blk, start = [], 0, False
            elif len(held) == size:
                out.append(block(held, True, start))
                held, blk = [], blk + 1
            held.append(row)
            if len(out) >= 512:
                yield batch_of(out)
                out = []
    if held:
        out.append(block(held, True, start))
    if out:
        yield batch_of(out)


def block_states(split: DataFrame) -> DataFrame:
    """(conv, part, blk, ends, state, last) of the blocks of conversations that may have several.

    The costs to go after each block come from the transitions of the later ones, the state in which each block is entered
    from the choices of the earlier ones; both are composed in trees (``block_entries``).
    """
    w = W.partitionBy("conv").orderBy("part", "blk")
    rows = staged(split.withColumns({"seq": F.row_number().over(w).cast("long"), "of": F.count(F.lit(1)).over(W.partitionBy("conv")), "goal": F.lit(list(FINAL)).cast("array<long>")}), "split")
    square = lambda m: tuple(tuple(int(x) for x in m[i : i + STATES]) for i in range(0, STATES * STATES, STATES))
    back = lambda early, late: [[x for line in times(square(late[0]), square(early[0])) for x in line]]
    ends = block_entries(rows.withColumn("seq", -F.col("seq")), ["conv"], "seq", ["steps"], "goal", back, lambda m, v: list(after(square(m[0]), tuple(int(x) for x in v))))
    ends = ends.select(F.col("conv").alias("c"), (-F.col("seq")).alias("s"), F.col("entry").alias("ends"))
    met = rows.join(ends, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s"))).drop("c", "s").withColumn("last", F.col("seq") == F.col("of"))

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = [[unroll(r["syms"], r["counts"], tuple(r["ends"]), s, r["last"])[2] for s in range(STATES)] for r in b.to_pylist()]
            yield pa.record_batch([b.column("conv"), b.column("seq"), pa.array(to, pa.list_(pa.int64())), pa.array([0] * len(to), pa.int64())], names=["conv", "seq", "exits", "begin"])

    kind = split.schema["conv"].dataType.simpleString()
    chosen = met.select("conv", "seq", "syms", "counts", "ends", "last").mapInArrow(exits, f"conv {kind}, seq long, exits array<long>, begin long")
    states = block_entries(chosen, ["conv"], "seq", ["exits"], "begin", lambda a, b: [[b[0][int(x)] for x in a[0]]], lambda m, s: int(m[0][int(s)]))
    states = states.select(F.col("conv").alias("c"), F.col("seq").alias("s"), F.col("entry").alias("state"))
    return met.join(states, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seq") == F.col("s"))).drop("c", "s", "of", "goal", "seq")


SOLVED = "conv {0}, part int, blk int, whole boolean, stats array<long>, cost long, audit string, kept array<struct<turn:long,key:binary,before:array<int>,role:int>>, tail array<int>"


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of blocks from the state in which they are entered."""
    kept = pa.list_(pa.struct([("turn", pa.int64()), ("key", pa.binary()), ("before", pa.list_(pa.int32())), ("role", pa.int32())]))
    for b in batches:
        out = [unroll(r["syms"], r["counts"], tuple(r["ends"]), r["state"], r["last"]) for r in b.select(["syms", "counts", "ends", "state", "last"]).to_pylist()]
        turns, keys = b.column("turns").to_pylist(), b.column("keys").to_pylist()
        rows = [[{"turn": t[i], "key": k[i], "before": before, "role": role} for i, before, role in o[3]] for o, t, k in zip(out, turns, keys, strict=True)]
        yield pa.record_batch([*[b.column(c) for c in ("conv", "part", "blk", "whole", "stats")], pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()),
                               pa.array(rows, kept), pa.array([o[4] for o in out], pa.list_(pa.int32()))], names=["conv", "part", "blk", "whole", "stats", "cost", "audit", "kept", "tail"])


def reports(solved: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) from the blocks, with what happens between blocks."""
    at = {s: F.col("stats")[i].alias(s) for i, s in enumerate(STATS)}
    rows = solved.select("conv", "part", "blk", "whole", *at.values(), "cost", "audit")
    gaps = lambda low, high, distinct: F.coalesce(high - low + 1 - distinct, F.lit(0))
    names = ["blank", "duplicate", "truncated", "illegal"]
    c = F.col
    one = rows.where("whole").select("conv", F.when(c("numbered") > 0, gaps(c("low"), c("high"), c("distinct"))).otherwise(0).alias("gaps"), *names, "cost", "audit")
    w = W.partitionBy("conv").orderBy("part", "blk")
    lines = rows.where("NOT whole").withColumns({"prev_role": F.lag("last_role").over(w), "prev_turn": F.lag(F.when(c("numbered") > 0, c("last_turn"))).over(w)})
    legal = F.struct("prev_role", "first_role").isin([F.struct(F.lit(a).cast("long").alias("prev_role"), F.lit(b).cast("long").alias("first_role")) for a, b in sorted(LEGAL)])
    edge = F.when(c("prev_role").isNotNull() & ~legal, 1).otherwise(0)
    again = F.when((c("numbered") > 0) & (c("prev_turn") == c("first_turn")), 1).otherwise(0)
    has = c("numbered") > 0
    lines = lines.withColumns({"illegal": c("illegal") + edge, "distinct": c("distinct") - again})
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "blk", "audit"))), lambda x: x["audit"]), "").alias("audit")
    many = lines.groupBy("conv").agg(gaps(F.min(F.when(has, c("low"))), F.max(F.when(has, c("high"))), F.sum("distinct")).alias("gaps"), *[F.sum(n).alias(n) for n in [*names, "cost"]], text)
    return one.unionByName(many)


def repaired_digests(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): of each repaired conversation's `role:text` lines.

    A digest is sequential, so the texts of a conversation stream through one task in order, next to the decisions on
    them; nothing is held but the digest.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    texts = rows.select("conv", "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.lit(1).alias("is_text"), "role", "text", F.lit(None).cast("array<int>").alias("before"), F.lit(None).cast("int").alias("to"), F.lit(0).alias("phase"))
    kept = solved.select("conv", F.inline("kept")).select("conv", "turn", "key", F.lit(0).alias("is_text"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "before", F.col("role").alias("to"), F.lit(0).alias("phase"))
    tails = solved.where(F.size("tail") > 0).select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("key"), F.lit(0).alias("is_text"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                                                    F.col("tail").alias("before"), F.lit(0).alias("to"), F.lit(1).alias("phase"))
    lines = kept.unionByName(tails).unionByName(texts).repartition("conv").sortWithinPartitions("conv", "phase", "turn", "key", "is_text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, empty, wanted, field = None, None, True, None, None

        def add(line: str) -> None:
            nonlocal empty
            sha.update((line if empty else "\n" + line).encode())
            empty = False

        for b in batches:
            done, field = [], b.schema.field("conv").type
            for r in b.to_pylist():
                if now is None or now[0] != r["conv"]:
                    if now is not None:
                        done.append((now[0], sha.hexdigest()))
                    now, sha, empty, wanted = (r["conv"],), hashlib.sha256(), True, None
                if not r["is_text"]:
                    for state in r["before"]:
                        add(ROLE[state] + ":")
                    wanted = (r["turn"], r["key"], r["to"])
                elif wanted and wanted[:2] == (r["turn"], r["key"]):
                    add((ROLE[wanted[2]] if wanted[2] else r["role"]) + ":" + r["text"])
                    wanted = None
            yield pa.record_batch([pa.array([d[0] for d in done], field), pa.array([d[1] for d in done], pa.string())], names=["conv", "repaired_sha256"])
        if now is not None:
            yield pa.record_batch([pa.array([now[0]], field), pa.array([sha.hexdigest()], pa.string())], names=["conv", "repaired_sha256"])

    return lines.mapInArrow(stream, f"conv {kind}, repaired_sha256 string")


def repair_conversations(turns: DataFrame, rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row for every conv_id of ``turns``: what is wrong with its ``rows`` (conv, turn, role, text, n) and the cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 as the contract of the query states
    them. Rows are taken by turn (null first), then by a digest of role and text; rows without a conv_id are one
    conversation; equal rows of a turn are handled by their number. A conversation without rows has zeros, an empty audit and the
    digest of the empty text; an empty table gives no rows; other columns are ignored.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    blocks = staged(in_order(symbols(rows), "conv", ["turn", "key"]).mapInArrow(lambda b: cut_blocks(b, size), BLOCKS.format(kind)), "blocks")
    whole = blocks.where("whole").withColumns({"ends": F.lit(list(FINAL)).cast("array<long>"), "state": F.lit(0).cast("long"), "last": F.lit(True)})
    met = whole.unionByName(block_states(blocks.where("NOT whole")))
    solved = staged(met.mapInArrow(solve, SOLVED.format(kind)), "solved")
    said = reports(solved).withColumnRenamed("conv", "c")
    sums = repaired_digests(rows, solved).withColumnRenamed("conv", "s")
    out = turns.select("conv_id").distinct()
    out = out.join(said, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("s")), "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def repair_damaged(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """``repair_conversations`` of the conversations after ``damage``."""
    return repair_conversations(turns, damage(turns), size)
