"""Repair of conversations by the cheapest edits, reconstructed by Hirschberg's divide and conquer.

A repaired conversation has the roles ``(s?(ua)+)?`` (initials of system, user, assistant).
Reading it goes through four states: nothing yet, after system, after user, after
assistant.  Every turn is kept (0), given the role user or assistant (1) or deleted (2, a must for blank and
duplicate turns), an empty turn may be inserted (5), and a truncated turn that is not deleted adds
5.  Of the cheapest edits those whose initials (D, I, K, R) are least in ASCII are taken.  Two inserts in a row
are never cheapest, since all they can save is the deletion of a system turn (2).

Hirschberg: a forward vector (least cost of each state, and the rank of its least edits among the
four) and a backward vector (least cost to the end) meet in the middle of a conversation; of the
states with the least sum the one with the least rank is crossed, and both halves are solved alike.  Ranks
can be carried on because no edits up to a turn are a prefix of others up to it.  Memory is one byte
for each turn and four numbers a vector.  A vector is kept relative to its least cost.  A state more than ``FAR`` above the least
is on no cheapest path, because from any state the edits of any other can be followed for that much more; so
there are few different vectors and a step is one look-up.

Turns are placed by ranges of (conversation, turn), so a conversation of any length lies in as many
slices as it needs.  A slice gives the costs and ranks from each state to each state for its first and last conversation;
from these, at most two rows a slice, the driver chooses the crossings at slice borders, and slices are then
solved by themselves.  Equal rows are counted before they are placed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from loadlens.functions.joins import checked_join
from loadlens.functions.lineage import cut
from loadlens.llm.common import joined_sha256, ship, stored

# Fixed values of the task.
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
SPACE = " \t\n\v\f\r"
#: A state this much above the least cost is on no cheapest path (two inserts follow any other state).
FAR = 2 * INSERT
NEVER = 1 << 40
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLE = {2: "user", 3: "assistant"}
END = "$"
#: Bytes of turns that a slice holds on average.
SLICE_BYTES = 64 << 20
#: Output rows of one Arrow batch.
BATCH = 2_000


def _moves(kind: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) over one turn of a kind, an insert before it included.

    Kinds: ``x`` must be deleted; s, u, a, o (any other role) may stay, in capitals when truncated;
    ``END`` stands behind the last turn and leads from all states to 0.
    """
    if kind == END:
        return [(0, 0, 0, ""), (3, 0, 0, ""), (2, 0, INSERT, "I"), (1, 0, 2 * INSERT, "II")]
    found = []
    for start in range(4):
        for first, cost, edits in ((start, 0, ""), (2 if start != 2 else 3, INSERT, "I")):
            found.append((start, first, cost + DELETE, edits + "D"))
            if kind == "x":
                continue
            stays = cost + (TRUNCATED if kind.isupper() else 0)
            for role, ends in NEXT.items():
                if first in ends:
                    own = role == kind.lower()
                    if own or role != "s":
                        found.append((start, ends[first], stays + (0 if own else REROLE), edits + ("K" if own else "R")))
    return found


KINDS = "xsuaoSUAO"
MOVES = {kind: _moves(kind) for kind in KINDS + END}
START = [tuple((0, 0) if s == p else (NEVER, 0) for s in range(4)) for p in range(4)]


class Steps(dict):
    """Remembers vectors: ``self[vector][kind]`` is (next vector, least cost taken off)."""

    def __init__(self, step):
        super().__init__()
        self.step = step

    def __missing__(self, vector):
        self[vector] = found = {kind: self.step(vector, kind) for kind in MOVES}
        return found


def _forward(vector, kind):
    best: dict[int, tuple] = {}
    for start, end, cost, edits in MOVES[kind]:
        before, rank = vector[start]
        if before < NEVER:
            way = (before + cost, rank, edits)
            if end not in best or way < best[end]:
                best[end] = way
    least = min(w[0] for w in best.values())
    near = {s: w for s, w in best.items() if w[0] <= least + FAR}
    order = sorted(near, key=lambda s: near[s][1:])
    return tuple((near[s][0] - least, order.index(s)) if s in near else (NEVER, 0) for s in range(4)), least


def _backward(vector, kind):
    best = [NEVER] * 4
    for start, end, cost, _ in MOVES[kind]:
        if vector[end] < NEVER:
            best[start] = min(best[start], cost + vector[end])
    least = min(best)
    return tuple(min(NEVER, c - least) if c < NEVER else NEVER for c in best), least


FORWARD, BACKWARD = Steps(_forward), Steps(_backward)


def across(kinds: str) -> list[tuple[int, int]]:
    """(cost, rank) from each state to each state over the turns, by start and then by end."""
    table = []
    for start in range(4):
        vector, total = START[start], 0
        for kind in kinds:
            vector, least = FORWARD[vector][kind]
            total += least
        table += [(total + c, r) if c < NEVER else (NEVER, 0) for c, r in vector]
    return table


def edits_of(kinds: str, start: int = 0, end: int = 0) -> list[str]:
    """Edits for each turn (an insert before it included) from one state to another at least cost."""
    out: list[str] = []
    todo = [(0, len(kinds), start, end)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low == 1:
            out.append(min((c, e) for s, t, c, e in MOVES[kinds[low]] if s == p and t == q)[1])
        elif high > low:
            middle = (low + high) // 2
            ahead = START[p]
            for kind in kinds[low:middle]:
                ahead = FORWARD[ahead][kind][0]
            back = tuple(0 if s == q else NEVER for s in range(4))
            for kind in kinds[middle:high][::-1]:
                back = BACKWARD[back][kind][0]
            _, _, crossing = min((ahead[s][0] + back[s], ahead[s][1], s) for s in range(4) if ahead[s][0] < NEVER and back[s] < NEVER)
            todo += [(middle, high, crossing, q), (low, middle, p, crossing)]
    return out


def _kind(role: Column, fault: Column) -> Column:
    first = F.substring(role, 1, 1)
    kept = F.when(first.isin("s", "u", "a"), first).otherwise("o")
    return F.when(fault.isin(BLANK, DUPLICATE), "x").when(fault == CUT_OFF, F.upper(kept)).otherwise(kept)


def placed_turns(conversations: DataFrame) -> DataFrame:
    """Distinct rows in order, in slices: conv_id, turn, role, text, n, fault, kind (cut).

    ``n`` is the number of equal rows; the first of them has the fault, the others are duplicates.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    owner = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    same = F.sha2(F.concat(owner, F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    said = rows.where(shown != "").groupBy(same.alias("_same"))
    firsts = said.agg(F.min(F.struct("turn")).alias("_first"), F.max(F.struct("turn")).alias("_last"))
    firsts = stored(firsts.where("_first != _last").select("_same", "_first"), "repeated")

    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("_same", same)
    # One of these rows has few others with its key: equal ones are counted, the rest differ in turn.
    sizes = rows.groupBy(same.alias("_same")).agg(F.count(F.lit(1)).alias("rows"))
    known = checked_join(counted, firsts, ["_same"], sizes, "left")
    fault = (
        F.when(shown == "", BLANK)
        .when(F.col("_first").isNotNull() & (F.struct("turn") > F.col("_first")), DUPLICATE)
        .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), CUT_OFF)
        .otherwise(0)
    )
    known = known.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))
    known = known.withColumn("kind", _kind(F.col("role"), F.col("fault")))

    spark = conversations.sparkSession
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("role") + 16)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLICE_BYTES))
    # Range bounds are kept on the driver: the start of a text is enough of it.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = known.repartitionByRange(parts, *order, F.substring("text", 1, 64))
    return cut(ranged.sortWithinPartitions(*order, "text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, its rows in this slice, first run, last run), one run of rows at a time."""
    owner, rows, first = None, [], True
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and row[0] != owner:
                yield owner, rows, first, False
                rows, first = [], False
            owner = row[0]
            rows.append(row)
    if rows:
        yield owner, rows, first, True


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and ranks of the first and the last conversation of a slice."""
    for owner, rows, first, last in _runs(batches):
        if first or last:
            table = across("".join(kind + "x" * (n - 1) for _, kind, n in rows))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([TaskContext.get().partitionId()], pa.int32()),
                "conv_id": pa.array([owner], pa.int64()),
                "last": pa.array([last]),
                "costs": pa.array([[c for c, _ in table]], pa.list_(pa.int64())),
                "ranks": pa.array([[r for _, r in table]], pa.list_(pa.int32())),
            })


def crossings(slices: DataFrame) -> dict[int, tuple]:
    """Per slice (comes in, state, goes on, state) for conversations that cross its borders.

    At most two rows for each slice pass through the driver.
    """
    ship()
    ends = slices.select("conv_id", "kind", "n").mapInArrow(
        _ends, "slice int, conv_id long, last boolean, costs array<long>, ranks array<int>"
    )
    chains: list[list] = []
    for row in sorted(ends.collect(), key=lambda r: (r.slice, r.last)):
        if chains and chains[-1][-1].last and chains[-1][-1].conv_id == row.conv_id:
            chains[-1].append(row)
        else:
            chains.append([row])
    found: dict[int, list] = {}
    for chain in (c for c in chains if len(c) > 1):
        close = [0, 2 * INSERT, INSERT, 0]
        after = [close]
        for row in chain[:0:-1]:
            close = [min(row.costs[4 * s + t] + close[t] for t in range(4)) for s in range(4)]
            after.insert(0, close)
        state = 0
        for row, close in zip(chain, after):
            here = found.setdefault(row.slice, [False, 0, False, 0])
            if row is not chain[0]:
                here[0:2] = True, state
            if row is not chain[-1]:
                _, _, state = min((row.costs[4 * state + t] + close[t], row.ranks[4 * state + t], t) for t in range(4))
                here[2:4] = True, state
    return {k: tuple(v) for k, v in found.items()}


TURNS = "conv_id long, slice int, place long, spans boolean, edit string, fault int, n long, turn long, role string, was string, text string"


def _edited(rows: list, edits: list[str], state: int) -> Iterator[tuple]:
    """(edit, fault, n, turn, role, was, text) of every edit, those of equal deleted rows together."""
    at = 0
    for _, turn, role, text, n, fault, _ in rows:
        for edit in edits[at]:
            if edit == "I":
                state = 3 if state == 2 else 2
                yield edit, 0, 1, None, ROLE[state], None, ""
                continue
            new = role
            if edit == "K":
                state = NEXT[role[0]][state]
            elif edit == "R":
                state = 3 if state == 2 else 2
                new = ROLE[state]
            yield edit, fault, 1, turn, new, role, text
        at += 1
        # Further copies are deleted; an insert, if any, comes before one of them.
        for extra in range(at, at + n - 1):
            if len(edits[extra]) > 1:
                state = 3 if state == 2 else 2
                yield "I", 0, 1, None, ROLE[state], None, ""
            yield "D", BLANK if fault == BLANK else DUPLICATE, 1, turn, role, role, text
        at += n - 1
    for _ in edits[at] if at < len(edits) else "":
        state = 3 if state == 2 else 2
        yield "I", 0, 1, None, ROLE[state], None, ""


def edited_turns(slices: DataFrame, borders: dict[int, tuple], only_spanning: bool = False) -> DataFrame:
    """One row per edit, in order of (slice, place): the turn after it, its old role, its fault.

    Deleted turns are there with edit D, inserted ones with edit I and no turn number.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        into, entry, onward, exit_ = borders.get(number, (False, 0, False, 0))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [c.split()[0] for c in TURNS.split(", ")]
        out: list[tuple] = []
        place = size = 0
        for owner, rows, first, last in _runs(batches):
            spans = (first and into) or (last and onward)
            if only_spanning and not spans:
                continue
            kinds = "".join(r[6] + "x" * (r[4] - 1) for r in rows)
            start = entry if first and into else 0
            edits = edits_of(kinds, start, exit_) if last and onward else edits_of(kinds + END, start, 0)
            for row in _edited(rows, edits, start):
                out.append((owner, number, place, spans, *row))
                place += 1
                size += len(row[-1])
                if len(out) >= BATCH or size > SLICE_BYTES >> 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    ship()
    columns = slices.select("conv_id", "turn", "role", "text", F.col("n").cast("int"), "fault", "kind")
    return columns.mapInArrow(solve, TURNS)


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, slice, place, edit, turn, role, text; (slice, place) gives the order.

    ``conversations`` has conv_id, turn, role and text; other columns are not read, whatever they are called.  Turns are taken by
    number (NULL first), then role and text.  A NULL role or text counts as one blank, so such a text is deleted; rows with NULL as conv_id
    are one conversation.  Very long texts are held one slice at a time; an empty table gives no rows.
    """
    slices = placed_turns(conversations)
    turns = edited_turns(slices, crossings(slices))
    return turns.where("edit != 'D'").select("conv_id", "slice", "place", "edit", "turn", "role", "text")


SEGMENT = (
    "conv_id long, slice int, blank long, duplicate long, truncated long, illegal long, first string, final string, "
    "low long, high long, opens long, turns long, cost long, audit string, sha string"
)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, audit and, for a conversation that lies in one slice, digest of every run of turns."""
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    price = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
    out: list[tuple] = []

    def told() -> tuple:
        return (
            owner, number, faults[BLANK], faults[DUPLICATE], faults[CUT_OFF], illegal, first, before, low, high, opens, numbers,
            cost, "".join(audit), None if spans else digest.hexdigest(),
        )

    started = False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not started or row[0] != owner:
                if started:
                    out.append(told())
                started, owner, number, spans = True, row[0], row[1], row[2]
                faults, illegal, cost, numbers, audit = [0] * 4, 0, 0, 0, []
                first = before = low = high = opens = latest = None
                digest, lines, seen = hashlib.sha256(), 0, 0
            _, _, _, edit, fault, turn, role, was, text = row
            audit.append(edit)
            cost += price[edit] + (TRUNCATED if fault == CUT_OFF and edit != "D" else 0)
            if edit != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
            if edit != "I":
                faults[fault] += 1
                initial = was[:1]
                if seen and before + initial not in ("su", "ua", "au"):
                    illegal += 1
                first, before = first if seen else initial, initial
                opens = opens if seen else turn
                seen += 1
                if turn is not None:
                    low, high = turn if low is None else low, turn
                    numbers += latest is None or latest != turn
                    latest = turn
    if started:
        out.append(told())
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = [types[c.split()[1]] for c in SEGMENT.split(", ")]
    for at in range(0, len(out), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + BATCH]), kinds)], names)


def report(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """One row per conversation: gaps, counts of faults, cost, audit and digest of its repair.

    ``every`` has the conv_ids to report (those of ``conversations`` unless given); one without rows gets zeros, an empty
    audit and the digest of the empty string.  Nulls, ties and order as in ``repaired``.  An audit is one string, so
    it ends at the 2 GB that a string may have; the digest of a conversation in several slices is made in
    one pass over its turns in order, which a task reads as a stream.
    """
    ids = (conversations if every is None else every).select("conv_id").distinct()
    slices = placed_turns(conversations)
    borders = crossings(slices)
    turns = edited_turns(slices, borders)
    # One row for each conversation of a slice.
    columns = ["conv_id", "slice", "spans", "edit", "fault", "turn", "role", "was", "text"]
    parts = stored(turns.select(*columns).mapInArrow(_segments, SEGMENT), "segments")

    spanning = edited_turns(slices, borders, only_spanning=True).where("edit != 'D'")
    line = F.concat("role", F.lit(":"), "text").alias("line")
    lines = spanning.select("conv_id", line, "slice", "place")
    joined = stored(joined_sha256(lines, ["conv_id"], ["slice", "place"], "line", "\n"), "digests")
    joined = joined.select("conv_id", F.lit(-1).alias("slice"), "joined")

    # At most one row for each slice in a conversation.
    order = Window.partitionBy("conv_id").orderBy("slice")
    before, latest = F.lag("final").over(order), F.lag("high").over(order)
    broken = F.when(F.concat(before, "first").isin("su", "ua", "au"), 0).when(before.isNotNull() & F.col("first").isNotNull(), 1)
    told = parts.withColumns({
        "illegal": F.col("illegal") + F.coalesce(broken, F.lit(0)),
        "turns": F.col("turns") - F.coalesce((latest == F.col("opens")).cast("int"), F.lit(0)),
    })
    told = told.unionByName(joined, allowMissingColumns=True)
    told = told.unionByName(ids.select("conv_id", F.lit(-2).alias("slice")), allowMissingColumns=True)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    audits = F.sort_array(F.collect_list(F.when(F.col("slice") >= 0, F.struct("slice", "audit"))))
    return told.groupBy("conv_id").agg(
        gaps, *[total(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(audits, lambda a: a["audit"]), "").alias("audit"),
        F.coalesce(F.max("joined"), F.max("sha"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) with faults put in by a hash of the row's numbers.

    Of twenty rows, one each is dropped, emptied, robbed of its ``.!?``, repeated, and given to the user.
    NULL counts as one blank, in the hash, too.
    """

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(lot == 4, "user").otherwise(shown("role"))
    times = F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    rows = conversations.where(lot != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times)
    return rows.drop("_copy")
