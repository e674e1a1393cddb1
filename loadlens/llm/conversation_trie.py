"""Prefix trie of conversations, from sorted matrices of turn ids.

A turn's id is two 64-bit hashes of role and text.  Conversations become rows of a matrix,
padded at the end, and are range partitioned by their ids, so a shard holds neighbours.  In a shard
numpy's ``lexsort`` orders the rows; a row starts a node of depth d if it differs from the row before in any of its
first d ids, which is an OR accumulated over the columns; ``reduceat`` over the starts gives members, children,
and, from the deepest column up, sums over subtrees.

Nodes that hold the first or the last row of a shard may go on in a neighbour: a shard gives their parts, at most
two for each depth, and one task puts the parts of all shards together.  Every other node is complete in its shard.

Conversations may be long and the matrix is not: it takes ``WIDTH`` turns, and those conversations that still share all of them
with another go on in a next, wider one, below the node that they share.  A conversation alone at the end of a
matrix is a plain path from there, which is written row by row and may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loadlens.functions.joins import checked_join
from loadlens.functions.ordered import running
from loadlens.llm.common import joined_sha256, ship, stored

#: Turns of the first matrix; each next one is ``WIDER`` times as wide, up to ``WIDEST``.
WIDTH, WIDER, WIDEST = 16, 4, 256
#: Bytes of ids in a shard, on average.
SHARD_BYTES = 64 << 20
# Fixed values of the task: conversations of five share the start of the first, of up to eight turns.
FAMILY, MOST_SHARED = 5, 9

_PAD = np.iinfo(np.int64).min
_NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), k1, k2 (id of the turn), bytes (stored); rows without conv_id are left out.

    Turns of a conversation are taken by number (NULL first); of equal numbers by role, then by hash of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ids = [F.xxhash64(F.lit(k), role, text).alias(f"k{k}") for k in (1, 2)]
    rows = conversations.where("conv_id is not null")
    rows = rows.select("conv_id", "turn", role.alias("role"), *ids, F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("k1"), F.col("k2")]
    return stored(running(rows, ["conv_id"], order, sums={"d": F.lit(1)}).select("conv_id", "d", "k1", "k2", "bytes"), "turns")


def lengths(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of all conversations with turns (stored)."""
    return stored(turns.groupBy("conv_id").agg(F.max("d").alias("n_turns")), "lengths")


def with_shared_starts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations rebuilt on the start of the first of their family.

    Conversation c starts with the first h turns of c - c % 5 (all if fewer, none if absent) and
    goes on with its own turns after its first h; h is a hash of c below nine.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = lengths(turns)
    members = own.select("conv_id", "n_turns", shared.alias("h"), first.alias("first"))
    heads = own.select(F.col("conv_id").alias("first"), F.col("n_turns").alias("n_first"))
    members = members.join(heads, "first", "left").withColumn("n_head", F.least("h", F.coalesce("n_first", F.lit(0))))
    total = F.col("n_head") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    members = stored(members.select("conv_id", "first", "h", "n_head", total.alias("total"), "n_turns"), "members")

    firsts = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("d") < MOST_SHARED)).withColumnRenamed("conv_id", "first")
    taken = firsts.join(members.select("conv_id", "first", "h"), "first").where("d <= h")
    sizes = members.select("conv_id", F.col("n_turns").alias("rows"))
    rest = checked_join(turns, members.select("conv_id", "h", "n_head"), ["conv_id"], sizes).where("d > h")
    rest = rest.withColumn("d", F.col("d") - F.col("h") + F.col("n_head"))
    columns = ["conv_id", "d", "k1", "k2", "bytes"]
    rebuilt = stored(taken.select(*columns).unionByName(rest.select(*columns)), "rebuilt")
    return rebuilt, members.select("conv_id", F.col("total").alias("n_turns"))


SHARD = (
    "open boolean, shard int, g1 long, g2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string, ends string, k1 long, k2 long, p1 long, p2 long, "
    "below_children long, below_leaves long, below_saved long, bytes long"
)


def _key(group: tuple[int, int], ids: np.ndarray) -> tuple[int, int]:
    """Name of a node from its group and ids."""
    found = hashlib.blake2b(np.array(group, np.int64).tobytes() + np.ascontiguousarray(ids).tobytes(), digest_size=16)
    return tuple(np.frombuffer(found.digest(), np.int64).tolist())


def _matrix(lists: pa.ListArray, lens: np.ndarray, per: int, fill: int) -> np.ndarray:
    """Lists as rows, ``per`` columns for each turn, filled up at the end."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    width = per * int(lens.max(initial=0))
    out = np.full((len(lens), width), fill, np.int64)
    out[np.arange(width) < (per * lens)[:, None]] = flat
    return out


def _nodes_of_shard(rows: pa.Table, low: int, shard: int) -> Iterator[dict]:
    """Nodes of one shard, a block of columns for each depth; ``low`` is the depth of the groups' nodes."""
    rows = rows.combine_chunks()

    def column(name: str) -> np.ndarray:
        return rows[name].to_numpy()

    lists = rows["ids"].combine_chunks()
    lens = np.diff(lists.offsets.to_numpy()) // 2
    ids, size = _matrix(lists, lens, 2, _PAD), _matrix(rows["bytes"].combine_chunks(), lens, 1, 0)
    g1, g2, conv = column("g1"), column("g2"), column("conv_id")
    order = np.lexsort((conv, *ids.T[::-1], g2, g1))
    ids, size, lens, g1, g2, conv = ids[order], size[order], lens[order], g1[order], g2[order], conv[order]
    total, top = column("n_turns")[order], column("top")[order]
    below = [column(c)[order] for c in ("below_children", "below_leaves", "below_saved")]
    n, deepest = len(conv), size.shape[1]

    changed = np.ones((n, deepest + 1), bool)
    changed[1:, 0] = (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])
    differ = ids[1:] != ids[:-1]
    changed[1:, 1:] = differ[:, 0::2] | differ[:, 1::2]
    changed = np.logical_or.accumulate(changed, axis=1)
    starts = [np.flatnonzero(changed[:, j]) for j in range(deepest + 1)]
    least = [np.minimum.reduceat(conv, s) for s in starts]

    def is_open(s: np.ndarray) -> np.ndarray:
        # The first and the last run of rows.
        found = np.zeros(len(s), bool)
        found[[0, -1]] = True
        return found

    saved, leaves = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(deepest, -1, -1):
        s = starts[j]
        real, open_ = lens[s] >= j, is_open(s)
        members = np.diff(np.append(s, n))
        children = np.zeros(len(s), np.int64)
        if j < deepest:
            child = starts[j + 1][(lens[starts[j + 1]] > j)]
            # Open children are counted where the parts come together.
            closed = child[~is_open(starts[j + 1])[lens[starts[j + 1]] > j]]
            np.add.at(children, np.searchsorted(s, closed, "right") - 1, 1)
        under = [np.maximum.reduceat(np.where(total > low + j, b, 0), s) if j == deepest else np.zeros(len(s), np.int64) for b in below]
        if j < deepest:
            # Rows that fill the matrix are the deepest ones; all others end inside it.
            under = [np.zeros(len(s), np.int64)] * 3
        bytes_ = size[s, j - 1] if j else np.zeros(len(s), np.int64)
        own = real & ~open_
        saved[s[own]] += ((members - 1) * bytes_ + under[2])[own]
        leaves[s[own]] += (under[1] + (children + under[0] == 0))[own]
        sum_saved, sum_leaves = np.add.reduceat(saved, s), np.add.reduceat(leaves, s)

        ends = np.flatnonzero(total == low + j)
        cut_low, cut_high = np.searchsorted(ends, s), np.searchsorted(ends, s + members)
        texts = [",".join(map(str, conv[ends[a:b]].tolist())) if b > a else "" for a, b in zip(cut_low, cut_high)]
        up = np.searchsorted(starts[j - 1], s, "right") - 1 if j else np.zeros(len(s), np.int64)
        up_open = is_open(starts[j - 1])[up] if j else np.zeros(len(s), bool)
        out: dict[str, list] = {c.split()[0]: [] for c in SHARD.split(", ")}
        for i in np.flatnonzero(real).tolist():
            at, group = s[i], (int(g1[s[i]]), int(g2[s[i]]))
            key = _key(group, ids[at, : 2 * j]) if open_[i] else (None, None)
            parent = upper = None
            if j == 1 and low:
                parent = int(top[at])
            elif j and not up_open[i]:
                parent = int(least[j - 1][up[i]])
            if j and up_open[i]:
                upper = _key(group, ids[at, : 2 * j - 2])
            whole = not open_[i]
            values = (
                not whole, shard, *group, int(least[j][i]), low + j, parent, int(members[i]),
                int(children[i] + (under[0][i] if whole else 0)), int(sum_leaves[i]), int(sum_saved[i]),
                (hashlib.sha256(texts[i].encode()).hexdigest() if texts[i] else _NOTHING) if whole else None,
                None if whole else texts[i], *key, *(upper or (None, None)),
                int(under[0][i]), int(under[1][i]), int(under[2][i]), int(bytes_[i]),
            )
            for name, value in zip(out, values):
                out[name].append(value)
        yield out


OPENED = ["k1", "k2", "g1", "g2", *NODE[:-1]]


def _joined_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open nodes, their parts summed already, with sums over the open nodes below them."""
    parts = [row for batch in batches for row in batch.to_pylist()]
    nodes = {(r["k1"], r["k2"]): r | {"more": 0, "leaves": 0, "saved": 0} for r in sorted(parts, key=lambda r: -r["depth"])}
    for r in nodes.values():  # from the deepest
        r["n_children"] += r["below_children"] + r["more"]
        # The parts have the sums over closed nodes at any depth; what open nodes add is passed up.
        r["leaves"] += r["below_leaves"] + (r["n_children"] == 0)
        r["saved"] += r["below_saved"] + (r["n_convs"] - 1) * r["bytes"]
        r["n_leaves"] += r["leaves"]
        r["saved_tokens"] += r["saved"]
        upper = nodes.get((r["p1"], r["p2"]))
        if upper is not None:
            upper["more"] += 1
            upper["leaves"] += r["leaves"]
            upper["saved"] += r["saved"]
            if r["parent_conv_id"] is None:
                r["parent_conv_id"] = upper["conv_id"]
    if nodes:
        columns = [pa.array([r[c] for r in nodes.values()], pa.int64()) for c in OPENED]
        yield pa.RecordBatch.from_arrays(columns, OPENED)


def _sharded(rows: DataFrame, low: int) -> DataFrame:
    """Nodes of the matrix ``rows``: g1, g2 and the columns of a node, the groups' own nodes included (stored)."""
    ship()
    spark = rows.sparkSession
    rows = stored(rows, "matrix")
    cells = rows.agg(F.sum(F.size("ids") + 8)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells * 8 // SHARD_BYTES))
    names = [c.split()[0] for c in SHARD.split(", ")]
    kinds = {"boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in SHARD.split(", ")]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            for block in _nodes_of_shard(pa.Table.from_batches(held), low, TaskContext.get().partitionId()):
                yield pa.RecordBatch.from_arrays([pa.array(block[c], t) for c, t in zip(names, types)], names)

    placed = rows.repartitionByRange(parts, "g1", "g2", "ids", "conv_id")
    found = stored(placed.mapInArrow(shard, SHARD), "shards")

    # At most two nodes for each shard and depth are open, so one task can join their parts.
    pieces = found.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    most = [F.max(c).alias(c) for c in ("g1", "g2", "depth", "parent_conv_id", "p1", "p2", "below_children", "below_leaves", "below_saved", "bytes")]
    summed = pieces.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), *sums, *most)
    opened = stored(summed.coalesce(1).mapInArrow(_joined_parts, ", ".join(f"{c} long" for c in OPENED)), "opened")
    digests = joined_sha256(pieces.where("ends != ''"), ["k1", "k2"], ["shard"], "ends", ",")
    whole = opened.join(digests, ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("joined", F.lit(_NOTHING)))

    closed = found.where("not open").select("g1", "g2", *NODE, "p1", "p2")
    # Bounded likewise by the number of shards.
    upper = F.broadcast(opened.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("_upper")))
    closed = closed.join(upper, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_upper"))
    return stored(closed.select("g1", "g2", *NODE).unionByName(whole.select("g1", "g2", *NODE)), "nodes")


def _levels(turns: DataFrame, members: DataFrame, low: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(nodes deeper than ``low``, nodes of depth ``low``) of ``members`` (conv_id, n_turns, g1, g2, top)."""
    high = low + width
    part = turns.where((F.col("d") > low) & (F.col("d") <= high))
    each = F.sort_array(F.collect_list(F.struct("d", "k1", "k2", "bytes")))
    listed = part.join(members.select("conv_id"), "conv_id") if low else part
    listed = listed.groupBy("conv_id").agg(each.alias("_t"))
    empty = F.array().cast("array<long>")
    ids = F.coalesce(F.flatten(F.transform("_t", lambda t: F.array(t["k1"], t["k2"]))), empty).alias("ids")
    rows = members.join(listed, "conv_id", "left").select(*members.columns, ids, F.coalesce("_t.bytes", empty).alias("bytes"))
    label = [F.xxhash64(F.lit(k), "g1", "g2", "ids").alias(f"l{k}") for k in (1, 2)]
    rows = stored(rows.select("*", *label), "sequences")

    # Where the matrix ends, conversations that are not alone go on in the next one.
    full = rows.where(F.col("n_turns") >= high).groupBy("l1", "l2")
    shared = full.agg(F.count(F.lit(1)).alias("rows"), F.min("conv_id").alias("top_"), F.max("n_turns").alias("_deep"))
    shared = stored(shared.where(F.col("_deep") > high), "shared")
    deeper = []
    zero = F.lit(0).cast("long")
    if shared.isEmpty():
        rows = rows.select("*", *[zero.alias(f"below_{c}") for c in ("children", "leaves", "saved")])
    else:
        labels = shared.select("l1", "l2", "top_", F.col("rows").alias("_n"))
        going = checked_join(rows.where(F.col("n_turns") > high), labels, ["l1", "l2"], shared)
        alone = stored(going.where("_n = 1").select("conv_id", "n_turns"), "alone")
        sizes = alone.select("conv_id", F.col("n_turns").alias("rows"))
        path = checked_join(turns.where(F.col("d") > high), alone, ["conv_id"], sizes)
        one = F.lit(1).cast("long")
        last = F.col("d") == F.col("n_turns")
        deeper.append(path.select(
            "conv_id", F.col("d").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
            F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
            F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
        ))
        next_ = going.where("_n > 1").select("conv_id", "n_turns", F.col("l1").alias("g1"), F.col("l2").alias("g2"), F.col("top_").alias("top"))
        next_ = stored(next_, "members")
        under = shared.where("rows = 1").select("l1", "l2", *[x.alias(f"below_{c}") for c, x in (("children", one), ("leaves", one), ("saved", zero))])
        if not next_.isEmpty():
            nodes, roots = _levels(turns, next_, high, min(WIDEST, width * WIDER))
            deeper.append(nodes)
            below = [F.col(c).alias(f"below_{n}") for c, n in (("n_children", "children"), ("n_leaves", "leaves"), ("saved_tokens", "saved"))]
            under = under.unionByName(roots.select(F.col("g1").alias("l1"), F.col("g2").alias("l2"), *below))
        rows = checked_join(rows, stored(under, "below"), ["l1", "l2"], shared, "left")
        rows = rows.fillna(0, [f"below_{c}" for c in ("children", "leaves", "saved")])
    below = ["below_children", "below_leaves", "below_saved"]
    found = _sharded(rows.select("g1", "g2", "top", "conv_id", "n_turns", "ids", "bytes", *below), low)
    nodes = found.where(F.col("depth") > low).select(*NODE)
    for more in deeper:
        nodes = nodes.unionByName(more)
    return nodes, found.where(F.col("depth") == low)


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of ``members`` (conv_id, n_turns) with ``turns`` (conv_id, d, k1, k2, bytes).

    A node is named by its smallest member and its depth.  ``parent_conv_id`` is NULL for the root, which all
    conversations share; ``saved_tokens`` are bytes that a cache of shared prefixes need not read again.  Without
    conversations there is no node.
    """
    zero = F.lit(0).cast("long")
    first = members.select("conv_id", "n_turns", zero.alias("g1"), zero.alias("g2"), zero.alias("top"))
    nodes, root = _levels(turns, first, 0, WIDTH)
    return nodes.unionByName(root.select(*NODE))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Trie of conversations (conv_id, turn, role, text) as they are.

    A NULL role or text counts as empty; rows without conv_id belong to no conversation; repeated rows are turns of
    their own.  Other columns are not read, whatever they are called.  Texts of any length are hashed where they are read.
    """
    turns = numbered_turns(conversations)
    return trie(turns, lengths(turns))
