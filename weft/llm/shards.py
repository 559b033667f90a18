"""K-d tree sharding by bytes (operator 4).

Nodes are split at the weighted median of their widest metadata dimension until
leaves reach the target bytes or the depth given.  A row's place along a
dimension is a key of digits: its coordinate there, then its text's hash, then
its id's hash, so the median can fall inside one hot value (copies of a text
with equal coordinates stay together unless a large group must be cut).  The median is found digit by
digit: each round sums bytes by (node, digit) over the rows that share the
node's prefix, in a shuffle of pre-aggregated sums, and the driver receives one
row per node.  A round stops for nodes whose remaining bin is below the
tolerance; a level takes two or three rounds.  Where the median falls inside the
copies of one text, these go to one side whole and the cut is sought once more
among the other rows.

Rows are read once, into a narrow table in the shared folder (id, bytes, hashes
and coordinates); the texts move nowhere.  Splits are broadcast as long as they
are few, else joined.

Null texts have size 1 and the hash of the empty text; null metadata is a value
of its own.  Rows that repeat are rows of their own.  An empty table has no
shards.  Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import named, written

#: Bits of a digit, digits of the text's and of the id's hash.
BITS, DIGITS = 12, 5
#: Splits that are broadcast to every task at most.
BROADCAST_NODES = 100_000
#: Groups of copies that a node sets apart at most, looking for a cut beside them.
APART = 8
#: Rows that one task numbers, about.
SLOT_ROWS = 50_000


def log_scale(c: Column) -> Column:
    """A coordinate of BITS bits for counts up to 2**40."""
    return F.least(F.lit((1 << BITS) - 1), F.floor(F.log2(F.greatest(F.coalesce(c, F.lit(0)).cast("double"), F.lit(1.0))) * ((1 << BITS) / 40))).cast("int")


def category(c: Column) -> Column:
    """A coordinate of BITS bits for names."""
    return F.shiftrightunsigned(F.xxhash64(c), 64 - BITS).cast("int")


def _digits(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, 64 - BITS * (i + 1)).bitwiseAND((1 << BITS) - 1).cast("int") for i in range(DIGITS)]


@dataclass
class Node:
    node: int
    total: int
    dim: int
    prefix: list[int] = field(default_factory=list)
    below: int = 0
    inclusive: bool = True
    open: bool = True
    #: Groups set apart, on the left and on the right, and their bytes.
    apart: tuple[list[str], list[str]] = field(default_factory=lambda: ([], []))
    held: list[int] = field(default_factory=lambda: [0, 0])

    def half(self) -> float:
        """Bytes of the rows not set apart that are to go left."""
        return min(self.total / 2 - self.held[0], self.total - sum(self.held))

    def set_apart(self, group: str, w: int, slack: float) -> bool:
        """Puts a group on the side that has room for it, and starts anew."""
        if sum(map(len, self.apart)) >= APART:
            return False
        for side in (0, 1):
            if self.held[side] + w <= self.total / 2 + slack:
                self.apart[side].append(group)
                self.held[side] += w
                self.prefix, self.below, self.open = [], 0, sum(self.held) < self.total
                if not self.open:  # no other rows
                    self.prefix, self.inclusive = [-1], False
                return True
        return False


def _table(like: DataFrame, nodes: list[Node], **columns: pa.Array) -> DataFrame:
    """A table of columns by node, to be joined on node."""
    made = like.sparkSession.createDataFrame(pa.table({"node": pa.array([n.node for n in nodes], pa.int64()), **columns}))
    return F.broadcast(made) if len(nodes) <= BROADCAST_NODES else made


def _splits(like: DataFrame, nodes: list[Node]) -> DataFrame:
    """(node, dim, prefix, inclusive, groups on the left, on the right) of the nodes."""
    prefixes = pa.array([n.prefix for n in nodes], pa.list_(pa.int32()))
    groups = {f"apart{i}": pa.array([n.apart[i] for n in nodes], pa.list_(pa.string())) for i in (0, 1)}
    return _table(like, nodes, dim=pa.array([n.dim for n in nodes], pa.int32()), prefix=prefixes, inclusive=pa.array([n.inclusive for n in nodes]), **groups)


def _key(length: int) -> Column:
    """The first digits of a row's key along dim."""
    along = F.element_at("coords", F.col("dim") + 1)
    return F.slice(F.concat(F.array(along), F.col("ties")), 1, length)


def _group() -> Column:
    """The name of a row's group of copies along dim."""
    return F.array_join(_key(1 + DIGITS).cast("array<string>"), ",")


def _median(rows: DataFrame, nodes: list[Node], tolerance: float, group_tolerance: float, largest: int) -> None:
    """Sets each node's prefix so that about half of its bytes go left."""
    while nodes:
        _search(rows, nodes, tolerance, group_tolerance, largest)
        nodes = [n for n in nodes if n.open]


def _search(rows: DataFrame, nodes: list[Node], tolerance: float, group_tolerance: float, largest: int) -> None:
    """Finds the nodes' cuts, but for nodes that set a group of copies apart:
    those are left open, for another search."""
    digits = 1 + 2 * DIGITS
    apart = any(n.apart[0] or n.apart[1] for n in nodes)
    for at in range(digits):
        active = [n for n in nodes if n.open and len(n.prefix) == at]
        if not active:
            return
        state = rows.join(_splits(rows, active), "node")
        if apart:
            state = state.where(~F.array_contains(F.concat("apart0", "apart1"), _group()))
        inside = state.where(_key(at) == F.col("prefix")) if at else state
        sums = inside.groupBy("node", F.element_at(_key(at + 1), -1).alias("digit")).agg(F.sum("size").alias("w"))
        below = sums.withColumn("up_to", F.sum("w").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)))
        half = _table(rows, active, half=pa.array([n.half() - n.below for n in active], pa.float64()))
        found = below.join(half, "node").where("up_to >= half").groupBy("node").agg(F.min(F.struct("digit", "up_to", "w")).alias("x"))
        got = {r["node"]: r["x"] for r in found.collect()}
        for n in active:
            x = got[n.node]
            n.prefix.append(x["digit"])
            before = n.below + x["up_to"] - x["w"]
            short, over = n.half() - before, before + x["w"] - n.half()
            n.inclusive = short > over
            n.open = x["w"] > min(tolerance * n.total, largest) and at + 1 < digits
            n.below = before
            if at == DIGITS and n.open and group_tolerance:  # the text's hash has ended: the bin is one text
                slack = max(tolerance * n.total, largest)
                if min(short, over) <= slack:
                    n.open = False
                elif not n.set_apart(",".join(map(str, n.prefix)), x["w"], slack):
                    n.open = x["w"] > group_tolerance * n.total


def shards(
    df: DataFrame, dimensions: dict[str, Column], target_bytes: int | None = None, max_depth: int = 40, leaves: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", tolerance: float = 1e-4, group_tolerance: float = 0.02,
) -> DataFrame:
    """One row per row of df: (id_col, size, text_crc32, shard, slot).

    dimensions: coordinates by name, from log_scale() or category().  Give
    target_bytes, or leaves (a power of two).  shard numbers the leaves from 0
    in key order; slot numbers the rows of a shard from 0 without gaps.  Copies of
    a text whose coordinates agree share a shard, but for groups of more than
    group_tolerance of the bytes where a cut falls and that neither side has room
    for: those are cut by id.  With group_tolerance 0 all groups are."""
    text = F.coalesce(named(text_col), F.lit(""))
    narrow = written(
        df.select(
            named(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.array(*dimensions.values()).alias("coords"),
            F.array(*_digits(F.xxhash64(text)), *_digits(F.xxhash64(named(id_col), F.lit(1)))).alias("ties"),
        )
    )
    whole = narrow.agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("size").alias("largest")).first()
    if not whole["n"]:
        return narrow.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    if leaves:
        max_depth, target_bytes = leaves.bit_length() - 1, 0
    rows = narrow.withColumn("node", F.lit(1).cast("bigint"))
    for _ in range(max_depth):
        spread = [(F.max(F.element_at("coords", i + 1)) - F.min(F.element_at("coords", i + 1))).alias(f"d{i}") for i in range(len(dimensions))]
        facts = rows.groupBy("node").agg(F.sum("size").alias("b"), F.count("*").alias("n"), *spread).where((F.col("b") > target_bytes) & (F.col("n") > 1)).collect()
        if not facts:
            break
        nodes = [Node(r["node"], r["b"], max(range(len(dimensions)), key=lambda i, r=r: r[f"d{i}"])) for r in facts]
        _median(rows, nodes, tolerance, group_tolerance, whole["largest"])
        split = rows.join(_splits(rows, nodes), "node", "left")
        key = _key(F.size("prefix"))
        left = F.when(F.col("inclusive"), key <= F.col("prefix")).otherwise(key < F.col("prefix"))
        if any(n.apart[0] or n.apart[1] for n in nodes):
            left = F.when(F.array_contains("apart0", _group()), True).when(F.array_contains("apart1", _group()), False).otherwise(left)
        place = F.when(F.col("dim").isNull(), F.col("node")).when(left, F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
        rows = split.select("id", "size", "text_crc32", "coords", "ties", place.alias("node"))
        rows = rows if leaves else written(rows)
    if leaves:  # a node that could not be split stays the left one
        depth = F.floor(F.log2("node")).cast("int")
        number = F.expr(f"shiftleft(node, {max_depth} - cast(floor(log2(node)) as int)) - {1 << max_depth}")
        leaf = rows.select("id", "size", "text_crc32", "ties", F.when(depth <= max_depth, number).cast("int").alias("shard"))
    else:
        order = F.lpad(F.conv(F.col("node").cast("string"), 10, 2), 64, "0")
        names = rows.groupBy("node").agg(F.first(F.rpad(F.ltrim(F.lit("0"), order), 64, "0")).alias("place")).select("node", (F.row_number().over(Window.orderBy("place")) - 1).cast("int").alias("shard"))
        leaf = rows.join(names, "node").select("id", "size", "text_crc32", "ties", "shard")
    blocks = max(1, -(-whole["n"] // SLOT_ROWS))
    dealt = leaf.withColumn("block", F.pmod(F.element_at("ties", 1 + DIGITS) * (1 << BITS) + F.element_at("ties", 2 + DIGITS), F.lit(blocks)))
    counts = dealt.groupBy("shard", "block").count()
    starts = counts.select("shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("start"))
    placed = dealt.join(starts, ["shard", "block"])
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "ties"))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("start") + rank - 1).cast("bigint").alias("slot"))
