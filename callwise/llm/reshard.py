"""Minimum-cost-flow resharding: which blocks of rows move so that new row capacities hold and the fewest bytes move."""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import count as counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwise.llm.common import with_order, written
from callwise.plans.storage import scratch_path

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
#: Bytes aimed at per file of a new shard.
FILE_BYTES = 256 << 20
#: Rows of a plan that are sent to every task (about 30 bytes each); a longer plan meets its rows by a shuffle.
SENT_ROWS = 500_000


class FlowNetwork:
    """Minimum-cost flow by successive shortest paths with potentials. Its size is that of the shard plan
    (shards times size classes), not of the data."""

    def __init__(self) -> None:
        self.arcs: list[list[float]] = []  # to, capacity left, cost; arc k ^ 1 is its reverse
        self.out: dict[object, list[int]] = {}

    def add(self, a: object, b: object, capacity: int, cost: float) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def solve(self, source: object, sink: object) -> tuple[int, float]:
        """Sends as much as fits, at the least cost; costs of arcs must not be negative."""
        potential = dict.fromkeys(self.out, 0.0)
        sent, paid = 0, 0.0
        while True:
            dist, via, tie = {source: 0.0}, {}, counter()
            heap, done = [(0.0, next(tie), source)], set()
            while heap:
                d, _, a = heapq.heappop(heap)
                if a in done:
                    continue
                done.add(a)
                for k in self.out.get(a, ()):
                    b, left, cost = self.arcs[k]
                    if left > 0 and b not in done:
                        nd = d + max(0.0, cost + potential[a] - potential[b])
                        if nd < dist.get(b, float("inf")):
                            dist[b], via[b] = nd, k
                            heapq.heappush(heap, (nd, next(tie), b))
            if sink not in done:
                return sent, paid
            for a in potential:
                potential[a] += min(dist.get(a, dist[sink]), dist[sink])
            path, a = [], sink
            while a != source:
                path.append(via[a])
                a = self.arcs[via[a] ^ 1][0]
            flow = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= flow
                self.arcs[k ^ 1][1] += flow
                paid += flow * self.arcs[k][2]
            sent += flow


def plan_moves(blocks: list[tuple[object, int, int, int]], capacities: list[int]) -> list[tuple[object, int, int, int, int]]:
    """(old shard, block, rows, bytes) and rows per new shard to runs (old shard, block, first row, rows, new shard).

    Old shard i stays new shard i at no cost; any other move costs the block's mean bytes per row. A block's
    rows that stay come first, then those that go, by new shard.
    """
    net, stay, leave, enter = FlowNetwork(), {}, {}, {}
    for at, (old, block, rows, size) in enumerate(blocks):
        net.add("source", ("block", at), rows, 0.0)
        if isinstance(old, int) and 0 <= old < len(capacities):
            stay[at] = net.add(("block", at), ("shard", old), rows, 0.0)
        leave[at] = net.add(("block", at), "road", rows, size / max(1, rows))
    for shard, capacity in enumerate(capacities):
        enter[shard] = net.add("road", ("shard", shard), capacity, 0.0)
        net.add(("shard", shard), "sink", capacity, 0.0)
    sent, _ = net.solve("source", "sink")
    if sent < sum(b[2] for b in blocks):
        raise ValueError("the new capacities do not hold all rows")
    flow = {k: net.arcs[k ^ 1][1] for k in [*stay.values(), *leave.values(), *enter.values()]}
    open_seats = [[shard, flow[k]] for shard, k in enter.items() if flow[k]]
    runs, seat = [], 0
    for at, (old, block, _, _) in enumerate(blocks):
        first = 0
        if at in stay and flow[stay[at]]:
            runs.append((old, block, 0, flow[stay[at]], old))
            first = flow[stay[at]]
        going = flow[leave[at]]
        while going:
            n = min(going, open_seats[seat][1])
            runs.append((old, block, first, n, open_seats[seat][0]))
            first, going = first + n, going - n
            open_seats[seat][1] -= n
            seat += not open_seats[seat][1]
    return runs


def even_capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def stored_shards(rows: DataFrame, old_shard: Column) -> DataFrame:
    """The old shards as files: (rid, old_shard, row), ``row`` with all columns of the input and ``rid`` a number per row."""
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), old_shard.cast("int").alias("old_shard"),
                           F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    path = scratch_path(rows.sparkSession, "reshard-old")
    numbered.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(numbered.schema).parquet(path)


def _blocks(slim: DataFrame) -> list[tuple[int | None, int, int, int]]:
    """(old shard, block, rows, bytes): at most 64 blocks per old shard, two more where one is parted."""
    blocks = [(r["old_shard"], r["_block"], r["n"], r["b"]) for r in slim.groupBy("old_shard", "_block")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()]
    return sorted(blocks, key=lambda b: (b[0] is None, b[0] or 0, b[1]))


def _parted(slim: DataFrame, runs: list[tuple[int | None, int, int, int, int]]) -> DataFrame | None:
    """``slim`` with every block of which some rows stay and some go parted by size: rows above, at and below the size up to which
    rows go. None if there is no such block."""
    going: dict[tuple[int | None, int], list[int]] = {}
    for old, block, _, rows, shard in runs:
        going.setdefault((old, block), [0, 0])[shard != old] += rows
    mixed = [(old, block, go) for (old, block), (stay, go) in going.items() if stay and go]
    if not mixed:
        return None
    table = F.broadcast(slim.sparkSession.createDataFrame(mixed, "old_shard int, _block int, _go long"))
    sizes = slim.join(table, ["old_shard", "_block"]).groupBy("old_shard", "_block", "_go", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("old_shard", "_block").orderBy("size"))
    cut = sizes.withColumn("_upto", upto).where("_upto >= _go").groupBy("old_shard", "_block").agg(F.min("size").alias("_cut"))
    part = F.when(F.col("_cut").isNull(), 0).when(F.col("size") > F.col("_cut"), 1).when(F.col("size") == F.col("_cut"), 2).otherwise(3)
    # One row per old shard at most.
    return slim.join(F.broadcast(cut), ["old_shard", "_block"], "left").withColumn("_block", F.col("_block") * 4 + part).drop("_cut")


def plan_rows(stored: DataFrame, capacities: Callable[[int], list[int]], text: str = "text", key: str = "doc_id",
              seed: int = 29) -> DataFrame:
    """(rid, size, old_shard, shard, slot, moved) of every stored row.

    A block is the rows of one old shard within one power of two of bytes; blocks, not rows, go to the driver. The flow says
    how many rows of a block stay. Where only some do, the block is parted at the size where that falls and the flow is solved again, so
    that exactly the smallest rows go. ``slot`` is gapless from 0 in each shard.
    """
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    slim = stored.select("rid", "old_shard", F.col("row").getField(key).alias("k"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                         F.crc32(body).alias("crc"), F.xxhash64(F.lit(seed), F.col("row").getField(key), body).alias("_h"))
    slim = written(slim, "reshard-rows").withColumn("_block", F.floor(F.log2("size")).cast("int"))
    blocks = _blocks(slim)
    total = sum(b[2] for b in blocks)
    new = capacities(total)
    runs = plan_moves(blocks, new)
    parted = _parted(slim, runs)
    if parted is not None:
        slim = written(parted, "reshard-parted")
        runs = plan_moves(_blocks(slim), new)
    table = F.broadcast(stored.sparkSession.createDataFrame(runs, "_o int, _b int, _first long, _rows long, shard int"))
    placed = with_order(slim, ["old_shard", "_block"], "_h", ["k", "size", "crc"], rows=total)
    hit = placed.join(table, F.col("old_shard").eqNullSafe(F.col("_o")) & (F.col("_block") == F.col("_b"))
                      & (F.col("_index") >= F.col("_first")) & (F.col("_index") < F.col("_first") + F.col("_rows")))
    dealt = written(hit.select("rid", "k", "size", "crc", "old_shard", "shard", "_h"), "reshard-dealt")
    slots = with_order(dealt, ["shard"], "_h", ["k", "size", "crc"], rows=total)
    return written(slots.select("rid", "size", "old_shard", "shard", F.col("_index").alias("slot"),
                                (~F.col("shard").eqNullSafe(F.col("old_shard"))).alias("moved")), "reshard-plan")


def rewrite_shards(stored: DataFrame, plan: DataFrame, path: str) -> tuple[DataFrame, list[int]]:
    """The rows after the plan, (row, old_shard, shard, slot), read back from files, and the numbers of the rewritten shards.

    Shards that gain or lose rows are written as new files under ``path``, a folder per shard, in files of about FILE_BYTES in the order of
    slots; the rows of the other shards are read where they were.
    """
    changed = plan.where("moved").select(F.explode(F.array("old_shard", "shard")).alias("s")).where("s is not null").distinct()
    numbers = sorted(r["s"] for r in changed.collect())
    n, size = plan.agg(F.count(F.lit(1)), F.sum("size")).first()
    each = max(1, n * FILE_BYTES // max(1, size or 0))
    seats = plan.select("rid", "shard", "slot")

    def seated(here: DataFrame) -> DataFrame:
        joined = stored.join(F.broadcast(here) if n <= SENT_ROWS else here, "rid")
        return joined.select("row", "old_shard", "shard", "slot")

    affected = seated(seats.where(F.col("shard").isin(numbers))).withColumn("_file", F.expr(f"slot div {each}"))
    (affected.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file")
     .write.option("compression", "zstd").partitionBy("shard").parquet(path))
    fresh = stored.sparkSession.read.schema(affected.drop("_file").schema).parquet(path).select("row", "old_shard", "shard", "slot")
    rest = seats.where(~F.col("shard").isin(numbers))
    return (fresh.unionByName(seated(rest)) if rest.limit(1).count() else fresh), numbers


def reshard(rows: DataFrame, old_shard: Column, capacities: Callable[[int], list[int]], text: str = "text",
            key: str = "doc_id", seed: int = 29) -> DataFrame:
    """Deals all rows to new shards of given row capacities, moving as few bytes as can be, and rewrites the affected shards.

    Output, a row per input row, read back from the files: key, size, text_crc32, old_shard, shard, slot, moved.
    ``capacities`` gets the row count and returns rows per new shard; old shard i goes on as new shard i.
    Null texts and keys are ordinary rows (a null text has ROW_BYTES bytes); a null old shard is a shard without a
    successor, so all its rows move; equal rows may be in different shards; an empty table gives an empty result. Files hold
    every column of the input, whatever its name.
    """
    stored = stored_shards(rows, old_shard)
    plan = plan_rows(stored, capacities, text, key, seed)
    after, _ = rewrite_shards(stored, plan, scratch_path(rows.sparkSession, "reshard-new"))
    body = F.coalesce(F.col("row").getField(text), F.lit(""))
    return after.select(F.col("row").getField(key).alias(key), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                        F.crc32(body).alias("text_crc32"), "old_shard", "shard", "slot",
                        (~F.col("shard").eqNullSafe(F.col("old_shard"))).alias("moved"))
