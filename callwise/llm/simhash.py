"""SimHash near-duplicates by deletion variants.

A fingerprint is cut into ``most // 2 + 1`` segments, so few that of two fingerprints with ``most`` different bits one
segment differs by one bit at most. Every fingerprint is indexed once per bit under its segment with that bit left
out; fingerprints that meet under one such variant are compared, and those close enough are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm.common import written
from callwise.llm.components import components

SHINGLE = 4
SEED = 42
BITS = 64
MOST = 4
#: Shingle hashes whose bits are counted at once.
HASHES_AT_ONCE = 1 << 15
#: Members of a bucket that a task compares at once; it decides how work is dealt, never a link.
CELL_MEMBERS = 2_048
#: Members up to which the pairs of a bucket are compared by shifting rows, all buckets of a batch at once.
SHIFTED = 48


def fingerprint(text: str | bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of the n-word shingles; 0 without words."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = data.lower().split()  # of bytes: A to Z only, and the six ASCII spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(n, len(words))
    left, right = starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(left), HASHES_AT_ONCE):
        some = [digest(joined[a:b], seed) for a, b in zip(left[at:at + HASHES_AT_ONCE], right[at:at + HASHES_AT_ONCE])]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(left), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp) of every row; texts travel as bytes, so no text can break a task."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["_k", "fp"])

    return slim.mapInArrow(run, f"_k {kind}, fp long").withColumnRenamed("_k", key)


def segments(most: int = MOST) -> list[tuple[int, int]]:
    """(first bit, number of bits) of each segment."""
    n = most // 2 + 1
    cuts = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(segment: int, value: str, most: int = MOST) -> list[str]:
    """SQL for the buckets of a segment's value: for each bit, the value without it; the bit's number stands above."""
    first, width = segments(most)[segment]
    if width > 57:
        raise ValueError("a segment this wide leaves no room for the bit's number; allow 2 different bits or more")
    return [f"({value} & {~(1 << i)}L) + {(first + i) << 57}L" for i in range(width)]


def segment_value(segment: int, most: int = MOST) -> str:
    """SQL for the value of a segment of ``fp``."""
    first, width = segments(most)[segment]
    return f"(shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L)"


def indexed(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """(bucket, fp): every fingerprint under its BITS variants."""
    every = [v for i in range(len(segments(most))) for v in variants(i, segment_value(i, most), most)]
    return nodes.select(F.explode(F.expr(f"array({', '.join(every)})")).alias("bucket"), "fp")


def crowded(nodes: DataFrame, most: int = MOST, size: int = CELL_MEMBERS) -> DataFrame:
    """(bucket, members) of the buckets with more than ``size`` members.

    The members of a variant hold one of two values in its segment. So only variants of values that more than half of
    ``size`` fingerprints hold are counted, and the index is not shuffled where there are none.
    """
    parts = range(len(segments(most)))
    values = ", ".join(f"named_struct('s', {i}, 'v', {segment_value(i, most)})" for i in parts)
    held = nodes.selectExpr(f"inline(array({values}))").groupBy("s", "v").agg(F.count(F.lit(1)).alias("c")).where(f"c > {size // 2}")
    held = written(held, "simhash-held")
    if not held.limit(1).count():
        return held.select(F.col("v").alias("bucket"), F.col("c").alias("members"))
    by_segment = " ".join(f"WHEN {i} THEN array({', '.join(variants(i, 'v', most))})" for i in parts)
    some = held.select(F.explode(F.expr(f"CASE s {by_segment} END")).alias("bucket")).distinct()
    return written(indexed(nodes, most).join(some, "bucket").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("members")).where(f"members > {size}"), "simhash-crowded")


def _close(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _spanning(fps: np.ndarray, labels: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Places (a, b) of links that join all members of a cell that links join; labels are classes already known.

    Every member is compared with those of other classes that no search has reached yet, so a crowd of alike members
    costs little more than one comparison each, and at most one link a member is emitted.
    """
    out = []
    free = np.arange(len(fps))
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            at = queue.pop()
            near = _close(fps[free], fps[at], most) | (labels[free] == labels[at])
            if near.any():
                hit = free[near]
                out += [(at, int(x)) for x in hit if labels[x] != labels[at]]
                queue += hit.tolist()
                free = free[~near]
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (root, node) that join what the pairs join, one less than nodes at most."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = place[:len(a)], place[len(a):], np.arange(len(nodes))
    while (label[x] != label[y]).any():
        np.minimum.at(label, np.maximum(label[x], label[y]), np.minimum(label[x], label[y]))
        while (label[label] != label).any():
            label = label[label]
    below = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[below]], nodes[below]


def _shifted(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links in many small groups that stand one after the other."""
    first, second, alive, d = [], [], np.arange(len(fps)), 0
    while len(alive):
        d += 1
        alive = alive[alive + d < len(fps)]
        alive = alive[keys[alive] == keys[alive + d]]
        near = alive[_close(fps[alive], fps[alive + d], most)]
        first.append(near)
        second.append(near + d)
    return (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (first, second))


def compare_cells(cells: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links inside the cells of (bucket, cell, fp, label), enough to join what links join.

    A cell must fit a task's memory; the rows of one cell are read together, those of many small ones at once.
    """
    dealt = cells.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell")

    def compared(group: pa.Table) -> pa.RecordBatch:
        bucket, cell, fps, labels = (group[c].to_numpy() for c in ("bucket", "cell", "fp", "label"))
        fps = fps.view(np.uint64)
        edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])) + 1
        starts = np.concatenate([[0], edge])
        sizes = np.diff(np.append(starts, len(fps)))
        number = np.repeat(np.arange(len(starts)), sizes)
        small = np.flatnonzero((sizes <= SHIFTED)[number] & (sizes > 1)[number])
        a, b = _shifted(number[small], fps[small], most)
        pairs = [np.stack([small[a], small[b]], axis=1)] if len(small) else []
        for i in np.flatnonzero(sizes > SHIFTED):
            s = slice(starts[i], starts[i] + sizes[i])
            links = _spanning(fps[s], labels[s], most)
            if links:
                pairs.append(np.array(links, np.int64) + starts[i])
        found = fps.view(np.int64)[np.concatenate(pairs)] if pairs else np.zeros((0, 2), np.int64)
        root, node = _forest(found[:, 0], found[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
            bucket, cell = part["bucket"].to_numpy(), part["cell"].to_numpy()
            # What belongs to the last cell waits for the next batch.
            other = np.flatnonzero((bucket != bucket[-1]) | (cell != cell[-1])) if len(part) else []
            last = int(other[-1]) + 1 if len(other) else 0
            if last:
                yield compared(part.slice(0, last))
            rest = part.slice(last)
        if rest is not None and len(rest):
            yield compared(rest)

    return dealt.mapInArrow(run, "a long, b long")


def _block(parts: str, salt: int):
    return F.pmod(F.xxhash64("fp", F.lit(salt)), F.col(parts))


def links(nodes: DataFrame, most: int = MOST, size: int = CELL_MEMBERS) -> DataFrame:
    """(a, b): enough links between the fingerprints of ``nodes`` to join all that links of at most ``most`` bits join.

    A bucket of more than ``size`` members is cut into blocks that are compared each for itself at first. The classes
    found so far are then known: members outside the bucket's largest class are compared block by block with the rest.
    Rows grow with the members, and with the square of those outside the largest class divided by ``size``.
    """
    big = crowded(nodes, most, size)
    every = indexed(nodes, most)
    if not big.limit(1).count():
        return written(compare_cells(every.withColumns({"cell": F.lit(0).cast("long"), "label": F.col("fp")}), most), "simhash-links")
    parts = F.ceil(F.coalesce("members", F.lit(0)) / size) + 1
    cut = every.join(big, "bucket", "left").withColumn("_p", F.when(F.col("members").isNull(), 1).otherwise(parts).cast("long"))
    cells = cut.select("bucket", _block("_p", 1).alias("cell"), "fp", F.col("fp").alias("label"))
    found = written(compare_cells(cells, most), "simhash-links")
    labels = components(found)
    known = every.join(big, "bucket").join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "bucket", "fp", F.coalesce("label", "fp").alias("label"))
    known = written(known, "simhash-crowds")
    counts = known.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("bucket").agg(F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("n_top"), F.sum("c").alias("n"))
    top = written(top.where("n > n_top").select(
        "bucket", "top", F.ceil(F.col("n_top") / size).alias("_t"), F.ceil((F.col("n") - F.col("n_top")) / size).alias("_o")), "simhash-open")
    if not top.limit(1).count():
        return found
    member = known.join(top, "bucket").withColumn("_in", F.col("label") == F.col("top"))
    # Cells are (block of the largest class or -1, block of others, block of others); their numbers are packed into one.
    lists = F.expr("sequence(0L, _o - 1)"), F.expr("sequence(0L, _t - 1)")
    mine = F.when(F.col("_in"), _block("_t", 2)).otherwise(_block("_o", 2))
    member = member.withColumn("_m", mine)
    against = F.transform(F.when(F.col("_in"), lists[0]).otherwise(lists[1]), lambda x: F.when(
        F.col("_in"), F.col("_m") * F.col("_o") + x).otherwise(x * F.col("_o") + F.col("_m")))
    among = F.when(~F.col("_in"), F.transform(lists[0], lambda x: -1 - (F.least(x, "_m") * F.col("_o") + F.greatest(x, "_m"))))
    cells = member.select("bucket", F.explode(F.concat(against, F.coalesce(among, F.array().cast("array<long>")))).alias("cell"), "fp", "label")
    return written(found.union(compare_cells(cells, most)), "simhash-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST,
                    seed: int = SEED, size: int = CELL_MEMBERS) -> DataFrame:
    """A row per input row: key, fingerprint (16 hex digits), component_id (least key that links reach, its own included).

    A text is its words between ASCII spaces, A to Z in lower case; its shingles, repeats included, vote on every bit. Texts of fewer
    words are one shingle. Null, empty and blank texts have fingerprint zero and are linked like any other. Fingerprints
    link at ``most`` or fewer different bits. Null keys never name a component unless it holds no other; equal rows are
    rows of their own; an empty table gives an empty result. Other columns are not looked at.
    """
    rows = written(fingerprints(docs, key, text, shingle, seed), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min(key).alias("least")), "simhash-nodes")
    labels = components(links(nodes.select("fp"), most, size))
    classed = written(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-classes")
    least = classed.groupBy("label").agg(F.min("least").alias("component_id"))
    named = classed.join(least, "label").select("fp", "component_id")
    return rows.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
