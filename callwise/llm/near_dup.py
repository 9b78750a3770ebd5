"""Near-duplicate documents by order MinHash, verified by banded alignment.

A text becomes its lower-case words. Its k-mers are labelled by occurrence; every sketch takes the k-mers with the least
labelled hashes and keeps them in text order, so that it agrees for texts with a small edit distance. Short texts take shorter
k-mers, as one edit spoils most of their long ones. Texts that share a sketch are candidates; a word alignment within
the band that the threshold allows decides. Candidates are compared inside the cells of a bucket; a cell gives out links that
join its members, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.llm.common import by_bytes, same, written
from callwise.llm.components import components

SIMILARITY = 0.8
SKETCHES = 80
#: k-mers in a sketch.
TAKEN = 2
#: (words below which texts are of the class, words of a k-mer); classes overlap by what the threshold allows.
LENGTHS = ((25, 2), (63, 3), (250, 4), (None, 5))
#: Mask of the bits of a bucket that tell class and place of its sketch.
PLACES = 0x1FF
#: Sketches whose buckets are compared in each round; classes joined in one round are not compared again in the next.
ROUNDS = (1, 9, 70)
#: Members of a block of a crowded bucket, whose signatures are compared (about 400 bytes a member), and words of their texts together.
CELL_MEMBERS = 4096
CELL_WORDS = 4_000_000
#: Members of a block whose texts are aligned in one go.
LINK_MEMBERS = 512
#: Minimum hashes of the bag of words.
BAG_HASHES = 64
#: Hashes computed at once.
HASHES_AT_ONCE = 1 << 16

_P, _P_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word: runs of letters and digits, lower case. Linear in the text, however long."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], _WORD[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up = np.full(len(data) + 1, _P, np.uint64)
    up[0] = 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(up)[:-1], out=sums[1:])
    down = np.full(len(data) + 1, _P_INV, np.uint64)
    down[0] = 1
    return _mix((sums[stop] - sums[start]) * np.cumprod(down)[start] + (stop - start).astype(np.uint64))


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """A hash per run of k words; a shorter text is one run."""
    k = max(1, min(k, len(words)))
    out = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(_P) + words[i:len(words) - k + 1 + i])
    return out


def occurrence_labels(grams: np.ndarray) -> np.ndarray:
    """How often the same k-mer stood earlier in the text."""
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(grams) else np.zeros(0, int)
    out = np.zeros(len(grams), np.uint64)
    runs = np.diff(np.append(first, len(grams)))
    out[order] = (np.arange(len(grams)) - np.repeat(first, runs)).astype(np.uint64)
    return out


def length_classes(n: int, similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """(class, k) of a text of n words. Texts as similar as ``similarity`` have a class in common."""
    out, low = [], 0
    for i, (high, k) in enumerate(LENGTHS):
        if low <= n and (high is None or n < high):
            out.append((i, k))
        low = int(similarity * high) if high else 0
    return out


@lru_cache(maxsize=8)
def _salt(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _hashed(values: np.ndarray, n: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first hash function, [function, value]) of n hash functions, some at a time. The values are well mixed, so that a
    multiplication of 32 bits each suffices for their order."""
    step = max(8, HASHES_AT_ONCE // max(1, len(values)))
    short = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, n, step):
        yield at, short[None, :] * _salt(n, seed)[at:at + step, None]


def sketches(words: np.ndarray, k: int, kind: int = 0, n: int = SKETCHES, seed: int = 7) -> np.ndarray:
    """n hashes of ordered k-mer tuples."""
    grams = kmers(words, k)
    labelled = _mix(grams + occurrence_labels(grams) * np.uint64(0xD6E8FEB86659FD93))
    picked = np.empty((min(TAKEN, len(grams)), n), np.int64)
    for at, h in _hashed(labelled, n, seed):
        rows = np.arange(len(h))
        for i in range(len(picked)):
            best = h.argmin(axis=1)
            picked[i, at:at + len(h)] = best
            h[rows, best] = np.uint32(0xFFFFFFFF)
    place = np.arange(n, dtype=np.uint64) + np.uint64(kind * n)
    code = place.copy()
    for row in np.sort(picked, axis=0):
        code = _mix(code * np.uint64(_P) + grams[row])
    # The last bits tell class and place of the sketch.
    return ((code & ~np.uint64(PLACES)) | place).view(np.int64)


def bag_signature(words: np.ndarray, n: int = BAG_HASHES, seed: int = 9) -> np.ndarray:
    """One byte of each minimum hash of the words, labelled by occurrence; it tells how much two bags overlap."""
    if not len(words):
        return np.zeros(n, np.int8)
    labelled = _mix(words + occurrence_labels(words) * np.uint64(0xD6E8FEB86659FD93))
    least = np.concatenate([h.min(axis=1) for _, h in _hashed(labelled, n, seed)])
    return (_mix(least.astype(np.uint64) * np.uint64(_P)) >> np.uint64(56)).astype(np.uint8).view(np.int8)


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The word edit distance if it is at most ``most``, else None.

    A column of the alignment is two integers with a bit per word of ``a`` (where the distance rises and where it falls
    from word to word), so that a word of ``b`` takes a dozen operations whatever the length. It ends as soon as the
    corner can no longer be reached within the band of ``most``.
    """
    if abs(len(a) - len(b)) > most:
        return None
    # What both texts begin or end with costs nothing.
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    head = int(unlike[0]) if len(unlike) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(unlike[0]) if len(unlike) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if not len(a) or not len(b):
        distance = len(a) + len(b)
        return distance if distance <= most else None
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    every, corner = (1 << len(a)) - 1, 1 << len(a) - 1
    rises, falls, distance, left = every, 0, len(a), len(b)
    for w in b.tolist():
        left -= 1
        here = places.get(w, 0)
        down = here | falls
        across = (((here & rises) + rises) ^ rises) | here
        up_h, down_h = falls | (every & ~(across | rises)), rises & across
        if up_h & corner:
            distance += 1
        elif down_h & corner:
            distance -= 1
        if distance - left > most:
            return None
        up_h, down_h = up_h << 1 | 1, down_h << 1
        rises, falls = (down_h | ~(down | up_h)) & every, up_h & down & every
    return distance if distance <= most else None


def alignment_cost(a: np.ndarray, b: np.ndarray) -> int:
    """The cost of one alignment, hence no less than the edit distance: words that both texts have once, in the
    same order, stand below each other; what lies between two of them is compared word by word."""
    both, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inverse[:len(a)], inverse[len(a):]
    once = (np.bincount(a, minlength=len(both)) == 1) & (np.bincount(b, minlength=len(both)) == 1)
    place = np.zeros(len(both), np.int64)
    place[b] = np.arange(len(b))
    i = np.flatnonzero(once[a])
    j = place[a[i]]
    in_order = (j >= np.maximum.accumulate(j)) & (j <= np.minimum.accumulate(j[::-1])[::-1]) if len(j) else np.zeros(0, bool)
    i, j = np.concatenate([[-1], i[in_order], [len(a)]]), np.concatenate([[-1], j[in_order], [len(b)]])
    di, dj = np.diff(i), np.diff(j)
    at = np.arange(len(a))
    gap = np.searchsorted(i, at, "right") - 1  # the last anchor at or before each word of a
    off = at - i[gap]
    compared = (off >= 1) & (off <= (np.minimum(di, dj) - 1)[gap])
    unlike = a[compared] != b[(j[gap] + off)[compared]]
    return int(unlike.sum() + np.abs(di - dj).sum())


def profile(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of a text's words and of its pairs of words, labelled by occurrence."""
    return tuple(np.sort(_mix(g + occurrence_labels(g) * np.uint64(0xD6E8FEB86659FD93))) for g in (words, kmers(words, 2)))


def profiles_allow(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> bool:
    """Whether the texts may be similar: an edit spoils no more than one word and two pairs of words of either text."""
    longest = max(len(a[0]), len(b[0]))
    most = int((1 - similarity) * longest + 1e-9)
    for q, (x, y) in enumerate(zip(a, b), 1):
        both = np.sort(np.concatenate([x, y]))
        if int((both[1:] == both[:-1]).sum()) < max(len(x), len(y)) - q * most:
            return False
    return True


def edit_similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether some alignment within the band costs little enough; the plain one is tried before the best one."""
    longest = max(len(a), len(b))
    most = int((1 - similarity) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    return alignment_cost(a, b) <= most or edit_distance_within(a, b, most) is not None


def describe(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """(key, _x, node, words, sets, bag): ``node`` is a digest of the words (of the text, if it has none); ``sets`` are the
    sketches of each of its length classes."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_x"), F.make_valid_utf8(text).alias("_t"))
    sets = pa.list_(pa.struct([("kind", pa.int32()), ("marks", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in by_bytes(whole.column(2), 1 << 22):
                batch = whole.slice(i, j - i)
                nodes, counts, marks, bags = [], [], [], []
                for t in batch.column(2).to_pylist():
                    words = word_hashes(t or "")
                    raw = words.tobytes() if len(words) else b"-" + (t or "").encode("utf-8", "surrogatepass")
                    nodes.append(hashlib.blake2b(raw, digest_size=16).digest())
                    counts.append(len(words))
                    marks.append([{"kind": c, "marks": sketches(words, k, c)} for c, k in length_classes(len(words), similarity)] if len(words) else [])
                    bags.append(bag_signature(words).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(counts, pa.int32()), pa.array(marks, sets),
                     pa.array(bags, pa.binary())], names=["_k", "_x", "node", "words", "sets", "bag"])

    return slim.mapInArrow(run, f"_k {kind}, _x long, node binary, words int, sets array<struct<kind:int,marks:array<long>>>, bag binary")


def least_agreement(similarity: float) -> int:
    """Bag hashes that agree for all but about one in 500,000 pairs of just that similarity: they share s / (2 - s) of
    their joint bag at least."""
    share = similarity / (2 - similarity)
    return max(0, int(BAG_HASHES * share - 4.6 * (BAG_HASHES * share * (1 - share)) ** 0.5))


def with_labels(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Adds ``label``, the class so far, to rows of nodes."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def first_cells(members: DataFrame, size: int) -> DataFrame:
    """(bucket, cell, node, words, label, cut) of the buckets with several classes. A large bucket is cut into cells by the hash
    of the node; its least node stands in all of them, so that what is like it joins at once."""
    buckets = members.groupBy("bucket").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(F.sum("words") / CELL_WORDS)).alias("parts"),
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("lead")).where("lo != hi")
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    cells = F.when(F.col("node") == F.col("lead"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own)
    return members.join(buckets, "bucket").select("bucket", F.explode(cells).alias("cell"), "node", "words", "label", (F.col("parts") > 1).alias("cut"))


def open_cells(members: DataFrame, size: int) -> DataFrame:
    """(bucket, cell, node, words, label) of buckets that were cut and still hold several classes: members outside the largest class
    are dealt against it and against each other, block by block.

    Rows grow with the members times the blocks outside the largest class.
    """
    counts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("words").alias("w"))

    def blocks(c: str, w: str) -> Column:
        return F.greatest(F.ceil(F.col(c) / size), F.ceil(F.col(w) / CELL_WORDS))

    top = counts.groupBy("bucket").agg(F.max_by(F.struct("label", "c", "w"), F.struct("c", "label")).alias("t"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    top = top.select("bucket", F.col("t.label").alias("top"), F.col("t.c").alias("tc"), F.col("t.w").alias("tw"),
                     (F.col("c") - F.col("t.c")).alias("oc"), (F.col("w") - F.col("t.w")).alias("ow")).where("oc > 0")
    top = top.select("bucket", "top", blocks("tc", "tw").alias("_t"), blocks("oc", "ow").alias("_o"))
    member = members.join(top, "bucket").withColumn("_in", F.col("label") == F.col("top"))
    member = member.withColumn("_m", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("_in"), F.col("_t")).otherwise(F.col("_o"))))
    others, tops = F.expr("sequence(0L, _o - 1)"), F.expr("sequence(0L, _t - 1)")
    # Cells are numbered (block of the largest class, block of others), and below zero (block of others, block of others).
    against = F.when(F.col("_in"), F.transform(others, lambda x: F.col("_m") * F.col("_o") + x)).otherwise(
        F.transform(tops, lambda x: x * F.col("_o") + F.col("_m")))
    among = F.when(~F.col("_in"), F.transform(others, lambda x: -1 - (F.least(x, "_m") * F.col("_o") + F.greatest(x, "_m"))))
    cells = F.explode(F.concat(against, F.coalesce(among, F.array().cast("array<long>"))))
    return member.select("bucket", cells.alias("cell"), "node", "words", "label")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (bucket, cell, part) after the other; they stand together."""
    rest: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        keys = np.stack([part[c].to_numpy() for c in ("bucket", "cell", "part")], axis=1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        starts = [0, *edges.tolist()]
        for a, b in zip(starts, [*starts[1:], len(part)]):
            if rest and tuple(keys[a]) != last:
                yield pa.concat_tables(rest).combine_chunks()
                rest = []
            rest.append(part.slice(a, b - a))
            last = tuple(keys[a])
    if rest:
        yield pa.concat_tables(rest).combine_chunks()


class Cell:
    """Which members of a cell are candidates of each other."""

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        n = len(rows)
        self.words, self.least, self.similarity = rows["words"].to_numpy(), least_agreement(similarity), similarity
        self.bags = np.frombuffer(b"".join(rows["bag"].to_pylist()), np.uint8).reshape(n, BAG_HASHES)
        self.marks = rows["marks"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        self.table = (rows["bucket"][0].as_py() & PLACES) % SKETCHES
        self.labels = np.unique(np.array(rows["label"].to_pylist(), object), return_inverse=True)[1]

    def candidates(self, x: int, among: np.ndarray) -> np.ndarray:
        """Those of other classes, of fitting length and with a bag alike, that x meets in no earlier sketch."""
        some = among[self.labels[among] != self.labels[x]]
        lo, hi = np.minimum(self.words[some], self.words[x]), np.maximum(self.words[some], self.words[x])
        some = some[lo >= hi * self.similarity - 1e-6]
        if len(some):
            some = some[(self.bags[some] == self.bags[x]).sum(axis=1) >= self.least]
        if len(some) and self.table:
            some = some[~(self.marks[some, :self.table] == self.marks[x, :self.table]).any(axis=1)]
        return some


def _dealt(cells: DataFrame) -> DataFrame:
    """Cells in as many tasks as there are shuffle partitions: their work is large against their bytes, so they are not merged."""
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "bucket", "cell", "part").sortWithinPartitions("bucket", "cell", "part")


def open_members(cells: DataFrame, similarity: float, size: int = LINK_MEMBERS) -> DataFrame:
    """The rows of ``cells`` that have a candidate in their cell; only their texts need be fetched.

    A large cell is cut into parts, each a pair of blocks with a candidate between them; a row is in the parts where it has one.
    """
    dealt = _dealt(cells.withColumn("part", F.lit(0).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            cell, n = Cell(rows, similarity), len(rows)
            met: dict[tuple[int, int], np.ndarray] = {}
            for x in range(n - 1):
                found = cell.candidates(x, np.arange(x + 1, n))
                for block in np.unique(found // size).tolist():
                    here = met.setdefault((x // size, block), np.zeros(n, bool))
                    here[found[found // size == block]] = True
                    here[x] = True
            at = rows.schema.get_field_index("part")
            for part, pair in enumerate(sorted(met)):
                some = rows.filter(pa.array(met[pair]))
                yield from some.set_column(at, "part", pa.array(np.full(len(some), part, np.int64))).to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def cell_links(cells: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the candidates of every cell, enough to join all that links join; one a member at most.

    A search goes from member to member; each is aligned with the candidates that no search has reached, and members of a
    class that is reached are reached.
    """
    dealt = _dealt(cells.join(texts, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            cell, n, words = Cell(rows, similarity), len(rows), {}
            node, text = rows["node"].to_pylist(), rows["text"]

            def of(i: int, words=words, text=text) -> tuple:
                if i not in words:
                    w = word_hashes(text[i].as_py())
                    words[i] = w, profile(w)
                return words[i]

            def linked(x: int, y: int, of=of) -> bool:
                (a, pa_), (b, pb) = of(x), of(y)
                return profiles_allow(pa_, pb, similarity) and edit_similar(a, b, similarity)

            first, second, free = [], [], np.arange(n)
            while len(free):
                queue, free = [int(free[0])], free[1:]
                while queue and len(free):
                    x = queue.pop()
                    hit = [int(y) for y in cell.candidates(x, free) if linked(x, int(y))]
                    first += [node[x]] * len(hit)
                    second += [node[y] for y in hit]
                    reached = np.isin(free, hit) | np.isin(cell.labels[free], cell.labels[[x, *hit]])
                    queue += free[reached].tolist()
                    free = free[~reached]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(second, pa.binary())], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def between_classes(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) with the classes of both ends, la and lb."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias("_l")), end, "left").withColumn(
            f"l{end}", F.coalesce("_l", end)).drop("_l")
    return pairs


def joined_classes(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """The labels after the links of ``found``; only classes are joined."""
    if labels is None:
        return components(found)
    joined = components(between_classes(found, labels).select(F.col("la").alias("a"), F.col("lb").alias("b")))
    up = joined.select(F.col("node").alias("label"), F.col("label").alias("_up"))
    fresh = joined.join(labels.select("node"), "node", "left_anti")
    return written(labels.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")).union(
        fresh.select("node", "label")), "dup-labels")


def joined_in_cells(cells: DataFrame, described: DataFrame, texts: DataFrame, labels: DataFrame | None, similarity: float,
                    part: int = LINK_MEMBERS) -> DataFrame | None:
    """The labels after the links of ``cells``; ``described`` holds the marks of the sketches up to theirs."""
    kind = F.floor(F.col("bucket").bitwiseAND(PLACES) / SKETCHES).cast("int")
    full = cells.withColumn("kind", kind).join(described, ["node", "kind"])
    found = written(cell_links(written(open_members(full, similarity, part), "dup-open"), texts, similarity), "dup-links")
    return joined_classes(labels, found) if found.limit(1).count() else labels


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    size: int = CELL_MEMBERS, part: int = LINK_MEMBERS) -> DataFrame:
    """A row per input row: key, class_id (least key of its class), class_size (rows), kept (the class's row with the least key
    and hash; rows equal in both are all kept), _x (hash of its text).

    Two texts are linked if 1 - edit distance / longer length >= ``similarity``, in words without case and punctuation, and
    they share one of SKETCHES sketches of a length class; classes are the connected components. Equal word sequences are
    one node. Buckets of some sketches are compared in each round; a pair is aligned in the first sketch it shares, unless its classes
    have been joined by then, and unless its bags of words differ more than those of one in 500,000 similar pairs. Texts
    without words, null texts among them (as empty), are classed with equal texts only; invalid UTF-8 counts as U+FFFD. Rows with a null key are documents; equal rows share
    a class; an empty table gives an empty result. Other columns are not looked at.
    """
    rows = written(describe(docs, key, text, similarity), "dup-rows")
    nodes = written(rows.groupBy("node").agg(F.min(F.struct("_k", "_x")).alias("rep"), F.first("sets").alias("sets"),
                                             F.first("bag").alias("bag"), F.first("words").alias("words")), "dup-nodes")
    marks = nodes.select("node", F.explode(F.flatten("sets.marks")).alias("bucket"))
    shared = marks.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("bucket")
    every = written(marks.join(shared, "bucket").join(nodes.select("node", "words"), "node"), "dup-buckets")
    wanted = every.select("node").distinct().join(nodes.select("node", "rep._k", "rep._x"), "node")
    source = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_x"), F.make_valid_utf8(text).alias("text"))
    texts = written(source.alias("s").join(wanted.alias("w"), same("s", "w", ["_k", "_x"])).select("node", "text").dropDuplicates(["node"]), "dup-texts")
    sets = nodes.select("node", "bag", F.inline("sets"))
    labels, begin, place = None, 0, F.col("bucket").bitwiseAND(PLACES) % SKETCHES
    for many in ROUNDS:
        # Whether two texts met in an earlier sketch is told by 32 bits of its marks.
        described = sets.select("node", "bag", "kind", F.transform(F.slice("marks", 1, begin + many), lambda m: F.shiftright(m, 32).cast("int")).alias("marks"))
        members = written(with_labels(every.where((place >= begin) & (place < begin + many)), labels), "dup-members")
        cells = written(first_cells(members, size), "dup-cells")
        labels = joined_in_cells(cells.drop("cut"), described, texts, labels, similarity, part)
        cut = cells.where("cut").select("bucket").distinct()
        if labels is not None and cut.limit(1).count():
            again = written(with_labels(members.drop("label").join(cut, "bucket"), labels), "dup-members")
            labels = joined_in_cells(written(open_cells(again, size), "dup-cells"), described, texts, labels, similarity, part)
        begin += many
    if labels is None:
        labels = nodes.select("node", F.col("node").alias("label")).where("false")
    classed = written(rows.select("_k", "_x", "node").join(labels, "node", "left").select(
        "_k", "_x", F.coalesce("label", "node").alias("label")), "dup-classes")
    totals = classed.groupBy("label").agg(F.min("_k").alias("class_id"), F.min(F.struct("_k", "_x")).alias("least"),
                                          F.count(F.lit(1)).alias("class_size"))
    is_kept = F.col("_k").eqNullSafe(F.col("least._k")) & F.col("_x").eqNullSafe(F.col("least._x"))
    return classed.join(totals, "label").select(F.col("_k").alias(key), "class_id", "class_size", is_kept.alias("kept"), "_x")


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the row with the least key of each class stays (null first)."""
    kept = near_duplicates(docs, key, text, similarity).where("kept").select(F.col(key).alias("_k"), "_x").distinct()
    kept = written(kept, "dup-kept")
    marked = docs.withColumn("_dx", F.xxhash64(text))
    out = marked.alias("d").join(kept.alias("k"), F.col(f"d.{key}").eqNullSafe(F.col("k._k")) & (F.col("d._dx") == F.col("k._x")), "left_semi")
    return out.dropDuplicates([key, "_dx"]).drop("_dx")
