"""Importance resampling towards a target distribution, with a head and a tail of words.

Texts are bags of hashed word runs. Of the frequent words the executors hold the exact CRC state, of the frequent pairs the
bucket; a word run that starts with a known state continues from it, all others take the CRC of their bytes. Both ways
give the same bucket, so the head decides the cost and never a result. Bucket totals of both tables are exact; a document's weight
sums the log ratio of its buckets, and the highest noisy scores are drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwise.llm.common import written

BUCKETS = 10_000
SEED = 2024
#: Percent of the documents that are long enough to be drawn.
PERCENT = 10
LEAST_WORDS = 20
#: Frequent words and pairs that executors hold, the longest of them in bytes, and the documents they are counted in.
HEAD = 50_000
HEAD_BYTES = 48
HEAD_DOCUMENTS = 20_000
#: Features looked up at once.
AT_ONCE = 1 << 18
#: Drawn rows that are ordered in one bucket.
ORDERED_ROWS = 2_000

_LOWER = bytes(range(256)).lower()
_WORDS = bytes(c if c >= 128 or bytes([c]).isalnum() else 32 for c in _LOWER)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters in lower case and bytes of other characters."""
    return (text or b"").translate(_WORDS).split()


class Head(dict):
    """Buckets of word runs; runs that are not frequent are hashed and not kept."""

    def __init__(self, words: list[bytes], pairs: list[bytes], buckets: int) -> None:
        self.states = {w: zlib.crc32(w) for w in words}
        super().__init__({w: c % buckets for w, c in self.states.items()})
        for p in pairs:
            first, rest = p.split(b" ", 1)
            self[p] = zlib.crc32(b" " + rest, self.states.get(first) or zlib.crc32(first)) % buckets
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        cut = run.find(b" ")
        state = self.states.get(run[:cut]) if cut > 0 else None
        return (zlib.crc32(run) if state is None else zlib.crc32(run[cut:], state)) % self.buckets

    def of(self, words: list[bytes], longest: int) -> Iterator[np.ndarray]:
        """The buckets of all runs of 1 to ``longest`` words, a block at a time."""
        for n in range(1, longest + 1):
            for at in range(0, max(0, len(words) - n + 1), AT_ONCE):
                part = words[at:at + AT_ONCE + n - 1]
                runs = part if n == 1 else list(map(b" ".join, zip(*(part[i:] for i in range(n)))))
                runs = runs[:max(0, len(part) - n + 1)]
                yield np.fromiter(map(self.__getitem__, runs), np.int32, len(runs))


def frequent_runs(texts: DataFrame, longest: int, most: int = HEAD, documents: int = HEAD_DOCUMENTS) -> tuple[list[bytes], list[bytes]]:
    """The ``most`` most frequent words, and pairs where runs are longer than a word, in at most about ``documents`` texts.

    The texts are drawn by their hash. Runs of over HEAD_BYTES bytes stay out, so the head has a bounded size.
    """
    total = texts.count()
    share = min(1.0, documents / max(1, total))
    some = texts.where(F.shiftrightunsigned(F.xxhash64("_t"), 33) < int(share * (1 << 31)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch.column(0):
                words = words_of(t.as_py())
                counts.update(w for w in words if len(w) <= HEAD_BYTES)
                if longest > 1:
                    counts.update(p for p in map(b" ".join, zip(words, words[1:])) if len(p) <= HEAD_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["run", "n"])

    counted = some.select("_t").mapInArrow(run, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    counted = written(counted, "target-head")
    found = []
    for is_pair in (False, True):
        rows = counted.where(F.expr("locate(' ', cast(run AS string)) > 0") == is_pair).orderBy(F.desc("n"), "run").limit(most)
        found.append([bytes(r["run"]) for r in rows.collect()])
    return found[0], found[1]


def bucket_totals(texts: DataFrame, head: Broadcast, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts; a task sends one count per bucket it met."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                for found in head.value.of(words_of(t.as_py()), longest):
                    total += np.bincount(found, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("_t").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    b = len(source)
    in_source, in_target = float(source.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1.0) * in_source / ((s + 1.0) * in_target)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: object, seed: int) -> int:
    """A Gumbel draw of the key in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """A row per input row: key, n_words, n_features, weight, score."""
    spark = docs.sparkSession
    source_texts = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t"))
    target_texts = target.select(F.col(target_text).cast("binary").alias("_t"))
    head = spark.sparkContext.broadcast(Head(*frequent_runs(source_texts.select("_t"), longest), buckets))
    gain = gains(bucket_totals(source_texts, head, longest, buckets), bucket_totals(target_texts, head, longest, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(t.as_py())
                n = weight = 0
                for found in head.value.of(words, longest):
                    n += len(found)
                    weight += int(gain[found].sum())
                rows.append((len(words), n, weight, weight + noise(k, seed)))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]],
                                             names=["_k", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return source_texts.mapInArrow(run, f"_k {kind}, n_words long, n_features long, weight long, score long").withColumnRenamed("_k", key)


def numbered(rows: DataFrame, key: str, most: int, among: Column) -> DataFrame:
    """Adds ``rank``: from 1, the place of the ``most`` rows with the highest scores of those ``among``; null for the others.

    Ties go to the smaller key. Quantiles of the scores cut the rows into buckets of about ORDERED_ROWS, each ordered by
    itself; one row per bucket carries the ranks on. ``rows`` should be a written table, as it is read several times.
    """
    head = rows.where(among).agg(F.count(F.lit(1)).alias("n")).first()
    parts = min(4_096, head["n"] // ORDERED_ROWS + 1)
    cuts = [i / parts for i in range(1, parts)] or [0.5]
    borders = rows.where(among).agg(F.percentile_approx("score", cuts, 20_000).alias("q")).first()["q"] or []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(borders))]).cast("array<long>"), lambda b: b > F.col("score")))
    cut = rows.withColumn("_bucket", F.when(among, above))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    opened = cut.where("_bucket IS NOT NULL").groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0")).where(F.col("_n0") < most)
    # One row per bucket, 4,097 at most.
    marked = cut.join(F.broadcast(opened), "_bucket", "left")
    inside = Window.partitionBy("_bucket").orderBy(F.desc("score"), F.col(key).asc_nulls_first())
    place = (F.row_number().over(inside) + F.col("_n0")).cast("long")
    ranked = marked.where("_n0 IS NOT NULL").withColumn("_place", place).withColumn("rank", F.when(F.col("_place") <= most, F.col("_place")))
    rest = marked.where("_n0 IS NULL").withColumn("rank", F.lit(None).cast("long"))
    columns = [*rows.columns, "rank"]
    return ranked.select(*columns).union(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1,
             buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row per input row: key, n_features, weight, score, rank (of the drawn rows, from 1; null for the others).

    Of the rows with ``least_words`` words or more, the ``percent`` with the highest scores are drawn, rounded down. Null, empty and
    wordless texts have no features and weight 0; a null key draws its noise like any key and stands first among ties; equal
    rows take ranks one after the other; an empty table gives an empty result, an empty target leaves all gains to
    the source alone. Other columns of both tables are not looked at.
    """
    rows = written(weighted(docs, target, key, text, target_text, longest, buckets, seed), "target-scores")
    long_enough = F.col("n_words") >= least_words
    most = rows.where(long_enough).count() * percent // 100
    return numbered(rows, key, most, long_enough).select(key, "n_features", "weight", "score", "rank")
