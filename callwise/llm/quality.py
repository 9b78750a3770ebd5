"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of character shapes and of repeated words and lines, weighted by their rarity in
all documents and projected by the singular vectors of a bounded labelled sample. Every document meets all labelled
vectors in exact blocked products; its nearest neighbours vote with their cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.llm.common import lowest, written

#: Labelled rows to fit on at most, taken in hash order; the only bound on what is read.
FIT_ROWS = 6_000
BINS = 2_048
RANK = 48
NEIGHBOURS = 25
#: Of 5 parts of the documents the one that is never learnt from.
FOLDS = 5
THRESHOLD = 0.3
#: Rows whose counts by bin are spread out at once in the fit.
ROWS_AT_ONCE = 256

_SHAPE = np.zeros(256, np.uint64)
_SHAPE[128:] = _SHAPE[ord("a"):ord("z") + 1] = 1  # letters, those outside ASCII with them
_SHAPE[ord("A"):ord("Z") + 1] = 2
_SHAPE[ord("0"):ord("9") + 1] = 3
for _i, _b in enumerate(b" \n\t\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SHAPE[_b] = 4 + _i


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % FOLDS == 0


def text_counts(text: str | None) -> np.ndarray:
    """Counts of a whole text by bin."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(BINS)
    if len(data) >= 3:
        s = _SHAPE[data]
        code = (s[:-2] * np.uint64(4096) + s[1:-1] * np.uint64(64) + s[2:]) * np.uint64(0x9E3779B97F4A7C15)
        out += np.bincount((code >> np.uint64(40)).astype(np.int64) % (BINS - 2), minlength=BINS)
    words = (text or "").split()
    lines = (text or "").split("\n")
    out[BINS - 2] = 3 * sum(map(eq, words, words[1:]))
    out[BINS - 1] = 3 * (len(lines) - len(set(lines)))
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts to rows of length 1 (or 0): shares of the text, damped, times rarity."""
    x = np.log1p(1000 * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) * idf
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def corpus_rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """log((1 + n) / (1 + documents with the bin)) per bin, over all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += text_counts(t) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())],
                                         names=["bin", "n"])

    rows = docs.select(text).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BINS + 1)
    for r in rows:
        found[r["bin"]] = r["n"]
    return np.log((1 + found[BINS]) / (1 + found[:BINS])) + 0.1


def singular_vectors(x: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration."""
    q = np.random.default_rng(seed).standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        rows: int = FIT_ROWS) -> dict:
    """The voting model: rarity, projection, labelled vectors (at most ``rows``) and their labels.

    Labels of held-out documents, null labels and labels of unknown documents are not used; a document with
    several labels has their rounded mean. Without usable labels every score is 0.5.
    """
    known = (labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
             .groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("_y")))
    there = docs.select(key).distinct()
    usable = written(known.join(there, key).withColumn("_h", F.xxhash64(key)), "quality-labels")
    chosen = lowest(usable, "_h", rows, usable.count()).drop("_h")
    sample = docs.select(key, text).join(F.broadcast(chosen), key).dropDuplicates([key])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_counts(t) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([i.astype(np.int32).tobytes() for i in at], pa.binary()),
                 pa.array([c[i].astype(np.float32).tobytes() for c, i in zip(counts, at)], pa.binary())], names=["k", "y", "at", "n"])

    kind = docs.schema[key].dataType.simpleString()
    found = sorted(sample.select(key, text, "_y").mapInArrow(sparse, f"k {kind}, y int, at binary, n binary").collect())
    idf = corpus_rarity(docs, text)
    # The driver holds the sample once, in single precision; counts are spread out for a few rows at a time.
    x = np.empty((len(found), BINS), np.float32)
    for first in range(0, len(found), ROWS_AT_ONCE):
        some = found[first:first + ROWS_AT_ONCE]
        counts = np.zeros((len(some), BINS))
        for row, r in zip(counts, some):
            row[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["n"], np.float32)
        x[first:first + len(some)] = weighted(counts, idf)
    basis = singular_vectors(x, min(RANK, max(1, len(found)))) if len(found) else np.zeros((BINS, 1), np.float32)
    return {"idf": idf, "basis": basis, "vectors": project(x, basis), "labels": np.array([r["y"] for r in found], np.float32)}


def project(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    z = x @ basis
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)


def vote(model: dict, texts: list[str | None], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts: the neighbours' labels weighted by their cosine, sharpened; texts without any shape get the mean label."""
    y = model["labels"]
    prior = float(y.mean()) if len(y) else 0.5
    out = np.full(len(texts), prior)
    k = min(neighbours, len(y))
    for at in range(0, len(texts) if k else 0, 512):
        z = project(weighted(np.stack([text_counts(t) for t in texts[at:at + 512]]), model["idf"]), model["basis"])
        cos = z @ model["vectors"].T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 4
        total = w.sum(axis=1)
        votes = (w * y[near]).sum(axis=1)
        out[at:at + 512] = np.where(total > 0, votes / np.maximum(total, 1e-30), prior)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: Broadcast, text: str = "text", out: str = "score", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``out`` (0 to 1, higher for label 1) and ``predicted``, for every row; null texts count as empty ones.

    Columns of the input with these names are replaced. Equal texts get equal scores. An empty table gives an empty one.
    """
    keep = docs.select(*[c for c in docs.columns if c.lower() not in (out, "predicted")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = vote(model.value, batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*batch.schema.names, out])

    return keep.mapInArrow(run, schema).withColumn("predicted", (F.col(out) >= threshold).cast("int"))
