"""Dense text vectors fitted on a corpus: rare terms weigh more, and a randomised singular value decomposition finds the directions
that carry most of the term matrix.

The matrix of texts and terms is never written: tasks build rows from texts and multiply them with a matrix of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.config import DEFAULTS

#: Terms of a space: the ones that most texts hold.
TERMS = 16_384
#: Tasks that multiply, more where more run at once, each with a sum of terms x columns numbers (50 MB as set), and texts that make a task worth while.
FIT_TASKS = 32
TASK_ROWS = 2_000
#: Entries of the term matrix whose sums are added at once, and products that are held for that: 2 MB, which stay in the processor's cache.
ENTRIES = 1 << 14
PRODUCTS = 1 << 18


@dataclass
class TextSpace:
    """``basis`` has a row per term and ``dim`` columns of length 1 (0 beyond the rank), the strongest first."""

    terms: list[str]
    weights: np.ndarray
    basis: np.ndarray
    strengths: np.ndarray


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def text_terms(df: DataFrame, text: str, most: int = TERMS) -> DataFrame:
    """(term, texts): the ``most`` terms that the largest numbers of texts hold, ties to the first term."""
    found = df.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("texts"))
    return counts.orderBy(F.desc("texts"), "term").limit(most)


def _counted(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of the texts of a batch, by row."""
    size = np.diff(lists.offsets.to_numpy())
    place = pc.fill_null(pc.index_in(lists.flatten(), value_set=terms), -1).to_numpy()
    row = np.repeat(np.arange(len(size)), size)[place >= 0]
    cell, times = np.unique(row * len(terms) + place[place >= 0], return_counts=True)
    return *np.divmod(cell, len(terms)), times


def _weighed(row: np.ndarray, term: np.ndarray, times: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    """The value of each entry of n texts; rows have length 1."""
    value = times * weights[term]
    length = np.sqrt(np.bincount(row, value * value, n))
    return value / np.where(length[row] > 0, length[row], 1.0)


def _term_counts(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(term, times): the known terms of every text of ``words``, looked up once for all passes; texts without one are left out."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            row, term, times = _counted(batch.column(0), known)
            ends = np.append(0, np.cumsum(np.unique(row, return_counts=True)[1])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, times)], names=["term", "times"])

    return texts.mapInArrow(run, "term array<int>, times array<int>")


def _add_products(key: np.ndarray, other: np.ndarray, value: np.ndarray, lines: np.ndarray, out: np.ndarray) -> None:
    """Adds the sums of ``lines[other] * value`` to the lines ``key`` of ``out``; equal keys stand together. The entries of a key are not
    parted below ENTRIES, so sums do not depend on PRODUCTS; of a key with many entries, some columns are summed at a time."""
    width = lines.shape[1]
    most = max(1, PRODUCTS // max(1, width))
    for at in range(0, len(key), ENTRIES):
        end = min(at + ENTRIES, len(key))
        first = at + np.flatnonzero(np.concatenate([[True], key[at + 1:end] != key[at:end - 1]]))
        stop = np.append(first[1:], end)
        a = 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(stop, first[a] + most, "right")))
            lo, hi = first[a], stop[b - 1]
            step = max(1, PRODUCTS // int(hi - lo))
            for c in range(0, width, step):
                parts = lines[other[lo:hi], c:c + step] * value[lo:hi, None]
                out[key[first[a:b]], c:c + step] += np.add.reduceat(parts, first[a:b] - lo, axis=0)
            a = b


def _projected(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, onto: np.ndarray) -> np.ndarray:
    """The product of n matrix rows with ``onto``."""
    out = np.zeros((n, onto.shape[1]))
    _add_products(row, term, value, onto, out)
    return out


def _back(row: np.ndarray, term: np.ndarray, value: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """Adds the product of the transposed matrix rows with ``x`` to ``out``."""
    order = np.argsort(term, kind="stable")
    _add_products(term[order], row[order], value[order], x, out)


def _multiplied(texts: DataFrame, weights: np.ndarray, q: np.ndarray, inner: bool) -> np.ndarray:
    """A'Aq, or q'A'Aq with ``inner``, for the matrix A of the texts' term counts. Each task sums its texts; its sums meet by line of the result."""
    sent = texts.sparkSession.sparkContext.broadcast((weights, q))
    lines = q.shape[1] if inner else q.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale, onto = sent.value
        total, any_row = np.zeros((lines, onto.shape[1])), False
        for batch in batches:
            size, (term, times) = pc.list_value_length(batch.column(0)).to_numpy(), (c.flatten().to_numpy() for c in batch.columns)
            row = np.repeat(np.arange(len(size)), size)
            if len(row):
                any_row = True
                value = _weighed(row, term, times, len(size), scale)
                x = _projected(row, term, value, batch.num_rows, onto)
                if inner:
                    total += x.T @ x
                else:
                    _back(row, term, value, x, total)
        if any_row:
            at = np.flatnonzero(total.any(axis=1))
            for i in range(0, len(at), 1024):
                some = at[i:i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([x.tobytes() for x in total[some]], pa.binary())], names=["line", "x"])

    def add(column: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py()) for x in column["x"]], axis=0)
        return pa.table({"line": column["line"][:1], "x": pa.array([total.tobytes()], pa.binary())})

    sums = texts.mapInArrow(run, "line long, x binary").groupBy("line").applyInArrow(add, "line long, x binary")
    out = np.zeros((lines, q.shape[1]))
    for r in sums.toLocalIterator():
        out[r["line"]] = np.frombuffer(r["x"])
    sent.destroy()
    return out


def fit_text_space(df: DataFrame, text: str, dim: int = DEFAULTS.embedding_dim, terms: int = TERMS, fit_rows: int | None = None,
                   extra: int = 16, passes: int = 2, seed: int = 17) -> TextSpace:
    """The space of the ``dim`` strongest directions of the term matrix.

    Terms and their weights, ln((1 + texts) / (1 + texts with the term)), come from all texts; directions from all different texts, or,
    if ``fit_rows`` is given, from about so many by their hashes. Each pass multiplies a random matrix of ``dim + extra`` columns with the texts; the driver holds
    that matrix, terms x columns, whatever the number of texts. A null text is empty; a corpus without words gives a space without terms.
    """
    found = [(r["term"], r["texts"]) for r in text_terms(df, text, terms).collect()]
    n = df.count()
    weights = np.log((1.0 + n) / (1.0 + np.array([c for _, c in found], float)))
    names = [t for t, _ in found]
    width = min(dim + extra, len(names))
    basis, strengths = np.zeros((len(names), dim), np.float32), np.zeros(dim)
    if not width:
        return TextSpace(names, weights, basis, strengths)
    mark = F.xxhash64(F.lit(seed), text)
    chosen = df.select(mark.alias("_m"), F.col(text).alias("_t"))
    if fit_rows is not None and n > fit_rows:
        chosen = chosen.where(F.shiftrightunsigned("_m", 34) < int((1 << 30) * fit_rows / n))
    tasks = max(1, min(max(FIT_TASKS, df.sparkSession.sparkContext.defaultParallelism), n // TASK_ROWS))
    # Term counts are smaller than texts, so these are what is dealt out and kept.
    counts = _term_counts(chosen.dropDuplicates(["_m"]).select(words(F.col("_t")).alias("words")), names).repartition(tasks).persist()
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(names), width)))[0]
    for _ in range(passes):
        q = np.linalg.qr(_multiplied(counts, weights, q, False))[0]
    power, turn = np.linalg.eigh(_multiplied(counts, weights, q, True))
    counts.unpersist()
    power, turn = np.maximum(power[::-1], 0.0), turn[:, ::-1]
    kept = min(dim, int((power > 1e-10 * max(power[0], 1e-300)).sum()))
    basis[:, :kept], strengths[:kept] = (q @ turn[:, :kept]), np.sqrt(power[:kept])
    return TextSpace(names, weights, basis, strengths)


def share_space(df: DataFrame, space: TextSpace) -> Broadcast:
    """The space sent to the workers once: terms x dim numbers, 25 MB as set."""
    return df.sparkSession.sparkContext.broadcast(space)


def space_vectors(df: DataFrame, text: str, space: Broadcast, out: str = "embedding") -> DataFrame:
    """``df`` with the unit vector of each text as an array of floats; zeros for a text without weighed terms."""
    def run(lists: pa.Array) -> pa.Array:
        here = space.value
        known, basis, results = pa.array(here.terms, pa.string()), here.basis, []
        for at in range(0, len(lists), 1024):
            some = lists.slice(at, 1024)
            some = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(some).to_numpy())]), pa.int32()), some.flatten())
            row, term, times = _counted(some, known) if len(known) else (np.zeros(0, int),) * 3
            x = _projected(row, term, _weighed(row, term, times, len(some), here.weights), len(some), basis)
            length = np.linalg.norm(x, axis=1, keepdims=True)
            x = (x / np.where(length > 0, length, 1.0)).astype(np.float32)
            results.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())))
        return pa.concat_arrays(results) if results else pa.array([], pa.list_(pa.float32()))

    encode = F.arrow_udf(run, "array<float>")
    return df.withColumn(out, encode(words(F.col(text))))


def space_encoder(space: Broadcast) -> Callable[[DataFrame, str, str], DataFrame]:
    """An encoder for the embedding cache. Its name there should tell the space, as vectors of two spaces do not mix."""
    return lambda df, text, out: space_vectors(df, text, space, out)
