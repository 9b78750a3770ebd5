"""Removal of repeated byte strings over a whole corpus, by suffix arrays of shards that hold all that can be equal.

Every stretch of LENGTH bytes belongs to a content anchor (see anchors.py), so equal stretches lie in snippets with the same
anchor. A snippet that is repeated as a whole needs its first place only. Snippets that share an anchor but
differ go, once each, to the shard of the anchor; the shard's suffix array and permuted common prefixes give every
stretch that an earlier snippet has too. Anchors with very many different snippets, as at the border of a
passage that countless documents share, are settled by aggregating their stretches instead, so no shard grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.llm.anchors import GRAM, Powers, PrefixHash, anchored_runs
from callwise.llm.common import same, written
from callwise.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 100
#: Bytes aimed at per suffix array.
SHARD_BYTES = 250_000
#: Different snippets of one anchor from which on its stretches are aggregated.
HOT_SNIPPETS = 2_000
#: Bytes of texts hashed at once; a longer text is taken alone, in overlapping pieces.
CHUNK = 1 << 20

_COVER = "cover array<struct<lo:int,hi:int>>"


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Batches of (text number, offset, bytes). Pieces of a long text overlap by length - 1, so each stretch lies in one piece."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = t[at:at + CHUNK + length - 1]
            if len(piece) < length:
                continue
            if size + len(piece) > 2 * CHUNK and batch:
                yield batch
                batch, size = [], 0
            batch.append((i, at, piece))
            size += len(piece)
    if batch:
        yield batch


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, _x, _t): key, a checksum of the text as an int, its bytes."""
    checksum = (F.crc32(F.coalesce(text, F.lit(""))) - F.lit(1 << 31)).cast("int")
    return docs.select(F.col(key).alias("_k"), checksum.alias("_x"), F.col(text).cast("binary").alias("_t"))


def _runs(texts: list[bytes | None], length: int, powers: Powers) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, anchor hash, snippet hash, anchor, shape) of the snippets, some texts at a time."""
    for group in _pieces([t or b"" for t in texts], length):
        data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
        bounds = np.cumsum([len(p) for _, _, p in group])
        owner, a, s, q, first, last = anchored_runs(data, bounds, length, powers)
        base = (np.concatenate([[0], bounds[:-1]]) - np.array([at for _, at, _ in group]))[owner]
        doc = np.array([i for i, _, _ in group])[owner]
        yield doc, a.view(np.int64), s.view(np.int64), (q - base).astype(np.int32), ((q - first) * 1024 + (last + length - first)).astype(np.int32)


def anchor_pairs(docs: DataFrame, text: str, length: int) -> DataFrame:
    """(a, lo, hi): the anchors of some texts with the least and the greatest of their snippets' hashes, and ``n``, how many they have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, a, s, _, _ in _runs(batch.column(0).to_pylist(), length, powers):
                order = np.argsort(a, kind="stable")
                a, s = a[order], s[order]
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
                lo, hi = (f.reduceat(s, first) if len(a) else s for f in (np.minimum, np.maximum))
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(lo), pa.array(hi), pa.array(np.diff(np.append(first, len(a))))],
                                                 names=["a", "lo", "hi", "n"])

    return docs.select(F.col(text).cast("binary").alias("_t")).mapInArrow(run, "a long, lo long, hi long, n long")


def anchor_rows(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(_k, _x, a, s, q, shape): a row per snippet; shape is 1024 * (anchor - first byte) + bytes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for doc, *columns in _runs(batch.column(2).to_pylist(), length, powers):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), batch.column(1).take(pa.array(doc)), *map(pa.array, columns)],
                    names=["_k", "_x", "a", "s", "q", "shape"])

    slim = _keyed(docs, key, text)
    return slim.mapInArrow(run, f"_k {kind}, _x int, a long, s long, q int, shape int")


def snippets_of(docs: DataFrame, places: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(a, s, first, bytes, kl, kr) of the snippets at their first places.

    Any stretch around an anchor holds at least half of what it has besides the anchor on one side; kl and kr hash the
    anchor with that much to its left and right (null where the snippet is too short). Snippets that agree with no
    other in either share no stretch.
    """
    kind = docs.schema[key].dataType.simpleString()
    half = (length - GRAM + 1) // 2
    of_doc = places.groupBy("first._k", "first._x").agg(F.collect_list(F.struct("a", "s", F.col("first.q").alias("q"), "shape")).alias("places"))
    source = _keyed(docs, key, text)
    both = source.alias("d").join(of_doc.alias("p"), same("d", "p", ["_k", "_x"])).select("d._k", "d._x", "_t", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                places = batch.column(3)
                a, s, q, shape = (f.to_numpy() for f in places.flatten().flatten())
                many = places.value_lengths().to_numpy()
                left, size = shape // 1024, shape % 1024
                start, kl, kr = q - left, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
                bodies, stops = [], np.cumsum(many)
                for t, i, j in zip(batch.column(2).to_pylist(), stops - many, stops):
                    # Hashes do not depend on where bytes stand, so one pass over the text serves all its snippets.
                    body = PrefixHash(np.frombuffer(t, np.uint8), powers)
                    at = q[i:j].astype(np.int64)
                    kl[i:j] = body(np.maximum(at - half, 0), at + GRAM).view(np.int64)
                    kr[i:j] = body(at, np.minimum(at + GRAM + half, len(t))).view(np.int64)
                    bodies += [t[x:x + n] for x, n in zip(start[i:j].tolist(), size[i:j].tolist())]
                of_text = pa.array(np.repeat(np.arange(batch.num_rows), many))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(s), batch.column(0).take(of_text), batch.column(1).take(of_text), pa.array(q), pa.array(bodies, pa.binary()),
                     pa.array(kl, mask=left < half), pa.array(kr, mask=left + GRAM + half > size)],
                    names=["a", "s", "_k", "_x", "q", "body", "kl", "kr"])

    made = both.mapInArrow(run, f"a long, s long, _k {kind}, _x int, q int, body binary, kl long, kr long")
    return made.dropDuplicates(["a", "s"]).select("a", "s", F.struct("_k", "_x", "q").alias("first"), "body", "kl", "kr")


def _covers(starts: np.ndarray, length: int) -> list[dict]:
    """Sorted starts of repeated stretches to the byte runs they cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return [{"lo": int(a), "hi": int(b) + length} for a, b in zip(starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])])]


def repeated_in_shard(bodies: list[bytes], length: int = LENGTH) -> list[list[dict]]:
    """Per snippet, in order of first places: the byte runs covered by stretches that an earlier snippet has too."""
    sizes = np.array([len(b) for b in bodies])
    symbols = np.concatenate([np.append(np.frombuffer(b, np.uint8).astype(np.int64) + 2, 1) for b in bodies] + [np.zeros(1, np.int64)])
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    owner = np.append(np.repeat(np.arange(len(bodies)), sizes + 1), len(bodies))
    sa = suffix_array(symbols, 258)
    shared = permuted_common_prefixes(symbols, sa, length)[sa] >= length
    full = np.arange(len(symbols)) + length <= np.append(start[1:] - 1, 0)[owner]  # the stretch ends within its snippet
    # Suffixes of a run that shares `length` bytes stand together; all but the earliest snippet's repeat it.
    group = np.cumsum(~shared)
    usable = full[sa]
    sa, group = sa[usable], group[usable]
    order = np.lexsort((owner[sa], group))
    sa, group = sa[order], group[order]
    later = np.concatenate([[False], group[1:] == group[:-1]]) if len(sa) else np.zeros(0, bool)
    again = np.sort(sa[later])
    parts = np.split(again, np.searchsorted(again, start[1:len(bodies)]))
    return [_covers(p - s, length) for p, s in zip(parts, start[:-1])]


def shard_covers(snippets: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(a, s, cover) of snippets some stretch of which an earlier snippet of their anchor has."""
    total = snippets.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank", kind="stable")
        cover = repeated_in_shard(part["body"].tolist(), length)
        out = pd.DataFrame({"a": part["a"].to_numpy(), "s": part["s"].to_numpy(), "cover": cover})
        return out[[len(c) > 0 for c in cover]]

    # A rank within the shard stands for the first place, of any key type.
    ranked = snippets.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards)))
    ranked = ranked.withColumn("rank", F.expr("row_number() over (partition by shard order by first)"))
    return ranked.select("shard", "rank", "a", "s", "body").groupBy("shard").applyInPandas(run, f"a long, s long, {_COVER}")


def hot_covers(snippets: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many snippets: the earliest snippet of every stretch, by aggregation."""
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                body = np.frombuffer(row.column(3)[0].as_py(), np.uint8)
                n = len(body) - length + 1
                h = PrefixHash(body, powers)(np.arange(n), np.arange(n) + length)
                repeat = pa.array(np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c).take(repeat) for c in range(3)), pa.array(np.arange(n, dtype=np.int32)), pa.array(h.view(np.int64))],
                    names=["a", "s", "first", "lo", "h"])

    kind = snippets.schema["first"].dataType.simpleString()
    rows = written(snippets.select("a", "s", "first", "body").mapInArrow(stretches, f"a long, s long, first {kind}, lo int, h long"), "sa-hot")
    earliest = rows.groupBy("a", "h").agg(F.min("first").alias("_e"))
    again = rows.join(earliest, ["a", "h"]).where("first != _e")
    return again.groupBy("a", "s").agg(F.sort_array(F.collect_list(F.struct("lo", (F.col("lo") + length).alias("hi")))).alias("cover"))


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   hot: int = HOT_SNIPPETS) -> DataFrame:
    """(_k, _x, lo, hi): byte runs of documents that are covered by a ``length``-byte string that also starts earlier."""
    # Anchors that occur once go first; what is left is a small part of the rows, written once.
    repeated = written(anchor_pairs(docs, text, length).groupBy("a").agg(F.sum("n").alias("_n"), (F.min("lo") != F.max("hi")).alias("several"))
                       .where("_n > 1").select("a", "several"), "sa-anchors")
    rows = written(anchor_rows(docs, key, text, length).join(repeated, "a"), "sa-rows")
    firsts = rows.groupBy("a", "s").agg(F.min(F.struct("_k", "_x", "q")).alias("first"), F.max("shape").alias("shape"),
                                        F.count(F.lit(1)).alias("n"), F.first("several").alias("several"))
    firsts = written(firsts, "sa-firsts")
    snippets = written(snippets_of(docs, firsts.where("several"), key, text, length), "sa-snippets")
    sides = snippets.select("a", "s", F.explode(F.array("kl", "kr")).alias("side"), F.lit(1)).where("side is not null")
    agreed = sides.groupBy("side").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("side")
    wanted = sides.join(agreed, "side").select("a", "s").distinct()
    wanted = written(snippets.select("a", "s", "first", "body").join(wanted, ["a", "s"]), "sa-wanted")
    crowded = wanted.groupBy("a").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > hot).select("a")
    crowded = written(crowded, "sa-hot-anchors")
    covers = shard_covers(wanted.join(crowded, "a", "left_anti"), length, shard_bytes)
    if crowded.limit(1).count():
        covers = covers.union(hot_covers(wanted.join(crowded, "a"), length))
    covers = written(covers, "sa-covers")
    known = firsts.join(covers, ["a", "s"], "left").where("n > 1 or cover is not null")
    known = written(known.select("a", "s", "first", "cover"), "sa-known")
    hit = rows.join(known, ["a", "s"])
    start, size = F.col("q") - F.expr("shape div 1024"), F.col("shape") % 1024
    is_first = F.struct("_k", "_x", "q").eqNullSafe(F.col("first"))
    whole = F.array(F.struct(start.alias("lo"), (start + size).alias("hi")))
    part = F.transform("cover", lambda c: F.struct((start + c["lo"]).alias("lo"), (start + c["hi"]).alias("hi")))
    return hit.select("_k", "_x", F.explode(F.when(is_first, part).otherwise(whole)).alias("c")).select("_k", "_x", "c.lo", "c.hi")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   hot: int = HOT_SNIPPETS) -> DataFrame:
    """A row per input row: key, n_bytes, removed (array of byte runs, maximal and in order), kept (the remaining bytes).

    A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in a document with a smaller key
    (null first, then, for equal keys, by the checksum of the text) or earlier in the same one. Strings are those of
    the input; matches do not cross documents. Null texts are empty, texts below ``length`` bytes stay as they are, rows
    equal in key and text are one document and come out alike; an empty table gives an empty result.
    """
    runs = repeated_bytes(docs, key, text, length, shard_bytes, hot)
    of_doc = runs.groupBy("_k", "_x").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    source = _keyed(docs, key, text)
    both = source.alias("d").join(of_doc.alias("r"), same("d", "r", ["_k", "_x"]), "left").select("d._k", "_t", "runs")
    kind = docs.schema[key].dataType.simpleString()
    spans = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 500):
                batch = whole.slice(at, 500)
                sizes, removed, kept = [], [], []
                for t, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    body, merged = t or b"", []
                    for r in sorted(runs or [], key=lambda r: (r["lo"], r["hi"])):
                        if merged and r["lo"] <= merged[-1]["hi"]:
                            merged[-1]["hi"] = max(merged[-1]["hi"], r["hi"])
                        else:
                            merged.append(dict(r))
                    parts, done = [], 0
                    for r in merged:
                        parts.append(body[done:r["lo"]])
                        done = r["hi"]
                    sizes.append(len(body)); removed.append(merged); kept.append(b"".join(parts) + body[done:])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, spans), pa.array(kept, pa.binary())],
                                                 names=["_k", "n_bytes", "removed", "kept"])

    out = both.mapInArrow(run, f"_k {kind}, n_bytes long, removed array<struct<lo:int,hi:int>>, kept binary")
    return out.select(F.col("_k").alias(key), "n_bytes", "removed", "kept")


def digest(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + (r["hi"] - r["lo"]))
    return removed.select(key, "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                          F.sha2("kept", 256).alias("kept_sha256"))
