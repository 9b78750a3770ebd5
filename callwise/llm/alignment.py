"""Alignment of the tokens of two tokenizers over the same bytes.

Lanes of a batch move in lockstep: one vector of pointers into the tokens of A and one into those of B advance together,
each step emits a link per lane and a cut where both tokens end, and finished lanes are taken out. A long text has many lanes, one per
LANE tokens of A, so that it takes no more steps than a short one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.llm.common import by_bytes, written

#: Tokens of A in a lane.
LANE = 256
#: Bytes of text that are encoded and aligned at once.
BATCH_BYTES = 1 << 21
#: Different units, and characters of them, that a task keeps with their tokens before it starts afresh.
KEPT_UNITS = 300_000
KEPT_CHARACTERS = 1 << 24
#: Pairs of ids whose counts executors hold at once (16 bytes each); beyond that they are looked up in several passes.
HELD_PAIRS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer file: encodes batches, and knows the bytes of every id."""

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        self.model = Tokenizer.from_str(content.decode())
        self.model.encode_special_tokens = True
        self.model.no_truncation()
        self.model.no_padding()
        alphabet, spec = byte_alphabet(), json.loads(content)
        #: Words are cut off before any merge, so texts may be cut between words.
        self.by_words = spec["pre_tokenizer"].get("use_regex", False)
        special = {t["id"] for t in spec.get("added_tokens", ())}
        self.spelt = [b""] * self.model.get_vocab_size()
        for token, i in self.model.get_vocab().items():
            self.spelt[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A piece model file; it adds the space before the text itself."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.spelt = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
                      for i in range(m.get_piece_size())]
        self.by_words = not any("▁" in m.id_to_piece(i).lstrip("▁") for i in range(m.get_piece_size()))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Lists:
    """Token ids of a batch, one text after the other, with the byte at which each token ends in the batch's bytes."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.end = np.cumsum(lengths[ids])


def lockstep(a: Lists, b: Lists, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B) of each overlap, and of each place where both end, in the order of A within either pair.

    Tokens are numbered through the batch. Both sides of every text must spell the same bytes.
    """
    many = -(-a.sizes // lane)
    text = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    at_a = a.start[text] + nth * lane
    stop = np.minimum(at_a + lane, a.start[text + 1])
    # A lane starts at the token of B that holds the first byte of its first token of A.
    begin = np.where(at_a > 0, a.end[np.maximum(at_a - 1, 0)], 0)
    at_b = np.searchsorted(b.end, begin, "right")
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        end_a, end_b = a.end[at_a], b.end[at_b]
        both = end_a == end_b
        cuts_a.append(at_a[both])
        cuts_b.append(at_b[both])
        at_b = at_b + (end_b <= end_a)
        at_a = at_a + (end_a <= end_b)
        left = at_a < stop
        if not left.all():
            at_a, at_b, stop = at_a[left], at_b[left], stop[left]
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(v) if v else none for v in (links_a, links_b, cuts_a, cuts_b))


class Speller:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, most: int) -> None:
        self.inner, self.bar, self.semi = (np.array([f"{i}{c}" for i in range(most)], object) for c in ",|;")

    def write(self, a: Lists, b: Lists, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """Groups of each text, and their digests."""
        last_a, last_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
        last_a[cut_a] = last_b[cut_b] = 1
        cut_a, cut_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        groups = np.cumsum(last_a)
        words = np.empty(len(a.ids) + len(b.ids), object)
        # A token stands after the earlier ones of its side and after the groups that the other side has ended before it.
        words[np.arange(len(a.ids)) + np.concatenate([[0], cut_b + 1])[groups - last_a]] = np.where(
            last_a, self.bar[a.ids], self.inner[a.ids])
        words[np.arange(len(b.ids)) + (cut_a + 1)[np.cumsum(last_b) - last_b]] = np.where(last_b, self.semi[b.ids], self.inner[b.ids])
        starts = (a.start + b.start).tolist()
        digests = ["" if i == j else hashlib.sha256("".join(words[i:j].tolist())[:-1].encode()).hexdigest() for i, j in zip(starts, starts[1:])]
        return np.diff(np.concatenate([[0], groups])[a.start]), digests


#: A text is cut into units at single spaces between characters that surely are no spaces: both encoders cut there before any merge.
_BETWEEN_WORDS = re.compile("(?<=[!-~À-ɏЀ-ӿ]) (?=[!-~À-ɏЀ-ӿ])")


class Aligner:
    """Encodes and aligns batches of texts. The tokens of a unit are found once and kept, as texts repeat their words."""

    def __init__(self, a_file: bytes, b_file: bytes) -> None:
        self.sides = ByteLevel(a_file), Pieces(b_file)
        self.lengths = [np.array(list(map(len, x.spelt)), np.int64) for x in self.sides]
        self.width = len(self.sides[1].spelt)
        self.speller = Speller(max(len(x.spelt) for x in self.sides))
        self.by_words = all(x.by_words for x in self.sides)
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.kept = 0
        self.flat = [np.zeros(0, np.int64) for _ in self.sides]
        self.start = [np.zeros(1, np.int64) for _ in self.sides]
        self.good = np.zeros(0, bool)

    def learn(self, units: list[str]) -> None:
        """Adds units; one that either side spells otherwise is kept as bad."""
        found = [side.encode([" " + u for u in units] if i == 0 else units) for i, side in enumerate(self.sides)]
        wanted = [(" " + u).encode() for u in units]
        good = np.array([all(b"".join(map(side.spelt.__getitem__, ids[i])) == want for side, ids in zip(self.sides, found))
                         for i, want in enumerate(wanted)], bool)
        self.good = np.concatenate([self.good, good])
        for i, lists in enumerate(found):
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            self.flat[i] = np.concatenate([self.flat[i], np.fromiter(chain.from_iterable(lists), np.int64, sizes.sum())])
            self.start[i] = np.concatenate([self.start[i], self.start[i][-1] + np.cumsum(sizes)])
        self.slots.update(zip(units, range(len(self.slots), len(self.slots) + len(units))))
        self.kept += sum(map(len, units))

    def tokens(self, texts: list[bytes | None]) -> tuple[Lists, Lists]:
        """The tokens of both sides; none for a text that either side spells otherwise."""
        cut = []
        for t in texts:
            try:
                plain = (t or b"").decode()
            except UnicodeDecodeError:
                plain = ""
            cut.append([] if not plain else _BETWEEN_WORDS.split(plain) if self.by_words else [plain])
        if len(self.slots) > KEPT_UNITS or self.kept > KEPT_CHARACTERS:
            self.forget()
        new = [u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in self.slots]
        if new:
            self.learn(new)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cut)), np.int64, many.sum())
        text = np.repeat(np.arange(len(cut)), many)
        bad = np.bincount(text, ~self.good[slots], len(cut)) > 0
        slots, text = slots[~bad[text]], text[~bad[text]]
        out = []
        for flat, start, lengths in zip(self.flat, self.start, self.lengths):
            sizes = start[slots + 1] - start[slots]
            stops = np.cumsum(sizes)
            place = np.arange(stops[-1] if len(stops) else 0) + np.repeat(start[slots] - (stops - sizes), sizes)
            out.append(Lists(flat[place], np.bincount(text, sizes, len(cut)).astype(np.int64), lengths))
        return tuple(out)

    def align(self, texts: list[bytes | None]) -> dict:
        a, b = self.tokens(texts)
        link_a, link_b, cut_a, cut_b = lockstep(a, b)
        text = np.repeat(np.arange(len(texts)), a.sizes)[link_a]
        groups, digests = self.speller.write(a, b, cut_a, cut_b)
        # The different id pairs of each text and how often it holds them linked, sorted as one number.
        most = len(self.sides[0].spelt) * self.width
        held = np.sort(text * most + a.ids[link_a] * self.width + b.ids[link_b])
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(held)))
        return {"n_a": a.sizes, "n_b": b.sizes, "n_groups": groups, "n_links": np.bincount(text, minlength=len(texts)), "digest": digests,
                "pairs": held[first] % most, "times": times.astype(np.int32), "start": np.searchsorted(held[first] // most, np.arange(len(texts) + 1))}


def share_files(spark: SparkSession, a_path: str, b_path: str) -> Broadcast:
    """The two tokenizer files for the executors, as they are; a few megabytes."""
    return spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))


def aligned(docs: DataFrame, files: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: key, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A id * width of B + B id, each once, ascending), times."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t"))
    names = ["_k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        for batch in batches:
            for i, j in by_bytes(batch.column(1), BATCH_BYTES):
                d = aligner.align(batch.column(1).slice(i, j - i).to_pylist())
                start = pa.array(d["start"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(d[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     pa.array(d["digest"], pa.string()), pa.ListArray.from_arrays(start, pa.array(d["pairs"])),
                     pa.ListArray.from_arrays(start, pa.array(d["times"]))], names=names)

    return slim.mapInArrow(run, f"_k {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                "pairs array<long>, times array<int>").withColumnRenamed("_k", key)


def links(docs: DataFrame, files: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The alignment itself, a row per input row: key, ids_a, ids_b, links (token of A, token of B, from 0), cuts (bytes of the
    space and the text up to each place where both sides end a token)."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("_k"), F.col(text).cast("binary").alias("_t"))
    link = pa.struct([("a", pa.int32()), ("b", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        for batch in batches:
            for i, j in by_bytes(batch.column(1), BATCH_BYTES):
                a, b = aligner.tokens(batch.column(1).slice(i, j - i).to_pylist())
                x, y, cuts, _ = lockstep(a, b)
                order = np.lexsort((y, x))
                x, y, cuts = x[order], y[order], np.sort(cuts)
                at_link, at_cut = (np.searchsorted(v, a.start).astype(np.int32) for v in (x, cuts))
                per_link = np.repeat(np.arange(j - i), np.diff(at_link))
                base = np.concatenate([[0], a.end])[a.start[:-1]]
                pairs = pa.StructArray.from_arrays([pa.array((x - a.start[per_link]).astype(np.int32)),
                                                    pa.array((y - b.start[per_link]).astype(np.int32))], fields=list(link))
                ends = a.end[cuts] - np.repeat(base, np.diff(at_cut))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i),
                     *[pa.ListArray.from_arrays(pa.array(v.start.astype(np.int32)), pa.array(v.ids.astype(np.int32))) for v in (a, b)],
                     pa.ListArray.from_arrays(pa.array(at_link), pairs), pa.ListArray.from_arrays(pa.array(at_cut), pa.array(ends))],
                    names=["_k", "ids_a", "ids_b", "links", "cuts"])

    return slim.mapInArrow(run, f"_k {kind}, ids_a array<int>, ids_b array<int>, links array<struct<a:int,b:int>>, cuts array<long>"
                           ).withColumnRenamed("_k", key)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """(pair, a, n, highest): texts that hold each pair of ids linked, and the most that hold a pair of the same A id."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "a", F.expr(f"pair div {width}")), "align-counts")
    return counts.join(counts.groupBy("a").agg(F.max("n").alias("highest")), "a")


def with_counts(rows: DataFrame, counts: DataFrame, width: int, held: int = HELD_PAIRS) -> DataFrame:
    """``rows`` (with a unique ``_row``) plus n_best and count_sum, without their pairs.

    Pairs that one text alone holds need no table: what is not found counts 1, and is the best of its A id if that id has no
    pair in two texts. The others are sent to the executors, ``held`` at a time; a larger table takes several passes over the
    rows, each responsible for the pairs of one remainder.
    """
    single = np.sort(np.array([r["a"] for r in counts.where("highest = 1").select("a").distinct().collect()], np.int64))  # ids of A at most
    common = written(counts.where("n > 1").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "align-common")
    passes = max(1, -(-common.count() // held))
    keep = [c for c in rows.columns if c not in ("pairs", "times")]
    context, parts = rows.sparkSession.sparkContext, []
    for i in range(passes):
        table = common.where(F.pmod("pair", F.lit(passes)) == i).toArrow().sort_by("pair")
        sent = context.broadcast((*[table[c].to_numpy() for c in ("pair", "n", "best")], single, width, passes, i))
        if passes == 1:
            return _summed(rows, sent, keep)
        parts.append(written(_summed(rows, sent, ["_row"]), "align-sums"))
        sent.unpersist()
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.union(p)
    return rows.select(*keep).join(sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "_row")


def _summed(rows: DataFrame, sent: Broadcast, keep: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best, single, width, passes, own = sent.value
        known, n, best = np.append(known, -1), np.append(n, 1), np.append(best, False)  # the last place is nobody's
        for batch in batches:
            pairs, times = batch.column(len(keep)), batch.column(len(keep) + 1)
            flat, weight = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            start = np.concatenate([[0], np.cumsum(pairs.value_lengths().to_numpy())])
            at = np.searchsorted(known[:-1], flat)
            at = np.where(known[at] == flat, at, len(known) - 1)
            alone = at == len(known) - 1
            is_best = np.where(alone, np.isin(flat // width, single), best[at])
            mine = weight * (flat % passes == own)
            sums = []
            for value in (is_best, n[at]):
                upto = np.concatenate([[0], np.cumsum(value * mine)])
                sums.append(pa.array((upto[start[1:]] - upto[start[:-1]]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *sums], names=[*keep, "n_best", "count_sum"])

    return rows.select(*keep, "pairs", "times").mapInArrow(run, schema)


def align_corpus(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", held: int = HELD_PAIRS) -> DataFrame:
    """A row per input row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level tokenizer file, ``b_path`` a piece model; A encodes a space and the text, B the text. Links are the pairs of
    tokens whose bytes overlap, groups lie between the places where both end a token. A pair of ids counts the rows that hold
    it linked; n_best counts a row's links whose pair no other pair of that A id outdoes, count_sum adds the counts of all its
    links. Null and empty texts, texts that are no valid UTF-8 and those that either side spells otherwise have no tokens:
    zeros and an empty digest. Null keys and equal rows are rows like any others; an empty table gives an empty result. Other
    columns are not looked at.
    """
    files = share_files(docs.sparkSession, a_path, b_path)
    width = Pieces(files.value[1]).model.get_piece_size()
    rows = written(aligned(docs, files, key, text).withColumn("_row", F.monotonically_increasing_id()), "align-rows")
    return with_counts(rows, pair_counts(rows, width), width, held).select(
        key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
