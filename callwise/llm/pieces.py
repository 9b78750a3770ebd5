"""SentencePiece encoding and decoding by N-best search over the piece lattice.

Forward Viterbi scores are exact heuristics of a backward A-star search. Pieces never reach over a space into the
next word, so the lattice of a text falls into lattices of units (spaces and the word after them): forward
and backward scores of all new units of a batch are found at once in numpy, and A-star runs in the few units
that can change the N best paths of a text.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callwise.llm.common import by_bytes

SPACE = "▁"
#: Stands in texts for a SPACE sign of the text itself, which only bytes can spell. No valid text holds it.
OWN_SPACE = "\udc81"
UNITS = re.compile(r" +[^ ]*")
#: Units, and characters of them, kept with their paths by a task before it starts afresh.
KEPT_UNITS = 200_000
KEPT_CHARACTERS = 1 << 22
#: Bytes of text encoded at once.
BATCH_BYTES = 1 << 20
#: Below the least score of a piece; the price of spelling one byte.
BYTE_PENALTY = 10.0
_P = np.uint64(0x9E3779B97F4A7C15)

ENCODED = ("ids array<int>, score double, alternatives array<struct<score:double,"
           "edits:array<struct<at:int,drop:int,ids:array<int>>>>>")


def read_vocabulary(path: str) -> dict:
    """Pieces, scores and byte ids of a model file: tens of thousands of short strings."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, first_byte = [], [], None
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            first_byte = i if first_byte is None else first_byte
        plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        piece = model.id_to_piece(i)
        if plain and SPACE in piece.lstrip(SPACE):
            raise ValueError("a piece reaches over a space")
        pieces.append(piece if plain else None)
        scores.append(model.get_score(i))
    if first_byte is None:
        raise ValueError("the vocabulary has no byte pieces, so texts would not come back whole")
    return {"pieces": pieces, "scores": scores, "first_byte": first_byte}


class Lattice:
    """Paths of units through a vocabulary."""

    def __init__(self, vocabulary: dict) -> None:
        self.pieces, self.first_byte = vocabulary["pieces"], vocabulary["first_byte"]
        known = [(p, i) for i, p in enumerate(self.pieces) if p]
        self.ids = {p: i for p, i in known}
        self.scores = np.array(vocabulary["scores"])
        sane = [vocabulary["scores"][i] for _, i in known if vocabulary["scores"][i] > -1e8]
        self.byte_score = min(sane, default=0.0) - BYTE_PENALTY
        self.longest = max(len(p) for p, _ in known)
        self.keys = np.zeros(len(self.pieces) + 1, np.uint64)  # by id; the last is nobody's
        for p, i in known:
            self.keys[i] = self._hash(p)
        # Slots without collisions: what finds its slot taken goes to the next, smaller table.
        self.tables = []
        ids, bits = np.array([i for _, i in known], dtype=np.int64), 19
        while len(ids):
            mult = np.uint64(2 * len(self.tables) * 0x5851F42D4C957F2D + 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
            slot = (self.keys[ids] * mult) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            id_at = np.full(1 << bits, -1, np.int32)
            id_at[slot[first]] = ids[first]
            self.tables.append((mult, np.uint64(64 - bits), id_at))
            ids, bits = np.delete(ids, first), max(14, bits - 4)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        found = np.full(h.shape, -1, np.int32)
        for mult, shift, id_at in self.tables:
            at = id_at[(h * mult) >> shift]
            found = np.where(self.keys[at] == h, at, found)
        return found

    def best(self, units: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per unit: ids of the best path, its score, and how much worse the second best is (inf: none)."""
        paths: list = [None] * len(units)
        score, delta = np.zeros(len(units)), np.full(len(units), np.inf)
        order = np.argsort([len(u) for u in units], kind="stable")
        at = 0
        while at < len(order):
            stop = at
            longest = len(units[order[at]])
            while stop < len(order) and stop - at < max(1, 400_000 // (len(units[order[stop]]) * self.longest)) \
                    and len(units[order[stop]]) <= longest + longest // 4:
                stop += 1
            stop = max(stop, at + 1)
            some = order[at:stop]
            self._best([units[i] for i in some], some, paths, score, delta)
            at = stop
        return paths, score, delta

    def _best(self, units: list[str], where: np.ndarray, paths: list, score: np.ndarray, delta: np.ndarray) -> None:
        n, lengths = len(units), np.array([len(u) for u in units])
        width = int(lengths.max())
        flat = np.frombuffer("".join(u.ljust(width, "\0") for u in units).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = flat.reshape(n, width).T.copy()  # position by unit
        real = np.where(codes == 0xDC81, 0x2581, codes)
        n_bytes = 1 + (real > 0x7F) + (real > 0x7FF) + (real > 0xFFFF)
        inside = np.arange(width)[:, None] < lengths[None, :]
        spans = min(self.longest, width)
        found, gain = [], []
        h = np.zeros((width, n), np.uint64)
        for k in range(1, spans + 1):
            h = h[:width - k + 1] * _P + (codes[k - 1:].astype(np.uint64) + np.uint64(1))
            ids = np.where(inside[k - 1:], self._find(h), -1)
            s = np.where(ids >= 0, self.scores[ids], -np.inf)
            if k == 1:  # characters without a piece are spelt in bytes
                spelt = (ids < 0) & inside
                ids = np.where(spelt, -2 - real.astype(np.int64), ids)
                s = np.where(spelt, self.byte_score * n_bytes, s)
            found.append(ids)
            gain.append(s)
        head = np.full((width + 1, n), -np.inf)
        head[0] = 0
        back = np.zeros((width + 1, n), np.int64)
        for j in range(1, width + 1):
            for k in range(1, min(spans, j) + 1):
                s = head[j - k] + gain[k - 1][j - k]
                better = s >= head[j]  # of equal paths the one with the longer last piece
                head[j] = np.where(better, s, head[j])
                back[j] = np.where(better & (s > -np.inf), k, back[j])
        cols = np.arange(n)
        total = head[lengths, cols]
        tail = np.full((width + 1, n), -np.inf)
        tail[lengths, cols] = 0
        for i in range(width - 1, -1, -1):
            for k in range(1, min(spans, width - i) + 1):
                tail[i] = np.maximum(tail[i], gain[k - 1][i] + tail[i + k])
        taken, pos = [], lengths.copy()
        while (pos > 0).any():
            live = pos > 0
            k = np.where(live, back[pos, cols], 0)
            start = pos - k
            step = np.zeros(n, np.int64)
            for size in np.unique(k[live]):
                hit = live & (k == size)
                step[hit] = found[size - 1][start[hit], cols[hit]]
                gain[size - 1][start[hit], cols[hit]] = -np.inf  # what is left are edges off the best path
            taken.append(np.where(live, step, -1))
            pos = start
        second = np.full(n, -np.inf)
        for k in range(1, spans + 1):
            through = head[:width - k + 1] + gain[k - 1] + tail[k:]
            second = np.maximum(second, through.max(axis=0))
        steps = np.stack(taken[::-1], axis=1) if taken else np.zeros((n, 0), np.int64)
        special = (steps <= -2).any(axis=1)
        small = np.where((steps <= -2) & (steps >= -2 - 0x7F), self.first_byte - 2 - steps, steps)
        wide = (small <= -2).any(axis=1)
        counts = (small != -1).sum(axis=1)
        ids = small[small != -1].astype(np.int32)
        for i, (w, part) in enumerate(zip(where, np.split(ids, np.cumsum(counts)[:-1]))):
            if special[i] and wide[i]:
                out: list[int] = []
                for x in steps[i][steps[i] != -1]:
                    out += self._bytes(chr(-2 - x)) if x <= -2 else [int(x)]
                part = np.array(out, np.int32)
            paths[w] = part
        score[where] = total
        delta[where] = np.where(second > -np.inf, total - second, np.inf)

    def _bytes(self, char: str) -> list[int]:
        return [self.first_byte + b for b in char.encode("utf-8", "surrogatepass")]

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a unit: forward Viterbi, then A-star from the end with those scores as heuristics."""
        size = len(unit)
        into: list[list[tuple[int, float, list[int]]]] = [[] for _ in range(size + 1)]
        head = [0.0] + [-np.inf] * size
        for j in range(1, size + 1):
            for k in range(1, min(self.longest, j) + 1):
                piece = self.ids.get(unit[j - k:j])
                if piece is not None:
                    into[j].append((j - k, float(self.scores[piece]), [piece]))
                elif k == 1:
                    ids = self._bytes(SPACE if unit[j - 1] == OWN_SPACE else unit[j - 1])
                    into[j].append((j - 1, self.byte_score * len(ids), ids))
            head[j] = max((head[i] + s for i, s, _ in into[j]), default=-np.inf)
        out: list[tuple[float, list[int]]] = []
        heap = [(-head[size], size, [], 0.0)]
        while heap and len(out) < n:
            f, j, ids, g = heapq.heappop(heap)
            if j == 0:
                out.append((-f, ids))
                continue
            for i, s, piece in into[j]:
                if head[i] > -np.inf:
                    heapq.heappush(heap, (-(head[i] + s + g), i, piece + ids, s + g))
        return out


def split_units(text: str) -> list[str]:
    """Units of a text with its dummy space in front; spaces written as SPACE."""
    if SPACE in text:
        text = text.replace(SPACE, OWN_SPACE)
    return UNITS.findall(" " + text)


class Encoder:
    """Encodes texts; keeps the paths of units it has met, up to a bound."""

    def __init__(self, vocabulary: dict, n_best: int) -> None:
        self.lattice, self.n = Lattice(vocabulary), n_best
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.score, self.delta = np.zeros(0), np.zeros(0)
        self.ranked: dict[str, list] = {}
        self.kept = 0

    def learn(self, units: set[str]) -> None:
        fresh = list(units.difference(self.slots))
        if not fresh:
            return
        paths, score, delta = self.lattice.best([u.replace(" ", SPACE) for u in fresh])
        self.slots.update(zip(fresh, range(len(self.score), len(self.score) + len(fresh))))
        self.kept += sum(map(len, fresh))
        sizes = np.fromiter(map(len, paths), np.int64, len(paths))
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, *paths])
        self.score, self.delta = np.concatenate([self.score, score]), np.concatenate([self.delta, delta])

    def alternatives(self, units: list[str], slots: np.ndarray, sizes: np.ndarray, total: float) -> list[dict]:
        """The second to n-th best paths of a text, as edits of the best one.

        Only the n - 1 places with the nearest second-best path can differ in them; their choices are searched best first.
        """
        delta = self.delta[slots]
        near = np.flatnonzero(delta < np.inf)
        if self.n < 2 or not len(near):
            return []
        if len(near) >= self.n:
            cut = np.partition(delta[near], self.n - 2)[self.n - 2]
            near = near[delta[near] <= cut]
            near = near[np.argsort(delta[near], kind="stable")[:self.n - 1]]
        near = np.sort(near)
        options = []
        for i in near:
            u = units[i]
            if u not in self.ranked:
                self.ranked[u] = self.lattice.n_best(u.replace(" ", SPACE), self.n)
            options.append(self.ranked[u])
        first = (0,) * len(near)
        heap, seen, out = [(0.0, first)], {first}, []
        while heap and len(out) < self.n:
            loss, choice = heapq.heappop(heap)
            out.append((loss, choice))
            for i, c in enumerate(choice):
                if c + 1 < len(options[i]):
                    nxt = (*choice[:i], c + 1, *choice[i + 1:])
                    if nxt not in seen:
                        seen.add(nxt)
                        heapq.heappush(heap, (loss + options[i][c][0] - options[i][c + 1][0], nxt))
        before = [int(sizes[:i].sum()) for i in near]
        return [{"score": total - loss, "edits": [
            {"at": before[x], "drop": int(sizes[i]), "ids": options[x][c][1]}
            for x, (i, c) in enumerate(zip(near, choice)) if c]} for loss, choice in out[1:]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list, list]:
        """All ids one after the other, where each text's ids start, scores and alternatives (null for null texts)."""
        cut = [[] if t is None else split_units(t) for t in texts]
        if len(self.slots) > KEPT_UNITS or self.kept > KEPT_CHARACTERS:
            self.clear()
        self.learn(set().union(*cut))
        ends = np.cumsum([0] + [len(u) for u in cut])
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cut)), np.int64, ends[-1])
        sizes = self.start[slots + 1] - self.start[slots]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.arange(stops[-1]) + np.repeat(self.start[slots] - stops[:-1], sizes)]
        scores: list = []
        more: list = []
        for text, units, a, b in zip(texts, cut, ends[:-1], ends[1:]):
            if text is None:
                scores.append(None); more.append(None)
                continue
            scores.append(float(self.score[slots[a:b]].sum()))
            more.append(self.alternatives(units, slots[a:b], sizes[a:b], scores[-1]))
        return ids, stops[ends], scores, more


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary for the executors; its size is that of the model file."""
    return spark.sparkContext.broadcast(read_vocabulary(path))


def encode(docs: DataFrame, vocabulary: Broadcast, text: str = "text", n_best: int = 4, decoded: str | None = None) -> DataFrame:
    """Adds ``ids``, ``score`` and ``alternatives`` (the second to n-th best paths as edits of ``ids``, best first).

    Of paths with equal scores the one with longer last pieces wins, unit by unit. The empty text is the dummy space alone; a null text
    gives nulls; characters without a piece are spelt in bytes, so every text comes back whole. Equal texts get equal
    rows. Invalid UTF-8 becomes U+FFFD. Columns of the input with one of the three names are replaced. ``decoded`` names a column for the text that the ids spell,
    decoded where they are found.
    """
    added = ["ids", "score", "alternatives"] + ([decoded] if decoded else [])
    keep = docs.select(*[c for c in docs.columns if c.lower() not in [a.lower() for a in added]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + ", " + ENCODED
    schema += f", `{decoded}` string" if decoded else ""
    edits = pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("edits", edits)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, spell = Encoder(vocabulary.value, n_best), speller(vocabulary.value)
        for whole in batches:
            for i, j in by_bytes(whole.column(whole.schema.get_field_index(text)), BATCH_BYTES):
                batch = whole.slice(i, j - i)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                flat, starts, scores, more = encoder.encode(texts)
                columns = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts])),
                           pa.array(scores, pa.float64()), pa.array(more, kind)]
                if decoded:
                    columns.append(pa.array([None if t is None else spell(flat[a:b].tolist()) for t, a, b in zip(texts, starts, starts[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return keep.withColumn(text, F.make_valid_utf8(text)).mapInArrow(run, schema)


def speller(vocabulary: dict) -> Callable[[list[int]], str]:
    """A function from ids to their text."""
    first = vocabulary["first_byte"]
    spelt = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") if p else b"" for p in vocabulary["pieces"]]
    spelt[first:first + 256] = [bytes([b]) for b in range(256)]
    return lambda ids: b"".join(map(spelt.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def decode(docs: DataFrame, vocabulary: Broadcast, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null ids give null."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{out}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = speller(vocabulary.value)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 200):
                batch = whole.slice(at, 200)
                column = batch.column(batch.schema.get_field_index(ids))
                texts = [None if x is None else spell(x) for x in column.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """An alternative path from the best one."""
    out, at = [], 0
    for e in sorted(edits, key=lambda e: e["at"]):
        out += [*ids[at:e["at"]], *e["ids"]]
        at = e["at"] + e["drop"]
    return out + ids[at:]


def piece_digest(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, score, the scores of the alternatives, and further columns."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
        "score", F.col("alternatives.score").alias("other_scores"), *more)
