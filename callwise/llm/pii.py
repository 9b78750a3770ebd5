"""Personal data: exact patterns, and a character-level BiLSTM-CRF that finds further spans.

The tagger is trained on windows labelled by the patterns and on other ways of writing the same data. Windows overlap by
half; a span counts where a window holds it whole, and what windows say is reconciled over the whole text. A span of
any kind holds a digit or an at sign, so windows without either need no decoding.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwise.llm.common import lowest, written
from callwise.llm.tagger import Tagger, char_classes

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN = 16
STEPS = 400
#: Labelled windows to fit on at most: with spans, without.
FIT_WINDOWS = (2_500, 1_500)
#: Windows decoded at once.
DECODED = 2_048

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0  # the pattern's local part reaches back to the end of the last match; no position is tried twice
    at = text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if m and start < at:
            yield start, m.end()
            done = m.end()
        else:
            done = at
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The contract's patterns, leftmost and non-overlapping per kind; linear in the text."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the overlapping windows that hold a digit or an at sign."""
    starts, last = set(), -1
    for m in _ANCHOR.finditer(text):
        block = m.start() // STRIDE
        if block != last:
            last = block
            starts.add(block * STRIDE)
            if block:
                starts.add((block - 1) * STRIDE)
    return sorted(starts)


def _windows(classes: np.ndarray, starts: list[int]) -> np.ndarray:
    padded = np.concatenate([classes, np.zeros(WINDOW, np.uint8)])
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)]


def _tags(spans: dict[str, list[tuple[int, int]]], size: int) -> np.ndarray:
    """0 outside, 2k + 1 first and 2k + 2 further characters of kind k; an earlier kind wins."""
    out = np.zeros(size, np.int8)
    for k in reversed(range(len(KINDS))):
        for s, e in spans[KINDS[k]]:
            out[s:e] = 2 * k + 2
            out[s] = 2 * k + 1
    return out


def other_forms(rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows with ways of writing personal data that the patterns miss, and look-alikes that are none."""
    x, y = np.zeros((n, WINDOW), np.uint8), np.zeros((n, WINDOW), np.int8)
    word = lambda: "".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(2, 9)))
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    forms = (
        (4, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"), (4, lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        (4, lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"), (1, lambda: f"{word()}.{digits(2)}@{word()}.{word()}.com"),
        (3, lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}"), (2, lambda: ".".join(digits(rng.integers(1, 4)) for _ in range(4))),
        (0, lambda: f"{digits(4)}-{digits(2)}-{digits(2)}"), (0, lambda: f"{digits(1)}.{digits(1)}."),
        (0, lambda: f"{word()}{digits(2)}{word()}{digits(5)}"), (0, lambda: f"{digits(rng.integers(1, 6))} {word()}"))
    for i in range(n):
        kind, make = forms[rng.integers(len(forms))]
        left, said = " ".join(word() for _ in range(rng.integers(0, 7)))[-30:], make()
        left += " " if left else ""
        text = (left + said + " " + " ".join(word() for _ in range(8)))[:WINDOW]
        x[i, :len(text)] = char_classes(text)
        if kind:
            y[i, len(left):len(left) + len(said)] = 2 * kind
            y[i, len(left)] = 2 * kind - 1
    return x, y


def fit(docs: DataFrame, text: str = "text", windows: tuple[int, int] = FIT_WINDOWS, steps: int = STEPS, hidden: int = HIDDEN,
        seed: int = 13) -> dict[str, np.ndarray]:
    """Weights of a tagger trained on labelled windows of the documents, drawn in hash order, and on other forms."""
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for t in batch.column(0).to_pylist():
                t = t or ""
                starts = window_starts(t)
                if starts:
                    tags = np.concatenate([_tags(base_spans(t), len(t)), np.zeros(WINDOW, np.int8)])
                    xs += [w.tobytes() for w in _windows(char_classes(t), starts)]
                    ys += [tags[s:s + WINDOW].tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    made = docs.select(text).where(F.col(text).rlike("[0-9@]")).mapInArrow(label, "x binary, y binary")
    # Each different window once; then those with the lowest hashes of each sort: what comes to the driver is bounded by
    # ``windows``, however many tasks there are.
    made = written(made.distinct().withColumn("full", F.col("y") != F.lit(bytes(WINDOW))), "pii-windows")
    n = {r["full"]: r["count"] for r in made.groupBy("full").count().collect()}
    drawn = []
    for full, most in ((True, windows[0]), (False, windows[1])):
        part = made.where(F.col("full") == full).withColumn("h", F.xxhash64("x", "y"))
        drawn += lowest(part, "h", most, n.get(full, 0)).select("x", "y").collect()
    rng = np.random.default_rng(seed)
    x, y = other_forms(rng, 1_500)
    if drawn:
        x = np.concatenate([x, np.stack([np.frombuffer(r["x"], np.uint8) for r in drawn])])
        y = np.concatenate([y, np.stack([np.frombuffer(r["y"], np.int8) for r in drawn])])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # in a task, where numpy keeps to its cores
        for _ in batches:
            tagger = Tagger.new(2 * len(KINDS) + 1, hidden, seed)
            tagger.train(x, y, steps, seed=seed)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger.w)], pa.binary())], names=["w"])

    return pickle.loads(docs.sparkSession.range(1).coalesce(1).mapInArrow(train, "w binary").first()["w"])


def _plausible(kind: str, said: str) -> bool:
    digits = re.sub(r"[^0-9]", "", said)
    if kind == "email":
        name, _, host = said.partition("@")
        return bool(name) and "." in host.strip(".") and not re.search(r"\s", said)
    if kind == "ip":
        parts = re.findall(r"[0-9]+", said)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15 and not re.search(r"[A-Za-z\n]", said)


def found_spans(tags: np.ndarray, starts: list[int], size: int) -> list[tuple[str, int, int]]:
    """Spans that a window holds whole: not cut by its border, unless that is the border of the text."""
    out = set()
    for start, row in zip(starts, tags):
        if not row.any():
            continue
        i = 0
        while i < WINDOW:
            if row[i] == 0:
                i += 1
                continue
            kind, j = (row[i] - 1) // 2, i + 1
            while j < WINDOW and row[j] == 2 * kind + 2:
                j += 1
            whole = (i > 0 or start == 0) and (j < WINDOW or start + j >= size)
            if whole and start + j <= size:
                out.add((KINDS[kind], start + i, start + j))
            i = j
    return sorted(out)


def reconcile(base: dict[str, list[tuple[int, int]]], found: list[tuple[str, int, int]], text: str) -> list[tuple[str, int, int]]:
    """Base spans stay; a found span comes in if it is plausible and overlaps nothing, the longer ones first."""
    taken = sorted((s, e) for spans in base.values() for s, e in spans)
    out = []
    for kind, s, e in sorted(found, key=lambda f: (f[1] - f[2], f[1], KINDS.index(f[0]))):
        if all(e <= a or b <= s for a, b in taken) and _plausible(kind, text[s:e]):
            taken.append((s, e))
            out.append((kind, s, e))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def find_all(texts: list[str], tagger: Tagger) -> list[tuple[dict, list]]:
    """(base spans, added spans) per text; windows of all texts are decoded together."""
    base = [base_spans(t) for t in texts]
    owners, rows, starts = [], [], []
    for i, t in enumerate(texts):
        at = window_starts(t)
        if at:
            owners.append((i, len(at)))
            rows.append(_windows(char_classes(t), at))
            starts.append(at)
    added: list[list] = [[] for _ in texts]
    if rows:
        x = np.concatenate(rows)
        tags = np.concatenate([tagger.decode(x[a:a + DECODED]) for a in range(0, len(x), DECODED)])
        at = 0
        for (i, n), own in zip(owners, starts):
            added[i] = reconcile(base[i], found_spans(tags[at:at + n], own, len(texts[i])), texts[i])
            at += n
    return list(zip(base, added))


def find(docs: DataFrame, weights: Broadcast, text: str = "text") -> DataFrame:
    """Adds ``pii``: array of (kind, start, end, base) in code points, end exclusive, by kind and start.

    Whole texts are looked at; null texts count as empty. Base spans are those of the patterns; others come from the
    tagger, overlap no base span and keep the kind's rules (digits, Luhn, octets). Equal texts get equal spans;
    an empty table gives an empty result; a column of that name is replaced.
    """
    keep = docs.select(*[c for c in docs.columns if c.lower() != "pii"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + \
        ", pii array<struct<kind:string,start:int,end:int,base:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights.value)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                rows = []
                for base, added in find_all(texts, tagger):
                    spans = [(k, s, e, True) for k, v in base.items() for s, e in v] + [(*a, False) for a in added]
                    spans.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
                    rows.append([{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "pii"])

    return keep.mapInArrow(run, schema)


def redact(docs: DataFrame, weights: Broadcast, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data replaced by <KIND>; other columns and null texts stay."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights.value)
        for whole in batches:
            for first in range(0, max(1, whole.num_rows), 500):
                batch = whole.slice(first, 500)
                column = batch.schema.get_field_index(text)
                texts, out = batch.column(column).to_pylist(), []
                for t, (base, added) in zip(texts, find_all([t or "" for t in texts], tagger)):
                    spans = sorted([(s, e, k) for k, v in base.items() for s, e in v] + [(s, e, k) for k, s, e in added])
                    parts, at = [], 0
                    for s, e, k in spans:  # kinds may overlap: what is covered twice goes once
                        if s >= at:
                            parts += [(t or "")[at:s], f"<{k.upper()}>"]
                        at = max(at, e)
                    out.append(None if t is None else "".join(parts) + t[at:])
                cols = list(batch.columns)
                cols[column] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    def base(kind: str) -> Column:
        return F.size(F.filter("pii", lambda p: p["base"] & (p["kind"] == kind))).cast("long").alias(f"n_{kind}")

    is_base = F.filter("pii", lambda p: p["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["start"], p["end"])), ",")
    return found.select(
        key, *[base(k) for k in KINDS],
        F.sha2(said(is_base), 256).alias("base_sha256"), said("pii").alias("spans"),
        F.size(F.filter("pii", lambda p: ~p["base"])).cast("long").alias("n_added"))
