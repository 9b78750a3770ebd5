"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "\n\n", "é", "a", "word " * 3000, "x" * 30_000, "one two three four five six seven", "one two three four five six seven",
             "漢字かな " * 40, "🙂 \0 \\ ▁ <s>", "ONE two, three four five six seven!"]


def repeats(rows: list[tuple[int, str | None]], length: int) -> dict[int, tuple]:
    """doc_id to (n_bytes, n_removed, n_spans, sha of the rest), straight from the definition."""
    seen: set[bytes] = set()
    out = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        body = (text or "").encode()
        covered = np.zeros(len(body) + 1, bool)
        for i in range(len(body) - length + 1):
            part = body[i:i + length]
            if part in seen:
                covered[i:i + length] = True
            seen.add(part)
        kept = bytes(b for b, c in zip(body, covered) if not c)
        spans = int((covered[:-1] & ~np.concatenate([[False], covered[:-2]])).sum()) if len(body) else 0
        out[key] = (len(body), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal_data(text: str | None) -> list[tuple[str, int, int]]:
    def luhn(d: str) -> bool:
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(d[::-1])) % 10 == 0

    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            bad = {"email": False, "ip": any(int(p) > 255 for p in m.group().split(".")) if kind == "ip" else False,
                   "card": not 13 <= len(digits) <= 19 or not luhn(digits), "phone": not 9 <= len(digits) <= 15}[kind]
            if not bad:
                out.append((kind, *m.span()))
    return out
