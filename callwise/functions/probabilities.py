"""SQL expressions over an array of class probabilities.

The array follows the sorted label list; everything stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from callwise.functions.sqltext import texts


def label_array(labels: Sequence[str]) -> str:
    return f"array({texts(labels)})"


def best_index(proba: str = "proba") -> str:
    """1-based position of the largest probability; the first one on ties."""
    return f"cast(array_position({proba}, array_max({proba})) AS int)"


def predicted_label(labels: Sequence[str], proba: str = "proba") -> str:
    return f"element_at({label_array(labels)}, {best_index(proba)})"


def confidence(proba: str = "proba") -> str:
    return f"round(array_max({proba}), 4)"


def probability_map(labels: Sequence[str], proba: str = "proba") -> str:
    return f"map_from_arrays({label_array(labels)}, transform({proba}, p -> round(p, 4)))"


def ranked(labels: Sequence[str], proba: str = "proba") -> str:
    """Structs (p, i, label), best first; on ties the higher position comes first."""
    pairs = (f"transform({proba}, (p, i) -> "
             f"struct(p AS p, i AS i, get({label_array(labels)}, i) AS label))")
    return f"reverse(array_sort({pairs}))"


def top_k_labels(labels: Sequence[str], k: int, proba: str = "proba") -> str:
    return f"transform(slice({ranked(labels, proba)}, 1, {k}), s -> s.label)"


def in_top_k(labels: Sequence[str], k: int, truth: str = "y_true", proba: str = "proba") -> str:
    return f"array_contains({top_k_labels(labels, k, proba)}, {truth})"


def normalised(scores: str) -> str:
    """Scores divided by their sum; equal shares where the sum is 0."""
    total = f"aggregate({scores}, 0D, (acc, x) -> acc + x)"
    return (f"transform({scores}, x -> coalesce(try_divide(x, nullif({total}, 0D)), "
            f"1D / size({scores})))")
