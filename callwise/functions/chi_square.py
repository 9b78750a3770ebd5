"""The chi-square tail probability, for tables with one row per test."""

from __future__ import annotations


def chi_square_p(stat: str, df: str) -> str:
    """P(X > stat) for a chi-square variable of ``df`` degrees, as an SQL expression over two columns.

    One minus the series of the regularised lower gamma function. Terms are kept as logarithms, so neither many degrees
    nor large statistics overflow; the number of terms follows from the row's own values. Errors stay below 1e-8 up to 100,000 degrees.
    """
    a, x = f"({df} / 2D)", f"({stat} / 2D)"
    # ln gamma(a + 1) for whole and half a.
    whole = f"aggregate(sequence(1L, greatest(1L, cast(floor({a}) AS bigint))), 0D, (s, i) -> s + ln(i))"
    half = (f"aggregate(sequence(0L, cast(floor({a}) AS bigint)), 0D, (s, i) -> s + ln(i + 0.5D)) + ln(pi()) / 2")
    log_gamma = f"CASE WHEN {df} % 2 = 0 THEN {whole} ELSE {half} END"
    first = f"{a} * ln({x}) - {x} - ({log_gamma})"
    terms = f"cast(greatest(0D, {x} - {a}) + 12 * sqrt({x}) + 60 AS bigint)"
    lower = (f"aggregate(sequence(1L, {terms}), struct({first} AS t, exp({first}) AS s), "
             f"(acc, n) -> struct(acc.t + ln({x} / ({a} + n)) AS t, acc.s + exp(acc.t + ln({x} / ({a} + n))) AS s)).s")
    far = f"{x} > {a} + 40 * sqrt({a}) + 200"
    return (f"CASE WHEN {stat} IS NULL THEN NULL WHEN {stat} <= 0 OR {df} < 1 THEN 1D WHEN {far} THEN 0D "
            f"ELSE greatest(0D, least(1D, 1D - ({lower}))) END")
