"""Lead records: nested calls to rows, status priors, class-targeted augmentation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.config import COLD_SOURCE, DEFAULTS, INBOUND_SOURCES, STATUS_PRIOR
from callwise.functions.sqltext import name, text, texts

# Employee counts that move the prior.
LARGE_COMPANY, SMALL_COMPANY = 500, 50

DEFAULT_GAP = 7
# Calls whose days are appended to one array.
DAY_BLOCK = 256


def lead_to_rows(records: DataFrame, calls: str = "calls", entry: str = "entry_date",
                 offset: str = "first_offset", sentinel: str = DEFAULTS.sentinel) -> DataFrame:
    """One row per call of each nested record.

    The first call lies ``offset`` days after entry and each gap adds at least
    one day. A record is one row, so its days are summed inside the row: no
    shuffle, and records that share a lead id stay apart.
    """
    gap = f"greatest(1, coalesce(c.days_until_next_call, {DEFAULT_GAP}))"
    kept = [name(c) for c in records.columns if c not in (calls, entry, offset)]
    # Appending copies an array, so days are summed in blocks: first the blocks' starts, then the days inside each.
    walk = lambda items, start, step: (
        f"aggregate({items}, struct({start} AS day, cast(array() AS array<int>) AS days), "
        f"(acc, c) -> struct(acc.day + {step} AS day, array_append(acc.days, acc.day) AS days)).days")
    blocks = (f"transform(sequence(0, (size(all_calls) - 1) div {DAY_BLOCK}), "
              f"b -> slice(all_calls, b * {DAY_BLOCK} + 1, {DAY_BLOCK}))")
    lengths = f"transform(blocks, b -> aggregate(b, 0, (s, c) -> s + {gap}))"
    rows = records.where(f"size({name(calls)}) > 0").selectExpr(
        *kept, f"{name(entry)} AS lead_entry_date", f"{name(calls)} AS all_calls", f"cast({name(offset)} AS int) AS __first",
    ).selectExpr("*", f"{blocks} AS blocks").selectExpr("*", f"{walk(lengths, '__first', 'c')} AS starts").selectExpr(
        "*", f"flatten(zip_with(blocks, starts, (b, s) -> {walk('b', 's', gap)})) AS days")
    before = lambda field: (
        f"coalesce(nullif(get(all_calls, i - 1).{field}, ''), {text(sentinel)})")
    # All that a call takes from its record goes into the exploded struct; the arrays stay behind.
    each = ("transform(all_calls, (c, i) -> struct(i + 1 AS call_number, days[i] AS day, coalesce(days[i] - get(days, i - 1), 0) AS since, "
            f"{before('outcome')} AS prev_outcome, {before('next_step')} AS prev_next_step, c AS call))")
    return rows.selectExpr(*kept, "lead_entry_date", f"explode({each}) AS r").selectExpr(
        *kept, "lead_entry_date", "r.call_number", "date_add(lead_entry_date, r.day) AS call_timestamp",
        "r.day AS days_since_entry", "r.since AS days_since_last_call", "r.prev_outcome", "r.prev_next_step",
        "r.call.transcript AS current_transcript", "r.call.outcome AS current_outcome", "r.call.next_step AS next_step")


def journey_prior(leads: DataFrame, employees: str = "company_num_employees",
                  source: str = "lead_source") -> DataFrame:
    """Add the prior of each final status, moved by company size and lead source."""
    size, origin, prior = name(employees), name(source), STATUS_PRIOR
    weights = {
        "p_converted": f"{prior['Converted']}D * if({size} >= {LARGE_COMPANY}, 1.5D, 1D)"
                       f" * if({origin} IN ({texts(INBOUND_SOURCES)}), 1.4D, 1D)"
                       f" * if({size} < {SMALL_COMPANY}, 0.7D, 1D)",
        "p_lost": f"{prior['Lost']}D * if({origin} = {text(COLD_SOURCE)}, 1.3D, 1D)",
        "p_nurturing": f"{prior['Nurturing']}D",
        "p_in_progress": f"{prior['In Progress']}D",
    }
    total = " + ".join(weights.values())
    return leads.selectExpr("*", *[f"round({w} / ({total}), 6) AS {c}" for c, w in weights.items()])


def leads_with_class(calls: DataFrame, target: str, label: str = "next_step",
                     lead: str = "lead_id") -> DataFrame:
    """All calls of the leads that have the target class in one of their calls."""
    wanted = calls.where(F.col(label) == target).select(lead).distinct()
    return calls.join(wanted, lead, "left_semi")


def records_with_class(records: DataFrame, target: str, calls: str = "calls") -> DataFrame:
    """Nested records with the target class in one of their calls."""
    return records.where(F.exists(calls, lambda c: c["next_step"] == target))


def augment_report(existing: DataFrame, added: DataFrame, label: str = "next_step") -> DataFrame:
    """Rows per class before and after appending ``added``."""
    tagged = existing.select(label, F.lit(0).cast("long").alias("new")).unionByName(
        added.select(label, F.lit(1).cast("long").alias("new")))
    return tagged.groupBy(label).agg(
        F.sum(1 - F.col("new")).alias("n_before"), F.count(F.lit(1)).alias("n_after"),
        F.sum("new").alias("n_added"))


def append_calls(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Both tables by column name; a column one side lacks is null there."""
    return existing.unionByName(added, allowMissingColumns=True)


def check_target(target: str, allowed: Sequence[str] = DEFAULTS.labels) -> None:
    if target not in allowed:
        raise ValueError(f"class {target!r} is not one of {list(allowed)}")
