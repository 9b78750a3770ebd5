"""Randomised hyperparameter search."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwise.config import DEFAULTS, PARAM_GRIDS
from callwise.operators.models import (
    Fit, Fitted, cross_validate, evaluate, fit_boosted, fit_forest, fold_scores, mean_std, spec_of,
)
from callwise.sources.calls import write_csv, write_json

CANDIDATE_SCHEMA = (
    "rank_test_score int, mean_test_score double, std_test_score double, params string")

TUNED_SCHEMA = (
    "model_name string, best_cv_score double, test_f1_weighted double, test_accuracy double, "
    "best_params string")


def param_grid(name: str, grids: dict | None = None) -> dict[str, list]:
    grids = PARAM_GRIDS if grids is None else grids
    if name not in grids:
        raise KeyError(f"no grid for {name!r}; available: {list(grids)}")
    return {k: list(v) for k, v in grids[name].items()}


def draw_candidates(grid: dict[str, list], n: int, seed: int) -> list[dict]:
    """``n`` different points of the grid; the whole grid if it is no larger."""
    names = list(grid)
    size = math.prod(len(v) for v in grid.values())
    picked = random.Random(seed).sample(range(size), min(n, size))
    found = []
    for index in picked:
        point = {}
        for name in reversed(names):
            index, place = divmod(index, len(grid[name]))
            point[name] = grid[name][place]
        found.append({name: point[name] for name in names})
    return found


def random_search(fit: Fit, grid: dict[str, list], train: DataFrame, labels: Sequence[str],
                  n_iter: int = DEFAULTS.search_draws, k: int = DEFAULTS.folds,
                  metric: str = "f1_weighted", seed: int = DEFAULTS.seed
                  ) -> tuple[Fitted, dict, DataFrame]:
    """(best model refitted on all rows, its parameters, candidates by rank).

    Tree ensembles of all candidates and folds share the passes over one binned table; other models are fitted one by one.
    A candidate whose cross-validation failed (NaN) has the last rank; if all did, that is an error.
    """
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    drawn = draw_candidates(grid, n_iter, seed)
    fits = [partial(fit, **params) for params in drawn]
    if all(map(spec_of, fits)):
        scores = fold_scores(fits, train, labels, k, metric)
    else:
        scores = [cross_validate(f, train, labels, k, metric) for f in fits]
    tried = [(*mean_std(s), params) for s, params in zip(scores, drawn)]
    order = sorted(tried, key=lambda t: -t[0] if not math.isnan(t[0]) else math.inf)
    if not order or math.isnan(order[0][0]):
        train.unpersist()
        raise ValueError("no candidate could be cross-validated")
    best = order[0][2]
    worth = [-math.inf if math.isnan(t[0]) else t[0] for t in order]
    rows = [(1 + sum(o > w for o in worth), t[0], t[1], json.dumps(t[2])) for w, t in zip(worth, order)]
    fitted = partial(fit, **best)(train, labels)
    train.unpersist()
    return fitted, best, train.sparkSession.createDataFrame(rows, CANDIDATE_SCHEMA).orderBy(
        "rank_test_score", "params")


def tune_all(train: DataFrame, test: DataFrame, labels: Sequence[str], grids: dict | None = None,
             n_iter: int = DEFAULTS.search_draws, k: int = DEFAULTS.folds,
             seed: int = DEFAULTS.seed) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tune both tree models and test the winners: (one row per model, candidate tables)."""
    rows, tables = [], {}
    for name, fit in (("gradient_boosting", fit_boosted), ("random_forest", fit_forest)):
        fitted, best, table = random_search(fit, param_grid(name, grids), train, labels, n_iter, k, seed=seed)
        m = evaluate(fitted, test)
        chosen = table.where((F.col("rank_test_score") == 1) & (F.col("params") == json.dumps(best)))
        rows.append((name, chosen.first()["mean_test_score"], round(m["f1_weighted"], 4),
                     round(m["accuracy"], 4), json.dumps(best)))
        tables[name] = table
    return train.sparkSession.createDataFrame(rows, TUNED_SCHEMA), tables


def save_tuning(tuned: DataFrame, tables: dict[str, DataFrame], folder: str) -> None:
    """Best parameters as JSON and each model's candidates as CSV."""
    write_json(tuned, f"{folder}/best_params")
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}_cv_results")
