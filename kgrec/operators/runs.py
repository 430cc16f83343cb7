"""Experiment operators: parameter grids (X1, X2), best run per model (A12), error-isolated runs
(X5) with a run log (K11), parameter save / reload with skip-if-present (K10).

Grids are configuration, not data: they are expanded on the driver from a few choice lists and
become a small DataFrame keyed by a config id, so that all runs can be scored in one job.
"""

from __future__ import annotations

import ast
import itertools
import math
import traceback
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_choices(text: str) -> list[tuple[str, list[str]]]:
    """Lines ``name choice [v1, v2]`` -> [(name, [v1, v2])]; values kept as their source text."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        name, kind, rest = line.split(None, 2)
        if kind != "choice":
            raise ValueError(f"unsupported search kind {kind!r}")
        values = ast.literal_eval(rest)
        out.append((name, [str(v) for v in values]))
    return out


def param_grid(spark: SparkSession, choices: list[tuple[str, list[str]]], cap: int | None = None) -> DataFrame:
    """Exhaustive grid ``(config_id, param, value)``; an explicit ``cap`` keeps the first configs and warns of the rest."""
    names = [n for n, _ in choices]
    total = math.prod(len(v) for _, v in choices)
    if cap is not None and total > cap:
        warnings.warn(f"grid of {total} configurations cut to the first {cap}; {total - cap} left out", stacklevel=2)
    rows = []
    for cid, combo in enumerate(itertools.islice(itertools.product(*[v for _, v in choices]), cap)):
        rows.extend((cid, n, v) for n, v in zip(names, combo))
    return spark.createDataFrame(rows, "config_id int, param string, value string")


def run_grid(spark: SparkSession, settings: list[str], layers: list[int], dropouts: list[float]) -> DataFrame:
    """Settings x layers x dropout: ``(run_id, setting, layers, dropout)``."""
    rows = [(i, s, l, d) for i, (s, l, d) in enumerate(itertools.product(settings, layers, dropouts))]
    return spark.createDataFrame(rows, "run_id int, setting string, layers int, dropout double")


def best_per_model(results: DataFrame, metric: str, model_col: str = "model",
                   tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """One row per model: the run with the highest ``metric`` (ties: smallest ``tie_cols``)."""
    others = [c for c in results.columns if c != model_col]
    top = results.groupBy(model_col).agg(F.max(metric).alias("_top"))
    tied = results.join(top, model_col).filter(F.col(metric).eqNullSafe(F.col("_top")))
    best = tied.groupBy(model_col).agg(F.min_by(F.struct(*others), F.struct(*(tie_cols or others))).alias("_b"))
    return best.select(model_col, *[F.col(f"_b.{c}").alias(c) for c in others])


def run_isolated(runs: dict[str, Callable[[], object]], spark: SparkSession | None = None,
                 log_path: str | None = None) -> tuple[dict[str, object], list[tuple[str, str, str]]]:
    """Run each callable; a failure is logged and does not stop the others.

    With ``log_path`` the log rows are appended to that table (K11) after the last run.
    """
    results, log = {}, []
    for name, fn in runs.items():
        try:
            results[name] = fn()
            log.append((name, "OK", ""))
        except Exception as e:  # noqa: BLE001
            log.append((name, "ERROR", f"{type(e).__name__}: {e}\n{traceback.format_exc(limit=3)}"))
    if log_path and log:
        from kgrec.sources.files import append_log
        append_log(spark, log_path, log)
    return results, log


def save_params(spark: SparkSession, theta: np.ndarray, path: str, force: bool = False) -> bool:
    """Store a parameter vector as ``(pos, value)`` parquet; skip if present unless ``force``."""
    from kgrec.sources.files import exists
    if exists(spark, path) and not force:
        return False
    pdf = pd.DataFrame({"pos": np.arange(len(theta), dtype=np.int64), "value": theta.astype(np.float64)})
    spark.createDataFrame(pdf).write.mode("overwrite").parquet(path)
    return True


def load_params(spark: SparkSession, path: str) -> np.ndarray:
    pdf = spark.read.parquet(path).toPandas().sort_values("pos")
    return pdf["value"].to_numpy()
