"""Orchestration: the stages of a page in order, stopping at the first that fails, and parameters by precedence."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTCOME = "page string, ord int, stage string, ok boolean, error string, warnings array<string>, timing_ms double"


def load_config(path: str | Path, missing_ok: bool = True) -> dict:
    """A YAML or JSON file of parameters; a missing one is empty if that is allowed."""
    path = Path(path)
    if not path.exists():
        if missing_ok:
            return {}
        raise FileNotFoundError(path)
    return parse_config(path.read_text(encoding="utf-8"), path.suffix)


def parse_config(text: str, suffix: str = ".yaml") -> dict:
    """The parameters of a YAML or JSON text; an empty one has none."""
    if suffix == ".json":
        return json.loads(text or "{}")
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML; JSON works without") from e
    return yaml.safe_load(text) or {}


def resolve_params(defaults: dict, config: dict, section: str) -> dict:
    """Defaults, overridden by the section of the configuration where it names one of them."""
    return defaults | {k: v for k, v in (config.get(section) or {}).items() if k in defaults}


def run_stages(spark: SparkSession, page: str, stages: Sequence[tuple[str, Callable[[], list[str] | None]]]) -> DataFrame:
    """Outcomes of a page's stages, a row each, none after the first that failed.

    A stage is a function that plans and runs its DataFrames and returns warnings, if any."""
    rows = []
    for k, (name, stage) in enumerate(stages):
        began = time.perf_counter()
        try:
            warnings, error = list(stage() or []), None
        except Exception as e:  # noqa: BLE001  the outcome is the result
            warnings, error = [], f"{type(e).__name__}: {e}"[:500]
        rows.append((page, k, name, error is None, error, warnings, (time.perf_counter() - began) * 1000))
        if error:
            break
    return spark.createDataFrame(rows, OUTCOME)


def summary(outcomes: DataFrame) -> DataFrame:
    """(page, ok, failed_stage, n_stages, n_warnings) of outcomes."""
    return outcomes.groupBy("page").agg(
        F.bool_and("ok").alias("ok"), F.min_by("stage", F.when(~F.col("ok"), F.col("ord"))).alias("failed_stage"),
        F.count("*").alias("n_stages"), F.sum(F.size("warnings")).alias("n_warnings"),
    )


def all_warnings(*tables: DataFrame) -> DataFrame:
    """(page, warning): the warnings (page, warnings) of several stages together, repeated ones too."""
    found = None
    for t in tables:
        one = t.select("page", F.explode("warnings").alias("warning"))
        found = one if found is None else found.union(one)
    return found
