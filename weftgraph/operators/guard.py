"""Failures inside grouped functions as rows, so that one bad document does not end the job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.skew import join_salted

FAILURE = "failure"


def _failed(frame: pd.DataFrame, keys: Sequence[str], columns: Sequence[str], error: Exception) -> pd.DataFrame:
    row = {c: frame[c].iloc[0] if c in keys else None for c in columns}
    return pd.DataFrame([row | {FAILURE: f"{type(error).__name__}: {error}"[:500]}])


def guarded(kernel: Callable, keys: Sequence[str], columns: Sequence[str]) -> Callable:
    """A grouped function of one frame whose result has a ``failure`` column: null, or in a row with
    nothing else but the keys why the group could not be computed."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return kernel(frame).assign(**{FAILURE: None})
        except Exception as error:  # becomes a row
            return _failed(frame, keys, columns, error)

    return run


def guarded_pair(kernel: Callable, keys: Sequence[str], columns: Sequence[str]) -> Callable:
    """The same for a function of two frames."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            return kernel(left, right).assign(**{FAILURE: None})
        except Exception as error:  # becomes a row
            return _failed(left if len(left) else right, keys, columns, error)

    return run


def split_failures(found: DataFrame, stage: str, spread: Sequence[str], key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Results of the documents of which no group failed, and one failure row
    (``doc_id, stage, message``) for each of the others.  ``found`` is a written table."""
    bad = found.where(F.col(FAILURE).isNotNull()).groupBy(key).agg(F.min(FAILURE).alias("message"))
    good = join_salted(found.where(F.col(FAILURE).isNull()), bad.select(key), [key], spread, "left_anti").drop(FAILURE)
    return good, bad.select(F.col(key).alias("doc_id"), F.lit(stage).alias("stage"), "message")
