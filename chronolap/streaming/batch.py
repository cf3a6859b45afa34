"""The folds over tables: one ordered pass for each session, by applyInPandas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from chronolap.streaming import folds


def _folded(rows: DataFrame, make: Callable, column: str, out: str, kind: str, emitted_only: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_ms", "id"], kind="stable")
        state = make()
        got = []
        for t, v in zip(pdf["t_ms"], pdf[column]):
            v = None if pd.isna(v) else v if column == "verdict" else int(v)
            got.append(state.observe(int(t), v) if column == "value" and not isinstance(state, folds.Confirmed) else state.observe(v))
        res = pd.DataFrame({"session_id": pdf["session_id"], "id": pdf["id"], out: pd.Series(got, index=pdf.index, dtype="object" if kind == "string" else "Int64")})
        return res[res[out].notna()] if emitted_only else res

    return rows.groupBy("session_id").applyInPandas(run, f"session_id long, id long, {out} {kind}")


def clock_gate(rows: DataFrame) -> DataFrame:
    return _folded(rows, folds.ClockGate, "value", "accepted_ms", "long", False)


def smoother(rows: DataFrame) -> DataFrame:
    return _folded(rows, folds.Smoother, "value", "smoothed_ms", "long", False)


def identity_gate(rows: DataFrame) -> DataFrame:
    return _folded(rows, folds.IdentityGate, "verdict", "change", "string", True)


def confirmed(rows: DataFrame) -> DataFrame:
    return _folded(rows, folds.Confirmed, "value", "confirmed", "long", True)
