"""Models applied to batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def infer(df: DataFrame, id_col: str, value_col: str, load: Callable[[], Callable], value_type: str = "double") -> DataFrame:
    """(id, ok, value, error) of a model on each row.

    `load` runs once per task and gives a function from a list of values to a list of results. If a
    batch fails, its rows are tried one by one, and those that fail alone carry their error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            values = [None if pd.isna(v) else v for v in pdf[value_col]]
            try:
                out = [(True, v, None) for v in model(values)]
            except Exception:
                out = []
                for v in values:
                    try:
                        out.append((True, model([v])[0], None))
                    except Exception as e:
                        out.append((False, None, type(e).__name__))
            yield pd.DataFrame({"id": pdf[id_col].to_numpy(), "ok": [o[0] for o in out], "value": [o[1] for o in out], "error": [o[2] for o in out]})

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, value_col).mapInPandas(run, f"id {kind}, ok boolean, value {value_type}, error string")
