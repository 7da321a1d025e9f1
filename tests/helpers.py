"""Small frames for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

NORMAL = "EM FUNCIONAMENTO|CARREGADO"
START = datetime(2026, 4, 13, 8, 0, 0)


def minutes(values: dict[str, list], mode: str = NORMAL, asset: int = 1, start: datetime = START) -> pd.DataFrame:
    """One reading per minute with the given columns."""
    n = len(next(iter(values.values())))
    oper, load = mode.split("|")
    frame = pd.DataFrame(values)
    frame.insert(0, "asset_id", asset)
    frame["ts"] = [start + timedelta(minutes=i) for i in range(n)]
    frame["us"] = [int((t - datetime(1970, 1, 1)).total_seconds() * 1_000_000) for t in frame["ts"]]
    frame["st_oper"], frame["st_carga_oper"], frame["mode_key"] = oper, load, mode
    return frame


def to_spark(spark, frame: pd.DataFrame):
    clean = frame.astype(object).where(frame.notna(), None)
    kinds = {"asset_id": "bigint", "us": "bigint", "row_idx": "bigint", "segment_id": "bigint", "eid": "bigint", "ts": "timestamp_ntz"}
    def kind(c):
        if c in kinds:
            return kinds[c]
        return "string" if any(isinstance(v, str) for v in clean[c]) else "double"
    kind_of = {c: kind(c) for c in clean.columns}
    schema = ", ".join(f"`{c}` {kind_of[c]}" for c in clean.columns)
    rows = []
    for row in clean.itertuples(index=False):
        out = []
        for c, v in zip(clean.columns, row):
            if v is None:
                out.append(None)
            elif kind_of[c] == "bigint":
                out.append(int(v))
            elif kind_of[c] == "double":
                out.append(float(v))
            elif kind_of[c] == "timestamp_ntz":
                out.append(pd.Timestamp(v).to_pydatetime())
            else:
                out.append(v)
        rows.append(tuple(out))
    return spark.createDataFrame(rows, schema)


def irregular(seed: int, n: int, assets: int = 2, gaps: float = 0.1, step_minutes: float = 3.0) -> pd.DataFrame:
    """Random cadence, random modes, random gaps; one asset has most of the rows."""
    rng = np.random.default_rng(seed)
    parts = []
    for asset in range(assets):
        size = n if asset == 0 else max(5, n // 6)
        step = rng.exponential(step_minutes * 60e6, size).astype("int64") + 1
        us = 1_700_000_000_000_000 + np.cumsum(step)
        mode = np.where(np.cumsum(rng.random(size) < 0.03) % 3 == 0, NORMAL, np.where(rng.random(size) < 0.5, "PARTINDO|CARREGADO", "PARADO|SEM CARGA"))
        value = np.round(rng.normal(50, 5, size), 3)
        parts.append(pd.DataFrame({"asset_id": asset, "us": us, "mode_key": mode, "x": np.where(rng.random(size) < gaps, np.nan, value),
                                   "y": np.where(rng.random(size) < 0.4, np.nan, value * 2)}))
    return pd.concat(parts, ignore_index=True)
