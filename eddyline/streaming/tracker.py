"""The tracker on a stream of frames.

Each region's state is yesterday's labelled runs. Frames must come in order, a day at a time
or more; days up to the state's own are refused, as they would rewrite what is out.
The same fold as in batch decides, so a stream and a batch of the same days agree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from eddyline.operators.components import _frame
from eddyline.operators.tracking import fold

_OUT = "region string, t int, yi int, x0 int, x1 int, component long, piece long, label long"
_STATE = "t int, runs string"


def _runs(frame: pd.DataFrame, width: int, connectivity: int, dust: int, least: int) -> pd.DataFrame:
    frame = frame.drop_duplicates(["yi", "xi"]).sort_values(["yi", "xi"])
    new = (frame["yi"].diff() != 0) | (frame["xi"].diff() != 1)
    grouped = frame.groupby(new.cumsum())
    table = pa.Table.from_pandas(pd.DataFrame({"t": grouped["t"].first(), "yi": grouped["yi"].first(), "x0": grouped["xi"].min(), "x1": grouped["xi"].max()}), preserve_index=False)
    out = _frame(width, connectivity, dust)(table).to_pandas()
    return out[out["piece_size"] >= least]


def _pairs(then: pd.DataFrame, now: pd.DataFrame, width: int) -> list[tuple]:
    both = now.merge(then, on="yi", suffixes=("", "_p"))
    both = both[(both["x0"] <= both["x1_p"]) & (both["x0_p"] <= both["x1"])]
    if both.empty:
        return []
    start = both[["x0", "x0_p"]].max(axis=1)
    both = both.assign(inter=both[["x1", "x1_p"]].min(axis=1) - start + 1, first=both["yi"].astype("int64") * width + start)
    sums = both.groupby(["t", "component_p", "component"]).agg(inter=("inter", "sum"), first=("first", "min")).reset_index()
    return list(sums.itertuples(index=False, name=None))


def track_stream(cells: DataFrame, width: int, height: int, least: int = 1, iou: tuple[int, int] | None = (1, 5), connectivity: int = 8, dust: int = 4) -> DataFrame:
    """Labelled runs of a stream of mask cells (region, t, yi, xi); each day of a region comes whole in one batch."""
    total = width * height

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, then = None, pd.DataFrame(columns=["yi", "x0", "x1", "component", "label"])
        if state.exists:
            at, stored = state.get
            then = pd.DataFrame(json.loads(stored), columns=["yi", "x0", "x1", "component", "label"])
        rows = pd.concat(list(frames), ignore_index=True)
        out = []
        for t, frame in sorted(rows.groupby("t"), key=lambda x: x[0]):
            if at is not None and t <= at:
                raise ValueError(f"day {t} comes after day {at}")
            own = _runs(frame, width, connectivity, dust, least)
            own["t"] = t
            sizes = (own["x1"] - own["x0"] + 1).groupby(own["component"]).sum()
            before = {}
            if len(then):
                then["n"] = then["x1"] - then["x0"] + 1
                before = {c: (int(g["label"].iloc[0]), int(g["n"].sum())) for c, g in then.groupby("component")}
            pairs = _pairs(then.drop(columns="label"), own, width) if len(then) else []
            found = fold([(t, int(c), int(n)) for c, n in sizes.items()], [tuple(map(int, p)) for p in pairs], total, iou, before, at)
            own["label"] = own["component"].map({c: label for _, c, label, _ in found})
            at, then = int(t), own[["yi", "x0", "x1", "component", "label"]]
            out.append(own.assign(region=key[0])[["region", "t", "yi", "x0", "x1", "component", "piece", "label"]])
        state.update((at, json.dumps(then[["yi", "x0", "x1", "component", "label"]].astype("int64").values.tolist())))
        yield pd.concat(out, ignore_index=True)

    return cells.groupBy("region").applyInPandasWithState(step, _OUT, _STATE, "append", "NoTimeout")
