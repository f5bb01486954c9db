"""Barrier labels kept up to date as bars arrive, late ones included, with a bounded state a stock.

A label looks `horizon` days ahead, so a bar that arrives changes its own label and those of the `horizon` days
before it, and no others. The state of a stock holds its last `keep` bars with the labels last told; a batch
is merged into it and only labels that changed go out, each with the number of its telling. A bar that comes so late that some
of the days before it are gone from the state cannot be labelled from it: it goes out as `too_late` and
`recomputed` makes its surroundings from the stored bars.

State and progress lie in the checkpoint folder; a restart goes on where the last run ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from barograph.operators import indicators

BARS = "stock_id string, trade_date date, open_price double, high_price double, low_price double"
TOLD = "stock_id string, trade_date date, label_reason string, triple_barrier int, label_end_date_tb date, telling long, too_late boolean"
_STATE = "days array<int>, opens array<double>, highs array<double>, lows array<double>, labels array<int>, ends array<int>, gone int, telling long"
#: Labels as the state holds them beyond -1, 0 and 1; no end is NO_END.
_REASONS = {7: "no_entry", 9: "insufficient_data", 8: indicators.AMBIGUOUS}
_UNTOLD, NO_END = 99, -(2**31)
_EPOCH = pd.Timestamp("1970-01-01")


def labels(opens: np.ndarray, highs: np.ndarray, lows: np.ndarray, horizon: int, up: float, down: float) -> np.ndarray:
    """Codes of one stock's days in order, as `indicators.triple_barrier` has them; NaN is what is not known."""
    n = len(opens)
    ahead = lambda x, k: np.concatenate([x[k:], np.full(min(k, n), np.nan)])
    entry = ahead(opens, 1)
    top, floor = entry * (1 + up), entry * (1 - down)
    code = np.zeros(n, np.int64)
    for k in range(1, horizon + 1):
        h, low = ahead(highs, k), ahead(lows, k)
        over, under = h >= top, low <= floor
        touch = np.select([np.isnan(h) | np.isnan(low), over & under, over, under], [9, 8, 1, -1], 0)
        code = np.where(code == 0, touch, code)
    at = np.arange(n)
    return np.select([at + 1 >= n, at + horizon >= n, np.isnan(entry)], [7, 9, 7], code)


def _merged(old: list[tuple], new: pd.DataFrame) -> dict[int, tuple]:
    """Rows by day; a bar that comes again keeps what was told of it."""
    rows = {r[0]: r for r in old}
    for day, o, h, low in zip((new["trade_date"] - _EPOCH).dt.days if len(new) else [], new["open_price"], new["high_price"], new["low_price"], strict=True):
        rows[int(day)] = (int(day), o, h, low, *rows[int(day)][4:]) if int(day) in rows else (int(day), o, h, low, _UNTOLD, NO_END)
    return rows


def _step(keep: int, horizon: int, up: float, down: float):
    none = lambda v: [None if x is None or np.isnan(x) else float(x) for x in v]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [], [], None, 0)
        *columns, gone, telling = held
        new = pd.concat(list(batches)).assign(trade_date=lambda x: pd.to_datetime(x["trade_date"])).drop_duplicates("trade_date", keep="last").sort_values("trade_date")
        old = list(zip(*columns, strict=True))
        days = (new["trade_date"] - _EPOCH).dt.days.to_numpy()
        # of what is left a bar needs `horizon` days before it, unless nothing is gone
        first = -(2**31) if gone is None else old[horizon][0] if len(old) > horizon else 2**31
        late = days < first
        rows = [v for _, v in sorted(_merged(old, new[~late]).items())]
        told = pd.DataFrame({"trade_date": new["trade_date"][late], "label": 0, "end": NO_END, "too_late": True})
        if rows:
            at, o, h, low, before, ends = (np.array(x, float) for x in zip(*rows, strict=True))
            now = labels(o, h, low, horizon, up, down)
            end = np.concatenate([at[horizon:], np.full(min(horizon, len(at)), NO_END)])
            changed = (now != before) | (end != ends)
            part = pd.DataFrame({"trade_date": _EPOCH + pd.to_timedelta(at[changed], "D"), "label": now[changed], "end": end[changed], "too_late": False})
            told = part if told.empty else pd.concat([told, part])
            cut = max(0, len(rows) - keep)
            gone = int(at[cut - 1]) if cut else gone
            ints = lambda v: [int(x) for x in v[cut:]]
            state.update((ints(at), none(o[cut:]), none(h[cut:]), none(low[cut:]), ints(now), ints(end), gone, telling + 1))
        if len(told):
            end = told["end"].to_numpy()
            yield pd.DataFrame({
                "stock_id": key[0], "trade_date": told["trade_date"].dt.date, "label_reason": [None if late else _REASONS.get(int(x)) for x, late in zip(told["label"], told["too_late"], strict=True)],
                "triple_barrier": pd.array([None if late or int(x) in _REASONS else int(x) for x, late in zip(told["label"], told["too_late"], strict=True)], "Int32"),
                "label_end_date_tb": [None if e == NO_END else (_EPOCH + pd.Timedelta(int(e), "D")).date() for e in end], "telling": telling + 1, "too_late": told["too_late"].to_numpy(),
            })

    return step


def told(bars: DataFrame, keep: int = 250, horizon: int = 5, up: float = 0.02, down: float = 0.015) -> DataFrame:
    """Streamed bars(stock_id, trade_date, open_price, high_price, low_price) -> TOLD: the labels that changed with each batch.

    A bar that comes again replaces the one there was. `keep` must exceed `horizon`; a stock's bars of one batch and
    its state meet in one task.
    """
    if keep <= horizon:
        raise ValueError("keep must exceed horizon")
    rows = bars.select("stock_id", "trade_date", "open_price", "high_price", "low_price")
    return rows.groupBy("stock_id").applyInPandasWithState(_step(keep, horizon, up, down), TOLD, _STATE, "update", GroupStateTimeout.NoTimeout)


def latest(tellings: DataFrame) -> DataFrame:
    """What was last told of each day: stock_id, trade_date, label_reason, triple_barrier, label_end_date_tb; too late ones apart."""
    w = Window.partitionBy("stock_id", "trade_date").orderBy(F.desc("telling"))
    last = tellings.where(~F.col("too_late")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return last.select("stock_id", "trade_date", "label_reason", "triple_barrier", "label_end_date_tb")


def recomputed(stored: DataFrame, tellings: DataFrame, horizon: int = 5, up: float = 0.02, down: float = 0.015) -> DataFrame:
    """Labels from the stored bars for each bar that came too late and the `horizon` days before it."""
    late = tellings.where("too_late").select("stock_id", "trade_date").distinct()
    marked = stored.join(late.withColumn("_late", F.lit(True)), ["stock_id", "trade_date"], "left")
    near = F.max(F.coalesce("_late", F.lit(False))).over(indicators.by_stock().rowsBetween(0, horizon))
    made = indicators.triple_barrier(marked.withColumn("_near", near), up, down, horizon)
    return made.where("_near").select("stock_id", "trade_date", "label_reason", "triple_barrier", "label_end_date_tb")
