"""The features as state of a stream: one processor for each account, one for the whole stream.

Events of a micro-batch are taken in order of (t, seq) within their key. An event older than
the last one seen is late: it is rejected, leaves state untouched and comes out with
late = true, as does one whose amount or time is missing or not finite (invalid = true).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.features import DECAY, FOOTPRINT, FOOTPRINT_LEAST, WINDOW_SECONDS
from ..session import ship

_EVENT = "seq long, t double, category string, amount double"
ACCOUNT_OUT = f"account long, {_EVENT}, ewma_account double, footprint double, late boolean, invalid boolean"
ACCOUNT_STATE = "ewma double, seen boolean, last_t double, history array<string>"
GLOBAL_OUT = f"{_EVENT}, account long, ewma_global double, count_window long, category_frequency double, late boolean, invalid boolean"
GLOBAL_STATE = "ewma double, seen boolean, last_t double, times array<double>, names array<string>, counts array<long>, total long"
#: Rows handed back at once by the processor of the whole stream.
OUT_ROWS = 100_000


def _finite(x) -> bool:
    return x is not None and x == x and abs(x) != float("inf")


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.iloc[np.lexsort((rows["seq"].to_numpy(), rows["t"].to_numpy()))]


class AccountState:
    """What one account's past says; read before update."""

    def __init__(self, prior: dict[str, float], decay: float = DECAY, last: int = FOOTPRINT, least: int = FOOTPRINT_LEAST, saved: tuple | None = None):
        self.prior, self.decay, self.last, self.least = prior, decay, last, least
        self.ewma, self.seen, self.last_t, self.history = (saved[0], saved[1], saved[2], list(saved[3])) if saved else (0.0, False, float("-inf"), [])

    def read(self, amount: float, category: str | None) -> tuple[float, float]:
        mean = self.ewma if self.seen else amount
        if len(self.history) < self.least:
            return mean, self.prior.get(category, 0.0)
        return mean, sum(c == category for c in self.history) / len(self.history)

    def update(self, amount: float, category: str | None, t: float) -> None:
        self.ewma = self.decay * self.ewma + (1 - self.decay) * amount if self.seen else amount
        self.seen, self.last_t = True, t
        self.history = [*self.history, category][-self.last :]

    def saved(self) -> tuple:
        return self.ewma, self.seen, self.last_t, self.history


class GlobalState:
    """What the whole stream's past says: read before update, event by event, or `run` over many ordered events at once."""

    def __init__(self, n_categories: int, seconds: float = WINDOW_SECONDS, decay: float = DECAY, saved: tuple | None = None):
        self.n, self.seconds, self.decay = n_categories, seconds, decay
        self.ewma, self.seen, self.last_t, self.times, self.counts, self.total = 0.0, False, float("-inf"), deque(), {}, 0
        if saved:
            self.ewma, self.seen, self.last_t, self.times = saved[0], saved[1], saved[2], deque(saved[3])
            self.counts, self.total = dict(zip(saved[4], saved[5], strict=True)), saved[6]

    def read(self, amount: float, category: str | None, t: float) -> tuple[float, int, float]:
        while self.times and self.times[0] <= t - self.seconds:
            self.times.popleft()
        return self.ewma if self.seen else amount, len(self.times), (self.counts.get(category, 0) + 1) / (self.total + self.n)

    def update(self, amount: float, category: str | None, t: float) -> None:
        self.ewma = self.decay * self.ewma + (1 - self.decay) * amount if self.seen else amount
        self.seen, self.last_t = True, t
        self.times.append(t)
        if category is not None:
            self.counts[category] = self.counts.get(category, 0) + 1
        self.total += 1

    def run(self, amounts: np.ndarray, categories: pd.Series, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What `read` gives before each of these events, taken in their order with `update` after each; times ascend."""
        n = len(amounts)
        if not n:
            return np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        decay, rest = self.decay, 1 - self.decay
        start, new = (self.ewma, amounts) if self.seen else (float(amounts[0]), amounts[1:])
        past = np.fromiter(accumulate(new.tolist(), lambda mean, x: decay * mean + rest * x, initial=start), float, len(new) + 1)
        mean = past[:n] if self.seen else np.r_[start, past[:-1]]
        known = np.r_[np.array(self.times, float), times]
        count = len(self.times) + np.arange(n) - np.searchsorted(known, times - self.seconds, "right")
        code, names = pd.factorize(categories)
        same = pd.Series(code).groupby(code).cumcount().to_numpy() + np.array([*(self.counts.get(c, 0) for c in names), 0])[code]
        share = (np.where(code < 0, 0, same) + 1) / (self.total + np.arange(n) + self.n)
        for name, more in zip(names, np.bincount(code[code >= 0], minlength=len(names)).tolist(), strict=True):
            self.counts[name] = self.counts.get(name, 0) + more
        self.ewma, self.seen, self.last_t, self.total = float(past[-1]), True, float(times[-1]), self.total + n
        self.times = deque(known[known > times[-1] - self.seconds].tolist())
        return mean, count, share

    def saved(self) -> tuple:
        return self.ewma, self.seen, self.last_t, list(self.times), list(self.counts), list(self.counts.values()), self.total


def account_features(events: DataFrame, prior: dict[str, float], decay: float = DECAY, last: int = FOOTPRINT, least: int = FOOTPRINT_LEAST) -> DataFrame:
    """ewma_account and footprint of a stream (or a batch); state is spread over accounts."""

    def step(key, frames, group: GroupState):
        state = AccountState(prior, decay, last, least, group.get if group.exists else None)
        out = []
        for e in _ordered(frames).itertuples(index=False):
            invalid, late = not (_finite(e.amount) and _finite(e.t)), _finite(e.t) and e.t < state.last_t
            mean = share = None
            if not invalid and not late:
                mean, share = state.read(e.amount, e.category)
                state.update(e.amount, e.category, e.t)
            out.append((key[0], e.seq, e.t, e.category, e.amount, mean, share, late, invalid))
        group.update(state.saved())
        yield pd.DataFrame(out, columns=["account", "seq", "t", "category", "amount", "ewma_account", "footprint", "late", "invalid"]).astype({"ewma_account": float, "footprint": float})

    ship(events.sparkSession)
    return events.groupBy("account").applyInPandasWithState(step, ACCOUNT_OUT, ACCOUNT_STATE, "append", GroupStateTimeout.NoTimeout)


def global_features(events: DataFrame, n_categories: int, seconds: float = WINDOW_SECONDS, decay: float = DECAY) -> DataFrame:
    """ewma_global, count_window and category_frequency of a stream.

    One state for the whole stream means one task, as the definition asks for one order of all
    events; partition the stream by entity and use account_features where that is not wanted.
    """
    from pyspark.sql import functions as F

    def step(_key, frames, group: GroupState):
        state = GlobalState(n_categories, seconds, decay, group.get if group.exists else None)
        rows = _ordered(frames)
        t, amount = rows["t"].to_numpy(float), rows["amount"].to_numpy(float)
        # In order of t only what came before this micro-batch can make an event late.
        invalid, late = ~(np.isfinite(amount) & np.isfinite(t)), np.isfinite(t) & (t < state.last_t)
        use = np.flatnonzero(~invalid & ~late)
        made = state.run(amount[use], rows["category"].iloc[use], t[use])
        group.update(state.saved())
        mean, count, share = (np.full(len(rows), np.nan) for _ in made)
        mean[use], count[use], share[use] = made
        rows = rows[["seq", "t", "category", "amount", "account"]].assign(ewma_global=mean, count_window=count, category_frequency=share, late=late, invalid=invalid)
        for first in range(0, len(rows), OUT_ROWS):
            yield rows.iloc[first : first + OUT_ROWS].astype({"count_window": "Int64"})

    ship(events.sparkSession)
    return events.withColumn("__all", F.lit(0)).groupBy("__all").applyInPandasWithState(step, GLOBAL_OUT, GLOBAL_STATE, "append", GroupStateTimeout.NoTimeout)
