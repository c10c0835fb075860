"""Causal features of event streams: what an event's own past says, never the event itself.

All orders are (t, seq). Nothing is windowed over the whole stream in one task: global orders
come from time blocks whose row counts are summed up first (one row a block), and the global
mean is a scan in blocks of positions, each fed by the block before it.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DECAY = 0.98
WINDOW_SECONDS = 60.0
FOOTPRINT = 20
FOOTPRINT_LEAST = 5
#: Time blocks of global positions and of positions within a key: short enough that a block fits one task on the
#: busiest streams, long enough that the table of block sizes stays small.
BLOCK_SECONDS, KEY_BLOCK_SECONDS = 600.0, 3600.0
#: Events of one key in one block of over_last.
HISTORY_BLOCK = 50_000


def valid(df: DataFrame) -> Column:
    """Events that may enter state: amount and time are there and finite."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine("amount") & fine("t")


def _apart(df: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`build` over the valid events; the others come out beside them with null features, and never enter state."""
    fine = valid(df)
    return build(df.where(fine)).unionByName(df.where(~fine), allowMissingColumns=True)


def with_position(df: DataFrame, name: str = "position", keys: tuple[str, ...] = (), block_seconds: float | None = None, source: DataFrame | None = None) -> DataFrame:
    """Rows before each one in order of (t, seq), within `keys` if there are any; rows of null keys are a key as well.

    Rows are numbered inside time blocks; only the table of block sizes is ordered as a whole. `source`, a frame of the
    same rows that costs less than `df`, is counted in its place.
    """
    block_seconds = block_seconds or (KEY_BLOCK_SECONDS if keys else BLOCK_SECONDS)

    def blocked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("__block", F.floor(F.col("t") / block_seconds))
        return rows.withColumn("__key", F.struct(*keys)) if keys else rows  # structs of nulls are equal, so joins keep them

    by = ["__key"] if keys else []
    sizes = blocked(df if source is None else source).groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by, "__block").orderBy("t", "seq")
    numbered = blocked(df).withColumn("__row", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*by, "__block"]).withColumn(name, F.col("__offset") + F.col("__row")).drop("__key", "__block", "__row", "__offset")


def _ewma_global(df: DataFrame, name: str = "ewma_global", decay: float = DECAY, position: str | None = None) -> DataFrame:
    """The exponentially weighted mean of all amounts before each event; the first event gets its own amount.

    s_0 = x_0, s_i = decay * s_(i-1) + (1 - decay) * x_i, and the feature is s_(i-1). Blocks are so long that
    what comes from before the block before has a weight under e**-100.
    """
    own = position or "__position"
    rows = df if position else with_position(df, own)
    length = max(2, int(100 / -log(decay)))
    rows = rows.withColumn("__b", F.floor(F.col(own) / length)).withColumn("__k", F.col(own) % length)
    up = F.pow(F.lit(1 / decay), F.col("__k"))
    share = F.when(F.col(own) == 0, F.col("amount")).otherwise((1 - decay) * F.col("amount")) * up
    inside = Window.partitionBy("__b").orderBy("__k")
    rows = rows.withColumn("__past", F.sum(share).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy((F.col("__b") + 1).alias("__b")).agg((F.sum(share) * F.pow(F.lit(decay), F.max("__k"))).alias("__carry"))
    rows = rows.join(ends, "__b", "left")
    local = F.coalesce(F.col("__past") * F.pow(F.lit(decay), F.col("__k") - 1), F.lit(0.0))
    carried = F.coalesce(F.col("__carry") * F.pow(F.lit(decay), F.col("__k")), F.lit(0.0))
    value = F.when(F.col(own) == 0, F.col("amount")).otherwise(local + carried)
    drop = ["__b", "__k", "__past", "__carry"] + ([] if position else [own])
    return rows.withColumn(name, value).drop(*drop)


def _count_window(df: DataFrame, name: str = "count_window", seconds: float = WINDOW_SECONDS, position: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Events before each one whose time is later than t - seconds (the left edge is out).

    Each event stands in the block of its time and, as history, in the next if that looks back so far; every block is
    counted by itself. With `position`, the column of that name tells the rows before each one, from the same blocks;
    `source` is as in with_position.
    """
    length = max(BLOCK_SECONDS, seconds)
    block = F.floor(F.col("t") / length)
    copies = F.when(F.col("t") >= (block + 1) * length - seconds, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    both = df.withColumn("__copy", F.explode(copies)).withColumn("__block", block + F.col("__copy"))
    ordered = Window.partitionBy("__block").orderBy("t", "seq")
    old = F.expr(f"count(1) OVER (PARTITION BY __block ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND {float(seconds)!r}D PRECEDING)")
    counted = both.withColumn("__row", F.row_number().over(ordered) - 1)
    if position:
        # History comes before all of a block's own events.
        history = F.sum("__copy").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counted = counted.withColumn("__own", F.col("__row") - history)
    counted = counted.withColumn(name, F.col("__row") - old).where("__copy = 0").drop("__copy", "__row")
    if not position:
        return counted.drop("__block")
    sizes = (df if source is None else source).groupBy(block.alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return counted.join(offsets, "__block").withColumn(position, F.col("__offset") + F.col("__own")).drop("__block", "__own", "__offset")


def _ewma_account(df: DataFrame, name: str = "ewma_account", decay: float = DECAY, position: str | None = None) -> DataFrame:
    """As the global mean, for each account by itself: positions and blocks are per account, so a hot account is spread over many blocks."""
    own = position or "__p"
    length = max(2, int(100 / -log(decay)))
    rows = df if position else with_position(df, own, ("account",))
    rows = rows.withColumn("__key", F.struct("account")).withColumn("__b", F.floor(F.col(own) / length)).withColumn("__k", F.col(own) % length)
    share = F.when(F.col(own) == 0, F.col("amount")).otherwise((1 - decay) * F.col("amount")) * F.pow(F.lit(1 / decay), F.col("__k"))
    inside = Window.partitionBy("__key", "__b").orderBy("__k")
    rows = rows.withColumn("__past", F.sum(share).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy("__key", (F.col("__b") + 1).alias("__b")).agg((F.sum(share) * F.pow(F.lit(decay), F.max("__k"))).alias("__carry"))
    rows = rows.join(ends, ["__key", "__b"], "left")
    local = F.coalesce(F.col("__past") * F.pow(F.lit(decay), F.col("__k") - 1), F.lit(0.0))
    carried = F.coalesce(F.col("__carry") * F.pow(F.lit(decay), F.col("__k")), F.lit(0.0))
    drop = ["__key", "__b", "__k", "__past", "__carry"] + ([] if position else [own])
    return rows.withColumn(name, F.when(F.col(own) == 0, F.col("amount")).otherwise(local + carried)).drop(*drop)


def over_last(df: DataFrame, name: str, value: Column, last: int, keys: tuple[str, ...] = ("account",), position: str | None = None, current: bool = False) -> DataFrame:
    """`value`, an aggregate, over each event's `last` predecessors of its key (and itself, if `current`).

    A key's events are cut into blocks by position, each with copies of the last events of the block
    before it, so a hot key is spread over many tasks.
    """
    own = position or "__p"
    rows = df if position else with_position(df, own, keys)
    block = max(HISTORY_BLOCK, 2 * last)
    copies = F.when(F.col(own) % block >= block - last, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("__copy", F.explode(copies)).withColumn("__block", F.floor(F.col(own) / block) + F.col("__copy"))
    frame = Window.partitionBy(*keys, "__block").orderBy(own).rowsBetween(-last, 0 if current else -1)
    return rows.withColumn(name, value.over(frame)).where("__copy = 0").drop("__copy", "__block", *([] if position else [own]))


def category_prior(df: DataFrame) -> DataFrame:
    """category, n, prior: shares of the categories in a (training) table."""
    counts = df.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).select("category", "n", (F.col("n") / F.col("__total")).alias("prior"))


def _footprint(df: DataFrame, prior: dict[str, float], name: str = "footprint", last: int = FOOTPRINT, least: int = FOOTPRINT_LEAST, position: str | None = None) -> DataFrame:
    """Share of an event's category among its account's last events; with fewer than `least`, the category's prior (0 if unknown)."""
    rows = over_last(df, "__h", F.collect_list("category"), last, position=position)
    known = F.lit(0.0)
    if prior:
        table = F.create_map(*(F.lit(x) for pair in sorted(prior.items()) for x in pair))
        known = F.coalesce(F.try_element_at(table, F.col("category")), F.lit(0.0))
    same = F.size(F.filter("__h", lambda c: c == F.col("category")))
    return rows.withColumn(name, F.when(F.size("__h") < least, known).otherwise(same / F.size("__h"))).drop("__h")


def _expanding_frequency(df: DataFrame, n_categories: int, name: str = "category_frequency", position: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """(earlier events of the category + 1) / (earlier events + n_categories); null is a category as well."""
    own = position or "__position"
    source = df if source is None else source
    rows = df if position else with_position(df, own, source=source)
    rows = with_position(rows, "__same", ("category",), source=source)
    return rows.withColumn(name, (F.col("__same") + 1) / (F.col(own) + n_categories)).drop("__same", *([] if position else [own]))


def ewma_global(df: DataFrame, name: str = "ewma_global", decay: float = DECAY) -> DataFrame:
    """The exponentially weighted mean of all valid amounts before each event; null for events that aren't valid."""
    return _apart(df, lambda rows: _ewma_global(rows, name, decay))


def count_window(df: DataFrame, name: str = "count_window", seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Valid events before each one within `seconds` (the left edge is out); null for events that aren't valid."""
    return _apart(df, lambda rows: _count_window(rows, name, seconds))


def ewma_account(df: DataFrame, name: str = "ewma_account", decay: float = DECAY) -> DataFrame:
    """The same mean within each account."""
    return _apart(df, lambda rows: _ewma_account(rows, name, decay))


def footprint(df: DataFrame, prior: dict[str, float], name: str = "footprint", last: int = FOOTPRINT, least: int = FOOTPRINT_LEAST) -> DataFrame:
    """Share of an event's category among its account's last valid events; with fewer than `least`, the category's prior."""
    return _apart(df, lambda rows: _footprint(rows, prior, name, last, least))


def expanding_frequency(df: DataFrame, n_categories: int, name: str = "category_frequency", position: str | None = None) -> DataFrame:
    """(earlier valid events of the category + 1) / (earlier valid events + n_categories).

    `position`, if given, counts the valid events before each.
    """
    return _apart(df, lambda rows: _expanding_frequency(rows, n_categories, name, position))


def hour_utc(name: str = "t") -> Column:
    """Hour of the day in UTC of seconds since the epoch."""
    return F.floor(F.pmod(F.floor(F.col(name)), F.lit(86_400)) / 3600).cast("int")


def linear_features(df: DataFrame, seconds: float = WINDOW_SECONDS, decay: float = DECAY) -> DataFrame:
    """The features of the linear policy, ewma_global and count_window, and `invalid`: null features, no part in state."""
    return _apart(df, lambda rows: _ewma_global(_count_window(rows, seconds=seconds, position="__at"), decay=decay, position="__at").drop("__at")).withColumn("invalid", F.col("count_window").isNull())


def account_features(df: DataFrame, prior: dict[str, float], seconds: float = WINDOW_SECONDS, decay: float = DECAY, position: str | None = None) -> DataFrame:
    """The six features of the table policy beside the amount: hour, count_window, ewma_account, footprint, category_frequency.

    And `invalid`, as in linear_features. `position`, if given, counts the valid events before each.
    """

    def build(source: DataFrame) -> DataFrame:
        # What needs its input twice comes first, while that is cheap; all sizes are counted from the source.
        rows = _ewma_account(with_position(source, "__own", ("account",)), decay=decay, position="__own")
        rows = _footprint(rows, prior, position="__own").drop("__own")
        rows = _count_window(rows, seconds=seconds, position=None if position else "__at", source=source)
        rows = _expanding_frequency(rows, max(len(prior), 1), position=position or "__at", source=source)
        return rows.drop("__at").withColumn("hour", hour_utc())

    return _apart(df, build).withColumn("invalid", F.col("count_window").isNull())
