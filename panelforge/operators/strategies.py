"""Portfolios and volatility-controlled strategies, in long form.

returns: keys, date, asset, r. weights: keys, asset, w (or keys, date, asset, w for a path). keys tell
portfolios apart, so a grid of settings is one plan that is partitioned by its id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import dated, period, rolling_std, so_far


def class_weights(dim: DataFrame, shares: DataFrame) -> DataFrame:
    """share, asset, w: the traditional split scaled to 1 - share, share dealt equally over crypto assets."""
    crypto = F.col("asset_class") == "crypto"
    n = F.sum(crypto.cast("int")).over(Window.partitionBy("share"))
    base = F.sum(F.when(~crypto, F.col("base_weight"))).over(Window.partitionBy("share"))
    w = F.when(crypto, F.col("share") / n).otherwise(F.col("base_weight") / base * (1 - F.col("share")))
    return dim.crossJoin(F.broadcast(shares)).withColumn("w", w).where("w > 0").select("share", "asset", "w")


def blended_bps(crypto_share: Column, traditional: float = 10.0, crypto: float = 25.0) -> Column:
    return (1 - crypto_share) * traditional + crypto_share * crypto


def constant_mix(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, r: weights on the assets that are there, scaled to one, every date; a missing return is 0."""
    present = weights.join(returns.select("asset").distinct(), "asset", "left_semi")
    scaled = present.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy(*keys)))
    return returns.join(F.broadcast(scaled), "asset").groupBy(*keys, "date").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("r"))


def true_buy_and_hold(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Invested once and never touched; the first date's return is 0 by definition."""
    value = F.col("w") * F.product(1 + F.coalesce("r", F.lit(0.0))).over(so_far([*keys, "asset"]))
    total = returns.join(F.broadcast(weights), "asset").withColumn("v", value).groupBy(*keys, "date").agg(F.sum("v").alias("v"))
    return total.withColumn("r", F.coalesce(F.col("v") / F.lag("v").over(dated(keys)) - 1, F.lit(0.0))).drop("v")


def together(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows dealt once by keys: what follows is partitioned by them and more, and needs no other exchange.

    A series of a panel is a row a date and asset, small enough for a task.
    """
    return rows.repartition(*[F.col(k) for k in keys]) if keys else rows


def held_weights(returns: DataFrame, weights: DataFrame, freq: str | Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, asset, r, w, and further columns of weights: weights reset into each period's first date and drifting within
    it. freq: the name of a period, or the period itself (null all along: never reset).

    In closed form: the target times the growth since the reset, scaled to one over the assets.
    """
    joined = together(returns.join(F.broadcast(weights), "asset"), keys).withColumn("__period", period(freq) if isinstance(freq, str) else freq)
    before = Window.partitionBy(*keys, "asset", "__period").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.col("w") * F.coalesce(F.product(1 + F.coalesce("r", F.lit(0.0))).over(before), F.lit(1.0))
    return joined.withColumn("__g", grown).withColumn("w", F.col("__g") / F.sum("__g").over(Window.partitionBy(*keys, "date"))).drop("__g", "__period")


def drifted_weights(returns: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The weights of a constant mix at a date's end, before they are reset."""
    grown = F.col("w") * (1 + F.coalesce("r", F.lit(0.0)))
    joined = returns.join(F.broadcast(weights), "asset").withColumn("__g", grown)
    return joined.withColumn("w", F.col("__g") / F.sum("__g").over(Window.partitionBy(*keys, "date"))).drop("__g")


def with_turnover(path: DataFrame, dim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, r, turnover, cost of a weight path with r: the change of held weights, and its price.

    The change of held weights counts passive drift too; see traded_turnover for trades alone.
    """
    change = F.coalesce(F.abs(F.col("w") - F.lag("w").over(dated([*keys, "asset"]))), F.lit(0.0))
    moved = path.withColumn("__d", change).join(F.broadcast(dim.select("asset", "cost_bps")), "asset")
    return moved.groupBy(*keys, "date").agg(
        F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("r"), F.sum("__d").alias("turnover"), F.sum(F.col("__d") * F.col("cost_bps") / 1e4).alias("cost")
    )


def traded_turnover(returns: DataFrame, weights: DataFrame, freq: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, traded: what is bought and sold into a reset, drifted weights against the target."""
    path = held_weights(returns, weights, freq, keys).join(F.broadcast(weights.withColumnRenamed("w", "__target")), [*keys, "asset"])
    grown = F.col("w") * (1 + F.coalesce("r", F.lit(0.0)))
    path = path.withColumn("__end", grown / F.sum(grown).over(Window.partitionBy(*keys, "date"))).withColumn("__last", F.lag("__end").over(dated([*keys, "asset"])))
    first = period(freq) != period(freq, F.lag("date").over(dated([*keys, "asset"])))
    return path.withColumn("__t", F.when(first, F.abs(F.col("__target") - F.col("__last"))).otherwise(0.0)).groupBy(*keys, "date").agg(F.sum("__t").alias("traded"))


def periodic_mix(returns: DataFrame, weights: DataFrame, dim: DataFrame, freq: str = "monthly", keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, gross, turnover, cost, r (net of cost) of a portfolio that is reset every period."""
    out = with_turnover(held_weights(returns, weights, freq, keys), dim, keys)
    return out.withColumnRenamed("r", "gross").withColumn("r", F.col("gross") - F.col("cost"))


def realised_vol(rows: DataFrame, keys: Sequence[str], method: str, lookback: Column | int, trading_days: int, halflife: int = 20, name: str = "__vol") -> DataFrame:
    """rows with the annualised volatility of r as `name`; null until the window is full."""
    annual = F.sqrt(F.lit(float(trading_days)))
    if method == "rolling":
        return rows.withColumn(name, rolling_std(F.col("r"), keys, lookback) * annual)
    return ewma_std(rows, keys, halflife, name).withColumn(name, F.col(name) * annual)


#: Half-lives of a block of rows (weights within it stay below 2 to the power of that), and how many of them still count.
BLOCK_LIVES, REACH_LIVES = 20, 60


def ewma_std(rows: DataFrame, keys: Sequence[str], halflife: int, name: str = "ewma") -> DataFrame:
    """rows with the exponentially weighted, bias-corrected standard deviation of r as `name`; null for the first rows.

    A scan of two levels. Rows that have an r are numbered and cut into blocks; within a block running sums weigh a row by
    how far it is from the block's first, so that one division gives sums that decay towards the current row. Blocks' sums, decayed in
    turn, are carried into the blocks after them, as far as a weight can change a double.
    """
    of, decay, size = list(keys), 0.5 ** (1 / halflife), BLOCK_LIVES * halflife
    moments = {"s0": (1.0, 1), "s00": (1.0, 2), "s1": (F.col("r"), 1), "s2": (F.col("r") * F.col("r"), 1)}
    grown = lambda power: F.pow(F.lit(1 / decay), F.col("__at").cast("double") * power)
    placed = rows.withColumn("__n", F.count("r").over(so_far(of))).withColumn("__b", F.floor((F.col("__n") - 1) / size)).withColumn("__at", F.col("__n") - 1 - F.col("__b") * size)
    terms = {m: F.when(F.col("r").isNotNull(), F.lit(x) * grown(power) if isinstance(x, float) else x * grown(power)).otherwise(0.0) for m, (x, power) in moments.items()}
    placed = placed.withColumns({f"__{m}": t for m, t in terms.items()})

    # a block's sums as its last place sees them, and what of all blocks before reaches its first place
    last = lambda power: decay ** ((size - 1) * power)
    blocks = placed.groupBy(*of, "__b").agg(*[(F.sum(f"__{m}") * last(power)).alias(f"__{m}") for m, (_, power) in moments.items()])
    order, back = Window.partitionBy(*of).orderBy("__b"), range(1, -(-REACH_LIVES // BLOCK_LIVES) + 1)
    carried = blocks.select(*of, "__b", *[sum((F.coalesce(F.lag(f"__{m}", j).over(order), F.lit(0.0)) * decay ** (((j - 1) * size + 1) * power) for j in back), F.lit(0.0)).alias(f"__c{m}") for m, (_, power) in moments.items()])
    within = Window.partitionBy(*of, "__b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.withColumns({f"__{m}": F.sum(f"__{m}").over(within) for m in moments}).join(carried, [*of, "__b"])
    sums = {m: (F.col(f"__{m}") + F.col(f"__c{m}")) / grown(power) for m, (_, power) in moments.items()}
    mean = sums["s1"] / sums["s0"]
    var = (sums["s2"] / sums["s0"] - mean * mean) * sums["s0"] * sums["s0"] / (sums["s0"] * sums["s0"] - sums["s00"])
    return summed.select(*rows.columns, F.when(F.col("__n") >= max(5, halflife), F.sqrt(F.greatest(var, F.lit(0.0)))).alias(name))


def target_exposure(vol: Column, target: Column | float, cap: float, keys: Sequence[str]) -> Column:
    """Target over realised volatility, capped, of the date before; all cash while the window fills."""
    e = F.when(vol == 0, F.lit(cap)).when(vol.isNotNull(), F.least(target / vol, F.lit(cap)))
    return F.coalesce(F.lag(e).over(dated(keys)), F.lit(0.0))


def held_exposure(e: Column, freq: str, keys: Sequence[str]) -> Column:
    """The first target of each day, ISO week or month, held through it."""
    if freq == "daily":
        return e
    within = Window.partitionBy(*keys, period(freq)).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first(e, ignorenulls=True).over(within)


def dead_band(series: DataFrame, band: float, keys: Sequence[str]) -> DataFrame:
    """Keeps the last traded exposure while the target is within the band of it.

    From each row the next trade is the first later row that is beyond the band on either side. It is searched by ranges: at each bit
    of the row numbers, rows of a left half look into the right half beside it, which windows ordered by exposure answer for all at once; the
    nearest half that has one comes first. The trades are then the rows that pointers reach from the first row, by doubling: the pointers of
    2, 4, 8, ... trades in turn, as one array a series.
    """
    if band <= 0:
        return series
    of = list(keys)
    rows = series.withColumn("__n", (F.row_number().over(dated(of)) - 1).cast("int"))
    sized = rows.select(*of, "__n", F.col("exposure").alias("__e"), (F.max("__n").over(Window.partitionBy(*of)) + 1).alias("__size"))
    bits = F.greatest(F.ceil(F.log2(F.col("__size").cast("double"))).cast("int"), F.lit(1))
    halves = sized.select("*", F.explode(F.sequence(F.lit(0), bits - 1)).alias("__b"))
    halves = halves.withColumn("__right", F.expr("shiftright(__n, __b) & 1")).withColumn("__pair", F.expr("shiftright(__n, __b + 1)"))
    by = ", ".join(f"`{c}`" for c in [*of, "__b", "__pair"])
    beyond = lambda key: F.expr(f"min(CASE WHEN __right = 1 THEN __n END) OVER (PARTITION BY {by} ORDER BY {key} RANGE BETWEEN UNBOUNDED PRECEDING AND {float(band)!r}D PRECEDING)")
    halves = halves.withColumn("__up", beyond("-__e")).withColumn("__down", beyond("__e"))
    following = halves.groupBy(*of, "__n").agg(F.min(F.when(F.col("__right") == 0, F.least("__up", "__down"))).alias("__next"), F.first("__size").alias("__size"))
    # an array of a series' pointers: a series of a panel is small enough for a task
    listed = following.groupBy(*of).agg(F.first("__size").alias("__size"), F.sort_array(F.collect_list(F.struct("__n", "__next"))).alias("__list"))
    end = F.col("__size")
    jumps = F.concat(F.transform("__list", lambda x: F.coalesce(x["__next"], end)), F.array(end))

    def doubled(state: Column, _: Column) -> Column:
        met = F.concat(state["s"], F.transform(state["s"], lambda x: F.get(state["j"], x)))
        return F.struct(F.transform(state["j"], lambda x: F.get(state["j"], x)).alias("j"), F.filter(met, lambda x: x < end).alias("s"))

    reached = F.aggregate(F.sequence(F.lit(0), bits), F.struct(jumps.alias("j"), F.array(F.lit(0)).alias("s")), doubled, lambda state: state["s"])
    trades = listed.select(*of, F.explode(reached).alias("__n"), F.lit(True).alias("__trade"))
    held = F.last(F.when(F.col("__trade"), F.col("exposure")), ignorenulls=True).over(so_far(of))
    return rows.join(trades, [*of, "__n"], "left").withColumn("__held", held).select(*[F.col("__held").alias(c) if c == "exposure" else F.col(c) for c in series.columns])


def vol_control(
    base: DataFrame,
    keys: Sequence[str],
    lookback: int = 13,
    trading_days: int = 52,
    cap: float = 1.0,
    freq: str = "daily",
    band: float = 0.0,
    method: str = "rolling",
    halflife: int = 20,
) -> DataFrame:
    """keys, date, exposure, gross, cost, r of base (keys, date, r, rf, target, bps): exposure to r, the rest in cash."""
    return controlled(realised_vol(base, keys, method, lookback, trading_days, halflife), keys, cap, freq, band)


def controlled(rows: DataFrame, keys: Sequence[str], cap: float = 1.0, freq: str = "daily", band: float = 0.0) -> DataFrame:
    """vol_control from the realised volatility in __vol on."""
    rows = rows.withColumn("__e", target_exposure(F.col("__vol"), F.col("target"), cap, keys)).drop("__vol")
    rows = rows.withColumn("exposure", held_exposure(F.col("__e"), freq, keys)).drop("__e")
    rows = dead_band(rows, band, keys)
    change = F.abs(F.col("exposure") - F.coalesce(F.lag("exposure").over(dated(keys)), F.lit(0.0)))
    rows = rows.withColumn("turnover", change).withColumn("cost", F.col("turnover") * F.col("bps") / 1e4)
    gross = F.col("exposure") * F.col("r") + (1 - F.col("exposure")) * F.col("rf")
    return rows.withColumn("gross", gross).withColumn("r", F.col("gross") - F.col("cost"))


def control_grid(base: DataFrame, grid: DataFrame, keys: Sequence[str], lookbacks: Sequence[int], trading_days: int, cap: float = 1.0, freq: str = "daily") -> DataFrame:
    """vol_control of every row of grid (config_id, keys, lookback, target, bps) over base (keys, date, r, rf), as one plan.

    Each lookback's volatility is one window column of the base, computed once and shared by all
    targets; the rows then fan out by config_id, which is the partition key of what follows.
    """
    vols = [F.struct(F.lit(n).alias("lookback"), (rolling_std(F.col("r"), keys, n) * F.sqrt(F.lit(float(trading_days)))).alias("__vol")) for n in lookbacks]
    measured = base.select(*keys, "date", "r", "rf", F.array(*vols).alias("__vols")).select(*keys, "date", "r", "rf", F.inline("__vols"))
    return controlled(measured.join(F.broadcast(grid), [*keys, "lookback"]), ["config_id"], cap, freq)


def risk_parity(returns: DataFrame, lookback: int = 63, freq: str = "monthly", strict: bool = True, keys: Sequence[str] = ()) -> DataFrame:
    """keys, date, asset, r, w: inverse rolling volatility of the date before, held by period; dates with weights only.

    strict: a period takes the weights known at its first date. Otherwise its first known weights fill the
    whole period, also backwards.
    """
    inverse = F.when(F.col("__s") > 0, 1 / F.col("__s"))
    raw = together(returns, keys).withColumn("__s", rolling_std(F.col("r"), [*keys, "asset"], lookback)).withColumn("__i", inverse)
    share = F.col("__i") / F.sum("__i").over(Window.partitionBy(*keys, "date"))
    lagged = raw.withColumn("__w", share).withColumn("__w", F.lag("__w").over(dated([*keys, "asset"]))).withColumn("__period", period(freq))
    within = Window.partitionBy(*keys, "asset", "__period").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = lagged.withColumn("w", F.first("__w", ignorenulls=not strict).over(within))
    live = held.withColumn("__total", F.sum("w").over(Window.partitionBy(*keys, "date"))).where("__total > 0.5")
    return live.select(*keys, "date", "asset", "r", "w")


def inverse_vol_weights(returns: DataFrame) -> DataFrame:
    """asset, w: inverse full-sample volatility, scaled to one."""
    found = returns.groupBy("asset").agg(F.stddev_samp("r").alias("s")).where("s > 0").withColumn("__i", 1 / F.col("s"))
    return found.withColumn("w", F.col("__i") / F.sum("__i").over(Window.partitionBy())).select("asset", "w")

