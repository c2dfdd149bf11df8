"""Ranks, correlation, ROC, and picks near a quantile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import stored


def running(counts: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """counts with running sums (name: column) in this order of its rows, each row's own value included.

    Rows are dealt to ranges of the order; a window runs within each range, and one over the ranges' totals, so that
    no window holds the table. Rows that are equal by the order must not occur.
    """
    placed = stored(counts.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    totals = placed.groupBy("_p").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = totals.select("_p", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_p").orderBy(*order)
    rows = placed.join(F.broadcast(before), "_p")
    return rows.withColumns({n: F.sum(c).over(within) + F.col(f"_{n}") for n, c in sums.items()}).drop("_p", *(f"_{n}" for n in sums))


#: A value of over 1 / FREQUENT of the rows is frequent: there are at most so many, and they are broadcast.
FREQUENT = 10_000


def placed_values(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """_v, _n (rows), _to (rows up to it) of each distinct value, once; nulls left out. A stored table."""
    n = F.count("*") if weight is None else F.sum(weight)
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(n.alias("_n"))
    return stored(running(counts, [F.col("_v")], {"_to": "_n"}).select("_v", "_n", "_to"))


def attached(df: DataFrame, value: str, placed: DataFrame, out: str, what: Column) -> DataFrame:
    """df with out, an expression over _n and _to of placed_values(); null where value is null.

    Frequent values, FREQUENT at most, are broadcast, so that none of them is a hot key of the join.
    """
    total = placed.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    table = placed.select("_v", "_n", what.alias("_out"))
    often = F.broadcast(table.filter(F.col("_n") * FREQUENT > total).drop("_n"))
    rare = table.filter(F.col("_n") * FREQUENT <= total).select(F.col("_v").alias("_key"), F.col("_out").alias("_other"), F.lit(0).cast("long").alias("_salt"))
    names = [*(c for c in df.columns if c != out), F.coalesce("_out", "_other").alias(out)]
    # one pass over df: rows that the broadcast has settled, and nulls, look for nothing and are spread by a number
    rows = df.drop(out).join(often, F.col(value) == often["_v"], "left")
    rows = rows.withColumn("_key", F.when(F.col("_v").isNull(), F.col(value)))
    rows = rows.withColumn("_salt", F.when(F.col("_key").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long")))
    return rows.join(rare, ["_key", "_salt"], "left").select(*names)


def value_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the average rank of value (ties share it), from 1; nulls have none."""
    return attached(df, value, placed_values(df, value), out, F.col("_to") - (F.col("_n") - 1) / 2)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the correlation of the average ranks; null if either has no variance. Equal pairs count together."""
    pairs = stored(df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_w")))
    ranked = pairs
    for c in ("_a", "_b"):
        ranked = attached(ranked, c, placed_values(pairs, c, F.col("_w")), f"{c}r", F.col("_to") - (F.col("_n") - 1) / 2)
    n = pairs.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    x, y = F.col("_ar") - (n + 1) / 2, F.col("_br") - (n + 1) / 2
    sums = ranked.agg(F.sum(F.col("_w") * x * y).alias("xy"), F.sum(F.col("_w") * x * x).alias("xx"), F.sum(F.col("_w") * y * y).alias("yy"))
    return sums.select(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = (), counted: bool = False) -> DataFrame:
    """by, share, value: exact quantiles with linear interpolation, of each group; nulls don't count, groups without a value
    give no row. counted: with n, the group's values. No task holds a group: distinct values are counted, put in order by ranges, and two of them picked."""
    counts = stored(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    earlier = Window.orderBy(*by, F.lit(0)).rowsBetween(Window.unboundedPreceding, -1)  # one row a group
    totals = totals.withColumn("_first", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    ranked = running(counts, [*(F.col(c) for c in by), F.col("_v")], {"_to": "_n"})
    rows = ranked.join(totals, list(by)) if by else ranked.join(F.broadcast(totals), F.col("_all").isNotNull())  # one row
    at = lambda s: (F.col("_all") - 1) * F.lit(float(s))
    to = F.col("_to") - F.col("_first")
    holds = lambda k: (to > k) & (to - F.col("_n") <= k)
    picks = F.array(*(F.struct(F.lit(float(s)).alias("share"), holds(F.floor(at(s))).alias("low"), holds(F.ceil(at(s))).alias("high"), (at(s) - F.floor(at(s))).alias("part")) for s in shares))
    found = rows.withColumn("_p", F.explode(F.filter(picks, lambda x: x["low"] | x["high"])))
    ends = found.groupBy(*by, F.col("_p.share").alias("share")).agg(F.max(F.when(F.col("_p.low"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_p.high"), F.col("_v"))).alias("_b"), F.max("_p.part").alias("_f"), F.max("_all").alias("n"))
    return ends.select(*by, "share", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("value"), *(["n"] if counted else []))


def quantile_values(df: DataFrame, value: str, shares: tuple[float, ...]) -> list[float | None]:
    """The quantiles themselves, in the order of shares; None without a value."""
    found = {r["share"]: r["value"] for r in quantiles(df, value, shares).collect()}
    return [found.get(float(s)) for s in shares]


def roc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """threshold, tpr, fpr for each distinct score from the highest down (ties together), after (null, 0, 0)."""
    rows = df.filter(F.col(score).isNotNull() & positive.isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    rows = stored(rows)
    all_p, all_n = rows.agg(F.sum("p"), F.sum("n")).first()
    out = running(rows, [F.desc("threshold")], {"tp": "p", "fp": "n"})
    points = out.select("threshold", F.try_divide("tp", F.lit(all_p).cast("long")).alias("tpr"), F.try_divide("fp", F.lit(all_n).cast("long")).alias("fpr"))
    return points.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")).union(points)


def auc(df: DataFrame, score: str, positive: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """by, n_pos, n_neg, auc from rank sums: (sum of positive ranks - n1 (n1 + 1) / 2) / (n1 n0); null without both classes."""
    counts = df.filter(F.col(score).isNotNull() & positive.isNotNull()).groupBy(*by, F.col(score).alias("v")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    placed = running(counts, [*(F.col(c) for c in by), F.col("v")], {"upto": "n"})
    before = F.col("upto") - F.col("n")  # negatives that come before this score, those of earlier groups included
    total = placed.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum(F.col("p") * (before + F.col("n") / 2)).alias("w"), F.min(before).alias("first"))
    wins = F.col("w") - F.col("first") * F.col("n_pos")
    return total.select(*by, "n_pos", "n_neg", F.try_divide(wins, F.col("n_pos") * F.col("n_neg")).alias("auc"))


def nearest_to(df: DataFrame, value: str, key: str, shares: tuple[float, ...]) -> DataFrame:
    """share, key, value of the row nearest to each quantile; of equally near ones the smallest key."""
    marks = [{"share": float(s), "at": q} for s, q in zip(shares, quantile_values(df, value, shares), strict=True) if q is not None]
    if not marks:
        return df.limit(0).select(F.lit(0.0).alias("share"), key, value)
    picks = df.agg(*(F.min(F.struct(F.abs(F.col(value) - r["at"]).alias("d"), F.col(key).alias("key"), F.col(value).alias("value"))).alias(f"p{k}") for k, r in enumerate(marks)))
    return picks.select(F.explode(F.array(*(F.struct(F.lit(r["share"]).alias("share"), F.col(f"p{k}.key").alias("key"), F.col(f"p{k}.value").alias("value")) for k, r in enumerate(marks)))).alias("r")).select("r.share", F.col("r.key").alias(key), F.col("r.value").alias(value))


def high_and_low(df: DataFrame, value: str, key: str, n: int = 3) -> DataFrame:
    """side, key, value: the n highest and lowest rows, ties to the smaller key."""
    rows = df.select(key, value)
    low, high = rows.orderBy(value, key).limit(n), rows.orderBy(F.desc(value), key).limit(n)
    return low.select(F.lit("low").alias("side"), key, value).union(high.select(F.lit("high").alias("side"), key, value))


def share_below(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the share of rows strictly below each value."""
    placed = placed_values(df, value)
    total = placed.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return attached(df, value, placed, out, (F.col("_to") - F.col("_n")) / F.lit(float(max(total, 1))))
