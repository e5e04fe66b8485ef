"""Student's t, the incomplete beta function and exact binomial tails as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of Newton's rule.
ROUNDS = 8
#: Coefficients of Stirling's series for log gamma, from 1/y on.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)


def lgamma(x: Column) -> Column:
    """log gamma of x > 0: Stirling's series at x + 8, and the eight factors between."""
    y = x + 8
    series = sum((c / F.pow(y, 2 * i + 1) for i, c in enumerate(STIRLING)), F.lit(0.0))
    between = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - between


def let(fn: Callable[[Column], Column], **values: Column) -> Column:
    """fn of a struct of the values, which are evaluated once (an expression that is used twice would be copied)."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), fn)[0]


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) for 0 < x < 1, by its continued fraction from the side where that converges fast."""

    def step(s: Column, m: Column) -> Column:
        p, q, z = s["p"], s["q"], s["z"]
        even = m * (q - m) * z / ((p - 1 + 2 * m) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 1 + 2 * m))

        def move(v: Column) -> Column:
            fields = {"c": 1 + v["odd"] / v["c"], "d": 1 / (1 + v["odd"] * v["d"])}
            return let(lambda w: F.struct(p.alias("p"), q.alias("q"), z.alias("z"), w["c"].alias("c"), w["d"].alias("d"), (s["h"] * v["d"] * v["c"] * w["d"] * w["c"]).alias("h")), **fields)

        return let(move, odd=odd, d=1 / (1 + even * s["d"]), c=1 + even / s["c"])

    def sides(v: Column) -> Column:
        p, q, z = v["p"], v["q"], v["z"]
        first = 1 / (1 - (p + q) * z / (p + 1))
        start = F.struct(p.alias("p"), q.alias("q"), z.alias("z"), F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        rounds = F.transform(F.sequence(F.lit(1), F.ceil(60 + 6 * F.sqrt(p + q)).cast("int")), lambda m: m.cast("double"))
        front = F.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * F.log(z) + q * F.log(1 - z))
        part = front * F.aggregate(rounds, start, step)["h"] / p
        return let(lambda w: F.when(v["near"], w["part"]).otherwise(1 - w["part"]), part=part)

    near = x < (a + 1) / (a + b + 2)
    return let(sides, near=near, p=F.when(near, a).otherwise(b), q=F.when(near, b).otherwise(a), z=F.when(near, x).otherwise(1 - x))


def binomial_tail(trials: Column, wins: Column) -> Column:
    """P[Bin(trials, 1/2) >= wins] in doubles; work grows with the root of the trials."""
    a, b = wins.cast("double"), (trials - wins + 1).cast("double")
    return F.when(wins <= 0, 1.0).when(wins > trials, 0.0).otherwise(beta_inc(a, b, F.lit(0.5)))


def _density(df: Column) -> Column:
    """gamma((df + 1) / 2) / gamma(df / 2) / sqrt(pi)."""
    return F.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / math.sqrt(math.pi)


def t_tail(t: Column, df: Column) -> Column:
    """P[T > t] of Student's t for t > 0, with full relative precision in the tail."""
    return 0.5 * beta_inc(df / 2, F.lit(0.5), df / (df + t * t))


def t_quantile(p: Column, df: Column) -> Column:
    """Quantile of Student's t for 1/2 < p < 1 and any df >= 1 (null below); Newton's rounds on the logarithm of the tail over log t."""
    df = F.when(df >= 1, df.cast("double"))
    # The normal quantile to three digits (a rational approximation), and its first correction, start the rounds.
    normal = lambda r: r - (2.515517 + 0.802853 * r + 0.010328 * r * r) / (1 + 1.432788 * r + 0.189269 * r * r + 0.001308 * r * r * r)
    near = let(lambda v: let(lambda w: w["z"] + (w["z"] * w["z"] * w["z"] + w["z"]) / (4 * df), z=normal(v["r"])), r=F.sqrt(-2 * F.log(1 - p)))
    start = F.when(df < 2, F.tan(math.pi * (p - 0.5))).otherwise(near)

    def step(t: Column, _: Column) -> Column:
        density = _density(df) / F.sqrt(df) * F.pow(1 + t * t / df, -(df + 1) / 2)
        move = lambda v: F.greatest(F.least((F.log(v["tail"]) - F.log(1 - p)) * v["tail"] / (t * density), F.lit(2.0)), F.lit(-2.0))
        return t * F.exp(let(move, tail=t_tail(t, df)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def with_t_quantile(df: DataFrame, p: Column, degrees: str, name: str) -> DataFrame:
    """``df`` with the t quantile at ``p`` for each row's degrees of freedom, solved once for each different pair."""
    asked = df.withColumn("_p", p)
    pairs = asked.select(F.col("_p").alias("_q"), F.col(degrees).alias("_df")).distinct()
    solved = pairs.withColumn(name, t_quantile(F.col("_q"), F.col("_df")))
    return asked.join(solved, (F.col("_p") == F.col("_q")) & (F.col(degrees) == F.col("_df")), "left").drop("_p", "_q", "_df")
