"""Scores of models under every assignment of reference blocks to the roles observation, prediction and input.

Profiles are arrays on one gene axis, and residuals are array expressions, so no Python runs per row.
"""

from __future__ import annotations

from itertools import permutations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERN = "CASE WHEN observation = prediction AND prediction = input THEN 'S' WHEN observation = prediction THEN 'M' WHEN observation = input THEN 'P' WHEN prediction = input THEN 'O' ELSE 'D' END"


def mean_profile(df: DataFrame, keys: list[str], profile: str = "profile") -> DataFrame:
    """Mean of the profiles of each key: partial sums by key and position, then one array for each key."""
    long = df.select(*keys, F.posexplode(profile).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("v"))
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("x")).select(*keys, F.transform("x", lambda e: e["v"]).alias("profile"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def mean_square(residual: Column, scale: Column) -> Column:
    return F.aggregate(F.zip_with(residual, scale, lambda r, s: (r / s) * (r / s)), F.lit(0.0), lambda acc, x: acc + x) / F.size(residual)


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


TUPLE = ["task", "allocation", "depth", "model", "kind", "conditioned"]


def role_tuple_mse(targets: DataFrame, blocks: DataFrame, predictions: DataFrame, scales: DataFrame, conditioned: DataFrame | None = None) -> DataFrame:
    """task, allocation, depth, model, kind, conditioned, observation, prediction, input, mse for all role tuples.

    State residual (p - y) + (b_o - b_p); effect residual p - (y - b_o). ``predictions`` are fixed, so
    their scores are made for (o, p) or (o) and repeated for the other roles; ``conditioned`` ones (with
    allocation, depth and input) are one profile for each input block.
    """
    key = ["allocation", "depth"]
    o = blocks.select(*key, F.col("block").alias("observation"), F.col("profile").alias("bo"))
    p = blocks.select(*key, F.col("block").alias("prediction"), F.col("profile").alias("bp"))
    each = o.select(*key, F.col("observation").alias("input"))
    both = o.join(p, key).select(*key, "observation", "prediction", minus("bo", "bp").alias("shift"))
    cols = ["task", *key, "model", "kind", "observation", "prediction", "input", "mse"]

    def losses(models: DataFrame, on: list[str]) -> DataFrame:
        """Effects meet observation blocks, states pairs of blocks; ``on`` are the keys that models and blocks share."""
        meet = lambda x, y: x.join(y, on) if on else x.crossJoin(F.broadcast(y))  # noqa: E731  few blocks
        effect = meet(models.where("kind = 'effect'"), o).withColumn("mse", mean_square(minus("f", minus("treated", "bo")), F.col("scale"))).drop("bo", "f", "treated", "scale")
        effect = effect.join(p.drop("bp"), key)
        state = meet(models.where("kind = 'state'"), both)
        state = state.withColumn("mse", mean_square(F.zip_with(minus("f", "treated"), "shift", lambda x, y: x + y), F.col("scale")))
        own = [c for c in cols if c in effect.columns]
        return effect.select(*own).union(state.select(*own))

    model = lambda df: targets.join(df.withColumnRenamed("prediction", "f"), "task").crossJoin(F.broadcast(scales))  # noqa: E731  one row of scales
    out = losses(model(predictions), []).join(each, key).select(*cols, F.lit(False).alias("conditioned"))
    if conditioned is not None:
        out = out.union(losses(model(conditioned), key).select(*cols, F.lit(True).alias("conditioned")))
    return out.select(*TUPLE, "observation", "prediction", "input", "mse")


def pattern_mse(tuples: DataFrame) -> DataFrame:
    """Mean score of each role-sharing pattern: score first, then average."""
    return tuples.groupBy(*TUPLE, F.expr(PATTERN).alias("pattern")).agg(F.avg("mse").alias("mse"), F.count("*").alias("tuples"))


def reference_distance(blocks: DataFrame, scales: DataFrame) -> DataFrame:
    """allocation, depth, v: mean scaled squared distance over ordered block pairs."""
    a, b = blocks.alias("a"), blocks.alias("b")
    on = (F.col("a.allocation") == F.col("b.allocation")) & (F.col("a.depth") == F.col("b.depth")) & (F.col("a.block") != F.col("b.block"))
    pair = a.join(b, on).crossJoin(F.broadcast(scales))  # one row of scales
    return pair.select("a.allocation", "a.depth", mean_square(minus("a.profile", "b.profile"), F.col("scale")).alias("v")).groupBy("allocation", "depth").agg(F.avg("v").alias("v"))


def pair_margins(patterns: DataFrame) -> DataFrame:
    """All model pairs with margins d_s and d_d (loss of b minus loss of a); a is the effect in mixed pairs.

    applicable: no model of the pair is an effect conditioned on the input, for which margins have no identity.
    """
    key = ["task", "allocation", "depth"]
    wide = patterns.groupBy(*TUPLE).agg(*[F.max(F.when(F.col("pattern") == x, F.col("mse"))).alias(x) for x in ("S", "D")])
    wide = wide.withColumn("free", ~(F.col("conditioned") & (F.col("kind") == "effect")))
    a, b = wide.alias("a"), wide.alias("b")
    order = ((F.col("a.kind") == "effect") & (F.col("b.kind") == "state")) | ((F.col("a.kind") == F.col("b.kind")) & (F.col("a.model") < F.col("b.model")))
    j = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key]).where(order)
    return j.select(
        *[f"a.{c}" for c in key], F.col("a.model").alias("model_a"), F.col("b.model").alias("model_b"), F.col("a.kind").alias("kind_a"), F.col("b.kind").alias("kind_b"),
        (F.col("b.S") - F.col("a.S")).alias("d_s"), (F.col("b.D") - F.col("a.D")).alias("d_d"), (F.col("a.free") & F.col("b.free")).alias("applicable"),
    )


def identity_check(pairs: DataFrame, distance: DataFrame, atol: float = 1e-9, rtol: float = 1e-9) -> DataFrame:
    """d_d = d_s + v for an effect against a state, d_d = d_s for two of a kind; null where it is not applicable."""
    moved = F.when(F.col("kind_a") != F.col("kind_b"), F.col("v")).otherwise(0.0)
    j = pairs.join(distance, ["allocation", "depth"])
    holds = F.abs(F.col("d_d") - (F.col("d_s") + moved)) <= atol + rtol * F.greatest(F.abs("d_d"), F.abs("d_s"), moved)
    return j.withColumn("holds", F.when(F.col("applicable"), holds)).select("task", "allocation", "depth", "model_a", "model_b", "d_s", "d_d", "v", "applicable", "holds")


def crossing(pairs: DataFrame, tau: float = 1e-12) -> DataFrame:
    """Label of each pair by its preferred model under shared and disjoint roles."""
    s, d, mixed = F.col("d_s"), F.col("d_d"), F.col("kind_a") != F.col("kind_b")
    named = mixed & F.col("applicable")  # reversals have a direction of their own where the identity holds
    label = (
        F.when((F.abs(s) <= tau) | (F.abs(d) <= tau), "numerical_tie")
        .when((s < 0) & (d > 0), F.when(named, "state_to_effect").otherwise("ranking_reversal"))
        .when((s > 0) & (d < 0), F.when(named, "unexpected_reversal").otherwise("ranking_reversal"))
        .when(s > 0, F.when(mixed, "effect_preferred_both").otherwise("a_preferred_both"))
        .otherwise(F.when(mixed, "state_preferred_both").otherwise("b_preferred_both"))
    )
    return pairs.withColumn("label", label)


def tolerant_ranks(df: DataFrame, key: list[str], item: str, loss: str, tau: float = 1e-12) -> DataFrame:
    """Competition rank 1 + number of losses smaller by more than tau, and whether another is within tau."""
    a, b = df.alias("a"), df.alias("b")
    gap = F.col(f"a.{loss}") - F.col(f"b.{loss}")
    j = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in key])
    tied = F.max((F.col(f"a.{item}") != F.col(f"b.{item}")) & (F.abs(gap) <= tau))
    return j.groupBy(*[f"a.{c}" for c in key], f"a.{item}").agg((F.count_if(gap > tau) + 1).alias("rank"), tied.alias("tied"))


def primary_scores(tuples: DataFrame) -> DataFrame:
    """held-out effect (observation B2, prediction B1), shared effect (both B1), treated state, by allocation and depth."""
    target = F.when((F.col("observation") == "B2") & (F.col("prediction") == "B1") & (F.col("kind") == "effect"), "heldout_effect")
    target = target.when((F.col("observation") == "B1") & (F.col("prediction") == "B1") & (F.col("kind") == "effect"), "shared_effect").when((F.col("observation") == "B1") & (F.col("prediction") == "B1"), "treated_state")
    return tuples.where("input = 'B1'").withColumn("target", target).where("target is not null").select("task", "allocation", "depth", "model", "target", "mse")


ROLES, BLOCKS = ("observation", "prediction", "input"), ("B1", "B2", "B3")


def _number(at: dict[str, str]) -> int:
    """A role tuple as a number below 27."""
    return sum(BLOCKS.index(at[role]) * 3**i for i, role in enumerate(ROLES))


def _contrasts(tuples: DataFrame, name: str, rows: dict[str, list[tuple[int, ...]]], signs: tuple[int, ...]) -> DataFrame:
    """task, allocation, depth, model, ``name`` and x, the array of signed sums of scores that can be made, for each row of the plan.

    ``rows`` lists the tuples' numbers of every sum. The plan is data, so the plan's length does not grow the code.
    """
    place = sum((F.array_position(F.array(*map(F.lit, BLOCKS)), F.col(role)) - 1) * 3**i for i, role in enumerate(ROLES))
    scores = tuples.groupBy("task", "allocation", "depth", "model").agg(F.map_from_entries(F.collect_list(F.struct(place.cast("int").alias("at"), "mse"))).alias("_s"))  # 27 entries
    plan = tuples.sparkSession.createDataFrame([(k, [list(v) for v in each]) for k, each in rows.items()], f"{name} string, _plan array<array<int>>")
    terms = lambda each: sum((F.try_element_at("_s", each[i]) * sign for i, sign in enumerate(signs)), F.lit(0.0))
    j = scores.crossJoin(F.broadcast(plan))  # three rows
    x = F.filter(F.transform("_plan", terms), lambda v: v.isNotNull())
    return j.select("task", "allocation", "depth", "model", name, x.alias("x")).where(F.size("x") > 0)


def _mean_abs() -> Column:
    return F.aggregate("x", F.lit(0.0), lambda acc, v: acc + F.abs(v)) / F.size("x")


def single_role_contrasts(tuples: DataFrame) -> DataFrame:
    """Per changed role: mean absolute and extreme differences over all directed changes with the other two roles fixed."""
    rows = {}
    for role in ROLES:
        other = [r for r in ROLES if r != role]
        rows[role] = [
            (_number(dict(zip(other, fixed, strict=True)) | {role: to}), _number(dict(zip(other, fixed, strict=True)) | {role: start}))
            for fixed in product(BLOCKS, repeat=2) for start, to in permutations(BLOCKS, 2)
        ]
    out = _contrasts(tuples, "role", rows, (1, -1))
    return out.select("task", "allocation", "depth", "model", "role", F.size("x").cast("long").alias("n"), _mean_abs().alias("mean_abs"), F.array_min("x").alias("least"), F.array_max("x").alias("most"))


def role_interactions(tuples: DataFrame) -> DataFrame:
    """S11 - S10 - S01 + S00 over two roles, the third fixed: count and mean absolute value of the 108."""
    rows = {}
    for first, second, fixed in (("observation", "prediction", "input"), ("observation", "input", "prediction"), ("prediction", "input", "observation")):
        corner = lambda x, y, z, n=(first, second, fixed): _number(dict(zip(n, (x, y, z), strict=True)))
        rows[f"{first}*{second}"] = [
            (corner(x, y, z), corner(x, v, z), corner(u, y, z), corner(u, v, z))
            for z in BLOCKS for x, u in permutations(BLOCKS, 2) for y, v in permutations(BLOCKS, 2)
        ]
    out = _contrasts(tuples, "roles", rows, (1, -1, -1, 1))
    return out.select("task", "allocation", "depth", "model", "roles", F.size("x").cast("long").alias("n"), _mean_abs().alias("mean_abs"))


OPERATIONS = [("anchor_O", "B1", "B1", "B2"), ("input_only", "B3", "B1", "B2"), ("rescore_only", "B1", "B1", "B3"), ("matched_O_new_input", "B3", "B3", "B2"), ("shared_S", "B1", "B1", "B1")]


def operation_scores(tuples: DataFrame) -> DataFrame:
    """Score of each operation on a prediction (input, prediction, observation block) and its change from the anchor."""
    ops = F.broadcast(tuples.sparkSession.createDataFrame(OPERATIONS, "operation string, input string, prediction string, observation string"))
    key = ["task", "allocation", "depth", "model"]
    got = tuples.join(ops, ["input", "prediction", "observation"]).select(*key, "operation", "mse")
    anchor = got.where("operation = 'anchor_O'").select(*key, F.col("mse").alias("anchor"))
    return got.join(anchor, key).select(*key, "operation", "mse", (F.col("mse") - F.col("anchor")).alias("change"))


def states_by_input(blocks: DataFrame, predictions: DataFrame, conditioned: DataFrame | None = None) -> DataFrame:
    """task, allocation, depth, model, conditioned, input, state: the state that a model gives for each input block (one and the same for fixed ones)."""
    fixed = predictions.where("kind = 'state'").crossJoin(F.broadcast(blocks.select("allocation", "depth", F.col("block").alias("input"))))  # few blocks
    cols = ["task", "allocation", "depth", "model", "conditioned", "input", "state"]
    out = fixed.withColumn("conditioned", F.lit(False)).withColumnRenamed("prediction", "state").select(*cols)
    if conditioned is not None:
        out = out.union(conditioned.where("kind = 'state'").withColumn("conditioned", F.lit(True)).withColumnRenamed("prediction", "state").select(*cols))
    return out


def cross_moments(states: DataFrame, targets: DataFrame, blocks: DataFrame, scales: DataFrame) -> DataFrame:
    """task, allocation, depth, model, conditioned, k, displacement, means over ordered pairs of blocks.

    k: scaled product of a state's residual for an input block with the shift from another block to that one;
    it is zero for fixed states, as the shift changes sign with the order. displacement: root mean square
    scaled distance of the states for two input blocks.
    """
    key = ["task", "allocation", "depth", "model", "conditioned"]
    b = blocks.select("allocation", "depth", "block", "profile")
    own = states.join(targets, "task").join(b.withColumnRenamed("block", "input").withColumnRenamed("profile", "bi"), ["allocation", "depth", "input"])
    pair = own.join(b.withColumnRenamed("profile", "bj"), ["allocation", "depth"]).where("block <> input").crossJoin(F.broadcast(scales))  # one row of scales
    over = lambda x: F.zip_with(x, "scale", lambda v, s: v / s)
    k = dot(over(minus("state", "treated")), over(minus("bi", "bj"))) / F.size("state")
    moments = pair.groupBy(*key).agg(F.avg(k).alias("k"))
    other = states.select(*[F.col(c).alias(f"_{c}") for c in (*key, "input", "state")])
    apart = states.join(other, [F.col(c) == F.col(f"_{c}") for c in key]).where("input <> _input").crossJoin(F.broadcast(scales))
    distance = apart.groupBy(*key).agg(F.sqrt(F.avg(mean_square(minus("state", "_state"), F.col("scale")))).alias("displacement"))
    return moments.join(distance, key)


def pattern_identities(patterns: DataFrame, distance: DataFrame, moments: DataFrame) -> DataFrame:
    """Largest deviations of the patterns' losses from what the geometry of the blocks predicts, by kind of model.

    For states M = S, D = S + v, P = S + v + 2k, O = S + v - 2k and D = (P + O) / 2, and all states of a task
    move alike from S to D (pair_shift). A fixed effect has one loss in all patterns (spread). ``mean_shift`` is
    the mean of D - S - v (states) or D - S. Identities that do not apply to a kind are null.
    """
    wide = patterns.groupBy(*TUPLE).agg(*[F.max(F.when(F.col("pattern") == x, F.col("mse"))).alias(x) for x in "SMPOD"])
    key = ["task", "allocation", "depth", "model", "conditioned"]
    j = wide.join(distance, ["allocation", "depth"]).join(moments.select(*key, "k"), key, "left")
    state = F.col("kind") == "state"
    moved = F.when(state, F.col("D") - F.col("S"))
    group = j.where(state).groupBy("task", "allocation", "depth").agg(F.max(F.col("D") - F.col("S")).alias("_top"), F.min(F.col("D") - F.col("S")).alias("_low"))
    j = j.join(group, ["task", "allocation", "depth"], "left")
    most = lambda c: F.max(F.abs(c))
    spread = F.greatest(*"SMPOD") - F.least(*"SMPOD")
    shifted = F.col("S") + F.col("v")
    return j.groupBy("kind", "conditioned").agg(
        F.count("*").alias("n"), most(F.when(state, F.col("M") - F.col("S"))).alias("m_minus_s"), most(moved - F.col("v")).alias("d_minus_s_v"),
        most(F.when(state, F.col("P") - shifted - 2 * F.col("k"))).alias("p_minus_s_v_2k"), most(F.when(state, F.col("O") - shifted + 2 * F.col("k"))).alias("o_minus_s_v_2k"),
        most(F.when(state, F.col("D") - (F.col("P") + F.col("O")) / 2)).alias("d_minus_po"), F.max(F.when(~state & ~F.col("conditioned"), spread)).alias("spread"),
        F.max(F.when(state, F.col("_top") - F.col("_low"))).alias("pair_shift"), F.avg(F.when(state, moved - F.col("v")).otherwise(F.col("D") - F.col("S"))).alias("mean_shift"),
    )


def profile_metrics(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """RMSE, Pearson, cosine, MAE, magnitudes and their ratio of profiles joined by task; null where a norm is 0."""
    j = observed.join(predicted, "task").select("task", "model", F.col("observed").alias("y"), F.col("predicted").alias("f"))
    n = F.size("y")
    yy, ff, yf = dot(F.col("y"), F.col("y")), dot(F.col("f"), F.col("f")), dot(F.col("y"), F.col("f"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    e = minus("f", "y")
    j = j.withColumn("my", total("y") / n).withColumn("mf", total("f") / n)
    j = j.withColumn("dy", F.transform("y", lambda x: x - F.col("my"))).withColumn("df", F.transform("f", lambda x: x - F.col("mf")))
    vy, vf, cov = dot(F.col("dy"), F.col("dy")) / n, dot(F.col("df"), F.col("df")) / n, dot(F.col("dy"), F.col("df")) / n
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))
    tiny = 1e-18
    return j.select(
        "task", "model", F.sqrt(dot(e, e) / n).alias("rmse"), (F.aggregate(e, F.lit(0.0), lambda acc, x: acc + F.abs(x)) / n).alias("mae"),
        F.when((vy > tiny) & (vf > tiny), clip(cov / F.sqrt(vy * vf))).alias("pearson"), F.when((yy > tiny) & (ff > tiny), clip(yf / F.sqrt(yy * ff))).alias("cosine"),
        F.sqrt(yy).alias("magnitude_observed"), F.sqrt(ff).alias("magnitude_predicted"), F.when(yy > tiny, F.sqrt(ff) / F.sqrt(yy)).alias("magnitude_ratio"),
    )


def centroid_retrieval(observed: DataFrame, predicted: DataFrame) -> DataFrame:
    """Share of other targets that are farther from a prediction than its own. The targets are one small roster."""
    c = F.broadcast(observed.select(F.col("task").alias("candidate"), F.col("observed").alias("c")))
    e = minus("predicted", "c")
    dist = predicted.crossJoin(c).select("task", "model", "candidate", dot(e, e).alias("d2"))
    own = dist.where("task = candidate").select("task", "model", F.col("d2").alias("own"))
    j = dist.where("task <> candidate").join(own, ["task", "model"])
    return j.groupBy("task", "model").agg(F.avg((F.col("d2") > F.col("own")).cast("double")).alias("retrieval"))


def standardized_utility(observed: DataFrame, predicted: DataFrame, scales: DataFrame, floor: float = 0.1, weights: DataFrame | None = None) -> DataFrame:
    """Minus the sum, the mean and, with ``weights`` (one row, an array by gene), the weighted sum of squared errors over scales of ``floor`` at least."""
    j = observed.join(predicted, "task").crossJoin(F.broadcast(scales))  # one row of scales
    if weights is not None:
        j = j.crossJoin(F.broadcast(weights.select("weight")))  # one row
        e = F.zip_with(minus("predicted", "observed"), F.transform("scale", lambda s: F.greatest(s, F.lit(floor))), lambda x, s: (x / s) * (x / s))
        j = j.withColumn("utility_weighted", -dot(F.col("weight"), e))
    mse = mean_square(minus("predicted", "observed"), F.transform("scale", lambda s: F.greatest(s, F.lit(floor))))
    return j.select("task", "model", (-mse * F.size("observed")).alias("utility_sum"), (-mse).alias("utility_mean"), *(["utility_weighted"] if weights is not None else []))


def complement_scores(targets: DataFrame, blocks: DataFrame, predictions: DataFrame, scales: DataFrame) -> DataFrame:
    """Effect score of each input block against the mean of the other two blocks; mean over blocks after squaring."""
    a, b = blocks.alias("a"), blocks.alias("b")
    on = (F.col("a.allocation") == F.col("b.allocation")) & (F.col("a.depth") == F.col("b.depth")) & (F.col("a.block") != F.col("b.block"))
    other = mean_profile(a.join(b, on).select("a.allocation", "a.depth", F.col("a.block").alias("input"), F.col("b.profile").alias("profile")), ["allocation", "depth", "input"])
    j = targets.join(predictions.where("kind = 'effect'"), "task").crossJoin(F.broadcast(other)).crossJoin(F.broadcast(scales))  # few blocks, one row
    mse = mean_square(minus("prediction", minus("treated", "profile")), F.col("scale"))
    return j.select("task", "model", "allocation", "depth", mse.alias("mse")).groupBy("task", "model", "depth").agg(F.avg("mse").alias("mse"), F.count("*").alias("n"))


def refuse_overlap(cells: DataFrame) -> None:
    """Raise when a cell has several roles, or one role twice, in a direction of a rule (rule, direction, role, cell_id)."""
    twice = cells.groupBy("rule", "direction", "cell_id").agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"input and observation rows overlap or repeat: {[tuple(r)[:3] for r in twice]}")


def partition_losses(cells: DataFrame, controls: DataFrame, families: DataFrame, targets: DataFrame, scales: DataFrame, key: tuple[str, ...] = ("rule", "direction")) -> DataFrame:
    """task, key, family, loss of models whose state is ``factor`` times a control's profile, weighted over genes.

    ``families`` (family, factor) is a small roster. The effect is the mean state minus the mean of the
    input cells; the target is the treated mean minus that of the observation cells. ``scales`` has gene, s
    and w (weights that sum to one).
    """
    long = cells.join(controls.select("cell_id", "profile"), "cell_id").select(*key, "role", F.posexplode("profile").alias("gene", "v"))
    of = lambda role: F.avg(F.when(F.col("role") == role, F.col("v")))
    means = long.groupBy(*key, "gene").agg(of("input").alias("given"), of("observation").alias("ref"))
    x = means.join(scales, "gene").join(targets, "gene").crossJoin(F.broadcast(families))
    e = ((F.col("factor") - 1) * F.col("given") - (F.col("y") - F.col("ref"))) / F.col("s")
    return x.groupBy("task", *key, "family").agg(F.sum(F.col("w") * e * e).alias("loss"))
