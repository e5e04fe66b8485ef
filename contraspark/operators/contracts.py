"""Contracts of comparisons (which reference plays which role) and what a change of one asks for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a contract that name a reference, and the values that the others may have.
ROLE_FIELDS = ["model_input_id", "prediction_reference_id", "observation_reference_id", "storage_baseline_id", "native_state_baseline_id"]
ALLOWED = {"task": ("treated_state", "reference_effect"), "output_kind": ("state", "native_effect"), "storage_encoding": ("state", "effect")}
FIELDS = ["task", "output_kind", "input_conditioned", "storage_encoding", *ROLE_FIELDS]


def _is_effect(p: str = "") -> Column:
    return F.col(f"{p}task") == "reference_effect"


def _is_state(p: str = "") -> Column:
    return F.col(f"{p}output_kind") == "state"


def _recoded(p: str = "") -> Column:
    """The stored array is not in the output's own encoding."""
    return F.col(f"{p}storage_encoding") != F.when(_is_state(p), "state").otherwise("effect")


def active_roles(contracts: DataFrame) -> DataFrame:
    """Adds ``active``, ``missing``, ``violations`` and ``valid``.

    active: fields that the contract needs, in the order of ROLE_FIELDS; missing: those of them that are null
    or empty. violations: names of fields with unknown or null values, ``empty:field`` for a reference
    given as empty text (an error even where the role is not active), ``missing:field``. A contract with an
    unknown task, kind, encoding or conditioning needs what its known fields tell.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    needed = {
        "model_input_id": F.col("input_conditioned"),
        "prediction_reference_id": _is_effect() & _is_state(),
        "observation_reference_id": _is_effect(),
        "storage_baseline_id": _recoded(),
        "native_state_baseline_id": (F.col("task") == "treated_state") & (F.col("output_kind") == "native_effect"),
    }
    needed = {c: sure(x) for c, x in needed.items()}
    listed = lambda pairs: F.array_compact(F.array(*[F.when(when, F.lit(name)) for name, when in pairs]))
    lacking = {c: needed[c] & (F.coalesce(F.col(c), F.lit("")) == "") for c in ROLE_FIELDS}
    unknown = [(c, ~sure(F.col(c).isin(*values))) for c, values in ALLOWED.items()] + [("input_conditioned", F.col("input_conditioned").isNull())]
    wrong = listed([*unknown, *[(f"empty:{c}", sure(F.col(c) == "")) for c in ROLE_FIELDS], *[(f"missing:{c}", lacking[c]) for c in ROLE_FIELDS]])
    out = contracts.withColumn("active", listed(list(needed.items()))).withColumn("missing", listed(list(lacking.items()))).withColumn("violations", wrong)
    return out.withColumn("valid", F.size("violations") == 0)


def action_plan(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """What each change of contract asks for.

    A change is ``plannable`` if both contracts are valid and output kind and conditioning stay; otherwise
    ``reason`` says why not, and all that would follow is null. A contract on one side alone is not plannable.
    """
    j = active_roles(before).alias("b").join(active_roles(after).alias("a"), F.col(f"b.{key}") == F.col(f"a.{key}"), "full")
    changed = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    reason = (
        F.when(F.col(f"b.{key}").isNull(), "no_contract_before").when(F.col(f"a.{key}").isNull(), "no_contract_after").when(~F.col("b.valid"), "invalid_contract_before").when(~F.col("a.valid"), "invalid_contract_after")
        .when(changed("output_kind"), "output_kind_changed").when(changed("input_conditioned"), "input_conditioned_changed")
    )
    effect, state = _is_effect("a."), _is_state("a.")
    task = changed("task")
    reload = F.col("a.input_conditioned") & changed("model_input_id")
    prediction = effect & state & changed("prediction_reference_id")
    observation = effect & changed("observation_reference_id")
    lift = ~effect & ~state & changed("native_state_baseline_id")
    scope = F.when(task, "new_task").when(observation, "new_observed_realization").when(prediction, "new_prediction_effect").when(lift, "new_prediction_state").otherwise("same_declared_quantity")
    action = F.when(~effect, "unused").when(~state & reload, "select_new_native_effect_without_centring").when(state & (task | prediction | reload), "recentre").otherwise("preserve")
    definition = task | prediction | lift
    columns = {
        "prediction_action": F.when(reload, "load_or_generate_for_new_input").otherwise("reuse"), "prediction_effect_action": action,
        "observed_target_action": F.when(task | observation, "rebuild").otherwise("preserve"), "comparison_scope": scope,
        "requires_task_declaration": task, "requires_reference_record_update": prediction | observation, "requires_prediction_definition_update": definition, "requires_score_recompute": reload | definition | observation,
        "task_type_changed": task, "model_input_changed": reload, "prediction_reference_changed": prediction, "observation_reference_changed": observation, "native_state_baseline_changed": lift,
        "prediction_definition_changed": definition, "observed_realization_changed": task | observation,
        "storage_encoding_changed": changed("storage_encoding"), "storage_baseline_changed": (_recoded("a.") | _recoded("b.")) & changed("storage_baseline_id"),
        "changed_fields": F.array_join(F.array_compact(F.array(*[F.when(changed(c), F.lit(c)) for c in FIELDS])), ","),
    }
    plannable = reason.isNull()
    planned = reduce(lambda out, name: [*out, F.when(plannable, columns[name]).alias(name)], columns, [])
    return j.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), plannable.alias("plannable"), reason.alias("reason"), *planned)
