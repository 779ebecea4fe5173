"""The router of a question's workflow, on rows that hold its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_VALUE = ("caption_evidence", "low_value_evidence", "metadata_evidence", "navigational_evidence")
STEPS = (
    ("conversation_resolver", "missing_conversation_resolution", "resolve_then_plan"),
    ("query_planner", "missing_plan", "plan_then_retrieve"),
    ("retrieval_strategist", "missing_candidates", "retrieve_then_synthesize"),
    ("retrieval_strategist", "insufficient_evidence", "refine_retrieve"),
    ("synthesizer", "ready_to_synthesize", "synthesize"),
    ("citation_auditor", "missing_citation_audit", "audit"),
    ("finish", "workflow_complete", "finish"),
)


def low_value_only(types: Column) -> Column:
    return (F.size(types) > 0) & F.forall(types, lambda t: t.isin(*LOW_VALUE))


def route(states: DataFrame) -> DataFrame:
    """Adds next_node, reason, route_type and should_continue: the first step whose need is open.

    Columns: resolved_query, has_plan, n_candidates, n_evidence, evidence_types, draft_answer, n_citations, retry_count and
    max_retry_count (null or 0: 2)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    retry = F.coalesce("retry_count", F.lit(0)) < F.coalesce(F.nullif(F.col("max_retry_count"), F.lit(0)), F.lit(2))
    weak = none("n_evidence") | F.coalesce(low_value_only(F.col("evidence_types")), F.lit(False))
    needs = (blank("resolved_query"), ~F.coalesce("has_plan", F.lit(False)), none("n_candidates"), weak & retry, blank("draft_answer"), none("n_citations"))
    at = F.when(F.lit(False), 0)
    for i, need in enumerate(needs):
        at = at.when(need, i)
    at = at.otherwise(len(STEPS) - 1)
    pick = lambda j: F.element_at(F.array(*[F.lit(s[j]) for s in STEPS]), at + 1)
    return states.select("*", pick(0).alias("next_node"), pick(1).alias("reason"), pick(2).alias("route_type"), (at < len(STEPS) - 1).alias("should_continue"))


def trace_length(candidates: Column, low_value: Column, citations: Column, retry_count: Column, max_retry: Column, max_steps: int = 8) -> Column:
    """Steps a question takes: six, one more for each repeated retrieval that weak evidence allows (the count is 1 after the first), all if it can't get on."""
    limit = F.coalesce(F.nullif(max_retry, F.lit(0)), F.lit(2))
    again = F.when(low_value, F.greatest(limit - (F.coalesce(retry_count, F.lit(0)) + 1), F.lit(0))).otherwise(0)
    return F.when((candidates == 0) | (citations == 0), max_steps).otherwise(F.least(6 + again, F.lit(max_steps)))


def summaries(state: DataFrame) -> DataFrame:
    """``state`` with summaries: what each node of the workflow has to say, as text (node -> key=value, ...)."""
    pairs = lambda *kv: F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in kv])
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    p = F.col("plan")
    said = {
        "conversation_resolver": pairs(("resolved_user_query", F.col("resolved_query")), ("conversation_anchor", F.col("anchor")), ("message_count", F.col("n_messages"))),
        "query_planner": pairs(("intent", p["intent"]), ("sub_intents", listed(p["sub_intents"])), ("top_k", p["top_k"]), ("tables_only", p["tables_only"]), ("time_terms", listed(p["time_terms"])), ("metric_scope", listed(p["metric_scope"])), ("aspect_scope", listed(p["aspect_scope"])), ("comparison_target", p["comparison_target"]), ("output_style", p["output_style"])),
        "retrieval_strategist": pairs(("retrieval_query", F.col("search_query")), ("retrieved_count", F.col("n_candidates")), ("selected_evidence_types", listed(F.array_sort(F.coalesce("evidence_types", F.array().cast("array<string>")))))),
        "synthesizer": pairs(("answer_len", F.col("answer_len")), ("claim_count", F.col("n_claims")), ("confidence", F.col("confidence"))),
        "citation_auditor": pairs(("citation_count", F.col("n_citations")), ("confidence", F.col("confidence"))),
        "finish": F.lit(""),
    }
    return state.withColumn("summaries", F.create_map(*[x for k, v in said.items() for x in (F.lit(k), v)]))


def trace(state: DataFrame, max_retry: int = 2, max_steps: int = 8) -> DataFrame:
    """(query_id, step, next_node, reason, route_type, node_summary, status): the steps the workflow takes, up to max_steps, from what its nodes found.

    A retrieval that finds nothing is asked again until the steps run out, weak evidence until the retries do, and so is an audit
    without citations; status, on all of a query's steps, is finished, or stopped where it could not get on."""
    limit = max_retry or 2
    again = F.array_repeat(F.lit(3), F.when(low_value_only(F.coalesce("evidence_types", F.array().cast("array<string>"))), limit - 1).otherwise(0))
    steps = lambda *n: F.array(*[F.lit(i) for i in n])
    path = F.when(F.col("n_candidates") == 0, F.concat(steps(0, 1), F.array_repeat(F.lit(2), max_steps))).when(F.col("n_citations") == 0, F.concat(steps(0, 1, 2), again, steps(4), F.array_repeat(F.lit(5), max_steps))).otherwise(F.concat(steps(0, 1, 2), again, steps(4, 5, 6)))
    taken = F.slice(path, 1, max_steps)
    pick = lambda j: F.element_at(F.array(*[F.lit(s[j]) for s in STEPS]), F.col("at") + 1)
    status = F.when(F.element_at(taken, -1) == 6, "finished").otherwise("stopped")
    each = summaries(state).select("query_id", "summaries", status.alias("status"), F.posexplode(taken).alias("step", "at"))
    return each.select("query_id", (F.col("step") + 1).alias("step"), pick(0).alias("next_node"), pick(1).alias("reason"), pick(2).alias("route_type"), F.try_element_at("summaries", pick(0)).alias("node_summary"), "status")
