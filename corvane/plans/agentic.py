"""A multi-turn answer as one plan: resolve, plan, retrieve, generate, audit, and the turns to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import answering, dialogue, routing
from corvane.plans import search

CONTEXT = "struct<metric_scope:array<string>,aspect_scope:array<string>,comparison_target:string,output_style:string,dialogue_referents:array<string>>"


def resolved(turns: DataFrame) -> DataFrame:
    """Turns (session_id, user_query, messages array<struct<role, content>>, and if there: last_entity, conversation_summary) with plan, search_query, generation_query and context."""
    none = F.lit(None)
    has = lambda c: F.col(c) if c in turns.columns else none.cast("string")
    session = F.coalesce("session_id", F.uuid())
    t = turns.select(session.alias("session_id"), "user_query", F.coalesce("messages", F.array().cast("array<struct<role:string,content:string>>")).alias("said"), has("last_entity").alias("last_entity"), has("conversation_summary").alias("kept_summary"))
    t = t.withColumn("messages", F.transform("said", lambda m: F.coalesce(m["content"], F.lit("")))).withColumn("conversation_anchor", none.cast("string")).withColumn("recent", none.cast("array<string>"))
    r = dialogue.resolve(t).withColumn("conversation_summary", F.coalesce(dialogue.blank_to_null(F.col("kept_summary")), dialogue.blank_to_null(dialogue.summary(F.col("said")))))
    r = r.select("*", none.cast("struct<entity:string,product:string,topic:string>").alias("topic"), none.cast(CONTEXT).alias("last_context"), none.cast("int").alias("top_k"), none.cast("boolean").alias("tables_only"))
    p = dialogue.plan(r)
    return p.select("session_id", "user_query", "resolved_query", "follow_up", "anchor", "plan", "said", "conversation_summary", dialogue.search_query(F.col("resolved_query"), F.col("plan")).alias("search_query"), dialogue.generation_query(F.col("resolved_query"), F.col("plan")).alias("generation_query"), dialogue.conversation_context(F.col("plan"), F.col("follow_up"), F.col("conversation_summary")).alias("context"))


def answer(turns: DataFrame, index: dict[str, DataFrame], *, top_k: int = 6, generator=answering.extractive, max_retry: int = 2, max_steps: int = 8, **fusion) -> dict[str, DataFrame]:
    """plans, answers, citations, trace and sessions of one turn for each session.

    ``sessions`` are (session_id, turn, question, answer), as sessions.track() takes them: feeding them there persists the turn."""
    plans = resolved(turns)
    asked = plans.select(F.col("session_id").alias("query_id"), F.col("search_query").alias("query"))
    ranked = search.indexed_search(asked, index, top_k, **fusion)
    evidence = answering.pack(ranked)
    prompts = answering.prompts(plans.select(F.col("session_id").alias("query_id"), F.col("generation_query").alias("query"), "context"), answering.evidence_block(evidence))
    answers = answering.generate(prompts, generator)
    claims = answers.select("query_id", F.posexplode("claims").alias("claim_ord", "c")).select("query_id", "claim_ord", "c.claim", "c.supporting_chunk_ids")
    verified = answering.audit(claims, evidence)
    cited = answering.citations(verified, evidence)
    kinds = dialogue.evidence_kind(F.lit(None).cast("string"), F.col("chunk_type"))
    found = ranked.groupBy("query_id").agg(F.count("*").alias("n_candidates"), F.collect_set(kinds).alias("evidence_types"))
    cites = cited.groupBy("query_id").agg(F.count("*").alias("n_citations"))
    state = plans.select(F.col("session_id").alias("query_id"), "resolved_query", "plan", F.size("said").alias("n_messages"), "anchor", "search_query").join(found, "query_id", "left").join(answers.select("query_id", F.length("answer").alias("answer_len"), F.size("claims").alias("n_claims"), "confidence"), "query_id", "left").join(cites, "query_id", "left")
    return {"plans": plans, "answers": answers.withColumnRenamed("query_id", "session_id"), "citations": cited.withColumnRenamed("query_id", "session_id"), "trace": routing.trace(state.na.fill(0, ["n_candidates", "n_citations"]), max_retry, max_steps).withColumnRenamed("query_id", "session_id"), "sessions": turns_to_keep(plans, answers)}


def turns_to_keep(plans: DataFrame, answers: DataFrame) -> DataFrame:
    a = answers.select(F.col("query_id").alias("session_id"), "answer")
    return plans.join(a, "session_id", "left").select("session_id", (F.floor(F.size("said") / 2) + 1).alias("turn"), F.col("user_query").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"))
