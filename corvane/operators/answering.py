"""From ranked evidence to an answer with citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import squeeze

REFUSAL = "The documents found do not support an answer."


def pack(ranked: DataFrame, most: int = 8) -> DataFrame:
    return ranked.where(F.col("rank") <= most)


def evidence_block(ranked: DataFrame) -> DataFrame:
    """(query_id, evidence, chunk_ids): numbered evidence texts, joined by blank lines."""
    head = F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] doc_id="), F.col("doc_id").cast("string"), F.lit(" page="), F.col("page_no").cast("string"), F.lit(" type="), F.col("chunk_type"), F.lit(" section="), F.array_join("section_path", " / "), F.lit("\n"), F.col("text"))
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", head.alias("line"), "chunk_id"))).alias("e"))
    return listed.select("query_id", F.array_join(F.transform("e", lambda x: x["line"]), "\n\n").alias("evidence"), F.transform("e", lambda x: x["chunk_id"]).alias("chunk_ids"))


def prompts(queries: DataFrame, evidence: DataFrame, system: str | None = None) -> DataFrame:
    """One prompt for each query; a column context (struct, see dialogue.conversation_context) of queries goes between question and evidence."""
    system = system or template()
    joined = queries.join(evidence, "query_id", "left")
    said = F.nullif(F.rtrim(context_block(F.col("context"))), F.lit("")) if "context" in queries.columns else F.lit(None).cast("string")
    user = F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.col("query")), said, F.when(F.col("evidence").isNotNull(), F.concat(F.lit("Evidence:\n"), F.col("evidence"))))
    return joined.select("query_id", "query", F.lit(system).alias("system"), user.alias("user"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"), "evidence")


STRICT = "You answer questions about documents. Use the evidence and nothing else, cite it as [C1], lead with the conclusion, and say so if the evidence doesn't settle the question."
FAMILIES = {"generic": "Answer from the evidence alone and cite it as [C1]; say so if it is insufficient.", "strict": STRICT}


def template(family: str = "auto", model_name: str = "") -> str:
    """The system prompt of a prompt family; auto goes by the model's name."""
    name = family.lower().strip()
    if name == "auto":
        name = "strict" if "qwen" in model_name.lower() else "generic"
    name = {"qwen": "strict", "zh": "generic", "zh_generic": "generic"}.get(name, name)
    if name not in FAMILIES:
        raise ValueError(f"Unsupported prompt family: {family}")
    return FAMILIES[name]


def context_block(context):
    """Up to seven lines that tell a generator what a conversation has settled, and a blank line; "" if nothing."""
    c = context
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Entities in question: "), F.array_join(c["dialogue_referents"], ", ")),
        F.concat(F.lit("Compared with: "), c["comparison_target"]),
        F.concat(F.lit("Output style: "), c["output_style"]),
        F.concat(F.lit("So far: "), c["conversation_summary"]),
        F.when(c["follow_up"], "This follows on the turn before: keep its subject and measures."),
        F.when(c["dialogue_mode"] == "compare", "Compare, and keep the subjects apart."),
        F.when(c["output_style"] == "list", "Answer as a list.").when(c["output_style"] == "detailed", "Give the conclusion, then what it rests on."),
    )
    return F.when(lines != "", F.concat(lines, F.lit("\n\n"))).otherwise("")


def extractive(evidence):
    """The stand-in for a language model: the first 200 characters of the evidence."""
    return F.substring(squeeze(evidence), 1, 200)


def generate(prompted: DataFrame, generator: Callable = extractive) -> DataFrame:
    """(query_id, answer, confidence, claims): one claim, the whole answer, supported by all evidence; none without evidence."""
    has = F.size("chunk_ids") > 0
    answer = F.when(has, generator(F.col("evidence"))).otherwise(REFUSAL)
    claim = F.array(F.struct(F.col("answer").alias("claim"), F.col("chunk_ids").alias("supporting_chunk_ids")))
    return prompted.withColumn("answer", answer).select("query_id", "answer", F.when(has, "medium").otherwise("low").alias("confidence"), F.when(has, claim).otherwise(F.slice(claim, 1, 0)).alias("claims"))


def audit(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(query_id, claim_ord, claim, chunk_ids): claims with those of their ids that are in evidence, in their order, repeats kept; claims with none go."""
    each = claims.select("query_id", "claim_ord", "claim", F.posexplode("supporting_chunk_ids").alias("pos", "chunk_id"))
    kept = each.join(evidence.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi")
    listed = kept.groupBy("query_id", "claim_ord", "claim").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id"))).alias("c"))
    return listed.select("query_id", "claim_ord", "claim", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"))


def confidence(queries: DataFrame, verified: DataFrame) -> DataFrame:
    return queries.select("query_id").join(verified.select("query_id").distinct().withColumn("v", F.lit(1)), "query_id", "left").select("query_id", F.when(F.col("v") == 1, "medium").otherwise("low").alias("final_confidence"))


def citations(verified: DataFrame, evidence: DataFrame, excerpt: int = 240) -> DataFrame:
    """One row for each chunk that a verified claim cites: the first claim wins."""
    each = verified.select("query_id", "claim_ord", "claim", F.posexplode("chunk_ids").alias("pos", "chunk_id"))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("claim_ord", "pos")
    own = each.withColumn("at", F.row_number().over(first)).where("at = 1").join(evidence.select("query_id", "chunk_id", "doc_id", "page_no", "text"), ["query_id", "chunk_id"])
    order = Window.partitionBy("query_id").orderBy("claim_ord", "pos")
    return own.select("query_id", F.row_number().over(order).alias("citation_no"), "claim", "doc_id", "page_no", "chunk_id", F.substring("text", 1, excerpt).alias("excerpt"))
