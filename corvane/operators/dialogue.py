"""Multi-turn query rewriting and planning, as columns of one row per turn.

A missing value is null all the way: a null comparison target or style adds no term anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import contains_any, found, history_times, normalize_query, planner_times, query_signature, squeeze, strip

#: product words -> (entity, product, topic)
ALIASES = ((("iphone", "苹果手机"), ("苹果", "iPhone", "苹果手机")),)
NOT_ENTITIES = sorted("今年 公司 前两个手机厂商 势头 发展 哪些 商业信息 如何 总结 手机厂商 提问 最近 测试问题 行业 近期 问题".split())
CONTEXT = ("他", "她", "它", "其", "这个", "这家", "该公司", "今年", "最近", "近期")
#: in the order in which a leading one is taken off
LEADING = tuple("那么它 那么他 那么她 那它 那他 那她 那么 那 它 他 她 其 这家公司 该公司 这家 这个".split())
METRICS = (("销量", ("销量",)), ("营收", ("收入", "营收")), ("利润", ("利润", "盈利")), ("份额", ("份额", "占比", "市占率")), ("增长", ("同比", "增速", "增长", "环比")))
ASPECTS = (("近期表现", ("势头", "最近", "表现", "近期")), ("财务表现", ("业绩", "利润", "营收", "财报")), ("产品表现", ("机型", "产品", "系列")))
STYLES = (("brief", ("一句话", "简单总结", "简单说", "简要")), ("detailed", ("具体说说", "展开", "详细")), ("list", ("列一下", "列个表", "有哪些")))
COMPARE = ("对比", "比较", "比起", "相比")
KNOWN = ("苹果手机", "iPhone", "苹果", "华为", "英伟达", "比亚迪")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def alias(query: Column, part: int) -> Column:
    """Entity (0), product (1) or topic (2) that an alias in the query stands for, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for markers, names in ALIASES:
        out = out.when(contains_any(F.lower(query), markers), names[part])
    return out


def entities(query: Column) -> Column:
    """Entity-like tokens, in order of first appearance."""

    def trim(t: Column) -> Column:
        t = F.regexp_replace(t, "^(?:关于|请问|那么|那|这个|这家|该|相比之下|相比|比起|和)", "")
        t = F.regexp_replace(t, "的?(?:其他电子产品|电子产品|产品|手机|情况|表现|趋势|销量).*$", "")
        return F.trim(F.regexp_replace(t, "(?:今年|商业信息|发展势头|呢|如何|怎么样|情况|最近|有什么|有哪些|表现|近期).*$", ""))

    cut = F.transform(found(query, "[一-鿿A-Za-z0-9]{2,32}"), trim)
    return F.array_distinct(F.filter(cut, lambda t: (F.length(t) > 1) & ~t.isin(*NOT_ENTITIES) & ~t.rlike(r"(?U)^\d+$")))


def hints(query: Column, rules) -> Column:
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(contains_any(low, markers), F.lit(name)) for name, markers in rules]))


def leading(query: Column) -> Column:
    """The leading marker of a follow-up, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for m in LEADING:
        out = out.when(query.startswith(m), m)
    return out


def blank_to_null(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def resolve(turns: DataFrame) -> DataFrame:
    """Adds anchor, query_entities, recent_entities, active_entities, referents, follow_up, hints and resolved_query.

    ``turns``: user_query, messages array<string> (contents, oldest first), last_entity, conversation_anchor and
    recent array<string>."""
    q = strip(F.coalesce("user_query", F.lit("")))
    base = turns.withColumn("q", q).withColumn("alias", alias(F.col("q"), 0)).withColumn("found_entities", F.when(F.col("alias").isNotNull(), F.array("alias")).otherwise(entities(F.col("q"))))
    refers = contains_any(F.col("q"), ("前两个", "前者", "后者")) | leading(F.col("q")).isNotNull()
    said = F.transform("messages", lambda m: F.coalesce(alias(m, 0), F.try_element_at(entities(m), F.lit(1))))
    history = F.try_element_at(F.filter(F.reverse(said), lambda x: x.isNotNull()), F.lit(1))
    older = F.coalesce(blank_to_null(F.col("last_entity")), blank_to_null(F.col("conversation_anchor")), history)
    first = F.try_element_at("found_entities", F.lit(1))
    base = base.withColumn("refers", refers).withColumn("anchor", F.when(F.col("refers") & F.col("alias").isNull(), older).otherwise(F.coalesce(first, older)))
    base = base.withColumn("query_entities", F.when(F.col("refers"), strings()).otherwise(F.slice("found_entities", 1, 1)))
    every = F.filter(F.transform(F.concat(F.coalesce("recent", strings()), F.array("last_entity", "anchor"), F.col("query_entities")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    base = base.withColumn("_all", F.array_distinct(every)).withColumn("recent_entities", F.slice("_all", F.greatest(F.size("_all") - 4, F.lit(1)), 5)).drop("_all")
    n = F.size("recent_entities")
    base = base.withColumn("active_entities", F.when(contains_any(F.col("q"), COMPARE) & (n >= 2), F.slice("recent_entities", F.greatest(n - 1, F.lit(1)), 2)).otherwise(strings()))
    order = F.when(F.size("active_entities") > 0, F.col("active_entities")).otherwise(F.col("recent_entities"))
    both = F.col("q").contains("前两个")
    referents = F.struct(F.when(both & (F.size(order) >= 2), F.slice(order, 1, 2)).alias("both"), F.when(both | F.col("q").contains("前者"), F.try_element_at(order, F.lit(1))).alias("former"), F.when(both | F.col("q").contains("后者"), F.try_element_at(order, F.lit(2))).alias("latter"))
    needs = contains_any(F.col("q"), CONTEXT) | (F.size("query_entities") == 0)
    mark = leading(F.col("q"))
    injected = F.concat("anchor", F.when(mark.isNotNull(), F.expr("substring(q, length(mark) + 1)")).otherwise(F.col("q")))
    base = base.withColumn("referents", referents).withColumn("follow_up", F.col("anchor").isNotNull() & needs).withColumn("mark", mark)
    target = F.trim(F.regexp_extract("q", "(?:与|和)([一-鿿A-Za-z0-9]{2,32})(?:对比|相比|比)", 1))
    return base.select(
        "*",
        F.when((F.col("q") != "") & F.col("alias").isNull() & F.col("follow_up"), injected).otherwise(F.col("q")).alias("resolved_query"),
        history_times(F.col("messages")).alias("inherited_times"),
        hints(F.col("q"), METRICS).alias("metric_hints"),
        hints(F.col("q"), ASPECTS).alias("aspect_hints"),
        hints(F.col("q"), STYLES).alias("style_hints"),
        F.when((target != "") & ~target.eqNullSafe(F.col("anchor")), target).alias("comparison_target"),
    ).drop("q", "mark", "refers", "found_entities")


def intent(q: Column) -> Column:
    low = F.lower(q)
    return F.when(contains_any(low, ("vs", "versus", "区别", "对比", "比较")), "compare").when(contains_any(q, ("介绍", "信息", "总结", "有哪些", "概述", "综述")), "summary").when(query_signature(q)["prefers"] | contains_any(low, ("chart", "figure", "table", "图", "表")), "structured_qa").otherwise("qa")


def complexity(q: Column) -> Column:
    many = F.regexp_count(q, F.lit("[、,与且并及和]")) >= 2
    return F.when((F.length(q) >= 30) | many, "high").when(F.length(q) >= 16, "medium").otherwise("low")


def sub_intents(q: Column, inherited: Column, follow_up: Column) -> Column:
    s = query_signature(q)
    own = F.size(s["time_terms"]) > 0
    tests = (
        (own, "time_grounded"),
        (~own & (F.size(inherited) > 0), "time_inherited"),
        (s["prefers"], "structured_preferred"),
        (q.rlike("占比|同比|增长|多少|数值|比率|环比|规模|金额"), "fact_lookup"),
        (q.rlike("为什么|原因|影响|逻辑|驱动"), "reasoning"),
        (follow_up, "follow_up"),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))


def summary_constraints(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    compares = contains_any(s, ("对比", "比较"))
    return F.struct(
        F.array_compact(F.array(F.when(s.contains("销量"), F.lit("销量")))).alias("metric_scope"),
        F.array_compact(F.array(F.when(contains_any(s, ("最近", "近期")), F.lit("近期表现")), F.when(compares, F.lit("对比分析")))).alias("aspect_scope"),
        F.when(contains_any(s, ("展开", "详细")), "detailed").when(contains_any(s, ("列出", "列表")), "list").alias("output_style"),
        F.array_compact(F.array(*[F.when(s.contains(t), F.lit(t)) for t in ("销量", *KNOWN)])).alias("summary_terms"),
    )


def plan(turns: DataFrame) -> DataFrame:
    """The retrieval plan of resolved turns.

    Besides resolve()'s columns: topic struct<entity, product, topic>, last_context struct<metric_scope, aspect_scope,
    comparison_target, output_style, dialogue_referents>, conversation_summary, top_k int and tables_only boolean (requests;
    null: the planner decides)."""
    t = turns.withColumn("nq", normalize_query(F.coalesce(blank_to_null(F.col("resolved_query")), "user_query"))).withColumn("s", summary_constraints(F.col("conversation_summary")))
    q, follow = F.col("nq"), F.col("follow_up")
    own = planner_times(q)
    times = F.when(F.size(own) > 0, own).otherwise(F.transform("inherited_times", F.upper))
    filled = lambda c: F.when(F.size(c) > 0, c)

    def inherit(now: Column, *before: Column) -> Column:
        return F.coalesce(filled(now), *[F.when(follow, filled(b)) for b in before], strings())

    metric = inherit(F.col("metric_hints"), F.col("last_context.metric_scope"), F.col("s.metric_scope"))
    aspect = inherit(F.col("aspect_hints"), F.col("last_context.aspect_scope"), F.col("s.aspect_scope"))
    aspect = F.when(contains_any(q, ("对比", "比较")), F.array_union(aspect, strings("对比分析"))).otherwise(aspect)
    target = F.coalesce(F.col("comparison_target"), F.when(follow, blank_to_null(F.col("last_context.comparison_target"))))
    style = F.coalesce(F.try_element_at("style_hints", F.lit(1)), F.when(follow, blank_to_null(F.trim("last_context.output_style"))), F.when(follow, F.col("s.output_style")))
    referents = F.coalesce(filled(F.col("referents.both")), filled(F.col("active_entities")), F.when(follow, filled(F.col("last_context.dialogue_referents"))), strings())
    c = complexity(q)
    prefers = query_signature(q)["prefers"]
    active = F.coalesce(filled(F.col("query_entities")), F.when(F.col("anchor").isNotNull(), F.array("anchor")), strings())
    product = F.coalesce(alias(F.col("user_query"), 1), F.col("topic.product"))
    topic = F.coalesce(alias(F.col("user_query"), 2), F.col("topic.topic"))
    made = F.struct(
        F.lit("hybrid").alias("mode"),
        intent(q).alias("intent"),
        sub_intents(q, F.col("inherited_times"), follow).alias("sub_intents"),
        c.alias("complexity"),
        F.coalesce(F.when(F.col("top_k") > 0, F.col("top_k")), F.when(c == "high", 8).when(c == "medium", 6).otherwise(4)).alias("top_k"),
        F.coalesce("tables_only", prefers & F.lower(q).rlike("chart|figure|table|图表|表")).alias("tables_only"),
        times.alias("time_terms"),
        F.array_sort(F.array_distinct(F.transform(times, lambda x: F.substring(x, 1, 4)))).alias("years"),
        active.alias("entity_scope"),
        F.coalesce(alias(F.col("user_query"), 0), F.col("topic.entity"), F.try_element_at(active, F.lit(1))).alias("topic_entity"),
        product.alias("topic_product"),
        topic.alias("topic"),
        metric.alias("metric_scope"),
        aspect.alias("aspect_scope"),
        target.alias("comparison_target"),
        style.alias("output_style"),
        referents.alias("dialogue_referents"),
        F.col("s.summary_terms").alias("summary_terms"),
    )
    return t.withColumn("normalized_query", q).withColumn("plan", made).drop("nq", "s")


def search_query(base: Column, p: Column) -> Column:
    """The query with each planned term appended once, if neither it nor an earlier term has it."""
    q = squeeze(F.coalesce(base, F.lit("")))
    terms = F.concat(p["entity_scope"], p["dialogue_referents"], F.array(p["topic_product"], p["topic"]), p["time_terms"], p["metric_scope"], p["aspect_scope"], p["summary_terms"], F.array(p["comparison_target"]))
    return appended(q, terms)


def appended(q: Column, terms: Column) -> Column:
    new = F.array_distinct(F.filter(F.transform(terms, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: (x != "") & ~F.contains(q, x)))
    return F.when(F.size(new) > 0, F.trim(F.concat_ws(" ", q, F.array_join(new, " ")))).otherwise(q)


def generation_query(base: Column, p: Column) -> Column:
    """The query for the generator: with referents, comparison target and output style appended, as search_query() does its terms."""
    q = squeeze(F.coalesce(base, F.lit("")))
    return appended(q, F.concat(F.coalesce(p["dialogue_referents"], strings()), F.array(p["comparison_target"], p["output_style"])))


def conversation_context(p: Column, follow_up: Column, conversation_summary: Column) -> Column:
    """struct<dialogue_mode, follow_up, dialogue_referents, comparison_target, output_style, conversation_summary>; what is missing is null."""
    referents = F.filter(F.coalesce(p["dialogue_referents"], strings()), lambda x: F.trim(x) != "")
    said = lambda c: blank_to_null(F.trim(c))
    compares = (F.size(referents) > 0) | said(p["comparison_target"]).isNotNull()
    follows = F.coalesce(follow_up, F.lit(False))
    mode = F.when(compares, "compare").when(follows, "follow_up").otherwise("single_turn")
    return F.struct(mode.alias("dialogue_mode"), follows.alias("follow_up"), F.when(F.size(referents) > 0, referents).alias("dialogue_referents"), said(p["comparison_target"]).alias("comparison_target"), said(p["output_style"]).alias("output_style"), said(conversation_summary).alias("conversation_summary"))


def evidence_kind(explicit: Column, chunk_type: Column) -> Column:
    return F.coalesce(blank_to_null(explicit), F.when(chunk_type == "table", "table_evidence").when(chunk_type == "heading", "caption_evidence").when(chunk_type.isin("figure_caption", "mixed"), "chart_evidence").otherwise("narrative_evidence"))


def summary(messages: Column, window: int = 6, most: int = 120) -> Column:
    """The last messages (array<struct<role, content>>), each on a line; blank ones within the window are left out."""
    last = F.slice(messages, F.greatest(F.size(messages) - (window - 1), F.lit(1)), window)
    said = F.transform(last, lambda m: F.struct(F.coalesce(m["role"], F.lit("unknown")).alias("role"), squeeze(F.coalesce(m["content"], F.lit(""))).alias("text")))
    return F.array_join(F.transform(F.filter(said, lambda m: m["text"] != ""), lambda m: F.concat(m["role"], F.lit(": "), F.substring(m["text"], 1, most))), "\n")
