"""Conversation operators: positions, context, surrounding replies, the customer corpus and cases.

All windows of one plan share (conversation; order columns), so a conversation table is shuffled and
sorted once however many of these columns are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from colloq.functions import text as tx
from colloq.functions.language import detect_language

CONTEXT_TURNS = 6
CANNED_AT = 20
CONTEXT_TYPE = "array<struct<role:string,text:string>>"


def ordered(conversation: str, order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(conversation).orderBy(*order)


def role_of(inbound: Column) -> Column:
    return F.when(inbound, F.lit("CUSTOMER")).otherwise(F.lit("BRAND"))


def from_messages(messages: DataFrame, lexical_order: bool = False) -> DataFrame:
    """Raw messages with conversation_id to (conv_id, at, message_id, role, text, author_id).

    ``lexical_order`` sorts the timestamp text itself, weekday first, as some published results did.
    """
    at = F.col("created_at") if lexical_order else tx_time(F.col("created_at"))
    return messages.select(F.col("conversation_id").alias("conv_id"), at.alias("at"), F.col("tweet_id").alias("message_id"), role_of(F.col("inbound")).alias("role"), "text", "author_id")


def tx_time(c: Column) -> Column:
    from colloq.functions.numbers import parse_message_time

    return parse_message_time(c)


def with_position(turns: DataFrame, conversation: str, order: Sequence[str]) -> DataFrame:
    """pos_in_conv (from 0) and conv_length."""
    w = ordered(conversation, order)
    return turns.withColumns({"pos_in_conv": (F.row_number().over(w) - 1).cast("int"), "conv_length": F.count("*").over(Window.partitionBy(conversation)).cast("int")})


def with_context(turns: DataFrame, conversation: str, order: Sequence[str], role: str = "role", text: str = "text_clean", turns_back: int = CONTEXT_TURNS) -> DataFrame:
    """context: up to ``turns_back`` earlier turns, nearest first, as an array of (role, text)."""
    w = ordered(conversation, order).rowsBetween(-turns_back, -1)
    said = F.struct(F.lower(role).alias("role"), F.col(text).alias("text"))
    return turns.withColumn("context", F.reverse(F.collect_list(said).over(w)))


def rendered_context(context: Column) -> Column:
    return F.array_join(F.transform(context, lambda t: tx.render_turn(F.upper(t["role"]), t["text"])), " | ")


def with_replies(turns: DataFrame, conversation: str, order: Sequence[str], is_brand: Column, value: Column) -> DataFrame:
    """previous_brand and next_brand: ``value`` of the nearest brand turn before and after, without a join.

    Both frames grow from the start of an order, the second of the reverse one, so each row is added to them once;
    a frame that shrinks would be computed anew for every row.
    """
    w = ordered(conversation, order)
    backwards = Window.partitionBy(conversation).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    said = F.when(is_brand, value)
    nearest = lambda over: F.last(said, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumns({"previous_brand": nearest(w), "next_brand": nearest(backwards)})


def next_reply(turns: DataFrame, conversation: str, order: Sequence[str], is_brand: Column, text: Column, at: Column) -> DataFrame:
    """next_brand as struct(text, at): the nearest brand turn behind each turn, with its time."""
    both = F.struct(text.alias("text"), at.alias("at"))
    backwards = Window.partitionBy(conversation).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return turns.withColumn("next_brand", F.last(F.when(is_brand, both), ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1)))


def with_start(turns: DataFrame, conversation: str, at: str, name: str = "root_created_at") -> DataFrame:
    """The earliest ``at`` of each conversation beside every turn; aggregated first, so a long conversation is no window."""
    first = turns.groupBy(conversation).agg(F.min(at).alias(name))
    return turns.join(first, conversation, "left")


def reply_mismatches(made: DataFrame, turns: DataFrame, order: str = "turn") -> DataFrame:
    """One row that cross-checks cases by another way: cases and replies in one column, read from the end of each conversation.

    ``turns`` (conv_id, ``order``, role, text_clean) are what ``made`` (conv_id, ``order``, brand_response) was built from. A reply answers the
    cases before it, none of its own place. Each row is looked at once, however long the conversation.
    """
    none = F.lit(None).cast("string")
    asked = made.select("conv_id", F.col(order).alias("__at"), F.lit(True).alias("__case"), "brand_response", none.alias("__said"))
    said = turns.where("role = 'BRAND'").select("conv_id", F.col(order).alias("__at"), F.lit(False).alias("__case"), none.alias("brand_response"), F.coalesce("text_clean", F.lit("")).alias("__said"))
    backwards = Window.partitionBy("conv_id").orderBy(F.col("__at").desc_nulls_last(), F.col("__case").desc())
    reply = F.last("__said", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
    found = asked.unionByName(said).withColumn("__reply", reply).where("__case")
    expected = F.nullif(F.trim("__reply"), F.lit(""))
    return found.agg(F.count("*").alias("n_cases"), F.count_if(~F.col("brand_response").eqNullSafe(expected)).alias("n_mismatches"))


def touched_by(messages: DataFrame, conversation: str, is_wanted: Column) -> DataFrame:
    """All messages of the conversations that have a wanted message."""
    ids = messages.where(is_wanted).select(conversation).where(F.col(conversation).isNotNull()).distinct()
    return messages.join(ids, conversation, "left_semi")


def customer_corpus(turns: DataFrame, conversation: str = "conv_id", order: Sequence[str] = ("turn",), role: str = "role", text: str = "text") -> DataFrame:
    """Customer turns with cleaned text, position, context and the surrounding brand messages: one shuffle."""
    prepared = turns.withColumn("text_clean", tx.clean_text(F.col(text)))
    prepared = with_position(prepared, conversation, order)
    prepared = with_context(prepared, conversation, order, role)
    prepared = with_replies(prepared, conversation, order, F.col(role) == "BRAND", F.col("text_clean"))
    return prepared.where(F.col(role) == "CUSTOMER")


def composition(turns: DataFrame, conversation: str, inbound: Column) -> DataFrame:
    """Per conversation: mixed, customer_only or brand_only."""
    sides = turns.groupBy(conversation).agg(F.bool_or(inbound).alias("c"), F.bool_or(~inbound).alias("b"))
    return sides.select(conversation, F.when(F.col("c") & F.col("b"), "mixed").when(F.col("c"), "customer_only").otherwise("brand_only").alias("composition"))


def with_template_counts(cases: DataFrame, template: str = "template_key", canned_at: int = CANNED_AT) -> DataFrame:
    """template_count and is_canned_template; a null template counts 0.

    Counted by a two-phase aggregation and joined back, so that one template with a large share of the
    rows is never one task's window.
    """
    counts = cases.where(F.col(template).isNotNull()).groupBy(template).agg(F.count("*").alias("template_count"))
    joined = cases.join(counts, template, "left").withColumn("template_count", F.coalesce("template_count", F.lit(0)))
    return joined.withColumn("is_canned_template", F.col("template_count") >= canned_at)


def cases(corpus: DataFrame, exclude: DataFrame | None = None, canned_at: int = CANNED_AT) -> DataFrame:
    """Historical cases from the customer corpus; ``exclude`` has the held-out conv_id's."""
    kept = corpus.join(exclude.select("conv_id").distinct(), "conv_id", "left_anti") if exclude is not None else corpus
    reply = F.nullif(F.trim(F.col("next_brand")), F.lit(""))
    flags = tx.response_flags(F.col("next_brand"))
    made = kept.select(
        F.concat_ws(":", "conv_id", "pos_in_conv").alias("case_id"),
        "conv_id",
        F.col("pos_in_conv").alias("position_in_conversation"),
        "conv_length",
        detect_language(F.col("text_clean")).alias("language"),
        F.col("text_clean").alias("customer_message"),
        F.col("context").alias("conversation_context"),
        reply.alias("brand_response"),
        reply.isNotNull().alias("has_usable_response"),
        F.when(reply.isNotNull(), tx.canonical_template(reply)).alias("template_key"),
        tx.flag_map(flags).alias("metadata"),
    )
    return with_template_counts(made, canned_at=canned_at)


def slim(made: DataFrame) -> DataFrame:
    """Nested columns as JSON text plus the document strings of both variants."""
    message, context = F.col("customer_message"), F.col("conversation_context")
    return made.withColumns(
        {
            "doc_msg": tx.document_text(message, context, False),
            "doc_ctx": tx.document_text(message, context, True),
            "conversation_context": F.to_json(context),
            "metadata": F.to_json("metadata"),
        }
    )


def from_slim(rows: DataFrame) -> DataFrame:
    """The nested columns of :func:`slim` again."""
    return rows.withColumns(
        {
            "conversation_context": F.from_json(F.coalesce("conversation_context", F.lit("[]")), CONTEXT_TYPE),
            "metadata": F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,boolean>"),
        }
    )


def forensics(made: DataFrame) -> DataFrame:
    """One row of corpus statistics over cases."""
    share = lambda c: F.round(100 * F.avg(c.cast("double")), 2)
    return made.agg(
        F.count("*").alias("n_cases"),
        F.count_distinct("conv_id").alias("n_conversations"),
        share(F.col("has_usable_response")).alias("pct_usable"),
        share(F.coalesce(F.col("is_canned_template"), F.lit(False))).alias("pct_canned"),
        F.count_distinct("template_key").alias("n_templates"),
        share(tx.is_low_content(F.col("customer_message"))).alias("pct_low_content"),
        (F.count("*") - F.count_distinct("conv_id", "customer_message")).alias("n_repeated_messages"),
        share(F.size("conversation_context") > 0).alias("pct_with_context"),
        F.avg("conv_length").alias("avg_conv_length"),
        F.percentile("conv_length", F.lit(0.5)).alias("median_conv_length"),
        share(F.element_at("metadata", "asks_dm")).alias("pct_asks_dm"),
        share(F.element_at("metadata", "contains_apology")).alias("pct_apology"),
        share(F.element_at("metadata", "contains_any_url")).alias("pct_any_url"),
        share(F.col("language") != "en").alias("pct_non_english"),
    )


def forensic_tables(made: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """The three tables beside the scalar statistics: cases by language, by response flag, and the k commonest templates."""
    flags = made.select(F.explode("metadata").alias("flag", "on"))
    return {
        "languages": made.groupBy(F.col("language").alias("name")).agg(F.count("*").alias("n")),
        "flags": flags.groupBy(F.col("flag").alias("name")).agg(F.count_if("on").alias("n")),
        "templates": made.where(F.col("template_key").isNotNull()).groupBy(F.col("template_key").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(k),
    }


def transcript(turns: DataFrame, conversation: str, order: Sequence[str], limit: int = 260, head: int | None = None) -> DataFrame:
    """Per conversation: 'ROLE: text' lines in order, line breaks to spaces, cut at ``limit`` with an ellipsis; with ``head`` the first
    so many of them."""
    if head is not None:
        turns = turns.withColumn("__place", F.row_number().over(ordered(conversation, order))).where(F.col("__place") <= head)
    flat = F.regexp_replace(F.col("text"), r"\n", " ")
    line = F.concat(F.upper("role"), F.lit(": "), F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat))
    lines = F.sort_array(F.collect_list(F.struct(*order, line.alias("line"))))
    return turns.groupBy(conversation).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
