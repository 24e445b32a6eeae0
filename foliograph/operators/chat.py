"""Conversation context and answer routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions.text import blank, rtrim_ws, slug, trim_ws
from foliograph.operators.grouping import top_k


def is_noise(top_score: Column) -> Column:
    """The retrieval gate. A fused score is at least 1/61, so only an empty result falls below it."""
    return F.coalesce(top_score < K.NOISE_THRESHOLD, F.lit(True))


def clipped(text: Column, limit: Column) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, limit), F.lit("…"))).otherwise(text)


def history_entries(messages: DataFrame, budget: int = K.HISTORY_BUDGET) -> DataFrame:
    """(conv_id, turn, entry): newest messages that fit the budget.

    Every entry is at least six characters, so at most budget/6 + 1 of a conversation's newest
    messages matter; they are cut out first, then a running sum decides. The newest message is
    kept even if it alone overflows, cut to the budget.
    """
    user = F.col("role") == "user"
    label = F.when(user, "User: ").otherwise("Assistant: ")
    limit = F.when(user, K.HISTORY_USER_CHARS).otherwise(K.HISTORY_ASSISTANT_CHARS)
    entries = messages.select(
        "conv_id", "turn", F.concat(label, clipped(blank(F.col("text")), limit)).alias("entry")
    )
    newest = top_k(entries, ["conv_id"], [F.col("turn").desc()], budget // len("User: ") + 1)
    spent = F.sum(F.length("entry")).over(
        Window.partitionBy("conv_id").orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, 0)
    )
    kept = newest.withColumn("spent", spent).filter((F.col("spent") <= budget) | (F.col("rank") == 1))
    return kept.select("conv_id", "turn", F.left("entry", F.lit(budget)).alias("entry"))


def _ordered_text(entries: DataFrame, separator: str) -> Column:
    parts = F.sort_array(F.collect_list(F.struct("turn", "entry")))
    return F.array_join(F.transform(parts, lambda p: p["entry"]), separator)


def history_block(messages: DataFrame, budget: int = K.HISTORY_BUDGET) -> DataFrame:
    """(conv_id, block): the history as prompt text, oldest first, within the budget."""
    entries = history_entries(messages, budget)
    text = F.concat(F.lit("Messages so far:\n"), _ordered_text(entries, "\n\n"), F.lit("\n\n---\n\n"))
    return entries.groupBy("conv_id").agg(text.alias("block"))


def first_titles(results: DataFrame, n: int = K.SHOWN_RESULTS) -> DataFrame:
    """(query_id, rank, title): the first titles of external results, told before an answer is written."""
    return top_k(results.select("query_id", F.col("rank").alias("place"), "title"), ["query_id"], [F.col("place"), F.col("title")], n).select(
        "query_id", "rank", "title"
    )


def route_context(messages: DataFrame) -> DataFrame:
    """(conv_id, block): last four non-blank user and assistant messages, tightly clipped."""
    user = F.col("role") == "user"
    text = trim_ws(blank(F.col("text")))
    limit = F.when(user, K.ROUTE_USER_CHARS).otherwise(K.ROUTE_ASSISTANT_CHARS)
    usable = messages.filter(F.col("role").isin("user", "assistant") & (text != ""))
    short = F.when(F.length(text) > limit, F.concat(rtrim_ws(F.left(text, limit)), F.lit("…"))).otherwise(text)
    entries = usable.select(
        "conv_id", "turn", F.concat(F.when(user, "User: ").otherwise("Assistant: "), short).alias("entry")
    )
    newest = top_k(entries, ["conv_id"], [F.col("turn").desc()], K.ROUTE_TURNS)
    block = F.concat(
        F.lit("Latest messages, as background:\n"), _ordered_text(newest, "\n"), F.lit("\n\n")
    )
    return newest.groupBy("conv_id").agg(block.alias("block"))


def parse_route(reply: Column) -> Column:
    """First known label in the reply, RETRIEVE when there is none."""
    upper = F.upper(blank(reply))
    route = F.when(F.contains(upper, F.lit(K.ROUTES[0])), K.ROUTES[0])
    for label in K.ROUTES[1:]:
        route = route.when(F.contains(upper, F.lit(label)), label)
    return route.otherwise(K.ROUTES[0])


def effective_route(route: Column, n_pages: Column, top_score: Column) -> Column:
    """Retrieval routes without usable context fall back to DIRECT."""
    empty = (F.coalesce(n_pages, F.lit(0)) == 0) | is_noise(top_score)
    return F.when(route.isin("RETRIEVE", "HYBRID") & empty, "DIRECT").otherwise(route)


def source_label(route: Column, with_web: Column) -> Column:
    def of(labels: dict[str, str]) -> Column:
        out = None
        for r, label in labels.items():
            out = F.when(route == r, label) if out is None else out.when(route == r, label)
        return out.otherwise("unknown")

    return F.when(with_web, of(K.WEB_SOURCE_LABELS)).otherwise(of(K.SOURCE_LABELS))


def retained(messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """Last 100 messages of the first 30 conversations (``conversations``: conv_id, position)."""
    first = conversations.orderBy("position", "conv_id").limit(K.MAX_CONVERSATIONS).select("conv_id")
    kept = messages.join(first, "conv_id", "left_semi")
    return top_k(kept, ["conv_id"], [F.col("turn").desc()], K.MAX_MESSAGES).drop("rank")


def synthesis_page(question: Column, answer: Column, source_names: Column, day: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.lit("---"), F.lit("type: synthesis"),
        F.concat(F.lit("created: "), day), F.concat(F.lit("updated: "), day),
        F.concat(F.lit("sources: ["), F.array_join(source_names, ", "), F.lit("]")),
        F.lit("tags: [query]"), F.lit("---"), F.lit(""),
        F.concat(F.lit("# "), question), F.lit(""), answer, F.lit(""),
    )


def synthesis_pages(answers: DataFrame, day: Column) -> DataFrame:
    """Answers (question, answer, sources) as synthesis pages; questions with an empty slug are refused."""
    pages = answers.select(
        F.lit("synthesis").alias("subdir"),
        slug(F.col("question")).alias("name"),
        synthesis_page(F.col("question"), F.col("answer"), F.col("sources"), day).alias("content"),
    )
    return pages.filter(F.col("name") != "")


def web_results_text(results: DataFrame) -> DataFrame:
    """(query_id, text): numbered web results (a result page, so a few rows per query)."""
    entry = F.format_string("%d. **%s**\n   %s\n   Source: %s", F.col("rank"), F.col("title"), F.col("body"), F.col("href"))
    parts = F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["entry"]), "\n\n").alias("text"))
