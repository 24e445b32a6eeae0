"""Questions to answers: routing, retrieval, context budget, model call, saved synthesis pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.operators import chat, models, retrieval, segments
from foliograph.session import persist_durably

_TOO_LARGE = "No answer: the model cannot take in even one page of the wiki."
_REFUSAL = (
    "This question is outside what can be answered here; questions on the wiki's subjects or on "
    "general knowledge are welcome."
)


def routes(questions: DataFrame, history: DataFrame | None, model) -> DataFrame:
    """(query_id, text, conv_id, route): intent of every question; failures mean RETRIEVE."""
    if history is None:
        rows = questions.withColumn("block", F.lit(""))
    else:
        rows = questions.join(chat.route_context(history), "conv_id", "left").withColumn("block", F.coalesce("block", F.lit("")))
    asked = models.call(rows.select(*questions.columns, "block"), model.route, ["text", "block"], "reply")
    return asked.select(*questions.columns, chat.parse_route(F.col("reply")).alias("route"))


def retrieve(questions: DataFrame, pages: DataFrame, stemmed: bool = True, k: int = K.TOP_K,
             index: segments.SegmentIndex | None = None) -> DataFrame:
    """Context pages of the questions that need the wiki, found in its stored index where there is one: then
    only the found pages are read."""
    asked = retrieval.clean_question(questions)
    if index is not None:
        return retrieval.context(persist_durably(segments.search(asked, index, k), "found"), pages)
    lengths = retrieval.phrase_lengths(asked)
    found = persist_durably(retrieval.search(asked, pages, k, stemmed=stemmed, lengths=lengths), "found")
    return retrieval.context(found, pages)


def answer(questions: DataFrame, pages: DataFrame, model=None, history: DataFrame | None = None, stemmed: bool = True,
           web: DataFrame | None = None, index: segments.SegmentIndex | None = None) -> DataFrame:
    """One row per question (query_id, text[, conv_id]): route, source label, answer, cited pages.

    Retrieval routes without context fall back to DIRECT. An overflow is retried once with the
    first half of the pages; what is left empty then is answered directly on the hybrid route.
    ``web`` holds external results (query_id, rank, title, body, href) to add. ``index`` is a stored index of
    ``pages``, kept up to date by its ``sync``.
    """
    model = model or models.OfflineModel()
    routed = persist_durably(routes(questions, history, model), "routes")
    needy = routed.filter(F.col("route").isin("RETRIEVE", "HYBRID"))
    ctx = persist_durably(retrieval.retrim(retrieve(needy.select("query_id", "text"), pages, stemmed, index=index)), "context")
    text = retrieval.context_text(ctx).withColumnRenamed("text", "context")
    half = retrieval.context_text(retrieval.halved(ctx)).withColumnRenamed("text", "half")
    cited = ctx.groupBy("query_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("sources")
    )
    rows = routed.join(text, "query_id", "left").join(half, "query_id", "left").join(cited, "query_id", "left")
    if history is not None:
        rows = rows.join(chat.history_block(history), "conv_id", "left")
    else:
        rows = rows.withColumn("block", F.lit(""))
    if web is not None:
        results = chat.web_results_text(web).withColumnRenamed("text", "web")
        rows = rows.join(results, "query_id", "left")
    else:
        rows = rows.withColumn("web", F.lit(None).cast("string"))
    empty = F.lit("")
    with_web = F.coalesce("web", empty) != ""
    prompt = F.concat_ws("\n\n", F.coalesce("context", empty), F.when(with_web, F.concat(F.lit("Web search results:\n"), F.col("web"))))
    ready = rows.select(
        "query_id", "text", chat.effective_route(F.col("route"), F.size(F.coalesce("sources", F.array().cast("array<string>"))), F.when(F.col("context").isNotNull(), 1.0)).alias("route"),
        prompt.alias("context"), F.coalesce("half", empty).alias("half"), F.coalesce("block", empty).alias("block"),
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), with_web.alias("with_web"),
    )
    refused = ready.filter(F.col("route") == "REFUSE").withColumn("answer", F.lit(_REFUSAL))
    asked = persist_durably(
        models.call(ready.filter(F.col("route") != "REFUSE"), model.answer, ["text", "context", "block", "route"], "answer"), "answers"
    )
    over = F.col("error") == "overflow"
    again = asked.filter(over).drop("answer", "error")
    gone = again.filter((F.col("half") == "") & (F.col("route") == "RETRIEVE")).withColumn("answer", F.lit(_TOO_LARGE))
    direct = F.when(F.col("half") == "", "DIRECT").otherwise(F.col("route"))
    retry = again.filter((F.col("half") != "") | (F.col("route") != "RETRIEVE")).withColumn("how", direct)
    retried = models.call(retry, model.answer, ["text", "half", "block", "how"], "answer")
    columns = ["query_id", "text", "route", "answer", "sources", "with_web"]
    out = refused.select(*columns)
    for part in (asked.filter(~over), gone, retried):
        out = out.unionByName(part.select(*columns))
    return out.withColumn("label", chat.source_label(F.col("route"), F.col("with_web"))).drop("with_web")


def saved(answers: DataFrame, day: str) -> DataFrame:
    """Synthesis pages of the answers worth keeping."""
    kept = answers.filter((F.col("route") != "REFUSE") & (F.coalesce("answer", F.lit("")) != ""))
    return chat.synthesis_pages(kept.select(F.col("text").alias("question"), "answer", "sources"), F.lit(day))
