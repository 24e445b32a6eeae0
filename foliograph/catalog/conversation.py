"""Registered queries: chunking, message archives, model replies, chat context and page rendering."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.catalog import sql as S
from foliograph.catalog.registry import query
from foliograph.functions import chunks, replies, rewrite
from foliograph.functions import text as T
from foliograph.operators import chat
from foliograph.session import shared_dir
from foliograph.sources import raw

_PARA = "replace(text, chr(10), chr(10) || chr(10))"


@query(
    "T13_chunks",
    f"""WITH RECURSIVE p AS (SELECT doc_id, {_PARA} AS t, string_split({_PARA}, chr(10) || chr(10)) AS ps FROM documents),
    f AS (SELECT doc_id, t, ps, 0 AS i, 0 AS k, '' AS cur, 0 AS size, false AS opened, NULL::VARCHAR AS flushed FROM p WHERE length(t) > 2000
      UNION ALL
      SELECT doc_id, t, ps, i + 1, CASE WHEN fl THEN k + 1 ELSE k END, CASE WHEN fl OR NOT opened THEN s ELSE cur || chr(10) || chr(10) || s END,
        CASE WHEN fl THEN length(s) ELSE size + length(s) + 2 END, true, CASE WHEN fl THEN cur END
      FROM (SELECT *, ps[i + 1] AS s, size + length(ps[i + 1]) > 2000 AND opened AS fl FROM f WHERE i < len(ps)))
    SELECT doc_id, CAST(k - 1 AS INTEGER) AS chunk, flushed AS text FROM f WHERE flushed IS NOT NULL
    UNION ALL SELECT doc_id, CAST(k AS INTEGER), cur FROM f WHERE i = len(ps)
    UNION ALL SELECT doc_id, 0, t FROM p WHERE length(t) <= 2000""",
)
def _(t):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t.documents.select("doc_id", F.posexplode(chunks.chunk_text(text, 2000)).alias("chunk", "text"))


@query(
    "T14_overflow_halves",
    f"""SELECT doc_id, CAST(i AS INTEGER) AS half, CASE i WHEN 0 THEN {S.rtrim('left(t, c)')} ELSE regexp_replace(substr(t, c + 1), '^{K.WS}+', '') END AS text
    FROM (SELECT doc_id, t, CASE WHEN last < m // 2 THEN m ELSE last END AS c FROM (
      SELECT *, CASE WHEN contains(h, chr(10) || chr(10)) THEN length(h) - instr(reverse(h), chr(10) || chr(10)) - 1 ELSE -1 END AS last FROM (
        SELECT doc_id, t, length(t) // 2 AS m, left(t, length(t) // 2 + 2000) AS h FROM (SELECT doc_id, {_PARA} AS t FROM documents)))), (VALUES (0), (1)) v(i)""",
)
def _(t):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return t.documents.select("doc_id", F.posexplode(chunks.overflow_halves(text)).alias("half", "text"))


@query(
    "W8_line_chunks",
    "SELECT conv_id, turn // 3 AS chunk, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL",
)
def _(t):
    lines = t.conversations.select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("line"))
    return raw.line_chunks(lines, ["conv_id"], pos="turn", size=3)


@query(
    "S8_sms_lines",
    "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || CASE event_type WHEN 'click' THEN 'SENT ' ELSE 'RECV ' END || CASE WHEN event_id % 5 = 0 THEN 'Unknown' ELSE 'user ' || user_id END || ': ' || event_type AS line FROM events",
)
def _(t):
    message = F.struct(
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("_date"), F.when(F.col("event_type") == "click", "2").otherwise("1").alias("_type"),
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("_contact_name"),
        F.concat(F.lit("  "), F.col("event_type"), F.lit("\n")).alias("_body"),
    )
    return t.events.select("event_id", raw.sms_line(message).alias("line"))


@query(
    "S8_messages",
    "SELECT line, count(*) AS n FROM (SELECT '[' || strftime(ts, '%Y-%m-%d %H:%M') || '] ' || CASE event_type WHEN 'click' THEN 'SENT ' ELSE 'RECV ' END || 'user ' || user_id || ': ' || event_type || ' <&\"' || event_id AS line FROM events) GROUP BY 1",
)
def _(t):
    """Message archives written from the events, read back in splits."""
    folder = f"{shared_dir(t.spark)}/archives-{uuid.uuid4().hex}"
    way = F.when(F.col("event_type") == "click", "2").otherwise("1")
    message = F.format_string(
        '<sms date="%d" type="%s" contact_name="user %d" body="%s &lt;&amp;&quot;%d" />',
        F.unix_millis(F.col("ts").cast("timestamp")), way, "user_id", "event_type", "event_id",
    )
    t.events.select(message.alias("value")).write.text(folder)
    return raw.sms_messages(t.spark, folder).groupBy("line").agg(F.count("*").alias("n"))


@query(
    "P18_tolerant_json",
    """SELECT event_id, event_type AS title, CASE WHEN event_id % 5 = 4 THEN '' ELSE props END AS summary,
    CAST(CASE WHEN event_id % 5 > 2 THEN 0 ELSE 1 END AS INTEGER) AS n_entities, CAST(CASE WHEN event_id % 5 = 3 THEN 1 ELSE 0 END AS INTEGER) AS n_claims FROM events""",
)
def _(t):
    e = F.col("event_id") % 5
    quoted = F.replace("props", F.lit('"'), F.lit('\\"'))
    head = F.concat(F.lit('{"title": "'), F.col("event_type"), F.lit('"'))
    full = F.concat(head, F.lit(', "entities": [{"name": "x"}], "summary": "'), quoted, F.lit('"}'))
    cut = F.concat(head, F.lit(', "summary": "'), quoted, F.lit('", "key_claims": ["one", "tw'))
    reply = (
        F.when(e == 0, full).when(e == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(e == 2, F.concat(F.lit("Here it is: "), full, F.lit(" Done."))).when(e == 3, cut)
        .otherwise(F.concat(head, F.lit(', "summary": "')))
    )
    read = t.events.select("event_id", replies.extraction(reply).alias("e"))
    return read.select("event_id", "e.title", "e.summary", F.size("e.entities").alias("n_entities"), F.size("e.key_claims").alias("n_claims"))


@query(
    "X4_judge_verdict",
    "SELECT doc_id, CASE WHEN quality = 1 THEN true WHEN toxic = 1 THEN NULL ELSE false END AS verdict FROM labels",
)
def _(t):
    reply = F.when(F.col("quality") == 1, " Same thing").when(F.col("toxic") == 1, "unsure").otherwise("different.\n")
    return t.labels.select("doc_id", replies.judge_verdict(reply).alias("verdict"))


@query(
    "X2_accepted_rewrite",
    """SELECT turn, conv_id, CASE WHEN length(trim(text, ' "')) BETWEEN 10 AND 400 AND role <> 'system' THEN trim(text, ' "') ELSE 'old' END AS description FROM
    (SELECT conv_id, turn, role, regexp_replace(text, '[''"\\s]+', ' ', 'g') AS text FROM conversations)""",
)
def _(t):
    plain = F.trim(F.regexp_replace("text", "['\"\\s]+", " "))
    reply = F.when(F.col("role") == "system", F.concat(F.lit("Unknown "), plain)).otherwise(F.concat(F.lit(' "'), plain, F.lit('" ')))
    return t.conversations.select("turn", "conv_id", replies.accepted_rewrite(reply, F.lit("old")).alias("description"))


_ENTRY = """ent AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END ||
   CASE WHEN length(text) > CASE WHEN role = 'user' THEN 4000 ELSE 2000 END THEN left(text, CASE WHEN role = 'user' THEN 4000 ELSE 2000 END) || '…' ELSE text END AS entry FROM conversations),
run AS (SELECT *, sum(length(entry)) OVER w AS spent, row_number() OVER w AS rank FROM ent WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))"""


@query("W4_history_entries", f"WITH {_ENTRY} SELECT conv_id, turn, left(entry, 1500) AS entry FROM run WHERE spent <= 1500 OR rank = 1")
def _(t):
    return chat.history_entries(t.conversations, 1500)


@query(
    "W4_history_block",
    f"WITH {_ENTRY} SELECT conv_id, 'Messages so far:' || chr(10) || string_agg(left(entry, 24000), chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block FROM run WHERE spent <= 24000 OR rank = 1 GROUP BY 1",
)
def _(t):
    return chat.history_block(t.conversations)


@query(
    "W6_route_context",
    f"""SELECT conv_id, 'Latest messages, as background:' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END ||
      CASE WHEN length(x) > CASE role WHEN 'user' THEN 400 ELSE 600 END THEN {S.rtrim("left(x, CASE role WHEN 'user' THEN 400 ELSE 600 END)")} || '…' ELSE x END, chr(10) ORDER BY turn) || chr(10) || chr(10) AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM (SELECT *, {S.trim('text')} AS x FROM conversations) WHERE role IN ('user', 'assistant') AND x <> '') WHERE rank <= 4 GROUP BY 1""",
)
def _(t):
    return chat.route_context(t.conversations)


@query(
    "W10_retained_messages",
    """SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations
      WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 ORDER BY max(turn) DESC, conv_id LIMIT 30)) WHERE rank <= 100""",
)
def _(t):
    positions = t.conversations.groupBy("conv_id").agg((-F.max("turn")).alias("position"))
    return chat.retained(t.conversations.select("conv_id", "turn"), positions)


_ROUTE_REPLY = "CASE turn % 5 WHEN 0 THEN 'I think direct' WHEN 1 THEN 'HYBRID or REFUSE' WHEN 2 THEN 'refuse' WHEN 3 THEN text ELSE 'hybrid: retrieve' END"


@query(
    "R19_route_label",
    f"""SELECT conv_id, turn, CASE WHEN contains(upper(r), 'RETRIEVE') THEN 'RETRIEVE' WHEN contains(upper(r), 'DIRECT') THEN 'DIRECT' WHEN contains(upper(r), 'HYBRID') THEN 'HYBRID'
     WHEN contains(upper(r), 'REFUSE') THEN 'REFUSE' ELSE 'RETRIEVE' END AS route FROM (SELECT conv_id, turn, {_ROUTE_REPLY} AS r FROM conversations)""",
)
def _(t):
    n = F.col("turn") % 5
    reply = F.when(n == 0, "I think direct").when(n == 1, "HYBRID or REFUSE").when(n == 2, "refuse").when(n == 3, F.col("text")).otherwise("hybrid: retrieve")
    return t.conversations.select("conv_id", "turn", chat.parse_route(reply).alias("route"))


@query(
    "R20_effective_route",
    """SELECT event_id, er AS route, CASE WHEN event_id % 2 = 0 THEN CASE er WHEN 'RETRIEVE' THEN 'wiki + web' WHEN 'DIRECT' THEN 'model + web' WHEN 'HYBRID' THEN 'wiki + model + web' ELSE 'none' END
      ELSE CASE er WHEN 'RETRIEVE' THEN 'wiki' WHEN 'DIRECT' THEN 'model' WHEN 'HYBRID' THEN 'wiki + model' ELSE 'none' END END AS label
    FROM (SELECT event_id, CASE WHEN r IN ('RETRIEVE', 'HYBRID') AND (event_id % 7 = 0 OR value / 10000 < 0.005 AND false OR event_id % 7 = 1) THEN 'DIRECT' ELSE r END AS er
      FROM (SELECT *, CASE event_type WHEN 'click' THEN 'RETRIEVE' WHEN 'view' THEN 'DIRECT' WHEN 'error' THEN 'REFUSE' ELSE 'HYBRID' END AS r FROM events))""",
)
def _(t):
    e, k = F.col("event_type"), F.col("event_id")
    route = F.when(e == "click", "RETRIEVE").when(e == "view", "DIRECT").when(e == "error", "REFUSE").otherwise("HYBRID")
    score = F.when(k % 7 == 1, F.lit(None).cast("double")).otherwise(F.lit(1.0) / 61)
    rows = t.events.select("event_id", chat.effective_route(route, F.when(k % 7 == 0, 0).otherwise(3), score).alias("route"))
    return rows.withColumn("label", chat.source_label(F.col("route"), F.col("event_id") % 2 == 0))


@query(
    "K6_synthesis_pages",
    f"""SELECT slug AS name, '---' || chr(10) || 'type: synthesis' || chr(10) || 'created: 2024-01-01' || chr(10) || 'updated: 2024-01-01' || chr(10) || 'sources: [a, b]' || chr(10) || 'tags: [query]' || chr(10) || '---' || chr(10) || chr(10) || '# ' || text || chr(10) || chr(10) || 'answer ' || item_id || chr(10) AS content
    FROM (SELECT *, replace({S.trim(rf"left(regexp_replace(text, '[^\p{{L}}\p{{N}}_\t\n\x0B\f\r\x1C-\x1F\x{{85}}\p{{Z}}]', '', 'g'), 50)")}, ' ', '_') AS slug FROM benchmark) WHERE slug <> ''""",
)
def _(t):
    answers = t.benchmark.select(
        F.col("text").alias("question"), F.concat(F.lit("answer "), F.col("item_id").cast("string")).alias("answer"),
        F.array(F.lit("a"), F.lit("b")).alias("sources"),
    )
    return chat.synthesis_pages(answers, F.lit("2024-01-01")).select("name", "content")


@query(
    "K6_url_slugs",
    rf"""SELECT page_id, replace({S.trim(r"left(regexp_replace(url, '[^\p{L}\p{N}_\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]', '', 'g'), 50)")}, ' ', '_') AS slug FROM pages""",
)
def _(t):
    return t.web_pages.select("page_id", T.slug(F.col("url")).alias("slug"))


@query(
    "T18_web_results",
    """SELECT page_id // 10 AS query_id, string_agg((page_id % 10 + 1) || '. **Page ' || page_id || '**' || chr(10) || '   body' || chr(10) || '   Source: ' || url, chr(10) || chr(10) ORDER BY page_id) AS text FROM pages GROUP BY 1""",
)
def _(t):
    p = F.col("page_id")
    rows = t.web_pages.select(
        F.floor(p / 10).alias("query_id"), (p % 10 + 1).cast("int").alias("rank"), F.concat(F.lit("Page "), p.cast("string")).alias("title"),
        F.lit("body").alias("body"), F.col("url").alias("href"),
    )
    return chat.web_results_text(rows)


@query(
    "K10_item_pages",
    """SELECT source, pos, '---' || chr(10) || 'type: ' || CASE subdir WHEN 'entities' THEN 'entity' ELSE 'concept' END || chr(10) || 'tags: [' || CASE WHEN type <> '' THEN type WHEN subdir = 'entities' THEN 'topic' ELSE '' END || ']' || chr(10) ||
      'sources: [' || source || ']' || chr(10) || 'source_dates: [' || source_date || ']' || chr(10) || 'created: 2024-01-01' || chr(10) || 'updated: 2024-01-01' || chr(10) || '---' || chr(10) || chr(10) ||
      '# ' || name || chr(10) || chr(10) || description || chr(10) || chr(10) || '## Mentioned In' || chr(10) || chr(10) || '- [[' || source || ']]' || chr(10) AS content FROM mentions""",
    "mentions",
)
def _(t):
    page = rewrite.item_page(
        F.col("subdir"), F.col("name"), F.col("description"), F.col("type"), F.col("source"), F.col("source_date"), F.lit("2024-01-01")
    )
    return t.mentions.select("source", "pos", page.alias("content"))


@query(
    "D13_added_source",
    r"""SELECT name, rtrim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(content, '(sources: \[[^\]]*)\]', '\1, New $1]'),
       'updated: \d{4}-\d{2}-\d{2}', 'updated: 2024-01-01'), 'source_dates: \[([^\]]*)\]', 'source_dates: [\1, 2024]'),
       '## Mentioned In', chr(10) || '### From [[New $1]]' || chr(10) || chr(10) || 'Fresh text.' || chr(10) || chr(10) || '## Mentioned In'), '^(---\n[\s\S]*?\n---\n)', '\1'), chr(10)) || chr(10) || '- [[New $1]]' || chr(10) AS content
    FROM wiki WHERE contains(content, 'source_dates:')""",
    "wiki",
)
def _(t):
    update = F.array(F.struct(F.lit("New $1").alias("source"), F.lit("Fresh text.").alias("description"), F.lit("2024").alias("source_date")))
    rows = t.wiki.filter(F.contains("content", F.lit("source_dates:")))
    return rows.select("name", rewrite.add_sources(F.col("content"), update, F.lit("2024-01-01")).alias("content"))


@query(
    "L6_first_titles",
    "SELECT page_id // 10 AS query_id, CAST(page_id % 10 + 1 AS INTEGER) AS rank, 'Page ' || page_id AS title FROM pages WHERE page_id % 10 < 5",
)
def _(t):
    p = F.col("page_id")
    rows = t.web_pages.select(
        F.floor(p / 10).alias("query_id"), (p % 10 + 1).cast("int").alias("rank"), F.concat(F.lit("Page "), p.cast("string")).alias("title")
    )
    return chat.first_titles(rows)
