"""Page parsing: front matter, list fields, paragraphs, links and markers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph import constants as K
from foliograph.functions.text import let, squeeze_ws, trim_ws


# --- front matter -------------------------------------------------------------------------


def _close(content: Column) -> Column:
    """Position of the line break that starts the closing marker, 0 without a front matter."""
    end = F.locate(K.FRONTMATTER_CLOSE, content, len(K.FRONTMATTER_OPEN) + 1)
    return F.when(F.startswith(content, F.lit(K.FRONTMATTER_OPEN)), end).otherwise(0)


def has_frontmatter(content: Column) -> Column:
    return _close(content) > 0


def frontmatter(content: Column) -> Column:
    start = len(K.FRONTMATTER_OPEN) + 1
    inside = F.substring(content, F.lit(start), _close(content) - start)
    return F.when(has_frontmatter(content), inside).otherwise("")


def raw_body(content: Column) -> Column:
    """Everything after the front matter, untrimmed."""
    rest = F.substring(content, _close(content) + len(K.FRONTMATTER_CLOSE), F.length(content))
    return F.when(has_frontmatter(content), rest).otherwise(content)


def body(content: Column) -> Column:
    """Trimmed remainder, or the page unchanged when it has no front matter."""
    return F.when(has_frontmatter(content), trim_ws(raw_body(content))).otherwise(content)


def searched_type(content: Column) -> Column:
    """First ``type:`` anywhere in the front matter."""
    return trim_ws(F.regexp_extract(frontmatter(content), r"type:\s*([^\n]+)", 1))


def searched_tags(content: Column) -> Column:
    return trim_ws(F.regexp_extract(frontmatter(content), r"tags:\s*\[([^\]]*)\]", 1))


def field_lines(content: Column, holding: str = "") -> Column:
    """Front matter as (key, value) entries in line order, of all lines or only those that hold a text."""
    lines = F.filter(F.split(frontmatter(content), "\n"), lambda line: F.contains(line, F.lit(":")) & F.contains(line, F.lit(holding)))
    return F.transform(
        lines,
        lambda line: F.struct(
            trim_ws(F.regexp_extract(line, r"^([^:]*):", 1)).alias("key"),
            trim_ws(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"),
        ),
    )


def field_map(content: Column) -> Column:
    """Front matter as a map; a repeated key keeps its last value."""

    def last_wins(entries: Column) -> Column:
        kept = F.filter(
            entries,
            lambda e, i: ~F.exists(
                F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
            ),
        )
        return F.map_from_entries(kept)

    return let(field_lines(content), last_wins)


def field_value(content: Column, key: str) -> Column:
    """Value of one field, empty when missing; the last line with the key wins."""
    hits = F.filter(field_lines(content, key), lambda e: e["key"] == key)
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))


def _strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, "^['\"]+|['\"]+$", "")


def is_list_value(value: Column) -> Column:
    return F.startswith(value, F.lit("[")) & F.endswith(value, F.lit("]"))


def list_items(value: Column) -> Column:
    """Items of ``[a, b]`` without quotes; blank items dropped; empty for scalar values."""
    inner = F.regexp_replace(value, r"^\[|\]$", "")
    items = F.filter(F.split(inner, ","), lambda v: trim_ws(v) != "")
    cleaned = F.transform(items, lambda v: _strip_quotes(trim_ws(v)))
    return F.when(is_list_value(value), cleaned).otherwise(F.array().cast("array<string>"))


def anchored_list(content: Column, field: str) -> Column:
    """Items of the front-matter line ``field: [..]`` that stands alone on its line."""
    inner = F.regexp_extract(
        frontmatter(content), rf"(?m)^{field}:[ \t]*\[([^\]]*)\][ \t]*$", 1
    )
    return F.filter(F.transform(F.split(inner, ","), trim_ws), lambda v: v != "")


def bracketed_items(value: Column) -> Column:
    """Items of the first ``[..]`` in a value, else the value itself as one item."""
    inner = F.regexp_extract(value, r"\[([^\]]*)\]", 1)
    items = F.filter(F.transform(F.split(inner, ","), trim_ws), lambda v: v != "")
    return (
        F.when(value.rlike(r"\[[^\]]*\]"), items)
        .when(value != "", F.array(value))
        .otherwise(F.array().cast("array<string>"))
    )


def first_tag(content: Column) -> Column:
    """Page type as the resolver sees it: first tag, else the ``type`` field."""
    tags = field_value(content, "tags")
    inner = trim_ws(F.get(F.split(F.regexp_extract(tags, r"\[([^\]]*)\]", 1), ","), F.lit(0)))
    return F.when(tags.rlike(r"\[[^\]]*\]"), inner).otherwise(field_value(content, "type"))


def source_dates(content: Column) -> Column:
    return bracketed_items(field_value(content, "source_dates"))


# --- paragraphs ---------------------------------------------------------------------------


def first_paragraph(text: Column) -> Column:
    """First paragraph that is neither a heading nor a quote, trimmed; empty for none."""
    paragraphs = F.transform(F.split(text, "\n\n+"), trim_ws)
    prose = F.filter(
        paragraphs,
        lambda p: (p != "") & ~F.startswith(p, F.lit("#")) & ~F.startswith(p, F.lit(">")),
    )
    return F.coalesce(F.get(prose, F.lit(0)), F.lit(""))


def description(content: Column) -> Column:
    return first_paragraph(raw_body(content))


def registry_paragraph(content: Column) -> Column:
    """First prose before the per-source sections, whitespace collapsed."""
    without_title = F.regexp_replace(raw_body(content), r"^([\s\S]*?)(?:(?<=\n)|(?<![\s\S]))#\s+[^\n]*\n", "$1")
    titled = raw_body(content).rlike(r"(?m)^#\s+[^\n]*\n")
    text = F.when(titled, without_title).otherwise(raw_body(content))

    def before_sections(t: Column) -> Column:
        cut = F.least(
            F.regexp_instr(t, F.lit(r"(?m)^###\s+From\s+\[\[")),
            F.regexp_instr(t, F.lit(r"(?mi)^##\s+Mentioned\s+In")),
        )
        either = F.greatest(
            F.regexp_instr(t, F.lit(r"(?m)^###\s+From\s+\[\[")),
            F.regexp_instr(t, F.lit(r"(?mi)^##\s+Mentioned\s+In")),
        )
        first = F.when(cut > 0, cut).otherwise(either)
        return F.when(first > 0, F.left(t, first - 1)).otherwise(t)

    def pick(t: Column) -> Column:
        paragraphs = F.transform(F.split(t, "\n\n"), trim_ws)
        prose = F.filter(paragraphs, lambda p: (p != "") & ~F.startswith(p, F.lit(">")))
        return squeeze_ws(F.coalesce(F.get(prose, F.lit(0)), F.lit("")))

    return let(let(text, before_sections), pick)


# --- lint views of a page -------------------------------------------------------------------


def after_dashes(content: Column) -> Column:
    """Text after the second ``---`` of a page that starts with one, else the page."""

    def cut(c: Column) -> Column:
        end = F.locate("---", c, 4)
        return F.when(F.startswith(c, F.lit("---")) & (end > 0), F.substring(c, end + 3, F.length(c))).otherwise(c)

    return let(content, cut)


def frontmatter_problems(content: Column) -> Column:
    """Missing block, unclosed block, or the required fields its text does not mention."""
    end = F.locate("---", content, 4)
    block = F.substring(content, F.lit(4), end - 4)
    required = F.array(*[F.lit(f) for f in K.REQUIRED_FIELDS])
    missing = F.transform(
        F.filter(required, lambda f: ~F.contains(block, f)),
        lambda f: F.concat(F.lit("missing '"), f, F.lit("'")),
    )
    return (
        F.when(~F.startswith(content, F.lit("---")), F.array(F.lit("missing yaml frontmatter")))
        .when(end == 0, F.array(F.lit("unclosed yaml frontmatter")))
        .otherwise(missing)
    )


_BOILERPLATE = r"(?m)^(?:" + "|".join(K.BOILERPLATE_HEADINGS) + r")$"


def substance(content: Column) -> Column:
    """Body without titles, boilerplate sections and the link lists that follow them."""
    link_item = F.lit("- [[")

    def from_first_content(lines: Column) -> Column:
        # Titles are skipped while nothing was kept; link items are skipped once a
        # boilerplate heading came first.
        heading = F.array_position(F.transform(lines, lambda s: s.rlike(_BOILERPLATE)), F.lit(True))
        kinds = F.transform(
            lines,
            lambda s, i: F.when(s.rlike(_BOILERPLATE) | F.startswith(s, F.lit("# ")), False)
            .when(F.startswith(s, link_item), (heading == 0) | (i + 1 < heading))
            .otherwise(True),
        )
        first = F.array_position(kinds, F.lit(True))
        return F.when(first == 0, F.array().cast("array<string>")).otherwise(
            F.slice(lines, first.cast("int"), F.size(lines))
        )

    def without_leading_links(segment: Column) -> Column:
        lines = F.filter(F.split(segment, "\n"), lambda s: s != "")

        def drop(ls: Column) -> Column:
            stop = F.array_position(F.transform(ls, lambda s: F.startswith(s, link_item)), F.lit(False))
            return F.when(stop == 0, F.array().cast("array<string>")).otherwise(
                F.slice(ls, stop.cast("int"), F.size(ls))
            )

        return let(lines, drop)

    def kept(lines: Column) -> Column:
        segments = F.split(F.array_join(lines, "\n"), _BOILERPLATE)
        cleaned = F.transform(
            segments,
            lambda s, i: F.when(i == 0, F.filter(F.split(s, "\n"), lambda t: t != "")).otherwise(
                without_leading_links(s)
            ),
        )
        return trim_ws(F.array_join(F.flatten(cleaned), "\n"))

    stripped = F.transform(F.split(after_dashes(content), r"\r\n|\n|\r"), trim_ws)
    lines = F.filter(stripped, lambda s: s != "")
    return let(let(lines, from_first_content), kept)


def is_bodyless(subdir: Column, content: Column) -> Column:
    """Sources with under 20 characters besides headings; entities and concepts with none."""

    def judge(text: Column) -> Column:
        no_headings = trim_ws(F.regexp_replace(text, rf"(?m)^##\s+{K.WORD}[^\n]*$", ""))
        return (
            F.when(subdir == "sources", F.length(no_headings) < K.BODYLESS_SOURCE_CHARS)
            .when(subdir.isin("entities", "concepts"), text == "")
            .otherwise(False)
        )

    return let(substance(content), judge)


# --- links and markers ------------------------------------------------------------------------


def link_occurrences(content: Column) -> Column:
    """Link targets in text order, repeated ones included."""
    return F.regexp_extract_all(content, F.lit(K.WIKILINK), F.lit(1))


def link_targets(content: Column) -> Column:
    """Distinct link targets."""
    return F.array_distinct(link_occurrences(content))


def source_markers(content: Column) -> Column:
    found = F.regexp_extract_all(content, F.lit(K.SOURCE_MARKER), F.lit(1))
    return F.filter(F.transform(found, trim_ws), lambda f: f != "")


def source_hash(content: Column) -> Column:
    return F.regexp_extract(content, K.SOURCE_HASH, 1)


def snippet(content: Column) -> Column:
    def cut(text: Column) -> Column:
        head = trim_ws(F.replace(F.left(text, F.lit(K.SNIPPET_CHARS)), F.lit("\n"), F.lit(" ")))
        return F.when(F.length(text) > K.SNIPPET_CHARS, F.concat(head, F.lit("..."))).otherwise(head)

    return let(body(content), cut)
