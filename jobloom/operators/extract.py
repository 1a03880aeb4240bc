"""Fields of stored pages, found by rules.

The boards differ only in their rules, so each step is one operator with the rules as
arguments.  Patterns stay inside what both Java and RE2 understand.  Lists inside a page are
arrays: they are as long as the page, and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobloom import rules as R
from jobloom.functions import text as X

HREF = r'<a[^>]*\shref="([^"]*)"'


# ---- text -------------------------------------------------------------------------------

class _TextRuns(HTMLParser):
    """Text between tags, without scripts, styles and comments."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.runs, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.runs.append(data.strip())


def _page_text(html: str | None) -> str:
    parser = _TextRuns()
    parser.feed(html or "")
    parser.close()
    return "\n".join(parser.runs)


@F.pandas_udf(StringType())
def html_to_text_exact(html: pd.Series) -> pd.Series:
    """Page text by a real parser, for markup the patterns of ``html_to_text`` misread."""
    return html.map(_page_text)


# ---- links ------------------------------------------------------------------------------

def extract_links(pages: DataFrame, pattern: str, area: str | None = None, html: str = "html",
                  base: str = "url", keep: Sequence[str] = ()) -> DataFrame:
    """Absolute posting URLs of list pages in page order, each once per page.

    ``area`` finds hrefs inside posting blocks; a page without any falls back to all its
    links.  ``pattern`` must occur in a link for it to count.
    """
    def links(p):
        found = F.filter(F.regexp_extract_all(html, F.lit(p), F.lit(1)), lambda h: h.rlike(pattern))
        return F.array_distinct(F.transform(found, lambda h: X.canonical_url(h, F.col(base))))

    out = pages.withColumn("_links", links(area or HREF))
    if area is not None:
        out = out.withColumn("_links", F.when(F.size("_links") > 0, F.col("_links")).otherwise(links(HREF)))
    return out.select(*keep, F.posexplode("_links").alias("pos", "link"))


# ---- labelled values --------------------------------------------------------------------

def field_of_label(label: str | Column, synonyms=R.LABEL_SYNONYMS) -> Column:
    return X.first_rule(F.trim(F.lower(X.col(label))), [(needles, field) for field, needles in synonyms])


def label_value_fields(pairs: DataFrame, key: str, synonyms=R.LABEL_SYNONYMS, label: str = "label",
                       value: str = "value", order: str = "pos", title: str | None = None) -> DataFrame:
    """(label, value) pairs as one row per key with a column per field.

    The first synonym found in a label decides its field; a later pair overwrites an
    earlier one.  ``title`` names a column preferred over the value where it is filled.
    """
    shown = F.col(value) if title is None else F.coalesce(X.blank_to_null(title), F.col(value))
    named = pairs.select(key, F.col(order).alias("_at"), shown.alias("_value"),
                         field_of_label(label, synonyms).alias("_field")).filter(F.col("_field").isNotNull())
    return named.groupBy(key).agg(*[
        F.max_by(F.when(F.col("_field") == f, F.col("_value")), F.when(F.col("_field") == f, F.col("_at"))).alias(f)
        for f, _ in synonyms])


# ---- sections ---------------------------------------------------------------------------

def _items(content: Column, tag: str) -> Column:
    found = F.regexp_extract_all(content, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: X.html_to_text(x, " ")), lambda x: x != "")


def block_text(content: Column) -> Column:
    """List items of a block, else its paragraphs, else all its text, one per line."""
    li, p = _items(content, "li"), _items(content, "p")
    return F.when(F.size(li) > 0, F.array_join(li, "\n")).when(F.size(p) > 0, F.array_join(p, "\n")).otherwise(
        X.html_to_text(content))


def sections(html: str | Column) -> Column:
    """Blocks of a page as array<struct<heading, content>>; text before a heading is out."""
    chunks = F.split(X.col(html), r"(?i)<h[1-6][^>]*>")
    return F.transform(F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0))), lambda c: F.struct(
        X.html_to_text(F.regexp_extract(c, r"(?is)^(.*?)</h[1-6]>", 1), " ").alias("heading"),
        F.regexp_replace(c, r"(?is)^(.*?)</h[1-6]>", "").alias("content")))


def section_text(pages: DataFrame, html: str = "html", synonyms=R.SECTION_SYNONYMS) -> DataFrame:
    """Add one column per field with the text under its first non-empty heading."""
    rule_list = [(needles, field) for field, needles in synonyms]
    typed = F.transform(sections(html), lambda s: F.struct(
        X.first_rule(F.lower(s["heading"]), rule_list).alias("field"), s["content"].alias("content")))
    out = pages.withColumn("_sections", F.filter(typed, lambda s: s["field"].isNotNull()))
    filled = F.filter(F.transform("_sections", lambda s: F.struct(s["field"].alias("field"), block_text(s["content"]).alias("text"))),
                      lambda s: s["text"] != "")
    out = out.withColumn("_sections", filled)
    pick = lambda f: F.get(F.filter("_sections", lambda s: s["field"] == f), F.lit(0))["text"]
    return out.withColumns({f: F.coalesce(pick(f), F.lit("")) for f, _ in synonyms}).drop("_sections")


# ---- single fields ----------------------------------------------------------------------

ANCHOR_TEXT = r"(?is)<a[^>]*>([^<]*)</a>"


def keyword_tags(html: str | Column, pattern: str = ANCHOR_TEXT) -> Column:
    return X.encode_tags(F.regexp_extract_all(X.col(html), F.lit(pattern), F.lit(1)))


def regex_field(c: str | Column, patterns: Sequence[str], group: int = 1) -> Column:
    """First pattern that finds something; null when none does."""
    return X.first_nonempty(*[F.regexp_extract(X.col(c), p, group) for p in patterns])


def text_before(c: str | Column, mark: str) -> Column:
    return F.trim(F.substring_index(X.col(c), mark, 1))


def title_fallback(heading, meta, card) -> Column:
    """Heading, else the title inside "Recruiting X at", else the text before a pipe, else
    the list card's title."""
    recruiting = F.trim(F.regexp_extract(X.col(meta), R.RECRUITING_TITLE, 1))
    before = F.trim(F.replace(F.substring_index(X.col(meta), "|", 1), F.lit(R.RECRUITING_WORDS), F.lit("")))
    return F.coalesce(X.first_nonempty(heading, recruiting, before, card), F.lit(""))


def classify_spans(spans: str | Column, classes=R.SPAN_CLASSES, limit: int = R.MAX_SPAN_CHARS) -> dict[str, Column]:
    """First short snippet of every class, the first matching class deciding a snippet."""
    rule_list = [(needles, name) for name, needles in classes]
    short = F.filter(X.col(spans), lambda s: (s != "") & (F.length(s) <= limit))
    typed = F.transform(short, lambda s: F.struct(s.alias("text"), X.first_rule(F.lower(s), rule_list).alias("cls")))

    def first_of(name):
        return F.coalesce(F.get(F.filter(typed, lambda s: s["cls"] == name), F.lit(0))["text"], F.lit(""))

    return {name: first_of(name) for name, _ in classes}


def drop_closed(df: DataFrame, title: str, markers: Sequence[str] = R.CLOSED_MARKERS) -> DataFrame:
    low = F.lower(title)
    return df.filter((F.coalesce(F.col(title), F.lit("")) != "") & ~X.contains_any(low, markers))


def page_blocked(html: str | Column, markers: Sequence[str] = R.CHALLENGE_MARKERS, window: int | None = R.CHALLENGE_WINDOW,
                 status: Column | None = None, statuses: Sequence[int] = R.BLOCK_STATUSES) -> Column:
    """Whether a stored page is a challenge or an error instead of content.

    Challenge pages name themselves at the top, so boards look at the first ``window``
    characters; ``None`` looks at the whole page.
    """
    low = F.lower(F.coalesce(X.col(html), F.lit("")))
    seen = low if window is None else F.substring(low, 1, window)
    short = (F.length(low) < R.SHORT_PAGE) & X.contains_any(low, R.SHORT_PAGE_MARKERS)
    out = X.contains_any(seen, markers) | short
    return out if status is None else out | status.isin(list(statuses))


def too_short(html: str | Column, least: int = R.MIN_DETAIL_CHARS) -> Column:
    return F.length(F.coalesce(X.col(html), F.lit(""))) <= least


# ---- places and companies ---------------------------------------------------------------

def place_and_address(place, address) -> Column:
    p, a = F.coalesce(X.col(place), F.lit("")), F.coalesce(X.col(address), F.lit(""))
    return (F.when((p != "") & (a != ""), F.when(F.contains(a, p), a).otherwise(F.concat(p, F.lit(" - "), a)))
            .otherwise(F.coalesce(X.first_nonempty(a, p), F.lit(""))))


def address_and_city(address, city) -> Column:
    a, c = F.coalesce(X.col(address), F.lit("")), F.coalesce(X.col(city), F.lit(""))
    both = F.regexp_replace(F.concat(a, F.lit(", "), c), r"^[, ]+|[, ]+$", "")
    return F.when((a != "") & (c != ""), both).otherwise(F.coalesce(X.first_nonempty(a, c), F.lit("")))


def company_name(text, alt, cuts: Sequence[str] = R.COMPANY_CUT) -> Column:
    """Element text up to the size or address label; the logo's alt text where the name is
    empty, too short or really a date."""
    name = F.trim(F.get(F.split(F.coalesce(X.col(text), F.lit("")), r"(?iu)\s*(?:" + "|".join(cuts) + ")"), F.lit(0)))
    other = X.blank_to_null(F.trim(X.col(alt)))
    bad = (F.length(name) < R.MIN_COMPANY_CHARS) | F.contains(F.lower(name), F.lit(R.COMPANY_DATE_WORD))
    return F.when(bad, F.coalesce(other, name)).otherwise(name)


def company_logo(src, base, placeholders: Sequence[str] = R.PLACEHOLDER_IMAGES) -> Column:
    """Logo address, made absolute and unwrapped; '' for placeholders."""
    s = F.trim(F.coalesce(X.col(src), F.lit("")))
    root = F.regexp_extract(X.col(base), r"^([A-Za-z]+://[^/?#]*)", 1)
    full = F.when(F.startswith(s, F.lit("/")), F.concat(root, s)).otherwise(s)
    return F.when((s == "") | X.contains_any(F.lower(s), placeholders), "").otherwise(X.unwrap_image_url(full))


# ---- list cards and detail pages --------------------------------------------------------

def _one_detail(details: DataFrame, key: str) -> DataFrame:
    """One row per key: of several, the one of the smallest fields in column order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(c for c in details.columns if c != key)))
    return details.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def enrich_override(cards: DataFrame, details: DataFrame, key: str, fields: Sequence[str] = R.DETAIL_FIELDS) -> DataFrame:
    """Cards whose fields are overridden by non-empty fields of the detail page."""
    used = [f for f in fields if f in details.columns]
    d = _one_detail(details, key).select(F.col(key).alias("_key"), *[F.col(f).alias(f"_d_{f}") for f in used])
    out = cards.join(d, F.col(key) == F.col("_key"), "left")
    return out.select(*[
        F.coalesce(X.blank_to_null(f"_d_{c}"), F.col(c)).alias(c) if c in used else F.col(c) for c in cards.columns])


def enrich_fallback(cards: DataFrame, details: DataFrame, key: str, fallback: dict[str, str],
                    defaults: dict[str, str]) -> DataFrame:
    """Detail rows completed from their card; a card without detail gives a row of its own,
    marked ``extracted_from = list_card``, with fixed defaults.

    ``fallback`` maps a field to the card column that fills it.
    """
    fields = [c for c in details.columns if c != key]
    d = _one_detail(details, key).select(F.col(key).alias("_key"), *[F.col(f).alias(f"_d_{f}") for f in fields])
    out = cards.join(d, F.col(key) == F.col("_key"), "left")
    alone = F.col("_key").isNull()
    columns = []
    for f in sorted({*fields, *fallback, *defaults}):
        parts = [F.col(f"_d_{f}")] if f in fields else []
        parts += [F.col(fallback[f])] if f in fallback else []
        value = X.first_nonempty(*parts) if parts else F.lit(None).cast("string")
        fixed = F.when(alone, F.lit(defaults[f])) if f in defaults else F.lit(None).cast("string")
        columns.append(F.coalesce(value, fixed).alias(f))
    return out.select(F.col(key), *columns, F.when(alone, "list_card").otherwise("detail").alias("extracted_from"))
