"""Visible text of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts that are not shown, and tags that start a new line.  An unclosed part
# hides the rest of the page; a tag ends before the next "<", so no search for a
# missing end is repeated.
HIDDEN = (
    r"(?is)<script(?:[\s/][^<>]*)?>.*?(?:</script\s*>|\z)"
    r"|<style(?:[\s/][^<>]*)?>.*?(?:</style\s*>|\z)"
    r"|<head(?:[\s/][^<>]*)?>.*?(?:</head\s*>|\z)|<!--.*?(?:-->|\z)"
)
BLOCK = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer"
    r"|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)"
    r"(?:[\s/][^<>]*)?>"
)
TAG = r"</?[A-Za-z!][^<>]*>"
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
)


def visible_text(html: Column) -> Column:
    """Drop scripts, styles, head and comments; tags become line breaks or nothing."""
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BLOCK, "\n")
    text = F.regexp_replace(text, TAG, "")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text
