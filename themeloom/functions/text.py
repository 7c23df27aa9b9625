"""Whitespace, HTML and token expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when trimming.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
NBSP = "\xa0"
# Unicode white space plus the four separator controls, for use inside a regex.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
TAG = "<[^>]+>"

# Markers of the page layout.
REGION = r'(?s)class="gnContent"[^>]*>(.*)'
ROW_START = r"(?=<tr[^>]*>)"
ROW_TAG = r"^<tr\s*([^>]*)>"
ROW_BODY = r"(?s)^<tr[^>]*>(.*)"
FULL_ROW = "extend_content"
NAME_CELL = r'(?s)class="gnName[^"]*"[^>]*>(.*?)(?:</td|</div|</span)'
SHORT_CELL = r'(?s)class="tdContent"[^>]*>(.*?)(?:</div)'
SCROLL_BOX = r'(?s)class="scrollbar-macosx[^"]*"[^>]*>(.*?)</div>\s*</td>'
DECORATION = r'<div[^>]*class="bg_trigon_box"[^>]*></div>'
INDUSTRY_LINK = r'(?s)所属行业.*?<a[^>]*href="[^"]*"[^>]*>([^<]+)</a>'
MORE_LINK = "更多>>"

WORD = r"[\p{L}\p{N}]+"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"


def strip(c: Column) -> Column:
    """Trim every white-space character, not only blanks, from both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def nonempty(c: Column) -> Column:
    """The value, or null where it counts as absent (null or empty)."""
    return F.nullif(c, F.lit(""))


def present(c: Column) -> Column:
    """Whether a text value counts as given."""
    return F.coalesce(c, F.lit("")) != ""


def drop_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, TAG, ""))


def plain_spaces(c: Column) -> Column:
    """Hard spaces, literal or as an entity, become blanks."""
    return F.replace(F.replace(c, F.lit(NBSP), F.lit(" ")), F.lit("&nbsp;"), F.lit(" "))


def html_text(c: Column) -> Column:
    """Readable text of a page fragment, taken from its scroll box if it has one."""
    boxed = F.regexp_replace(F.regexp_extract(c, SCROLL_BOX, 1), DECORATION, "")
    inner = F.when(F.rlike(c, F.lit(SCROLL_BOX)), boxed).otherwise(c)
    return strip(F.regexp_replace(plain_spaces(drop_tags(inner)), SPACE_RUN, " "))


def industry_of(html: Column) -> Column:
    """First link text after the industry label; the 'more' link is no industry."""
    found = strip(F.regexp_extract(html, INDUSTRY_LINK, 1))
    return F.when(found == MORE_LINK, "").otherwise(found)


def words(c: Column) -> Column:
    """Letter and digit runs of the whole text, in order, repeats included."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def grams(run: Column, n: int) -> Column:
    """All ``n``-character pieces of one run; none if the run is shorter."""
    last = F.char_length(run) - n + 1
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(run, i, F.lit(n))),
    ).otherwise(F.array().cast("array<string>"))


def has_han(c: Column) -> Column:
    return F.rlike(c, F.lit(HAN))
