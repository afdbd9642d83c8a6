"""Text columns: tokens, token estimates, snippets, slugs, anchors. All are built-in expressions and stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are never terms.
STOP_WORDS = ("的", "了", "和", "或", "及", "请问", "一般", "情况下", "怎么", "如何", "the", "a", "an", "and", "or", "to", "of", "in")
#: White space as JavaScript's \s and trim() have it.
BLANK = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
TITLE_WEIGHT, SLUG_WEIGHT = 4, 3
SNIPPET, SNIPPET_CUT = 260, 257


def trim(c: Column) -> Column:
    """Trims all JavaScript white space; Spark's trim() takes spaces only."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+\\z", "")


def terms(c: Column) -> Column:
    """Terms with repetition: lower case, split at everything but letters, digits and dots, cleaned, without stop words.

    After the split only dots are left to clean off, so no pattern runs on the parts but on those of one character.
    """
    parts = F.transform(F.split(F.lower(c), "[^\\p{L}\\p{N}.]+"), lambda t: F.btrim(t, F.lit(".")))
    one_han = lambda t: (F.length(t) == 1) & F.regexp_like(t, F.lit("^\\p{IsHan}\\z"))
    return F.filter(parts, lambda t: (t != "") & ~t.isin(*STOP_WORDS) & ~one_han(t))


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query in order, by the same rules as `terms`. Compatibility forms stay apart on both sides here;
    the search's own terms, which fold them, are in segment.py."""
    out: list[str] = []
    for part in re.split(r"[^\w.]+|_", query.lower()):
        t = part.strip(".")
        if t and t not in STOP_WORDS and t not in out and not (len(t) == 1 and "一" <= t <= "鿿"):
            out.append(t)
    return out


def occurrences(haystack: Column, needles: list[str]) -> Column:
    """Non-overlapping occurrences of all needles in a text, added up."""
    each = [((F.length(haystack) - F.length(F.replace(haystack, F.lit(n), F.lit("")))) / F.lit(len(n))).cast("long") for n in needles if n]
    return reduce(lambda a, b: a + b, each, F.lit(0).cast("long"))


def estimate_tokens(c: Column, han_per_token: float = 1.6) -> Column:
    """Runs of ASCII words, plus Han characters by a ratio, plus an eighth of what isn't Han; 1 at least."""
    runs = F.regexp_count(c, F.lit("[A-Za-z0-9_./+-]+"))
    han = F.regexp_count(c, F.lit("\\p{IsHan}"))
    rest = F.length(F.regexp_replace(c, "\\p{IsHan}", ""))
    return F.greatest(F.lit(1).cast("long"), F.ceil(runs + han / F.lit(float(han_per_token)) + rest / F.lit(8.0)))


def snippet(c: Column) -> Column:
    flat = trim(F.regexp_replace(c, f"[{BLANK}]+", " "))
    return F.when(F.length(flat) > SNIPPET, F.concat(F.substring(flat, 1, SNIPPET_CUT), F.lit("..."))).otherwise(flat)


def slug_words(c: Column) -> Column:
    return F.regexp_replace(c, "[./_-]+", " ")


def slug_of(path: Column) -> Column:
    """A path's last part without its last extension."""
    name = F.regexp_extract(path, "([^/]*)\\z", 1)
    return F.when(F.regexp_like(name, F.lit("^.+\\.[^.]*\\z")), F.regexp_replace(name, "\\.[^.]*\\z", "")).otherwise(name)


def concept_id(path: Column) -> Column:
    return F.regexp_replace(path, "(?i)\\.md\\z", "")


def humanize(slug: Column) -> Column:
    flat = trim(F.regexp_replace(F.regexp_replace(slug, "[-_]+", " "), f"[{BLANK}]+", " "))
    return F.concat(F.upper(F.substring(flat, 1, 1)), F.substring(flat, 2, 1 << 30))


def anchor_of(heading: Column) -> Column:
    kept = F.regexp_replace(F.lower(trim(heading)), f"[^\\p{{L}}\\p{{N}}{BLANK}-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, f"[{BLANK}]+", "-"), "-+", "-"), "^-|-\\z", "")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<!--.*?-->", "")


def first_heading(body: Column, level: int = 1) -> Column:
    found = F.regexp_extract(body, f"(?m)^#{{{level}}}[{BLANK}&&[^\\n]]+([^\\n]+?)[{BLANK}&&[^\\n]]*$", 1)
    return F.nullif(found, F.lit(""))


def tier(path: Column, boosts: dict[str, float]) -> Column:
    """The boost of the longest matching prefix, else 1."""
    out = F.lit(1.0)
    for prefix in sorted(boosts, key=len):
        out = F.when(F.startswith(path, F.lit(prefix)), F.lit(float(boosts[prefix]))).otherwise(out)
    return out


def occurrences_of(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == F.lit(term)))


def weighted_counts(title: Column, slug: Column, body: Column, wanted: list[str]) -> Column:
    """For each wanted term its occurrences, title and slug counting by their weights."""
    return F.array(*(TITLE_WEIGHT * occurrences_of(title, t) + SLUG_WEIGHT * occurrences_of(slug, t) + occurrences_of(body, t) for t in wanted))
