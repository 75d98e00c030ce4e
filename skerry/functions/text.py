"""Text column semantics: codes, labels, tokens, keywords, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
NULL_WORDS = ("", "nan", "none", "<na>")
BOARD_PREFIXES = (("BJ", ("4", "8", "920")), ("SH", ("6", "9", "5")))


def safe_text(c: Column, most: int | None = None) -> Column:
    """Trimmed text; NULL and its spellings are empty (STR-01)."""
    x = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    x = F.when(F.lower(x).isin(*NULL_WORDS), "").otherwise(x)
    return F.substring(x, 1, most) if most else x


def normalize_code(c: Column, tickers: bool = False) -> Column:
    """Six digits from a code in any spelling; else a ticker if asked for; else empty (STR-02)."""
    x = F.regexp_replace(safe_text(c), r"\.0$", "")
    inside = F.regexp_extract(x, r"(?<!\d)(\d{6})(?!\d)", 1)
    digits = F.regexp_replace(x, r"\D", "")
    pad = lambda d: F.right(F.concat(F.lit("000000"), d), F.lit(6))
    out = F.when(x == "", "").when(x.rlike(r"^\d+$"), pad(x)).when(inside != "", inside)
    if tickers:
        out = out.when(x.rlike(r"^[A-Za-z][A-Za-z0-9.\-]*$"), F.upper(x))
    return out.when(digits != "", pad(digits)).otherwise("")


def exchange_code(c: Column) -> Column:
    """Code with its exchange (STR-03)."""
    x = F.upper(F.trim(c.cast("string")))
    six = F.when(F.length(x) < 6, F.lpad(x, 6, "0")).otherwise(x)
    suffix = F.lit("SZ")
    for name, prefixes in reversed(BOARD_PREFIXES):
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | six.startswith(p)
        suffix = F.when(hit, name).otherwise(suffix)
    return F.when(F.instr(x, ".") > 0, x).otherwise(F.concat(six, F.lit("."), suffix))


def labels(c: Column) -> Column:
    """A label list from delimited text: trimmed, without null spellings, in order, once each (STR-04)."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin(*NULL_WORDS)))


def merge_labels(*cs: Column) -> Column:
    return F.array_join(F.array_distinct(F.concat(*[labels(c) for c in cs])), ",")


def merge_summaries(*cs: Column) -> Column:
    """Up to eight different parts (STR-05)."""
    parts = F.concat(*[F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[\n|]"), lambda x: F.trim(x)), lambda x: x != "") for c in cs])
    return F.array_join(F.slice(F.array_distinct(parts), 1, 8), " | ")


def topic_tokens(c: Column) -> Column:
    """The set of topics in a summary: what stands before a colon (STR-06)."""
    parts = F.transform(F.split(safe_text(c), r"[|,，;；/\s]+"), lambda x: F.trim(F.substring_index(x, ":", 1)))
    return F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin("rank", *NULL_WORDS)))


# fixed values: words that say nothing about a topic
TOPIC_STOPS = ("概念", "板块", "行业", "产业", "主题", "指数")


def topic_key(c: Column) -> Column:
    """A topic's key: lower case, letters and digits only, without words that say nothing (STR-07)."""
    x = F.regexp_replace(F.lower(safe_text(c)), "人工智能", "ai")
    return F.regexp_replace(F.regexp_replace(x, "|".join(TOPIC_STOPS), ""), r"[^\p{L}\p{N}]", "")


def match_score(query: Column, alias: Column) -> Column:
    """Similarity of two topic keys: equal, one within the other, or by their sets of characters (STR-08)."""
    a, b = F.length(alias), F.length(query)
    qs, al = F.array_distinct(F.split(query, "")), F.array_distinct(F.split(alias, ""))
    overlap = F.size(F.array_intersect(qs, al)) / F.size(F.array_union(qs, al))
    return (
        F.when((query == "") | (alias == ""), 0.0)
        .when(query == alias, 1.0)
        .when((a >= 2) & (F.instr(query, alias) > 0), 0.82 + 0.08 * a / b)
        .when((b >= 2) & (F.instr(alias, query) > 0), 0.78 + 0.10 * b / a)
        .when(overlap >= 0.45, 0.42 + 0.28 * overlap)
        .otherwise(0.0)
    )


def flags_of(pairs: list[tuple[Column, str]]) -> Column:
    """The names whose condition holds, joined by semicolons in the order given (STR-09, STR-10)."""
    return F.array_join(F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]), lambda x: x.isNotNull()), ";")


def keyword_tags(c: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Labels any of whose keywords occurs in the text, plainly, in the table's order (STR-11)."""
    text = F.coalesce(c, F.lit(""))
    hits = []
    for label, words in table.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        hits.append((hit, label))
    return flags_of(hits)


def day_key(c: Column) -> Column:
    """A day as eight digits, from ISO or plain text; NULL for blanks (DAT-01)."""
    x = F.trim(c.cast("string"))
    return F.when(x != "", F.substring(F.regexp_replace(x, "-", ""), 1, 8))


def iso_day(c: Column) -> Column:
    """A day of eight digits in ISO form; other texts as they are, a blank one for NULL (DAT-01)."""
    x = F.coalesce(day_key(c), F.lit(""))
    return F.when(F.length(x) == 8, F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))).otherwise(x)
