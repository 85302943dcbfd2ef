"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.scalar import col

#: Company suffixes, in the order in which they are tried.
COMPANY_SUFFIXES = ("有限公司", "有限责任公司", "股份有限公司", "公司", "集团")


def clean_text(x: Column | str) -> Column:
    """One blank for any run of white space, no control characters, trimmed; null gives ''."""
    flat = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(flat, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""))


def normalize_whitespace(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def strip_html(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"<[^>]+>", "")


def truncate_text(x: Column | str, most: int = 100, suffix: str = "...") -> Column:
    """At most ``most`` characters, the suffix included."""
    x = col(x)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - len(suffix)), F.lit(suffix)))


def truncate_at_sentence(x: Column | str, most: int) -> Column:
    """The first ``most`` characters, ended after the last sentence mark if that lies beyond four fifths."""
    x = col(x)
    head = F.substring(x, 1, most)
    back = F.reverse(head)
    last = F.greatest(*[F.when(F.instr(back, c) > 0, F.lit(most) - F.instr(back, c)).otherwise(F.lit(-1)) for c in (".", "\n", "。")])
    cut = F.when(last > most * 0.8, F.substring(head, F.lit(1), last + 1)).otherwise(head)
    return F.when(F.length(x) <= most, x).otherwise(cut)


def normalize_company(x: Column | str) -> Column:
    """Without the first suffix of the list that fits."""
    x, out = F.trim(col(x)), F.trim(col(x))
    for suffix in reversed(COMPANY_SUFFIXES):
        out = F.when(F.endswith(x, F.lit(suffix)), F.substring(x, F.lit(1), F.length(x) - len(suffix))).otherwise(out)
    return out


def normalize_school(x: Column | str) -> Column:
    return F.trim(col(x))


def is_chinese_name(x: Column | str) -> Column:
    return F.coalesce(F.regexp_like(col(x), F.lit(r"^[一-龥]{2,4}$")), F.lit(False))


def is_english_name(x: Column | str) -> Column:
    return F.coalesce(F.regexp_like(col(x), F.lit(r"^[A-Za-z](?:[A-Za-z\s]*[A-Za-z])?$")), F.lit(False))


def _jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0)).cast("double")


def text_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the lower-cased words between blanks; 0 if a side has none."""
    words = lambda x: F.filter(F.array_distinct(F.split(F.lower(F.coalesce(col(x), F.lit(""))), r"\s+")), lambda w: w != "")
    return _jaccard(words(a), words(b))


def char_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard of the lower-cased character sets."""
    chars = lambda x: F.filter(F.array_distinct(F.split(F.lower(F.coalesce(col(x), F.lit(""))), "")), lambda c: c != "")
    return _jaccard(chars(a), chars(b))


def entry_similarity(a: Column | str, b: Column | str, fields: tuple[str, ...] = ("school", "company", "name", "title")) -> Column:
    """Mean over the fields present on both sides: 1.0 if equal, 0.8 if one holds the other; others don't count."""
    a, b = col(a), col(b)
    scores = []
    for f in fields:
        x, y = F.lower(F.trim(a[f])), F.lower(F.trim(b[f]))
        there = (F.coalesce(x, F.lit("")) != "") & (F.coalesce(y, F.lit("")) != "")
        scores.append(F.when(there & (x == y), F.lit(1.0)).when(there & (F.contains(x, y) | F.contains(y, x)), F.lit(0.8)))
    kept = F.array_compact(F.array(*scores))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)).otherwise(F.lit(0.0))


def normalize_keyword(x: Column | str, synonyms: Column) -> Column:
    """Canonical form by a map of aliases: looked up as it is, without dots, without blanks; else the input itself."""
    key = F.lower(F.trim(col(x)))
    look = lambda k: F.element_at(synonyms, k)
    return F.coalesce(look(key), look(F.replace(key, F.lit("."), F.lit(""))), look(F.replace(key, F.lit(" "), F.lit(""))), col(x))


def text_key(x: Column | str) -> Column:
    return F.substring(F.sha2(col(x), 256), 1, 16)


def markdown_to_text(x: Column | str) -> Column:
    """Markdown without its marks; a link keeps its address in brackets."""
    rules = [
        (r"(?m)^#{1,6}\s*", ""),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\(([^)]*)\)", "$1 ($2)"),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"`([^`]*)`", "$1"),
        (r"(?m)^\s*[-*+]\s+", "• "),
        (r"(?m)^>\s?", ""),
    ]
    out = col(x)
    for pattern, instead in rules:
        out = F.regexp_replace(out, pattern, instead)
    return F.trim(out)
