"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"


def like_ci(col: Column, needle: str) -> Column:
    """SQL LIKE '%needle%' without regard to case; % and _ in the needle stay wildcards. (F-01)"""
    return col.ilike(f"%{needle}%")


def tokenize(col: Column) -> Column:
    """Every CJK ideograph, in order, then lower-cased runs of a-z; everything else separates. (F-02)"""
    return F.concat(F.regexp_extract_all(col, F.lit(CJK), F.lit(0)), F.regexp_extract_all(F.lower(col), F.lit("[a-z]+"), F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, in double."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Dot over the shorter length by the full norms; 0 where a norm is 0. (F-03)"""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def float32(a: Column) -> Column:
    """The values as they are after storage in single precision. (F-04)"""
    return F.transform(a, lambda x: x.cast("float"))


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge in which new keys win, without depending on the session's policy for repeated keys. (F-06)"""
    new = F.coalesce(new, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(kept, new)


def positive_int(col: Column) -> Column:
    """The first run of digits as a number if it is above 0, else null. (F-07)"""
    n = F.regexp_extract(col.cast("string"), r"(\d+)", 1).try_cast("long")
    return F.when(n > 0, n)


def first_positive(*cols: Column) -> Column:
    """The first column that gives a positive number. (F-08, F-35)"""
    return F.coalesce(*[positive_int(c) for c in cols])


def enum_of(col: Column, synonyms: dict[str, list[str]], default: str) -> Column:
    """The enum value of which the lower-cased, trimmed text is a synonym, else the default. (F-09)"""
    text, out = F.lower(F.trim(col)), F.lit(default)
    for value, names in synonyms.items():
        out = F.when(text.isin([value, *names]), F.lit(value)).otherwise(out)
    return out


def split_patterns(col: Column, delimiters: str = "[,;/|、，；。\\n]+") -> Column:
    """A delimited string as its trimmed, distinct, non-empty parts. (F-10, F-11 by delimiters)"""
    return F.array_distinct(F.filter(F.transform(F.split(col, delimiters), lambda x: F.trim(x)), lambda x: x != ""))


def count_patterns(col: Column, delimiters: str = "[,;/|、，；。\\n]+") -> Column:
    """Number of distinct parts; null where there is none. (F-10, U-05)"""
    n = F.size(split_patterns(col, delimiters))
    return F.when(n > 0, n)


def recency(source: Column, current: Column) -> Column:
    """1 / (1 + age), ages below 0 counting as 0; null gives 0. (F-14)"""
    return F.coalesce(1.0 / (1 + F.greatest(F.lit(0), current - source)), F.lit(0.0))


def frequency(n: Column) -> Column:
    """Logarithmic saturation that reaches 1 at ten. (F-15)"""
    return F.least(F.lit(1.0), F.ln(1 + n) / F.ln(F.lit(11.0)))


def length_score(col: Column, full: int = 1200, cap: float = 0.2) -> Column:
    """Length relative to ``full``, at most 1, times the cap. (F-16)"""
    return F.least(F.char_length(F.coalesce(col, F.lit(""))) / F.lit(float(full)), F.lit(1.0)) * cap


def has_any(col: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring. (F-17)"""
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def count_of(col: Column, word: str) -> Column:
    """Non-overlapping occurrences of a word. (F-18)"""
    return ((F.char_length(col) - F.char_length(F.replace(col, F.lit(word), F.lit("")))) / len(word)).cast("long")


def head(col: Column, n: int = 300) -> Column:
    """The first characters. (F-19)"""
    return F.left(col, F.lit(n))


def tail(col: Column, n: int = 300) -> Column:
    """The last characters. (F-19)"""
    return F.right(col, F.lit(n))


def compact(col: Column, budget: int, marker: str = "...[cut]...", share: float = 0.65, hard: int = 120) -> Column:
    """At most ``budget`` characters: as it is, cut hard for small budgets, else head, marker and tail. (F-20)"""
    n_head = int(budget * share)
    n_tail = max(0, budget - n_head - 10)
    if budget <= hard:
        long = F.left(col, F.lit(budget))
    else:
        long = F.left(F.concat(F.left(col, F.lit(n_head)), F.lit(marker), F.right(col, F.lit(n_tail))), F.lit(budget))
    return F.when(F.char_length(col) <= budget, col).otherwise(long)


def section(col: Column, title: str) -> Column:
    """The trimmed body under the Markdown heading of that title, up to the next heading. (F-21)"""
    return F.btrim(F.regexp_extract(col, rf"(?ms)^#+\s*\Q{title}\E\s*$\n(.*?)(?=^#|\z)", 1), F.lit(" \t\r\n"))


def bullets(col: Column, n: int) -> Column:
    """The first ``n`` bullet texts. (F-22)"""
    lines = F.filter(F.split(col, "\n"), lambda x: F.trim(x).rlike(r"^[-*]\s+\S"))
    return F.slice(F.transform(lines, lambda x: F.regexp_replace(F.trim(x), r"^[-*]\s+", "")), 1, n)


def split_tokens(col: Column, separators: str = r"[+/,|、，]", limit: int | None = None) -> Column:
    """Parts between separators, trimmed, distinct without regard to case (the first spelling stays). (F-23)"""
    parts = F.filter(F.transform(F.split(col, separators), lambda x: F.trim(x)), lambda x: x != "")
    lowered = F.transform(parts, F.lower)
    first = F.filter(parts, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
    return F.slice(first, 1, limit) if limit else first


def translate_token(col: Column, aliases: dict[str, str]) -> Column:
    """Dictionary lookup that falls through. (F-24)"""
    if not aliases:
        return col
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(table, col), col)


def chapter_of_path(col: Column) -> Column:
    """The first number in the file name. (F-25)"""
    return F.regexp_extract(F.element_at(F.split(col, "/"), -1), r"(\d+)", 1).try_cast("long")


def volume_of(col: Column, per: int = 50) -> Column:
    """The volume of a chapter, 1 for the first ``per``; null for numbers below 1. (F-25)"""
    return F.when(col >= 1, F.floor((col - 1) / per) + 1)


def stats_field(col: Column, name: str) -> Column:
    """The value of the first line ``- **name**: value``. (F-26)"""
    got = F.regexp_extract(col, rf"(?m)^\s*[-*]\s*\*\*\Q{name}\E\*\*\s*[:：]\s*(.+?)\s*$", 1)
    return F.when(got != "", got)


def range_of(col: Column) -> Column:
    """``a-b`` with 0 < a <= b as a struct (first, last), else null. (F-28)"""
    a = F.regexp_extract(col, r"^\s*(\d+)\s*[-~–]\s*(\d+)\s*$", 1).try_cast("long")
    b = F.regexp_extract(col, r"^\s*(\d+)\s*[-~–]\s*(\d+)\s*$", 2).try_cast("long")
    return F.when((a > 0) & (a <= b), F.struct(a.alias("first"), b.alias("last")))


def review_end(col: Column) -> Column:
    """The last number of a range, a JSON list or a file name; 0 where there is none. (F-27)"""
    return F.coalesce(F.regexp_extract(col, r"(\d+)\D*$", 1).try_cast("long"), F.lit(0))


def polarity(col: Column, negative: list[str], positive: list[str]) -> Column:
    """-1 if a negative word is in it, else 1 if a positive one is, else 0. (F-29)"""
    return F.when(has_any(col, negative), -1).when(has_any(col, positive), 1).otherwise(0)


def confidence_band(col: Column, high: float = 0.8, mid: float = 0.5) -> Column:
    """auto, warn or manual. (F-30)"""
    return F.when(col >= high, F.lit("auto")).when(col >= mid, F.lit("warn")).otherwise(F.lit("manual"))


def first_class(col: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The first class one of whose words is in the text. (F-31)"""
    out = None
    for name, words in classes.items():
        out = F.when(has_any(col, words), F.lit(name)) if out is None else out.when(has_any(col, words), F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def all_classes(col: Column, classes: dict[str, list[str]]) -> Column:
    """Every class one of whose words is in the text. (F-31)"""
    return F.array_compact(F.array(*[F.when(has_any(col, w), F.lit(n)) for n, w in classes.items()]))


def normal_outline(col: Column) -> Column:
    """Headings' marks removed and white space collapsed. (F-32)"""
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"(?m)^#+\s*", ""), r"\s+", " "))


def to_double(col: Column, default: float = 0.0) -> Column:
    """A number of any text, the default where it is none. (F-36)"""
    return F.coalesce(col.try_cast("double"), F.lit(default))


def to_long(col: Column, default: int = 0) -> Column:
    """A whole number of any text, the default where it is none. (F-36)"""
    return F.coalesce(col.try_cast("double").cast("long"), F.lit(default))


def json_field(col: Column, ddl: str) -> Column:
    """A JSON text under a declared type; malformed text gives null. (F-05)"""
    return F.from_json(col, ddl)


def coalesce_keys(col: Column, keys: list[str]) -> Column:
    """The first of several synonymous keys of a JSON text that is set. (F-12, F-13)"""
    return F.coalesce(*[F.get_json_object(col, f"$.{k}") for k in keys])


def grouped(col: Column, places: int = 2, most: int = 20) -> Column:
    """A number with grouped digits, cut to a width. (F-34)"""
    return F.left(F.format_number(col, places), F.lit(most))


def round_half_up(col: Column, places: int) -> Column:
    """Rounding as SQL does it, half away from zero on the decimal text; halves of binary fractions can differ from
    rounding to even. (F-37)"""
    return F.round(col, places)
