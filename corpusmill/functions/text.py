"""Column functions on text. All stay inside the JVM; none needs a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"一-鿿"
BLANK = r"[ \t\n\r\f\x0B]"


BLANKS = " \t\n\r\f\x0b"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    """Whether a text holds nothing but blanks; looks no further than to the first other character."""
    return ~col.rlike(r"[^ \t\n\r\f\x0B]")


def squeeze(col: Column) -> Column:
    """Any run of blanks becomes one space, ends trimmed."""
    return F.trim(F.regexp_replace(col, rf"{BLANK}+", " "))


def occurrences(col: Column, char: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(char), F.lit("")))


def count_cjk(col: Column) -> Column:
    """Number of CJK characters, from what is left without them: a text that has none is not copied."""
    return F.length(col) - F.length(F.regexp_replace(col, rf"[{CJK}]+", ""))


def tokenize(col: Column) -> Column:
    """Lower-case tokens: each CJK character, each run of Latin letters, each digit run."""
    return F.regexp_extract_all(F.lower(col), F.lit(rf"[{CJK}]|[a-z]+|[0-9]+"), F.lit(0))


def memory_tokens(col: Column) -> Column:
    """Token set of the memory search: CJK characters and alphanumeric runs of two or more."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(col), F.lit(rf"[{CJK}]|[a-z0-9]{{2,}}"), F.lit(0))
    )


def unify_breaks(col: Column) -> Column:
    """Drop NUL, non-breaking space to space, every line end to a line feed."""
    col = F.coalesce(col, F.lit(""))
    for old, new in (("\u00a0", " "), ("\x00", ""), ("\r\n", "\n"), ("\r", "\n")):
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def normalize_blanks(col: Column) -> Column:
    """Collapse blanks and trim; single spaces are no match and cost no copy."""
    return F.trim(F.regexp_replace(col, r"\t[\t ]*| [\t ]+", " "))


def normalize_line(col: Column) -> Column:
    """Collapse blanks, trim, close gaps the extraction left between CJK characters."""
    col = normalize_blanks(col)
    col = F.regexp_replace(col, rf"([{CJK}]) +(?=[{CJK}])", "$1")
    col = F.regexp_replace(col, rf"([{CJK}]) +(?=[、，。；：！？])", "$1")
    return F.regexp_replace(col, rf"([（《]) +(?=[{CJK}])", "$1")


def map_lines(text: Column, build: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """``build(line, normalize)`` for every line of a text; gaps between CJK characters are looked for only in texts that have some."""
    lines = F.split(unify_breaks(text), "\n")
    plain = F.transform(lines, lambda x: build(x, normalize_blanks))
    return F.when(text.rlike(f"[{CJK}]"), F.transform(lines, lambda x: build(x, normalize_line))).otherwise(plain)


def normalize_text(col: Column) -> Column:
    """``normalize_line`` on every line, outer blank lines removed."""
    return strip(F.array_join(map_lines(col, lambda x, normalize: normalize(x)), "\n"))


def lines_of(col: Column) -> Column:
    """Array of the non-empty normalised lines."""
    return F.filter(F.split(normalize_text(col), "\n"), lambda x: x != "")


def preview(col: Column, limit: int, mark: str = "…") -> Column:
    """Cut to ``limit`` characters, the last being the mark when something was lost."""
    return F.when(F.length(col) <= limit, col).otherwise(
        F.concat(F.substring(col, 1, limit - 1), F.lit(mark))
    )


def extract_numbers(col: Column) -> Column:
    """All decimal numbers of a text as doubles, thousands commas dropped."""
    found = F.regexp_extract_all(F.replace(col, F.lit(","), F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.transform(found, lambda x: x.cast("double"))


def first_number(col: Column) -> Column:
    return F.try_element_at(extract_numbers(col), F.lit(1))


def estimate_tokens(col: Column) -> Column:
    """CJK characters count 2, others 0.3, truncated."""
    cjk = count_cjk(col)
    return (cjk * 2 + (F.length(col) - cjk) * F.lit(0.3)).cast("long")


def logged_tokens(col: Column) -> Column:
    """Log rule: a quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(col) / 4)).cast("long")


def token_overlap(query: Column, content: Column) -> Column:
    """Share of the query's distinct tokens found in the content; the default rerank scorer."""
    wanted = F.array_distinct(tokenize(query))
    hit = F.size(F.array_intersect(wanted, tokenize(content)))
    return F.when(F.size(wanted) > 0, hit / F.size(wanted)).otherwise(F.lit(0.0))


def fixed(col: Column, digits: int) -> Column:
    """Fixed decimals as C and Python print them: half-even on the exact binary value."""
    return F.call_function("format_number", col.cast("double"), F.lit("0." + "0" * digits if digits else "0"))
