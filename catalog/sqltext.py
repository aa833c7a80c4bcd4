"""SQL fragments shared by the oracle statements."""

from corpusmill.functions import patterns as P


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


def breaks(x: str) -> str:
    return rf"regexp_replace(replace({x}, chr(160), ' '), '\r\n|\r', chr(10), 'g')"


def normalize(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({breaks(x)}, '[\t ]+', ' ', 'g'), '(?m)^ +| +$', '', 'g')")


def lines(x: str) -> str:
    return f"list_filter(string_split({normalize(x)}, chr(10)), lambda x: x != '')"


def occurrences(x: str, char: str) -> str:
    return f"(length({x}) - length(replace({x}, '{char}', '')))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\x{{4e00}}-\x{{9fff}}]|[a-z]+|[0-9]+')"


def colon_end(x: str) -> str:
    return f"(ends_with({x}, ':') or ends_with({x}, '：'))"


def is_table(x: str) -> str:
    return f"({occurrences(x, '|')} >= 2 or {occurrences(x, ',')} >= 3)"


def rx(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def is_heading(x: str, nxt: str) -> str:
    return f"""(not {rx(x, P.DATE_RANGE)} and length({x}) <= 90 and not {rx(x, P.BULLET)} and (
        {rx(x, P.NUMBERED_HEADING)} or {rx(x, P.CHAPTER_HEADING)}
        or (length({x}) <= 48 and {colon_end(x)})
        or (length({x}) <= 28 and {rx(x, P.HEADING_WORD)})
        or (coalesce({rx(nxt, P.DATE_RANGE)}, false) and length({x}) <= 70)))"""


def heading_level(x: str, nxt: str) -> str:
    number = rf"regexp_replace(string_split({x}, ' ')[1], '^[.、]+|[.、]+$', '', 'g')"
    return f"""(case when {rx(x, P.NUMBERED_HEADING)} then least(4, {occurrences(number, '.')} + 1)
        when {rx(x, P.CHAPTER_HEADING)} then 1
        when coalesce({rx(nxt, P.DATE_RANGE)}, false) then 2
        when length({x}) <= 28 and {rx(x, P.HEADING_WORD)} then 1 else 2 end)"""


def any_rule(x: str, patterns: tuple[str, ...]) -> str:
    joined = ("(?i)(" + ")|(".join(patterns) + ")").replace("'", "''")
    return f"regexp_matches({x}, '{joined}')"
