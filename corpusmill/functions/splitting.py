"""Recursive character splitting, the one text rule that needs Python: it runs on Arrow batches,
takes only the long texts, and no row depends on another."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Separators in order of priority, general and fixed-size variants.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
FIXED_SEPARATORS = ("\n\n", "\n", "。", ".", "，", ",", " ", "")
MARKDOWN_SEPARATORS = ("\n\n", "\n", "。", ".", " ", "")
#: Texts of a batch that are Python strings, with their chunks, at once.
SLICE = 64


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that start with the separator they were cut at."""
    if separator == "":
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in (head, *(separator + t for t in tail)) if p]


def _pack(pieces: Sequence[str], size: int, overlap: int) -> Iterator[str]:
    """Join pieces up to ``size``; the next chunk starts with up to ``overlap`` of the last."""
    window: deque[str] = deque()
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.popleft())
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Cut at the first separator that occurs, pack what fits, cut what does not further."""

    def run(part: str, level: int) -> Iterator[str]:
        while level < len(separators) - 1 and separators[level] not in part:
            level += 1
        fitting: list[str] = []
        for piece in _cut(part, separators[level]):
            if len(piece) < size:
                fitting.append(piece)
                continue
            yield from _pack(fitting, size, overlap)
            fitting = []
            if level + 1 < len(separators):
                yield from run(piece, level + 1)
            else:
                yield piece
        yield from _pack(fitting, size, overlap)

    return [c for c in (chunk.strip() for chunk in run(text, 0)) if c]


def _line_kind(line: str) -> str:
    if line.startswith("|") and line.rstrip().endswith("|") and len(line.rstrip()) > 2:
        return "table"
    if re.match(r"[-*][ \t]+\S", line) or re.match(r"[0-9]+\.[ \t]+\S", line):
        return "list"
    return ""


def block_spans(text: str) -> list[tuple[str, str]]:
    """The text as (kind, lines) runs: code fences, tables, lists, and free text as "". A fence that never closes is free text."""
    lines, out, at = text.splitlines(keepends=True), [], 0
    while at < len(lines):
        kind, end = _line_kind(lines[at]), at + 1
        if lines[at].lstrip().startswith("```"):
            close = next((i for i in range(at + 1, len(lines)) if lines[i].lstrip().startswith("```")), None)
            kind, end = ("code", close + 1) if close is not None else ("", end)
        elif kind:
            while end < len(lines) and _line_kind(lines[end]) == kind:
                end += 1
        run = "".join(lines[at:end])
        if out and not kind and not out[-1][0]:
            out[-1] = ("", out[-1][1] + run)
        else:
            out.append((kind, run))
        at = end
    return out


def split_protected(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks that never cut a code fence, a table or a list: only the free text between them is split. A block
    joins the chunk before it, or free text the block before it, while both fit the size by their real lengths."""
    chunks: list[str] = []
    joins = False
    for kind, run in block_spans(text):
        for i, part in enumerate([run.strip("\n")] if kind else split_text(run, size, overlap, separators)):
            if chunks and (kind or (joins and i == 0)) and len(chunks[-1]) + 1 + len(part) <= size:
                chunks[-1] += "\n" + part
            elif part.strip():
                chunks.append(part)
        joins = bool(kind)
    return chunks


def _in_slices(split: Callable[[str, int, int], list[str]], texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
    """Chunks of a batch of texts; only ``SLICE`` of them at a time are Python objects."""
    kind = pa.list_(pa.string())
    parts = [pa.array([], kind)]
    for low in range(0, len(texts), SLICE):
        rows = zip(*(column.slice(low, SLICE).to_pylist() for column in (texts, sizes, overlaps)))
        parts.append(pa.array([None if t is None else split(t, s, o) for t, s, o in rows], kind))
    return pa.concat_arrays(parts)


def chunks_column(
    text: Column, size: Column | int, overlap: Column | int, separators: Sequence[str] = SEPARATORS, protected: bool = False
) -> Column:
    """Array of chunks. Texts that fit are trimmed in the JVM; only longer ones reach Python."""
    split = split_protected if protected else split_text
    seps = tuple(separators)

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array, sizes: pa.Array, overlaps: pa.Array) -> pa.Array:
        return _in_slices(lambda t, s, o: split(t, s, o, seps), texts, sizes, overlaps)

    size = F.lit(size) if isinstance(size, int) else size
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    long = F.when(F.length(text) > size, text)
    whole = T.strip(text)
    short = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return F.coalesce(cut(long, size, overlap), F.coalesce(short, F.array().cast("array<string>")))
