"""License scan: fingerprints of the templates pick candidates, banded alignment reports coverage and spans.

The index maps fingerprints of the templates (a bounded table that goes to every task) to template and place. All word windows of a
text are looked up in one vector operation; hits close to one diagonal are one candidate, which is aligned within a band around
its diagonals. Texts stay where they are: one pass over the documents without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import rolling, rows, slices, word_hashes
from corpusmill.llm.license_texts import TEMPLATES

#: Words of a fingerprint, at most.
SHINGLE = 3

_DROPPED = b".,;:!?()[]{}\"'<>*#/"
#: Case and punctuation don't count; places in the text stay the same.
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _DROPPED, bytes(range(97, 123)) + b" " * len(_DROPPED))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_words(n: int, least: float) -> int:
    """Words of a fingerprint so short that one stays whole in every match of at least ``least`` of ``n`` words with one word put in."""
    changed = n - math.ceil(least * n - 1e-9)
    return next((k for k in range(SHINGLE, 1, -1) if n - (k - 1) - k * changed - (k - 1) >= 1), 1)


class Index:
    """Inverted index of all the templates' fingerprints, by their number of words."""

    def __init__(self, templates: Mapping[str, str], least: float = 0.8):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for t, name in enumerate(self.names):
            words = word_hashes([templates[name].encode().translate(_PLAIN)])[0]
            self.words.append(words)
            if len(words):
                h = rolling(words, k := shingle_words(len(words), least))
                found.setdefault(k, []).append((h, np.full(len(h), t), np.arange(len(h))))
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for k, parts in sorted(found.items()):
            value, owner, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(value, kind="stable")
            self.tables[k] = value[order], owner[order], place[order]

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, place in it, place in the text) of every shared fingerprint."""
        for k, (value, owner, place) in self.tables.items():
            h = rolling(words, k)
            low, high = np.searchsorted(value, h, "left"), np.searchsorted(value, h, "right")
            for p in np.flatnonzero(high > low).tolist():
                for x in range(int(low[p]), int(high[p])):
                    yield int(owner[x]), int(place[x]), p


def align(template: list[int], text: list[int], first: int, last: int, band: int) -> tuple[int, int, int]:
    """(matched words, first word, end word) of the best alignment of a template within a band of diagonals.

    Diagonals first - band to last + band are allowed; most matches count, then the shortest span, then the earliest.
    """
    low, width = first - band, last - first + 2 * band + 1
    none = (0, 0, 0)
    row = [none] * (width + 1)
    for i, w in enumerate(template):
        new = [none] * (width + 1)
        for d in range(width):
            j = i + low + d
            best = max(row[d + 1], new[d - 1] if d else none)
            if 0 <= j < len(text) and text[j] == w:
                m, start, _ = row[d]
                best = max(best, (m + 1, start if m else -j, -j - 1))
            new[d] = best
        row = new
    matched, start, end = max(row)
    return matched, -start, -end


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, matched_words, coverage, start_word, end_word, start_char, end_char of every notice found.

    Needs doc_id and text; other columns are ignored. Coverage is the share of the template's words that are matched in order; candidates below
    ``least`` are left out. Spans are half open; words are those that remain when case and punctuation are dropped, characters are those
    of the text. Null and empty texts have no notices; repeated rows report each.
    """
    index = Index(templates, least)
    fields = [("doc_id", pa.int64()), ("license", pa.string()), ("matched_words", pa.int64()), ("coverage", pa.float64())]
    fields += [(c, pa.int64()) for c in ("start_word", "end_word", "start_char", "end_char")]
    schema = pa.schema(fields)

    def candidates(found: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, lowest and highest diagonal) of hits that lie within a band of each other."""
        seen: dict[int, set[int]] = {}
        for t, q, p in index.hits(found):
            seen.setdefault(t, set()).add(p - q)
        for t, diagonals in sorted(seen.items()):
            band, run = _band(index.words[t]), []
            for d in sorted(diagonals):
                if run and (d - run[-1] > band or d - run[0] > len(index.words[t])):
                    yield t, run[0], run[-1]
                    run = []
                run.append(d)
            yield t, run[0], run[-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, texts in slices(batch):
                plain = [t.translate(_PLAIN) for t in texts]
                hashes, begin = word_hashes(plain)
                some = np.concatenate([np.flatnonzero(np.isin(rolling(hashes, k), v[0])) for k, v in index.tables.items()] or [np.empty(0, np.int64)])
                out = []
                for i in np.unique(np.searchsorted(begin, some, "right") - 1).tolist():
                    a, b = int(begin[i]), int(begin[i + 1])
                    words, spans = hashes[a:b].tolist(), None
                    for t, first, last in candidates(hashes[a:b]):
                        template = index.words[t].tolist()
                        if first == last and first >= 0 and words[first : first + len(template)] == template:
                            matched, start, end = len(template), first, first + len(template)
                        else:
                            band = _band(index.words[t])
                            part = Counter(words[max(0, first - band) : max(0, last + band + len(template))])
                            if (part & Counter(template)).total() < least * len(template):
                                continue  # no alignment matches more words than both have
                            matched, start, end = align(template, words, first, last, band)
                        if matched < least * len(template):
                            continue
                        spans = spans or [m.span() for m in _WORD.finditer(plain[i])]
                        chars = [len(texts[i][:x].decode("utf-8", "ignore")) for x in (spans[start][0], spans[end - 1][1])]
                        out.append((ids[low + i], index.names[t], matched, matched / len(template), start, end, *chars))
                if out:
                    yield rows(schema, zip(*out))

    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    spec = "doc_id long, license string, matched_words long, coverage double, start_word long, end_word long, start_char long, end_char long"
    return texts.mapInArrow(scan, spec)


def _band(words: np.ndarray) -> int:
    return max(1, len(words) // 10)
