"""Runs of periodic words, found as maximal pairs of positions in each text.

A run of period p and length L is a pair of positions at distance p whose words agree for L - p words, no further, and whose left
neighbours differ. Only agreements of ``seed`` words or more can belong to a run that is long enough, so the interval tree of common
prefixes is taken from that depth on: its topmost intervals are the groups of equal seeds of one text. A group whose positions all have
the same left word holds no maximal pair and goes at once. The others are put into suffix order by prefix doubling, which also gives
their common prefixes, and the intervals are joined bottom-up. Every interval keeps its positions and, while it is one, their common
left word; the smaller of two joined sets looks up its partners in the larger one, within the distance that the length allows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import mix, rolling, slices, word_hashes

RUN = "struct<start: long, length: long, period: long>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

#: Words from those of a text, for callers that look for runs in changed texts.
Prepare = Callable[[object, list[bytes]], list[bytes]]


def seed_words(least: int, times: int) -> int:
    """Words that agree at the distance of the period in every run of at least ``least`` words and ``times`` periods."""
    return min(max(least - p, (times - 1) * p) for p in range(1, least + 1))


def _seeds(words: np.ndarray, begin: np.ndarray, seed: int) -> np.ndarray:
    """Positions whose seed comes again in their text, in groups with two left words at least."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    fits = np.flatnonzero(np.arange(len(words)) + seed <= begin[1:][text])
    if not len(fits):
        return fits
    with np.errstate(over="ignore"):
        left = np.concatenate((words[:1], words[:-1])) | np.uint64(1)
        left[begin[:-1][np.diff(begin) > 0]] = 0  # no word; an own class
        key = mix(rolling(words, seed)[fits] ^ mix(text[fits].astype(np.uint64)))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    left = left[fits[order]]
    mixed = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    return np.sort(fits[order][np.repeat(mixed, np.diff(np.append(first, len(key))))])


def _ranks(words: np.ndarray, at: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words from each position, until those at ``at`` are told apart in each text.

    ``words`` are numbers with a 0 behind every text. A rank is the place of a stretch among all sorted ones; only stretches that
    are not yet alone are sorted again.
    """
    order = np.argsort(words, kind="stable")
    n = len(words)
    rank, active = _renamed(np.zeros(n, np.int64), order, words[order], n)
    levels, step = [rank], 1
    while True:
        here = rank[at] * (text.max() + 1) + text
        if len(np.unique(here)) == len(at):
            return levels
        ahead = active + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        first = rank[active]
        by = np.lexsort((second, first))
        rank, active = _renamed(rank, active[by], first[by] * (n + 1) + second[by], n, first[by])
        levels.append(rank)
        step *= 2


def _renamed(rank: np.ndarray, order: np.ndarray, key: np.ndarray, n: int, bucket: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after sorting ``order`` by ``key``, and the positions that share theirs; ``bucket``: the ranks before."""
    new = np.concatenate(([True], key[1:] != key[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(key)))
    if bucket is None:
        head = first
    else:
        opens = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        head = bucket[first] + first - opens[np.searchsorted(opens, first, "right") - 1]
    out = rank.copy()
    out[order] = np.repeat(head, size)
    return out, order[np.repeat(size > 1, size)]


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the stretches from a and from b of the same text share; the two differ."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        out += np.where(levels[k][a + out] == levels[k][b + out], 1 << k, 0)
    return out


def _joined(large: list[int], small: list[int]) -> list[int]:
    if 8 * len(small) < len(large):
        for i in small:
            insort(large, i)
        return large
    return sorted(large + small)


def _pairs(at: list[int], shared: list[int], left: np.ndarray, seed: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(first position, distance, common words) of the maximal pairs whose distance the common words allow.

    ``at`` are positions in suffix order, ``shared`` the common words with the next one. Of the positions within a third or less
    of the common words all but the first have the same left word (they lie in one run), so that only the first one before and
    the next ones behind can be partners.
    """
    todo: list[tuple[int, list[int], object]] = []
    for here, after in zip(at, shared, strict=True):
        own, kind = [here], left[here]
        while todo and todo[-1][0] >= after:
            common, other, other_kind = todo.pop()
            if common < seed:
                own, kind = [], None
                continue
            if not other:
                continue
            small, large = (other, own) if len(other) < len(own) else (own, other)
            if kind is None or kind != other_kind:
                reach = common // (times - 1)
                for i in small:
                    k = bisect_left(large, i - reach)
                    if k < len(large) and (j := large[k]) < i and left[i] != left[j] and i - j + common >= least:
                        yield j, i - j, common
                    k = bisect_right(large, i)
                    while k < len(large) and (j := large[k]) <= i + reach and left[i] != left[j]:
                        if j - i + common >= least:
                            yield i, j - i, common
                        k += 1
                kind = None
            own = _joined(large, small)
        todo.append((after, own, kind))


def find_runs(words: np.ndarray, begin: np.ndarray, least: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period.

    ``words`` are hashes of all words of the texts, ``begin`` the first word of each (n + 1 offsets).
    """
    seed, out = seed_words(least, times), [[] for _ in begin[1:]]
    at = _seeds(words, begin, seed)
    if not len(at):
        return out
    # Only texts that hold such positions are ranked; a 0 ends each of them.
    text = np.searchsorted(begin, at, "right") - 1
    chosen, text = np.unique(text, return_inverse=True)
    size = begin[chosen + 1] - begin[chosen]
    opens = np.concatenate(([0], np.cumsum(size + 1)))
    inside = np.arange(opens[-1]) - np.repeat(opens[:-1], size + 1)
    ends = inside == np.repeat(size, size + 1)
    held = np.zeros(opens[-1], np.int64)
    held[~ends] = np.unique(words[(np.repeat(begin[chosen], size + 1) + inside)[~ends]], return_inverse=True)[1] + 1
    left = np.concatenate(([0], held[:-1]))
    at = opens[text] + at - begin[chosen[text]]
    levels = _ranks(held, at, text)
    order = np.lexsort((levels[-1][at], text))
    at, text = at[order], text[order]
    shared = np.zeros(len(at), np.int64)
    same = np.flatnonzero(text[1:] == text[:-1])
    shared[same] = _common(levels, at[same], at[same + 1])
    found: dict[tuple[int, int], int] = {}
    for i, p, common in _pairs(at.tolist(), shared.tolist(), left, seed, least, times):
        key = (i, p + common)
        found[key] = min(p, found.get(key, p))
    for (i, length), p in sorted(found.items()):
        k = int(np.searchsorted(opens, i, "right")) - 1
        out[chosen[k]].append((i - int(opens[k]), length, p))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def without_runs(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, prepare: Prepare | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed (the text with each run's first period only).

    A run is a stretch of words with smallest period q, of at least ``least`` words and ``times`` (3 or more) periods, that no neighbour
    extends. Words are runs of other characters than white space, numbered from 0; kept ones are joined by one space. ``prepare``
    may change the words of a text first. One row per input row: null and empty texts have no runs and collapse to an empty text, a null
    doc_id is kept, ids may come more than once; other columns are ignored. A text is handled in one task, in memory that grows with its words.
    Words are told apart by 64-bit hashes.
    """
    if times < 3:
        raise ValueError("times must be 3 at least")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for low, high, texts in slices(batch):
                words = [t.split() for t in texts]
                if prepare:
                    words = [prepare(i, w) for i, w in zip(ids.slice(low, high - low).to_pylist(), words, strict=True)]
                hashes, begin = word_hashes([b" ".join(w) for w in words])
                runs = find_runs(hashes, begin, least, times)
                kept = [b" ".join(without_runs(w, r)) for w, r in zip(words, runs, strict=True)]
                named = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), pa.array(named, pa.list_(_RUN)), pa.array(kept, pa.binary())], ["doc_id", "runs", "collapsed"]
                )

    found = table.mapInArrow(scan, f"doc_id long, runs array<{RUN}>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the run with the greatest length over period, and digests of all runs and the collapsed text."""
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda acc, r: F.when(r["length"] * acc["period"] > acc["length"] * r["period"], r).otherwise(acc),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.concat_ws("\n", lines), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
