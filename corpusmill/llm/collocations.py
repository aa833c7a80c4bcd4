"""Phrases of words that keep together, counted over one FM-index per shard.

A shard holds texts of one language, bounded in bytes. Its words become numbers, pieces are parted by zeros, and two indexes are kept: rows
of all suffixes in the order of their first words, and the same for the reversed shard. The transform of a row is the word before it. A
phrase is an interval of rows in both indexes; all intervals of one length are extended together, to the right over the transform of the
reversed index and to the left over that of the forward one. As the depth is limited, rows are ordered by one word less than that only.

Counts are summed over shards twice. The first pass sends short hashes of all phrases, as blobs of a shard's hashes for one range of them;
those that reach the least count set bits in a filter of fixed size. The second pass counts the phrases in the filter, now with their words, and does not extend others. As the filter never
misses a frequent phrase, counts are exact however full it gets; a fuller one lets more rare phrases through to the second sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.session import cut_lineage
from corpusmill.functions.skew import each
from corpusmill.llm.common import mix, pack_gaps, rows, signed, unpack_gaps, word_spans

#: Bytes of text in a shard, but for single longer texts; about a million words.
SHARD_BYTES = 6_000_000
#: Bits of the filter that the first pass builds: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
#: Bits of the hashes that the first pass sends; equal ones of different phrases only let both pass.
SENT_BITS = 40
#: Tasks among which the phrases with the same first or last word are dealt.
SALTS = 8

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[ord(c) for c in ".,;:!?"]] = 10
_CLEAN[10:14] = 10
_CLEAN[9] = 32
_CLEAN = _CLEAN.tobytes()

_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_HASHES = pa.schema([("part", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])
_GRAMS = pa.schema([("lang", pa.string()), ("w1", pa.int64()), ("w2", pa.int64()), ("w3", pa.int64()), ("c", pa.int64()), ("word", pa.binary())])


class Intervals(NamedTuple):
    """Phrases of one length as rows [low, low + count) of the forward and [back, back + count) of the reversed index."""

    words: np.ndarray  # one row of word numbers for each phrase
    low: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def take(self, at: np.ndarray) -> Intervals:
        return Intervals(*[x[at] for x in self])


class Index:
    """Suffix rows, in the order of their first ``depth`` words, with the word before each of them."""

    def __init__(self, text: np.ndarray, depth: int, starts: np.ndarray):
        n, key = len(text), text
        padded = np.concatenate((text, np.zeros(depth, text.dtype)))
        bits = int(text.max(initial=0)).bit_length()
        for k in range(1, depth):
            if int(key.max(initial=0)).bit_length() + bits > 63:
                key = np.unique(key, return_inverse=True)[1]
            key = (key << bits) | padded[k : k + n]
        row = np.argsort(key)
        self.before = text[row - 1]
        self.starts, self.occurrences = starts, None

    def rank(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many rows before ``row`` have ``word`` before them."""
        if self.occurrences is None:
            self.occurrences = np.sort(self.before * (len(self.before) + 1) + np.arange(len(self.before)))
        return np.searchsorted(self.occurrences, word * (len(self.before) + 1) + row) - self.starts[word]

    def extensions(self, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, word, count, rows of the interval with smaller words) of every word before the rows of each interval."""
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        width = np.int64(len(self.starts))
        key = np.repeat(np.arange(len(low)), count) * width + self.before[np.repeat(low, count) + inside]
        found, times = np.unique(key, return_counts=True)
        owner, word = found // width, found % width
        smaller = np.cumsum(times) - times - (np.cumsum(count) - count)[owner]
        real = word > 0
        return owner[real], word[real], times[real], smaller[real]


class BidirectionalIndex:
    """Forward and reversed index of a text of word numbers, a zero at both ends; phrases of ``depth`` words can be extended."""

    def __init__(self, text: np.ndarray, words: int, depth: int):
        self.text, self.depth = text, depth
        self.totals = np.bincount(text, minlength=words + 1)
        self.starts = np.cumsum(self.totals) - self.totals
        self._forward = self._reversed = None

    @property
    def forward(self) -> Index:
        if self._forward is None:
            self._forward = Index(self.text, self.depth, self.starts)
        return self._forward

    @property
    def reversed(self) -> Index:
        if self._reversed is None:
            self._reversed = Index(self.text[::-1], self.depth, self.starts)
        return self._reversed

    def single(self) -> Intervals:
        words = np.flatnonzero(self.totals[1:]) + 1
        return Intervals(words[:, None], self.starts[words], self.starts[words], self.totals[words])

    def right(self, x: Intervals, last: bool = False) -> Intervals:
        """All phrases one word longer at the end; ``last``: they are not extended again, so that one index may leave their rows out."""
        owner, word, count, smaller = self.reversed.extensions(x.back, x.count)
        back = np.full(len(word), -1) if last else self.starts[word] + self.reversed.rank(word, x.back[owner])
        return Intervals(np.hstack((x.words[owner], word[:, None])), x.low[owner] + smaller, back, count)

    def left(self, x: Intervals, last: bool = False) -> Intervals:
        """All phrases one word longer at the front."""
        owner, word, count, smaller = self.forward.extensions(x.low, x.count)
        low = np.full(len(word), -1) if last else self.starts[word] + self.forward.rank(word, x.low[owner])
        return Intervals(np.hstack((word[:, None], x.words[owner])), low, x.back[owner] + smaller, count)


class Shard:
    """Words of some texts of one language: their hashes, numbers from 1 in the order of the hashes, and the parted text."""

    def __init__(self, lang: str, joined: bytes):
        buf = np.frombuffer(joined, np.uint8)
        starts, self.lens, hashes = word_spans(buf)
        self.lang, self.joined, self.begins, self.size = lang, joined, starts, len(starts)
        self.hashes, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        self.first = first
        # Zeros part the pieces and stand at both ends, so that the rows of either direction are all rotations.
        gap = np.cumsum(np.diff(np.cumsum(buf == 10)[starts], prepend=0) > 0) if len(starts) else starts
        self.text = np.zeros(len(starts) + (int(gap[-1]) if len(starts) else 0) + 2, np.int64)
        self.text[np.arange(len(starts)) + gap + 1] = number + 1
        with np.errstate(over="ignore"):
            seed = np.uint64(int.from_bytes(lang.encode()[:8].ljust(8, b"\0"), "little")) + np.uint64(len(lang.encode()))
            for k in range(8, len(lang.encode()), 8):
                seed = mix(np.array([seed], np.uint64))[0] + np.uint64(int.from_bytes(lang.encode()[k : k + 8].ljust(8, b"\0"), "little"))
            self.seed = mix(np.array([seed], np.uint64))[0]

    def index(self, depth: int) -> BidirectionalIndex:
        return BidirectionalIndex(self.text, len(self.hashes), depth)

    def names(self, words: np.ndarray) -> np.ndarray:
        """A 64-bit name of each phrase in this language."""
        with np.errstate(over="ignore"):
            return mix((self.hashes[words - 1] * _STEPS[: words.shape[1]]).sum(axis=1, dtype=np.uint64) + self.seed)

    def only(self, frequent: np.ndarray) -> None:
        """Words that are not ``frequent`` part the text from now on."""
        self.text = np.where(frequent[self.text - 1] & (self.text > 0), self.text, 0)
        self.text = self.text[(self.text > 0) | np.concatenate(([True], self.text[:-1] > 0))]


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    """Shards of a task's texts; the language with most bytes goes first when the held ones reach ``limit``."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def out(lang: str) -> Shard:
        size.pop(lang)
        return Shard(lang, b"\n".join(held.pop(lang)))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            clean = (text.as_py() or b"").translate(_CLEAN)
            held.setdefault(lang, []).append(clean)
            size[lang] = size.get(lang, 0) + len(clean) + 64
            if sum(size.values()) > limit:
                yield out(max(size, key=size.get))
    for lang in list(held):
        yield out(lang)


def _filter(docs: DataFrame, least: int) -> Broadcast:
    """Bits at the hashes of all phrases that reach ``least``; collected by blocks of 4 KB, ``FILTER_BITS`` in all."""
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * count
    width = np.uint8 if least < 256 else np.uint32

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, SHARD_BYTES):
            if not shard.size:
                continue
            index = shard.index(2)
            one = index.single()
            two = index.right(one)
            levels = (one, two, index.left(two, last=True))
            name = np.concatenate([_short(shard.names(x.words)) for x in levels])
            times = np.concatenate([x.count for x in levels])
            part, name = name % parts, name // parts
            order = np.lexsort((name, part))
            name, times = name[order], np.minimum(times[order], least).astype(width)
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            held = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
            yield rows(_HASHES, (held, [pack_gaps(name[cuts[p] : cuts[p + 1]]) for p in held], [times[cuts[p] : cuts[p + 1]].tobytes() for p in held]))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for p, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "names", "counts")), strict=True):
                blobs.setdefault(p, []).append(x)
        for p in list(blobs):
            names, times = zip(*blobs.pop(p), strict=True)
            name = np.concatenate([unpack_gaps(x) for x in names])
            order = np.argsort(name)
            name = name[order]
            first = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
            total = np.add.reduceat(np.frombuffer(b"".join(times), width)[order], first, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name[first[total >= least]] * parts + p)], ["name"])

    sent = docs.mapInArrow(send, "part int, names binary, counts binary").repartition(count, "part")
    bit = F.pmod(F.col("name"), F.lit(FILTER_BITS)) + 1
    blocks = sent.mapInArrow(frequent, "name long").select(F.bitmap_bucket_number(bit).alias("block"), F.bitmap_bit_position(bit).alias("bit"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for block, found in blocks.groupBy("block").agg(F.bitmap_construct_agg("bit")).collect():
        bits[(block - 1) * 4096 : block * 4096] = np.frombuffer(found, np.uint8)
    return spark.sparkContext.broadcast(bits)


def _short(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(64 - SENT_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = _short(names) % FILTER_BITS
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, w1, w2, w3, c, word: counts by shard of words, pairs (w3 null) and triples that may reach ``least`` in all.

    Words come with their bytes; rows without w1 hold the number of all words. ``docs`` has lang, not null, and text as bytes.
    """
    bits = _filter(docs, least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, SHARD_BYTES):
            yield rows(_GRAMS, ([shard.lang], [None], [None], [None], [shard.size], [None]))
            if not shard.size:
                continue
            everything = np.arange(1, len(shard.hashes) + 1)[:, None]
            known = _passes(bits.value, shard.names(everything))
            shard.only(known)
            index = shard.index(2)
            one = index.single()
            at = shard.first[one.words[:, 0] - 1]
            spelled = [shard.joined[a : a + n] for a, n in zip(shard.begins[at].tolist(), shard.lens[at].tolist(), strict=True)]
            yield _named(shard, one, spelled)
            two = index.right(one)
            two = two.take(_passes(bits.value, shard.names(two.words)))
            yield _named(shard, two)
            three = index.left(two, last=True)
            yield _named(shard, three.take(_passes(bits.value, shard.names(three.words))))

    return docs.mapInArrow(count, "lang string, w1 long, w2 long, w3 long, c long, word binary")


def _named(shard: Shard, x: Intervals, words: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(x.count)
    named = [pa.array(signed(shard.hashes[x.words[:, k] - 1])) if k < x.words.shape[1] else pa.nulls(n, pa.int64()) for k in range(3)]
    arrays = [pa.repeat(pa.scalar(shard.lang), n), *named, pa.array(x.count, pa.int64()), pa.array(words or [None] * n, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, schema=_GRAMS)


def _cuts(grams: DataFrame) -> DataFrame:
    """Every way to cut a phrase in two: lang, w1 to w3, a, k, and both parts (one or two words)."""
    end = F.lit(None).cast("long")

    def cut(k: int, left: tuple, right: tuple) -> Column:
        return F.struct(F.lit(k).alias("k"), *[c.alias(n) for n, c in zip(("l1", "l2", "r1", "r2"), (*left, *right), strict=True)])

    w1, w2, w3 = (F.col(f"w{i}") for i in (1, 2, 3))
    two = F.array(cut(1, (w1, end), (w2, end)))
    three = F.array(cut(1, (w1, end), (w2, w3)), cut(2, (w1, w2), (w3, end)))
    return grams.filter("w2 is not null").select("lang", "w1", "w2", "w3", "a", F.explode(F.when(w3.isNull(), two).otherwise(three)).alias("x")).select(
        "lang", "w1", "w2", "w3", "a", "x.*"
    )


def collocations(docs: DataFrame, least: int = 10, best: int = 2000, keep_percent: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of two or three words.

    Texts are lower-cased in A-Z and cut at ``.,;:!?`` and line ends; words lie between spaces and tabs. a, l and r count a phrase and the
    two parts of its lowest-scoring cut, n all words of the language; the score is floor(1,000,000 a a / (l r)), exact in decimals. Phrases
    with at least ``least`` occurrences count, but for pairs inside a triple that has ``keep_percent`` of their occurrences. Order: score and a
    descending, phrase by its bytes. A null lang counts as ``und``; null and empty texts have no words; ids, repeats and other columns do not
    matter; an empty table gives no rows. Words are told apart by 64-bit hashes. A text is indexed whole in one task.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    texts = docs.select(lang, F.col("text").cast("string").cast("binary").alias("text"))
    found = cut_lineage(phrase_counts(texts, least))
    grams = cut_lineage(
        found.filter("w1 is not null").groupBy("lang", "w1", "w2", "w3").agg(F.sum("c").alias("a")).filter(F.col("a") >= least)
    )
    words = found.filter("word is not null").groupBy("lang", "w1").agg(F.first("word").cast("string").alias("word"))
    sizes = found.filter("w1 is null").groupBy("lang").agg(F.sum("c").alias("n"))

    # A common word starts or ends many phrases: these are dealt among tasks, its count is sent to each of them.
    parts = grams.filter("w3 is null").withColumn("salt", each(SALTS))
    cuts = _cuts(grams).withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)).cast("long"))
    for side in ("l", "r"):
        part = parts.select(F.col("lang").alias("pl"), F.col("w1").alias("p1"), F.col("w2").alias("p2"), F.col("salt").alias("ps"), F.col("a").alias(side))
        same = (F.col("lang") == F.col("pl")) & (F.col(f"{side}1") == F.col("p1")) & F.col(f"{side}2").eqNullSafe(F.col("p2")) & (F.col("salt") == F.col("ps"))
        cuts = cuts.join(part, same).drop("pl", "p1", "p2", "ps")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.expr("(wide_a * wide_a) * 1000000 div (wide_l * wide_r)")
    scored = cuts.select("*", *[v.alias(f"wide_{c}") for c, v in wide.items()]).withColumn("score", score)
    lowest = scored.groupBy("lang", "w1", "w2", "w3", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    pair = F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"))))
    inside = grams.filter("w3 is not null").select("lang", "a", pair.alias("x")).groupBy("lang", "x.w1", "x.w2").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, (lowest.lang == inside.lang) & (lowest.w1 == inside.w1) & (lowest.w2 == inside.w2) & lowest.w3.isNull(), "left").filter(
        F.col("longer").isNull() | (100 * F.col("longer") < keep_percent * F.col("a"))
    ).select(lowest.lang, lowest.w1, lowest.w2, "w3", "a", "x.*")

    # Ties stay until the words are known; the filter on the rank cuts every partition before the shuffle.
    order = [F.desc("score"), F.desc("a")]
    first = kept.withColumn("salt", F.pmod(F.xxhash64("w1", "w2", "w3"), F.lit(SALTS)))
    for group in (("lang", "salt"), ("lang",)):
        first = first.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("place") <= best)
    first = first.drop("place", "salt")
    for i in (1, 2, 3):
        first = first.join(words.select("lang", F.col("w1").alias(f"w{i}"), F.col("word").alias(f"t{i}")), ["lang", f"w{i}"], "inner" if i < 3 else "left")
    named = first.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    ranked = named.withColumn("rank", place.cast("long")).filter(F.col("rank") <= best)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
