"""Removal of word runs that occur earlier in the corpus, found over fixed-block anchors.

Every document is cut into reference blocks of half a window, side by side; their hashes are the index. All rolling
half windows of all documents probe it. A repeated window holds one whole reference block of its earlier
place, so its later place has a hit within its first half. Around hits, whole windows are compared: of the
places of one window sequence the earliest stays, and every later one is a part of a maximal repeat whose words go.

Index, probes and windows travel as compact blobs of a task's hashes for one hash range, never as rows; what
comes back are positions of a document. A hash range is decided in one task whose memory is set by the number
of shuffle partitions. The hashes of a window that very many places share are first reduced in each task to
its earliest place there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import mix, numbered_rows, pack_gaps, rolling, rows, slices, unique_ids, unpack_gaps, word_hashes

#: Hashes gathered in a task before they are sent to their ranges.
SENT_AT_ONCE = 3_000_000
#: Bytes of a block hash that travel; windows are told apart by eight bytes afterwards.
ANCHOR_BYTES = 5

_PLACES = "part int, docs binary, sizes binary, places binary, hashes binary"
_SENT = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary()), ("hashes", pa.binary())])
_BACK = pa.schema([("doc_id", pa.int64()), ("places", pa.binary())])


def _blobs(part: np.ndarray, parts: int, doc: np.ndarray, place: np.ndarray, value: np.ndarray, width: int) -> pa.RecordBatch:
    """One blob for each part; places ascend within a document, and a document's places are side by side."""
    order = np.argsort(part, kind="stable")
    doc, place, value = doc[order], place[order], value[order]
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    out = [[], [], [], [], []]
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if a == b:
            continue
        first = np.concatenate(([0], np.flatnonzero(np.diff(doc[a:b])) + 1))
        size = np.diff(np.append(first, b - a))
        last = place[a:b][first + size - 1]
        at = place[a:b] + np.repeat(np.cumsum(np.concatenate(([0], last[:-1]))), size)  # one ascending run over all documents
        raw = value[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        for column, x in zip(out, (p, doc[a:b][first].tobytes(), pack_gaps(np.cumsum(size)), pack_gaps(at), raw.tobytes()), strict=True):
            column.append(x)
    return rows(_SENT, out)


class _Sender:
    """Gathers (document, place, hash) and cuts them by hash range."""

    def __init__(self, parts: int, width: int):
        self.parts, self.width, self.held, self.size = parts, width, [], 0

    def add(self, doc: int, place: np.ndarray, value: np.ndarray) -> None:
        self.held.append((doc, place, value))
        self.size += len(place)

    def flush(self) -> pa.RecordBatch:
        doc = np.repeat(np.array([d for d, _, _ in self.held], dtype=np.int64), [len(p) for _, p, _ in self.held])
        place = np.concatenate([p for _, p, _ in self.held])
        value = np.concatenate([v for _, _, v in self.held])
        self.held, self.size = [], 0
        n = np.uint64(self.parts)
        return _blobs((value % n).astype(np.int32), self.parts, doc, place, value // n, self.width)


def _received(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, hash) of everything that reached one task, one hash range at a time."""
    blobs: dict[int, list[tuple]] = {}
    for batch in batches:
        for p, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "docs", "sizes", "places", "hashes")), strict=True):
            blobs.setdefault(p, []).append(x)
    for p in list(blobs):
        doc, place, value = [], [], []
        for docs, sizes, places, hashes in blobs.pop(p):
            size = np.diff(unpack_gaps(sizes), prepend=0)
            at = unpack_gaps(places)
            last = at[np.cumsum(size) - 1]
            at = at - np.repeat(np.concatenate(([0], last[:-1])), size)
            raw = np.zeros((len(at), 8), np.uint8)
            raw[:, :width] = np.frombuffer(hashes, np.uint8).reshape(len(at), width)
            doc.append(np.repeat(np.frombuffer(docs, np.int64), size))
            place.append(at)
            value.append(raw.view("<u8").ravel())
        yield np.concatenate(doc), np.concatenate(place), np.concatenate(value)


def _replies(found: Iterator[tuple[np.ndarray, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """What a task found, (document, place) in any order, as one blob for each group of documents."""
    found = list(found)
    if found:
        doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        yield _blobs((mix(doc.view(np.uint64)) % np.uint64(parts)).astype(np.int32), parts, doc, place, np.zeros(len(doc), np.uint64), 0)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for doc, place, _ in _received(batches, 0):
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        ids, first = np.unique(doc, return_index=True)
        ends = np.append(first[1:], len(doc))
        yield rows(_BACK, (ids, [pack_gaps(place[a:b]) for a, b in zip(first, ends, strict=True)]))


def repeated_windows(texts: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, places): starts of windows whose words also start at an earlier place.

    Needs doc_id, unique and not null, and the text as bytes; see ``substring_dedup`` for the general case.
    """
    spark, block = texts.sparkSession, (window + 1) // 2
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 2 * count

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(parts, ANCHOR_BYTES)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, found in slices(batch):
                hashes, begin = word_hashes(found)
                h = rolling(hashes, block)
                for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                    if b - a >= window:
                        sender.add(ids[low + i], np.arange(b - a - block + 1), h[a : b - block + 1])
                if sender.size > SENT_AT_ONCE:
                    yield sender.flush()
        if sender.size:
            yield sender.flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for doc, place, value in _received(batches, ANCHOR_BYTES):
            order = np.argsort(value, kind="stable")
            v = value[order]
            same = np.zeros(len(v), bool)
            same[1:] = v[1:] == v[:-1]
            many = same.copy()
            many[:-1] |= same[1:]
            if not many.any():
                continue
            order, v = order[many], v[many]
            anchors = np.unique(v[place[order] % block == 0])
            hit = order[np.isin(v, anchors)]
            if len(hit):
                yield doc[hit], place[hit]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(parts, 8)
        for batch in batches:
            ids, hits = batch.column("doc_id").to_pylist(), batch.column("hits").to_pylist()
            for low, _, found in slices(batch):
                hashes, begin = word_hashes(found)
                w = rolling(hashes, window)
                for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                    n = b - a - window + 1
                    at = unpack_gaps(hits[low + i])
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.clip(at - block + 1, 0, n), 1)
                    np.add.at(edge, np.clip(at + 1, 0, n), -1)
                    start = np.flatnonzero(np.cumsum(edge[:n]) > 0)
                    if len(start):
                        sender.add(ids[low + i], start, w[a + start])
                if sender.size > SENT_AT_ONCE:
                    yield sender.flush()
        if sender.size:
            yield sender.flush()

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for doc, place, value in _received(batches, 8):
            order = np.lexsort((place, doc, value))
            v = value[order]
            again = order[1:][v[1:] == v[:-1]]
            if len(again):
                yield doc[again], place[again]

    def back(df: DataFrame, find) -> DataFrame:
        sent = df.repartition(count, "part").mapInArrow(lambda x: _replies(find(x), parts), _PLACES)
        return sent.repartition(count, "part").mapInArrow(_by_document, "doc_id long, places binary")

    hits = back(texts.mapInArrow(probe, _PLACES), match).withColumnRenamed("places", "hits")
    # All columns stay: the dealt-out texts are then the same for this join and the one that rebuilds them, and are reused.
    near = texts.join(hits, "doc_id", "left").filter("hits is not null").select(*texts.columns, "hits")
    return back(near.mapInArrow(extend, _PLACES), later)


def dedup_texts(docs: DataFrame, window: int = 20) -> DataFrame:
    """keep (all columns but the text), n_words, n_removed, kept_sha256 and kept (the text without its repeats; as it was if it
    has none); see ``substring_dedup``."""
    keep = F.struct(*[c for c in docs.columns if c != "text"])
    text = F.col("text").cast("string").cast("binary")
    if unique_ids(docs):
        row = F.col("doc_id").cast("long")
    else:
        docs, row = numbered_rows(docs, "__row"), F.col("__row")
    # Both joins with the texts start from this, so that the texts are dealt out once.
    texts = docs.select(row.alias("doc_id"), keep.alias("keep"), text.alias("text")).filter("doc_id is not null")
    spec = texts.select("keep").schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept", "string")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, there = batch.column("hits").to_pylist(), batch.column("text").is_valid().to_pylist()
            for low, high, texts in slices(batch):
                out = [[], [], [], []]
                for i, text in enumerate(texts, low):
                    words, n, removed = text.split(), 0, 0
                    n = len(words)
                    if hits[i]:
                        start = unpack_gaps(hits[i])
                        edge = np.bincount(start, minlength=n + 1) - np.bincount(start + window, minlength=n + 1)
                        gone = np.cumsum(edge[:n]) > 0
                        removed = int(gone.sum())
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = b" ".join(words)
                    found = (n, removed, hashlib.sha256(kept).hexdigest(), kept.decode() if removed else text.decode() if there[i] else None)
                    for column, x in zip(out, found, strict=True):
                        column.append(x)
                keep = batch.column("keep").slice(low, high - low)
                n_words, n_removed, digest, kept = out
                arrays = [keep, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["keep", "n_words", "n_removed", "kept_sha256", "kept"])

    places = repeated_windows(texts, window).withColumnRenamed("places", "hits")
    return texts.join(places, "doc_id", "left").select("keep", "hits", "text").mapInArrow(rebuild, spec)


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """Remove each word that lies in a window of ``window`` words whose sequence also starts earlier.

    Earlier is a smaller doc_id, or a smaller place in the same document; windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space), one row per input row.
    Null and empty texts have no words. Rows that share a doc_id have an order that their contents fix, and of equal rows all but
    one count as later; a null doc_id is the smallest. Other columns are ignored. Windows are told apart by 64-bit hashes.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return dedup_texts(named, window).select("keep.doc_id", "n_words", "n_removed", "kept_sha256")
