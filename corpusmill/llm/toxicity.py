"""Toxicity over a noisy channel: obfuscated words are decoded under a character model, then the restored text is scored.

The channel turns letters into look-alikes, repeats them and puts separators between them. A word that may have gone through it is a
lattice of letters, each with the channel's cost; Viterbi search finds the likeliest path under a trigram model of characters whose
counts are gathered from all documents. Words, restored or as they stand, give evidence by a lexicon of words and stems learned from labels; a
logistic model over a document's strongest evidence gives the score.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import binary_texts, rows, slices

#: Labelled documents of each class that the classifier is fitted on, at most (in expectation; chosen by hash of the id).
TOXIC_SAMPLE, CLEAN_SAMPLE = 3000, 6000
#: Documents and different neighbours that a word or stem needs; copies of one passage give one neighbourhood.
LEAST_DOCUMENTS, LEAST_NEIGHBOURS = 4, 4
LEAST_EVIDENCE = 1.5
STEMS = (4, 5, 6)
KEPT_WORDS = 300_000
#: Long runs are decoded in windows; a word of up to SHARED characters, separators included, lies whole in one of them.
WINDOW, SHARED = 240, 80

SYMBOLS = 64
SPACE, LETTER, OTHER = 60, 59, 61
_CODE = np.full(0x250, OTHER, dtype=np.int64)
_CODE[97:123] = np.arange(26)
_CODE[0xDF:0x100] = 26 + np.arange(33)
_CODE[0x100:0x250] = LETTER
_CODE[[9, 10, 11, 12, 13, 32, 0xA0]] = SPACE

#: Letters that a character can stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs (negative log probabilities) of the channel's steps.
SUBSTITUTED, REPEATED, SEPARATED, KEPT_APART, DROPPED = 1.2, 0.4, 0.3, 1.5, 4.0

_ALIKE = "".join(c for c in LOOKALIKES if not c.isdigit())
#: A doubled letter, or a letter or look-alike in a word that is not all letters.
_DOUBLED = re.compile(r"([^\W\d_])\1")
_READABLE = re.compile(rf"[^\W_]|[{re.escape(_ALIKE)}]")
#: Single characters, look-alikes too and each perhaps repeated, with any number of separators between them.
_UNIT = rf"([^\W_]|[{re.escape(_ALIKE)}])\{{}}*+(?![^\W_])"
_SPACED = re.compile(rf"(?<![^\W_]){_UNIT.format(1)}(?:[\s.,\-_*~|]++{_UNIT.format(2)}){{2,}}+")
_GAP = re.compile(r"[\s.,\-_*~]{2,}")
_LONG_REPEAT = re.compile(r"(.)\1{3,}", re.DOTALL)
#: Edges that never stand for a letter, and those that may.
_EDGES = ".,;:?\"')[]{}«»“”"
_LOOSE_EDGES = _EDGES + "(!|+<¡"
_LETTERS = re.compile(r"[^\W\d_]+")


def _codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(raw < 0x250, _CODE[np.minimum(raw, 0x24F)], LETTER)


@functools.cache
def _code(c: str) -> int:
    return int(_CODE[ord(c)]) if ord(c) < 0x250 else LETTER


def character_model(docs: DataFrame) -> np.ndarray:
    """log p(third | first two) for 64 classes of characters, from counts over all documents."""
    schema = pa.schema([("gram", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, _, texts in slices(batch):
                c = _codes("\n".join(t.decode().lower() for t in texts))
                total += np.bincount((c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield rows(schema, (at, total[at]))

    sums = binary_texts(docs.filter("text is not null")).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n = np.zeros(SYMBOLS**3)
    for r in sums.collect():  # at most 64 * 64 * 64 rows
        n[r.gram] = r.n
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS) + 0.05
    return np.log(n / n.sum(axis=2, keepdims=True)).astype(np.float32)


#: Per worker: the costs of the last model's trigrams as one list, which is read faster than an array.
_COSTS: list = [None, []]


def _costs(model: np.ndarray) -> list[float]:
    if _COSTS[0] is not model:
        _COSTS[:] = model, model.ravel().tolist()
    return _COSTS[1]


def restore(seen: str, model: np.ndarray) -> str:
    """The likeliest text behind ``seen`` (lower case): Viterbi search over the lattice of its characters.

    A state is the last two characters; each seen character is kept, replaced by a letter that it looks like, taken as a repetition, or, if
    it separates letters, left out or taken as a blank.
    """
    costs = _costs(model)
    states: dict[int, tuple[float, str]] = {SPACE * SYMBOLS + SPACE: (0.0, "")}
    last = ""
    for c in seen:
        if len(states) == 1 and c != last and c.isalpha():  # nothing to choose from
            ((pair, (cost, text)),) = states.items()
            at = pair * SYMBOLS + _code(c)
            states = {at % (SYMBOLS * SYMBOLS): (cost - costs[at], text + c)}
            last = c
            continue
        steps: list[tuple[str, int, float]] = []
        if c.isalpha():
            steps.append((c, _code(c), 0.0))
        elif c.isspace():
            steps += [(" ", SPACE, KEPT_APART), ("", 0, SEPARATED)]
        else:
            steps += [(x, _code(x), SUBSTITUTED) for x in LOOKALIKES.get(c, "")]
            steps += [("", 0, SEPARATED), (" ", SPACE, KEPT_APART)] if c in ".-_*~|" else [("", 0, DROPPED)]
        if c == last:
            steps.append(("", 0, REPEATED))
        last = c
        following: dict[int, tuple[float, str]] = {}
        for pair, (cost, text) in states.items():
            for x, k, price in steps:
                if x:
                    at = pair * SYMBOLS + k
                    key, value = at % (SYMBOLS * SYMBOLS), (cost + price - costs[at], text + x)
                else:
                    key, value = pair, (cost + price, text)
                held = following.get(key)
                if held is None or value < held:
                    following[key] = value
        states = following
    return min((cost - costs[pair * SYMBOLS + SPACE], text) for pair, (cost, text) in states.items())[1].strip()


@dataclass
class ToxicityModel:
    characters: np.ndarray
    evidence: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    constant: float | None = None


def suspects(word: str) -> list[str]:
    """The forms of a lower-cased word that may be obfuscated: without its edges, and also without those that look like letters."""
    if word.isalpha():  # no edges
        return [word] if len(word) > 2 and _DOUBLED.search(word) else []
    forms = {word.strip(_EDGES), word.strip(_LOOSE_EDGES)}
    return sorted(f for f in forms if len(f) > 2 and (_DOUBLED.search(f) or not f.isalpha() and _READABLE.search(f)))


def decoded(seen: str, model: np.ndarray) -> list[str]:
    """What is restored from a run of any length, window by window."""
    seen = _LONG_REPEAT.sub(r"\1\1\1", seen)
    return [restore(seen[i : i + WINDOW], model) for i in range(0, max(1, len(seen) - SHARED), WINDOW - SHARED)]


def readings(word: str, model: np.ndarray) -> list[str]:
    """The letter runs of a lower-cased word, and of what is restored from it if it may be obfuscated."""
    found = [word] if word.isalpha() else _LETTERS.findall(word)
    for seen in suspects(word):
        for text in decoded(seen, model):
            found += _LETTERS.findall(text)
    return found


def features(run: str) -> list[str]:
    return [run, *(run[:n] + "*" for n in STEMS if len(run) > n)]


def spaced_runs(text: str) -> list[str]:
    """Runs of single characters with separators between them, several separators as one."""
    return [_GAP.sub(lambda g: " " if any(map(str.isspace, g[0])) else g[0][0], m[0]) for m in _SPACED.finditer(text)]


def spaced_out(text: str, model: np.ndarray) -> list[str]:
    """Words restored from runs of single characters with separators between them."""
    return [w for m in spaced_runs(text) for d in decoded(m, model) for w in _LETTERS.findall(d) if len(w) > 2]


class _Scorer:
    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}
        # all features of a run begin like the run, so one look tells whether any can be known
        self.openings = {f[: STEMS[0]] for f in model.evidence}

    def word(self, word: str) -> float:
        get, openings = self.model.evidence.get, self.openings
        runs = [r for r in readings(word, self.model.characters) if r[: STEMS[0]] in openings]
        return max(max((get(f, 0.0) for r in runs for f in features(r)), default=0.0), 0.0)

    def measures(self, text: str) -> tuple[float, float, float, float, float]:
        """Constant, strongest and second evidence, number of words with evidence, length."""
        lower = text.lower()
        words = lower.split()
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        found = set(words)
        for w in found.difference(self.known):
            self.known[w] = self.word(w)
        strong = [e for e in map(self.known.__getitem__, found) if e]
        strong += [e for w in spaced_out(lower, self.model.characters) if (e := self.word(w))]
        strong.sort(reverse=True)
        first, second = (*strong, 0.0, 0.0)[:2]
        return 1.0, first, second, math.log1p(len(strong)), math.log1p(len(words)) / 10

    def score(self, text: str) -> float:
        if self.model.constant is not None:
            return self.model.constant
        x = float(np.dot(self.model.weights, self.measures(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def is_held_out(doc_id: str = "doc_id", folds: int = 5):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> ToxicityModel:
    """Fit on labelled documents whose crc32 of the id, as text, is not divisible by ``folds``.

    The character model counts all documents. The rest sees a sample of about TOXIC_SAMPLE and CLEAN_SAMPLE
    documents at most: the logistic model is fitted on one half with the lexicon of the other, then the lexicon on all of it. Labels that are null, or whose document is missing, are left out. With one class only the
    score is constant; without labelled texts it is 0.
    """
    model = ToxicityModel(character_model(docs))
    known = labels.filter("toxic is not null and doc_id is not null").filter(~is_held_out(folds=folds))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        model.constant = float(next(iter(sizes), 0))
        return model
    share = F.when(F.col("toxic") == 1, F.lit(TOXIC_SAMPLE / sizes[1])).otherwise(F.lit(CLEAN_SAMPLE / sizes[0]))
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    sample = known.filter(place < share).select("doc_id", "toxic", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("first"))
    texts = docs.filter("text is not null").join(F.broadcast(sample), "doc_id").select("toxic", "first", F.col("text").cast("binary").alias("text"))
    model.evidence = _lexicon(texts.filter("first"), model)
    _weigh(texts, model)
    model.evidence = _lexicon(texts, model)
    return model


def _lexicon(texts: DataFrame, model: ToxicityModel) -> dict[str, float]:
    def found_in(known: dict[str, set[str]], word: str) -> set[str]:
        if word not in known:
            if len(known) > KEPT_WORDS:
                known.clear()
            known[word] = {f for r in readings(word, model.characters) for f in features(r)}
        return known[word]

    found_schema = pa.schema([("feature", pa.string()), ("near", pa.int64())])
    count_schema = pa.schema([("feature", pa.string()), ("n", pa.int64())])

    def in_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for batch in batches:
            for _, _, found in slices(batch):
                out: dict[tuple[str, int], int] = {}
                for i, t in enumerate(found):
                    words, seen = t.decode().lower().split(), set()
                    for k, w in enumerate(words):
                        near = _pair(words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "")
                        for f in found_in(known, w):
                            if f not in seen:
                                seen.add(f)
                                out[f, i] = near
                yield rows(found_schema, ([f for f, _ in out], list(out.values())))

    toxic = texts.filter("toxic = 1").select("text").mapInArrow(in_toxic, "feature string, near long")
    toxic = toxic.groupBy("feature").agg(F.count("*").alias("n"), F.countDistinct("near").alias("nears"))
    toxic = {r.feature: r.n for r in toxic.filter((F.col("n") >= LEAST_DOCUMENTS) & (F.col("nears") >= LEAST_NEIGHBOURS)).collect()}

    def in_clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        known: dict[str, set[str]] = {}
        for batch in batches:
            for _, _, found in slices(batch):
                for t in found:
                    total.update({f for w in set(t.decode().lower().split()) for f in found_in(known, w)}.intersection(toxic))
        yield rows(count_schema, (list(total), list(total.values())))

    clean = texts.filter("toxic = 0").select("text").mapInArrow(in_clean, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    clean = {r.feature: r.n for r in clean.collect()}
    sizes = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    evidence = {}
    for f, n in toxic.items():
        e = math.log((n + 0.5) / (sizes.get(1, 0) + 1)) - math.log((clean.get(f, 0) + 0.5) / (sizes.get(0, 0) + 1))
        if e >= LEAST_EVIDENCE:
            evidence[f] = e
    return evidence


def _pair(a: str, b: str) -> int:
    return zlib.crc32(f"{a}\n{b}".encode())


def _weigh(texts: DataFrame, model: ToxicityModel) -> None:
    """Newton steps of a logistic model over the other half of the sample."""
    schema = pa.schema([("toxic", pa.int32()), ("x", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for low, high, found in slices(batch):
                yield rows(schema, (batch.column("toxic").slice(low, high - low), [list(scorer.measures(t.decode())) for t in found]))

    held = texts.filter("not first").select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect()
    if not held:
        held = texts.select("toxic", "text").mapInArrow(measure, "toxic int, x array<double>").collect()
    if not held:
        model.constant = 0.0
        return
    x, y = np.array([r.x for r in held]), np.array([r.toxic for r in held], dtype=float)
    order = np.lexsort((*x.T, y))  # sums don't depend on the order of rows
    x, y = x[order], y[order]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w


def scored_texts(docs: DataFrame, model: ToxicityModel, with_text: bool = True) -> DataFrame:
    """keep (all columns but the text), score, predicted and, if asked for, the text."""
    keep = F.struct(*[c for c in docs.columns if c != "text"])
    texts = docs.select(keep.alias("keep"), F.col("text").cast("string").cast("binary").alias("text"))
    spec = texts.select("keep").schema.add("score", "double").add("predicted", "integer")
    spec = spec.add("text", "binary") if with_text else spec

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in batches:
            for low, high, found in slices(batch):
                s = [scorer.score(t.decode()) for t in found]
                arrays = [batch.column("keep").slice(low, high - low), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())]
                names = ["keep", "score", "predicted"]
                if with_text:
                    arrays, names = [*arrays, batch.column("text").slice(low, high - low)], [*names, "text"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    out = texts.mapInArrow(score, spec)
    return out.withColumn("text", F.col("text").cast("string")) if with_text else out


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on), one row per input row.

    Needs doc_id and text; other columns are ignored. Null and empty texts are scored as texts without words.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored_texts(named, model, with_text=False).select("keep.doc_id", "score", "predicted")


def restored_words(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, seen, restored: the obfuscated words of every document and what was decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("seen", pa.string()), ("restored", pa.string())])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, found in slices(batch):
                out = []
                for doc, t in zip(ids[low:], found):
                    lower = t.decode().lower()
                    seen = [s for w in lower.split() for s in suspects(w)] + spaced_runs(lower)
                    out += [(doc, w, d) for w in seen for d in decoded(w, model.characters)]
                yield rows(schema, tuple(zip(*out)) or ([], [], []))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(show, "doc_id long, seen string, restored string")
