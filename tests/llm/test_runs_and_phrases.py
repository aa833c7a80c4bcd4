import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corpusmill.llm import collocations as phrases
from corpusmill.llm import vector_dedup
from corpusmill.llm.collocations import Shard, collocations
from corpusmill.llm.common import word_hashes
from corpusmill.llm.periodic_runs import find_runs, periodic_runs, run_digests
from corpusmill.llm.queries import repeating
from corpusmill.llm.vector_dedup import near_duplicate_vectors

CLASHES = "lang string, doc_id long, text string, word string, w1 long, runs int, key long, a long, salt int"


def plain_runs(w, least=6, times=4):
    """Every stretch that agrees with itself at some distance, by that distance."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i) + 1
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(r):
    letters = r.choice(["a", "ab", "ab", "abc", "abcdefgh"])
    w = [r.choice(letters) for _ in range(r.randrange(0, 60))]
    for _ in range(r.randrange(0, 4)):
        s = [r.choice(letters) for _ in range(r.randrange(1, 9))]
        at = r.randrange(0, len(w) + 1)
        w[at:at] = (s * r.randrange(2, 9))[: r.randrange(1, 60)]
    return w


@pytest.mark.parametrize("least, times", [(6, 4), (3, 3), (12, 5)])
def test_runs_are_those_of_all_distances(least, times):
    r = random.Random(least)
    for _ in range(300):
        docs = [repetitive(r) for _ in range(r.randrange(1, 6))]
        hashes, begin = word_hashes([" ".join(w).encode() for w in docs])
        assert find_runs(hashes, begin, least, times) == [plain_runs(w, least, times) for w in docs]


def test_long_periodic_texts_stay_cheap():
    for w in (["a"] * 60_000, ["a", "b", "c"] * 30_000 + ["a"]):
        hashes, begin = word_hashes([" ".join(w).encode()])
        assert find_runs(hashes, begin) == [[(0, len(w), 1 if w[1] == "a" else 3)]]


def test_run_digests_hold_against_plain_python(spark):
    r = random.Random(5)
    texts = [(i, r.choice([" ", "\n\t "]).join(repetitive(r))) for i in range(400)]
    texts += [(400, None), (401, ""), (402, " \n"), (None, "a " * 9), (7, "x y z"), (7, "x y z"), (403, "a b\x1fc " * 8 + "é\xa0é " * 7)]
    docs = spark.createDataFrame([("en", i, t, "w", 1, 2, 3, 4, 5) for i, t in texts], CLASHES).repartition(5)
    want = Counter()
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)),
              sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert Counter(tuple(x) for x in run_digests(periodic_runs(docs, prepare=repeating)).collect()) == want
    assert run_digests(periodic_runs(docs.limit(0))).count() == 0


def plain_collocations(texts, least=10, best=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        rows = []
        for g, a in f[lang].items():
            if len(g) > 1 and a >= least:
                longer = [b for h, b in f[lang].items() if len(h) > len(g) and b >= least and any(h[i : i + len(g)] == g for i in range(len(h)))]
                if not any(100 * b >= 50 * a for b in longer):
                    score, _, l, r = min((1_000_000 * a * a // (f[lang][g[:k]] * f[lang][g[k:]]), k, f[lang][g[:k]], f[lang][g[k:]]) for k in range(1, len(g)))
                    rows.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1)]
    return sorted(out)


def spoken(seed, n):
    r = random.Random(seed)
    words = ["la", "La", "maison", "de", "été", "x y", "New", "york", "city", "a", "b"]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ". ", "\n", ", ", "  "]) for _ in range(k))
    texts = [(r.choice(["en", "en", "fr", None, "und", "langue très longue"]), text(r.randrange(0, 60))) for _ in range(n)]
    return texts + [("en", None), ("en", ""), ("fr", "..."), ("en", "new york city " * 40), ("xx", None), ("en", "aa " * 30)]


@pytest.mark.parametrize("best, shard", [(2000, 12_000_000), (7, 400)])
def test_collocations_hold_against_plain_counts(spark, monkeypatch, best, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    texts = spoken(best, 250)
    docs = spark.createDataFrame([(g, i % 9, t, "w", 1, 2, 3, 4, 5) for i, (g, t) in enumerate(texts)], CLASHES).repartition(6)
    got = sorted(tuple(x) for x in collocations(docs, best=best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(texts, best=best)
    assert collocations(docs.limit(0)).count() == 0


def test_collocations_are_exact_with_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", 32768)
    monkeypatch.setattr(phrases, "_passes", lambda bits, names: np.ones(len(names), bool))
    texts = spoken(3, 120)
    docs = spark.createDataFrame([(g, i, t, "w", 1, 2, 3, 4, 5) for i, (g, t) in enumerate(texts)], CLASHES)
    got = sorted(tuple(x) for x in collocations(docs).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(texts)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_extensions_to_both_sides_give_the_same_counts(depth):
    r = random.Random(depth)
    joined = "".join(r.choice("abcd") + r.choice(["  ", " ", "\n"]) for _ in range(3000)).encode()
    shard = Shard("en", joined)
    index = shard.index(depth)
    right = left = index.single()
    for step in range(1, depth + 1):
        last = step == depth
        right, left = index.right(right, last), index.left(left, last)
        plain = Counter(tuple(w[i : i + step + 1]) for p in joined.decode().split("\n") for w in [p.split()] for i in range(len(w) - step))
        spell = {h: w for w in "abcd" for h in word_hashes([w.encode()])[0].tolist()}
        for found in (right, left):
            names = [tuple(spell[int(shard.hashes[k - 1])] for k in row) for row in found.words]
            assert dict(zip(names, found.count.tolist(), strict=True)) == plain


VECTORS = "embedding array<float>, vec_id long, label int, x int, key int, u int, root int, copies int"


def plain_links(table, threshold=0.9):
    good = [(i, np.array(x, np.float64)) for i, x in table if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    links, at = Counter(), {i: i for i, _ in table}
    find = lambda i: i if at[i] == i else find(at[i])
    count = [0] * len(good)
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                count[a] += 1
                count[b] += 1
                low, high = sorted((find(good[a][0]), find(good[b][0])))
                at[high] = low
    for k, (i, _) in enumerate(good):
        links[(i, count[k], find(i), find(i) == i)] += 1
    sound = {id(x) for x in good}
    bad = [i for i, x in table if not (i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x))]
    links.update((i, 0, i if i is None else find(i), i is None or find(i) == i) for i in bad)
    return links, sound


def grouped(seed, n, dims=16, spread=0.05, groups=12):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dims))
    x = [(centre[k % groups] + r.normal(size=dims) * spread * (1 + k % 9)).astype(np.float32).tolist() for k in range(n)]
    table = [(i, v) for i, v in enumerate(x)]
    table += [(n + i, x[7]) for i in range(40)] + [(n + 40 + i, [v * 3 for v in x[7]]) for i in range(3)]
    return table + [(-5, x[9]), (2000, None), (2001, []), (2002, [0.0] * dims), (2003, [None] + x[0][1:]), (2004, [float("nan")] + x[0][1:]),
                    (2005, [float("inf")] + x[0][1:]), (2006, [1.0, 2.0]), (2007, [1.0, 2.1]), (None, x[3]), (2008, [3e38] * dims), (2009, [1e-38] * dims)]


def as_table(spark, table):
    return spark.createDataFrame([(x, i, 1, 2, 3, 4, 5, 6) for i, x in table], VECTORS)


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_links_hold_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", block)
    table = grouped(1, 150)
    got = Counter(tuple(x) for x in near_duplicate_vectors(as_table(spark, table)).collect())
    assert got == plain_links(table)[0]
    assert near_duplicate_vectors(as_table(spark, table).limit(0)).count() == 0


@pytest.mark.parametrize("certain, least", [(True, 1.0), (False, 0.97)])
def test_vector_links_across_cells(spark, monkeypatch, certain, least):
    monkeypatch.setattr(vector_dedup, "CELL_ROWS", 40)
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", 64)
    r = np.random.default_rng(4)
    base = r.normal(size=(260, 16))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base + 0.1 * r.normal(size=base.shape)  # cosines around 0.92, above and below the threshold
    table = [(i, v.tolist()) for i, v in enumerate(np.vstack((base, near)).astype(np.float32))]
    want = plain_links(table)[0]
    got = near_duplicate_vectors(as_table(spark, table), certain=certain).collect()
    found, all_links = sum(x.n_links for x in got), sum(k[1] * c for k, c in want.items())
    assert all_links > 200 and least * all_links <= found <= all_links
    if certain:
        assert Counter(tuple(x) for x in got) == want


def test_repeated_vector_ids_are_one_node(spark):
    table = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    got = sorted(tuple(x) for x in near_duplicate_vectors(as_table(spark, table)).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_filter_bits_are_those_of_frequent_grams(spark):
    docs = spark.createDataFrame([("en", b"one two three " * 12 + b"four five")], "lang string, text binary")
    bits = phrases._filter(docs, 10).value
    shard = Shard("en", b"one two three four five")
    known = phrases._passes(bits, shard.names(np.arange(1, 6)[:, None]))
    spell = {int(h): w for w in ("one", "two", "three", "four", "five") for h in word_hashes([w.encode()])[0]}
    assert {spell[int(h)] for h in shard.hashes[known]} == {"one", "two", "three"}
    assert int(np.unpackbits(bits).sum()) == 9
