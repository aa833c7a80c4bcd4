import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F


from corpusmill.llm import exact_search, license_scan, ngram_join, packing, tokens
from corpusmill.llm.chat_format import chat_digests, format_chats, parse_chats
from corpusmill.llm.common import components, pack_gaps, rolling, unpack_gaps, word_hashes
from corpusmill.llm.mixing import mix_documents, mix_sources
from corpusmill.llm.ngram_join import ngram_jaccard_join
from corpusmill.llm.quality_rules import POLICIES, ablations, apply_policies, quality_verdicts, rule_ledger
from corpusmill.llm.substring_dedup import dedup_texts, substring_dedup
from corpusmill.llm.token_files import read_token_index, read_tokens, token_round_trip, write_token_files
from corpusmill.llm.toxicity import fit_toxicity, is_held_out, restore, score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, row int, ids int"
BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def table(spark, texts, sources=None):
    """Documents with columns whose names clash with those of the operators' own."""
    rows = [(i, t, "en", (sources or {}).get(i, "a"), 0 if t is None else len(t), 1, 2, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(seed=3, n=60):
    """Texts with copies, near copies, shared passages, nulls, empty ones and a long one."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(45)]
    texts = []
    for i in range(n):
        words = [word() for _ in range(r.randrange(0, 90))]
        if texts and i % 5 == 1:
            words = (r.choice(texts)[1] or "").split()
            for _ in range(i % 3):
                if words:
                    words[r.randrange(len(words))] = word()
        if i % 7 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        texts.append((i, r.choice([" ", "\n", "\t "]).join(words)))
    texts += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, " ".join(word() for _ in range(9000)))]
    return texts


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined(rows):
    sets, at = [shingles(t) for _, t in rows], {k: k for k in range(len(rows))}
    find = lambda k: k if at[k] == k else find(at[k])
    links = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                at[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return Counter((i, len(sets[k]), low.get(find(k), i), links[k]) for k, (i, _) in enumerate(rows))


def deduped(rows, window=20):
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone.update(range(p, p + window))
            seen.add(key)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_hashes_and_gaps():
    texts = [b"a bb  c", b"", b"a\xc3\xa9\x0b\x0cbb", b"x" * 70_000]
    h, begin = word_hashes(texts)
    assert np.diff(begin).tolist() == [3, 0, 2, 1]
    assert h[0] != h[1] and h[1] == h[4] and len(rolling(h, 7)) == 0 and len(rolling(h, 6)) == 1
    for x in ([], [0], [5, 5, 300, 10**12]):
        assert unpack_gaps(pack_gaps(np.array(x))).tolist() == x


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9] + [(7, 7)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {i: i // 10 * 10 for i in range(40)}


def test_ngram_join_equals_all_pairs(spark):
    rows = corpus()
    got = ngram_jaccard_join(table(spark, rows))
    assert Counter(map(tuple, got.collect())) == joined(rows)
    tiled = ngram_jaccard_join(table(spark, rows), block_rows=2)
    assert Counter(map(tuple, tiled.collect())) == joined(rows)


@pytest.mark.parametrize("ranked", [True, False])
def test_ngram_join_with_frequent_ngrams(spark, monkeypatch, ranked):
    """N-grams of more rows than HOT_ROWS, known as such from the counts or not."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 4)
    monkeypatch.setattr(ngram_join, "PAIRS_AT_ONCE", 3)
    monkeypatch.setattr(ngram_join, "FILTER_BITS", 64)
    if not ranked:
        monkeypatch.setattr(ngram_join, "frequent_ngrams", lambda docs, k: (np.empty(0, np.uint64), 0))
    rows = corpus(5)
    assert Counter(map(tuple, ngram_jaccard_join(table(spark, rows)).collect())) == joined(rows)


def test_ngram_join_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e f"), (4, "A b c d e f"), (4, "A b c d e f"), (9, None), (None, None), (5, "other words of one text here")]
    got = Counter(map(tuple, ngram_jaccard_join(table(spark, rows)).collect()))
    assert got == Counter([(None, 2, 4, 2), (4, 2, 4, 2), (4, 2, 4, 2), (9, 0, 9, 0), (None, 0, None, 0), (5, 2, 5, 0)])
    assert ngram_jaccard_join(table(spark, [])).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(5) + [(200, " ".join(["same"] * 70))]
    got = sorted(map(tuple, substring_dedup(table(spark, rows)).collect()), key=str)
    assert got == deduped(sorted(rows))
    assert any(r[2] for r in got)
    assert substring_dedup(table(spark, [])).count() == 0


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = Counter((r.doc_id, r.n_removed) for r in substring_dedup(table(spark, [(1, text), (1, text), (None, text), (2, "")])).collect())
    assert got == Counter([(None, 0), (1, 30), (1, 30), (2, 0)])
    kept = dedup_texts(table(spark, [(1, "a\n b"), (2, None)])).select("keep.*", "kept").collect()
    assert {(r.doc_id, r.kept, r.score) for r in kept} == {(1, "a\n b", 1), (2, None, 1)}


def toxic_tables(spark):
    r = random.Random(1)
    say = lambda n: [r.choice(("the of and then house tree river stone light water cloud paper").split()) for _ in range(n)]
    docs, labels = [], []
    for i in range(400):
        words = say(30)
        if i % 4 == 0:
            for bad in r.sample(("vilewort", "grumblet", "scorncap"), 2):
                words.insert(r.randrange(30), bad)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    docs += [(1000, "the river then vi1ew0rt of light gr*u*m*b*l*e*t stone"), (1001, "paper v i l e w o r t house s c o r n c a p tree"), (1002, "vilewooort and grumbleeet"), (1003, None), (1004, ""), (1005, "river " * 20_000)]
    return table(spark, docs + [(7, "river of stone")]), spark.createDataFrame(labels + [(1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_decodes_and_scores(spark):
    docs, labels = toxic_tables(spark)
    model = fit_toxicity(docs, labels)
    got = score_toxicity(docs, model).withColumn("held", is_held_out()).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held and r.doc_id < 400]
    assert len(held) > 50 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert [by[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [1, 1, 1, 0, 0, 0]
    assert restore("vi1ew0rt", model.characters) == "vilewort"
    assert {r.held for r in got if r.doc_id == 1} == {zlib.crc32(b"1") % 5 == 0}


def test_toxicity_without_labels(spark):
    docs, labels = toxic_tables(spark)
    assert {r.score for r in score_toxicity(docs, fit_toxicity(docs, labels.limit(0))).collect()} == {0.0}
    empty = docs.limit(0)
    assert score_toxicity(empty, fit_toxicity(empty, labels)).count() == 0


OBFUSCATED = [
    "5h17", "a$$", "4$$", "stuupid", "iiddiioott", "sc.um", "s_tupid", "1 d ! o t", "$ c u m", "i  d  i  o  t", "i. d. i. o. t", "a s s",
    "$ t u p i d", "river-" * 10 + "st.upid", "id" + "i" * 300 + "ot", "(1d!ot!)", "s " + ". " * 200 + "c u m",
]


def test_toxicity_decodes_every_form(spark):
    """Each form alone between clean words: found, and the same text without it not."""
    r, bad = random.Random(2), "shit ass stupid idiot scum".split()
    say = lambda n: [r.choice("the of and then house tree river stone light water cloud paper".split()) for _ in range(n)]
    docs = [(i, " ".join(say(15) + [bad[i // 2 % 5]] * (i % 2) + say(15))) for i in range(800)]
    docs += [(1000 + k, " ".join([*say(12), form, *say(12)])) for k, form in enumerate(OBFUSCATED)] + [(2000, "1 2 3 in 2024, well-known letters (e.g. 50 %) cost $5")]
    model = fit_toxicity(table(spark, docs), spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, toxic int"))
    got = {x.doc_id: x.predicted for x in score_toxicity(table(spark, docs), model).collect()}
    assert [f for k, f in enumerate(OBFUSCATED) if not got[1000 + k]] == []
    assert got[2000] == 0 and all(got[i] == i % 2 for i in range(800))


def test_license_scan_matches_plain_alignment(spark):
    index = license_scan.Index(license_scan.TEMPLATES)
    mit = license_scan.TEMPLATES["MIT"]
    changed = " ".join("X" if i % 17 == 5 else w for i, w in enumerate(mit.split()))
    rows = [(1, "Some words. RELEASED under the\nMIT license"), (2, "pad " * 30 + changed + " pad"), (3, None), (4, ""), (5, "no notice at all " * 5000), (6, "é All rights reserved."), (6, "é All rights reserved.")]
    got = license_scan.scan_licenses(table(spark, rows)).collect()
    found = Counter((r.doc_id, r.license) for r in got)
    assert found == Counter({(1, "MIT-notice"): 1, (2, "MIT"): 1, (6, "All-rights-reserved"): 2})
    for r in got:
        text = dict(rows)[r.doc_id]
        template = index.words[index.names.index(r.license)].tolist()
        words = word_hashes([text.encode().translate(license_scan._PLAIN)])[0].tolist()
        longest = np.zeros((len(template) + 1, len(words) + 1), int)
        for i, a in enumerate(template):
            for j, b in enumerate(words):
                longest[i + 1, j + 1] = longest[i, j] + 1 if a == b else max(longest[i, j + 1], longest[i + 1, j])
        assert r.matched_words == longest[-1, -1]
        part = text[r.start_char : r.end_char].encode().translate(license_scan._PLAIN)
        assert word_hashes([part])[0].tolist() == words[r.start_word : r.end_word]
    assert license_scan.scan_licenses(table(spark, [])).count() == 0


def test_license_scan_finds_every_changed_notice(spark):
    """Each word of each template changed in turn, and a word put in: found where plain alignment reaches the bound."""
    index = license_scan.Index(license_scan.TEMPLATES)
    plain = {n: w.tolist() for n, w in zip(index.names, index.words)}
    texts = []
    for name in index.names:
        words = license_scan.TEMPLATES[name].split()
        for i in range(len(words)):
            texts.append(" ".join(["pad"] * 9 + words[:i] + ["changed"] + words[i + 1 :] + ["pad"] * 9))
        texts.append(" ".join(words[:1] + ["added"] + words[1:]))
        texts.append(" ".join("changed" if i % 5 == 2 else w for i, w in enumerate(words)))
    want, seen_words = set(), []
    for d, text in enumerate(texts):
        seen = word_hashes([text.encode().translate(license_scan._PLAIN)])[0].tolist()
        seen_words.append(seen)
        for name, template in plain.items():
            row = [0] * (len(seen) + 1)
            for a in template:
                new = [0]
                for j, b in enumerate(seen):
                    new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
                row = new
            if row[-1] >= 0.8 * len(template):
                want.add((d, name))
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(table(spark, list(enumerate(texts)))).collect()}
    assert got <= want
    for d, name in want - got:  # words scattered over the text: too few on any diagonal with its band
        template, band = plain[name], license_scan._band(plain[name])
        best = max(license_scan.align(template, seen_words[d], x, x, band)[0] for x in range(-len(template), len(seen_words[d])))
        assert best < 0.8 * len(template), (texts[d], name)


def test_mix_meets_targets(spark):
    r = random.Random(2)
    names = {i: ("a", "b", None, "c")[min(i % 9, 3)] if i % 3 else "a" for i in range(1500)}
    rows = [(i, " ".join(["w"] * r.choice((0, 3, 20, 21, 200)))) for i in range(1500)] + [(2000, None)]
    docs = table(spark, rows, {**names, 2000: "c"})
    got = mix_sources(docs).collect()
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        s = names.get(x.doc_id, "c")
        size[s] += x.size
        taken[s] += x.taken
        target[s] = x.target
        assert x.taken in (0, x.size, 2 * x.size) and x.source_size > 0
    assert all(x.source_size == size[names.get(x.doc_id, "c")] for x in got)
    free, left, want = {"a": 3, "b": 1, "c": 2, None: 3}, 1.5 * sum(size.values()), {}
    while over := [s for s in free if left * free[s] / sum(free.values()) > 2 * size[s]]:
        for s in over:
            want[s] = 2 * size[s]
            left -= want[s]
            free.pop(s)
    want |= {s: left * w / sum(free.values()) for s, w in free.items()}
    assert target == pytest.approx(want) and dict(taken) == pytest.approx(want, rel=0.01)
    again = mix_sources(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_mix_of_empty_and_repeated_rows(spark):
    assert mix_sources(table(spark, [])).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    docs = table(spark, rows)
    assert mix_sources(docs).agg(F.sum("taken")).first()[0] in (7, 8)
    assert mix_documents(docs).columns == docs.columns
    assert {r.source_size for r in mix_sources(table(spark, [(1, ""), (2, None)])).collect()} == {0}


def test_quality_rules_and_policies(spark):
    eight = " ".join("abcdefgh")
    rows = [(1, None), (2, ""), (3, f"{eight} x {eight}"), (4, "# $ line\n\nsame\nsame\n same"), (5, " ".join(f"word{i}" for i in range(30))), (5, " ".join(f"word{i}" for i in range(30))), (6, "ab " * 50_000), (None, "é ü")]
    got = quality_verdicts(table(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[3].n_repeat_words == 16 and by[6].n_repeat_words == 50_000
    assert (by[4].n_symbols, by[4].n_dup_lines, by[4].word_chars) == (2, 1, 18) and by[None].word_chars == 2
    assert by[5].kept and not by[5].base_failed and not by[6].kept and by[1].base_failed
    ledger = rule_ledger(table(spark, rows))
    assert apply_policies(ledger).filter("kept_base_v1").count() == 2
    out = {r.rule: tuple(r)[1:] for r in ablations(ledger, POLICIES[0]).collect()}
    assert out["too_short"] == (5, 4, 6) and out["repeated_windows"] == (2, 1, 3)
    assert quality_verdicts(table(spark, [])).count() == 0


def test_chat_format_round_trip(spark):
    tricky = "\\### </turn>\n<turn:assistant>\n<part/> \\l \\e \\\\l <b>"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (1, 2, "assistant", ""), (1, 3, "a>\n\\g", None), (2, 5, None, "x"), (2, 5, None, "x"), (None, 1, "assistant", "y" * 100_000), (3, None, "assistant", "é")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, pieces int")
    chats = format_chats(turns)
    back = {r.conv_id: [(t.role, t.text, t.loss) for t in r.turns] for r in parse_chats(chats).collect()}
    assert back[1] == [("user", tricky, False), ("assistant", tricky, True), ("assistant", "", True), ("a>\n\\g", "", False)]
    assert back[2] == [("", "x", False)] * 2 and back[3] == [("assistant", "é", True)]
    for r in chats.collect():
        assert sum(m.length for m in r.mask) == len(r.formatted)
    digest = {r.conv_id: r for r in chat_digests(chats).collect()}
    assert digest[1].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest() and digest[None].loss_chars == 100_000
    assert chat_digests(format_chats(turns.limit(0))).count() == 0


def brute_top(rows, k=5, every=50):
    sound = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in {i: x for i, x in sound if i % every == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in sound if i != q and len(y) == len(x))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_exact_search_equals_brute_force(spark, monkeypatch):
    for name, value in {"BLOCK_VECTORS": 150, "PAGE_ENTRIES": 16, "TASK_QUERIES": 5, "TOGETHER": 3}.items():
        monkeypatch.setattr(exact_search, name, value)
    r = np.random.default_rng(4)
    centre = r.normal(size=(6, 8))
    rows = [(i, (centre[i % 6] + 0.3 * r.normal(size=8)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.25] * 8) for i in range(300)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, []), (None, [1.0] * 8), (2200, [1.0, 2.0]), (2201, [3.0, 1.0]), (2250, [float("inf")] * 8)]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, region int")
    exact = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert sorted(map(tuple, exact_search.exact_top_k(frame).collect())) == brute_top(exact)
    assert exact_search.exact_top_k(frame.limit(0)).count() == 0


@pytest.mark.parametrize("size,floor", [(100, False), (100, True), (1 << 28, False)])
def test_tree_search_equals_brute_force(monkeypatch, size, floor):
    """Also scores beyond what doubles hold exactly, copies in pages of their own and scores known beforehand."""
    monkeypatch.setattr(exact_search, "PAGE_ENTRIES", 8)
    r = np.random.default_rng(5)
    values = r.integers(-size, size, (300, 6))
    values[200:] = values[7]
    ids = r.permutation(300)
    lift = float((values.astype(float) ** 2).sum(axis=1).max())
    pivot = exact_search._lifted(values[:1].astype(float), lift)[0]
    tree = exact_search.build(exact_search._lifted(values.astype(float), lift), values, ids, pivot)
    q = np.concatenate((values[:20], np.zeros((1, 6), np.int64)))
    own = np.append(ids[:20], -1)
    scores = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in values] for x in q]
    want = [sorted((-s, int(i)) for s, i in zip(row, ids) if i != o)[:5] for row, o in zip(scores, own)]
    floors = np.array([-w[-1][0] if floor else exact_search.NONE for w in want])
    best = exact_search.search(tree, pivot, exact_search._query_points(q.astype(float)), q, own, 5, lift, floors)
    assert [[(-int(s), int(i)) for s, i in zip(a, b)] for a, b in zip(best.scores, best.ids)] == want


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    r = random.Random(8)
    pool = ["word", "It's", " we'll", "Été", "ß", "Straße", "123", "4²", "\n\n ", "\t", "  ", "<|endoftext|>", "<|startoftext|>", "中文", "é", "İ", "\u0085", "\x1c", "_a_", "a-b!?", "“q”", "€5", "🙂", "don'T"]
    for path, words in ((BYTE_BPE, False), (WORD_BPE, True)):
        own, library = tokens.Encoder(path, words), Tokenizer.from_file(path)
        for text in ["", *pool, *("".join(r.choice(pool) + r.choice(["", " "]) for _ in range(r.randrange(12))) for _ in range(400))]:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_is_gapless_and_tight(spark):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(80)] + [(100, None), (101, ""), (5, "word " * 5), (5, "word " * 5), (102, "long " * 5000), (None, "x")]
    got = packing.best_fit_pack(table(spark, rows), BYTE_BPE).collect()
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(held) <= -(-sum(r.length for r in got) // 1024) + 1
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 102)
    assert all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == [0, *np.cumsum([n for _, _, n in long])[:-1].tolist()]
    assert packing.best_fit_pack(table(spark, []), BYTE_BPE).count() == 0


def test_plan_covers_every_piece_once():
    r = random.Random(6)
    for _ in range(30):
        counts = {length: r.randrange(1, 400) for length in r.sample(range(1, 65), r.randrange(1, 30))}
        used, slots = Counter(), {}
        for length, first, last, sequence, times, offset in packing.plan_best_fit(counts, 64):
            for n in range(last - first + 1):
                used[length, first + n] += 1
                slots.setdefault(sequence + n // times, []).append((offset + length * (n % times), length))
        assert used == Counter({(length, n): 1 for length, c in counts.items() for n in range(c)})
        for pieces in slots.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 64


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_round_trip(spark, tmp_path, encoding):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    rows = [(9 - i, f"text number {i} " * (i % 4)) for i in range(10)] + [(20, None), (21, ""), (22, "long " * 30_000)]
    path = str(tmp_path / encoding)
    write_token_files(table(spark, rows), path, WORD_BPE, files=3, encoding=encoding)
    at, want = 0, {}
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (at, len(ids), ids)
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, list(r.ids)) for r in read_tokens(spark, path).collect()} == want
    assert {r.doc_id: (r.start, r.n_tokens) for r in read_token_index(spark, path).collect()} == {i: x[:2] for i, x in want.items()}


def test_token_files_of_odd_tables(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (1, "c d")]
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in token_round_trip(table(spark, rows), WORD_BPE).collect())
    assert got[0] == (0, 2, None) and [g[0] for g in got] == [0, *np.cumsum([g[1] for g in got])[:-1].tolist()]
    assert token_round_trip(table(spark, []), WORD_BPE).count() == 0


def test_words_whose_openings_are_unknown_are_not_looked_up(monkeypatch):
    from corpusmill.llm import toxicity

    grams = np.random.default_rng(1).random((64, 64, 64), np.float32)
    model = toxicity.ToxicityModel(np.log(grams / grams.sum(axis=2, keepdims=True)), {"badly*": 2.0, "bad": 3.0, "wors*": 1.0, "neg": -1.0})
    words = ["badlyx", "bad", "bad!", "b4d", "wor", "worser", "wooorse", "neg", "harmless", "letter", "a.b.c", "²", "ß$s", "harm-less1"]

    def plain(word):
        found = (model.evidence.get(f, 0.0) for r in toxicity.readings(word, model.characters) for f in features(r))
        return max(max(found, default=0.0), 0.0)

    features, asked = toxicity.features, []
    monkeypatch.setattr(toxicity, "features", lambda run: asked.append(run) or features(run))
    got = [toxicity._Scorer(model).word(w) for w in words]
    assert not {"harmless", "wor"} & set(asked) and "badlyx" in asked
    assert got == [plain(w) for w in words] and got[:2] == [2.0, 3.0]
