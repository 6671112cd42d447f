"""Exact dedup, n-gram join, substring dedup and decontamination against brute force, on small hostile tables."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidegauge.llm import components as C
from tidegauge.llm import decontaminate as D
from tidegauge.llm import exact_dedup as E
from tidegauge.llm import ngram_join as J
from tidegauge.llm import substring_dedup as S
from tidegauge.llm.textbatch import flat

SCHEMA = "doc_id long, text string, lang string, recipe string, n long, mark long, _id long"


def table(spark, rows, parts=5):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, 3) for i, t in rows], SCHEMA).repartition(parts)


def corpus(seed=0, n=60):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["É", "naïve", "日本語", "<|x|>"]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    rows, texts = [], []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.2:
            t = rnd.choice(texts)
        elif texts and kind < 0.4:
            w = rnd.choice(texts).split()
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(words)
            t = " ".join(w)
        else:
            t = rnd.choice([" ", "\n", "\t "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 120)))
            if rnd.random() < 0.4:
                t += f"\n{passage}  " + rnd.choice(words)
        texts.append(t)
        rows.append((i * 7 % 101, t))
    return [*rows, (500, None), (501, ""), (502, " \t\x0b\n"), (503, "one two"), (504, "two  ONE"), (505, "one\ttwo"), (506, "long " * 20_000), (507, "long " * 20_000 + "x")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def squeezed(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(spark):
    rows = corpus(1)
    got = by_id(E.exact_groups(table(spark, rows)))
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    for i, t in rows:
        own = groups[squeezed(t)]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(own)[1], len(own), min(own)[1] == i)
        assert r.text_sha256 == hashlib.sha256(squeezed(t).encode()).hexdigest()
    kept = E.deduplicated(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g)[1] for g in groups.values())


def test_exact_dedup_widens_names_that_collide(spark):
    docs = table(spark, corpus(2, 300))
    assert E.verified_width(docs, width=1) > 1
    assert {r.doc_id: r.keep_id for r in E.exact_groups(docs, width=1).collect()} == {r.doc_id: r.keep_id for r in E.exact_groups(docs).collect()}


def test_exact_dedup_null_and_repeated_ids(spark):
    docs = table(spark, [(1, "a b"), (1, "a b"), (1, "other"), (None, "a b"), (2, "o t h e r"), (None, None)])
    assert sorted((r.doc_id or 0, squeezed(r.text)) for r in E.deduplicated(docs).collect()) == [(0, ""), (1, "ab"), (2, "other")]


def test_chunks_cover_texts_and_resist_insertions():
    rng = np.random.default_rng(0)
    body = rng.integers(97, 123, 60_000).astype(np.uint8)
    texts = [body, np.concatenate((body[:100], body[50:])), np.full(30_000, 97, np.uint8), body[:5], body[:0]]
    off = np.cumsum([0, *map(len, texts)])
    found = E.cuts(np.concatenate(texts), off)
    names = []
    for (s, e), ends in zip(zip(off[:-1], off[1:], strict=True), found, strict=True):
        assert (ends[-1] if ends else s) == e and all(0 < y - x <= E.MOST for x, y in zip([s, *ends], ends, strict=False))
        names.append({np.concatenate(texts)[x:y].tobytes() for x, y in zip([s, *ends], ends, strict=False)})
    assert len(names[0] & names[1]) > 0.8 * len(names[0])


def shingles(t):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("seed", "hot", "buckets"), [(1, J.HOT, None), (2, 3, None), (3, J.HOT, 1), (4, 2, 3)])
def test_ngram_join(spark, seed, hot, buckets, monkeypatch):
    monkeypatch.setattr(J, "HOT", hot)
    if buckets:
        monkeypatch.setattr(J, "parts_for", lambda *_: buckets)
    rows = corpus(seed)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.linked(table(spark, rows))).items()}
    assert got == brute_classes(rows)


def near_copies(n=70):
    """A family of near copies, a chain that drifts away from them, and bystanders that share a passage."""
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(n):
        w = list(base)
        w[rnd.randrange(150)] = f"e{i}"
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(n, n + 12):
        for k in range(3):
            w[(i - n) * 12 + 4 * k] = f"c{i}.{k}"
        rows.append((i, " ".join(w)))
    return rows + [(n + 20 + k, " ".join(base[:40] + [f"z{k}.{j}" for j in range(60)])) for k in range(10)]


def test_set_sizes_are_verified():
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["ab", "AB", "b", "longer-than-eight", "longer-than-eighT", "é"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    buf, off = flat(pa.array(texts, pa.string()))
    n, digests, collides = J.verified_sets(buf, off)
    assert n.tolist() == [len(shingles(t)) for t in texts] and not collides.any()
    assert [[a == b for b in digests] for a in digests] == [[shingles(a) == shingles(b) for b in texts] for a in texts]
    row, token = J.shingle_sets(buf, off)
    assert np.bincount(row, minlength=80).tolist() == n.tolist() and all((np.diff(token[row == k].astype(object)) > 0).all() for k in range(80))
    narrow = J.Hashing(bits=8)
    n, _, collides = J.verified_sets(buf, off, narrow)
    row, _ = J.shingle_sets(buf, off, narrow)
    assert collides.any() and all(c or x == len(shingles(t)) for c, x, t in zip(collides, n.tolist(), texts, strict=True))


def test_overlaps_are_those_of_the_words():
    rnd = random.Random(9)
    for _ in range(300):
        x, y = (" ".join(rnd.choice("abC") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        a, b = shingles(x), shingles(y)
        assert J.overlap(x.encode(), y.encode(), 4) == (len(a), len(b), len(a & b))


@pytest.mark.parametrize("bits", [8, 13])
def test_ngram_join_with_hashes_that_collide(spark, bits):
    rows = corpus(6)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.linked(table(spark, rows), bits=bits)).items()}
    assert got == brute_classes(rows)


def test_false_links_start_another_attempt(spark, monkeypatch):
    rows = near_copies()
    docs = table(spark, rows).select("doc_id", "text")
    links = spark.createDataFrame([(0, 1), (0, 81), (95, 96)], "a long, b long")
    assert [tuple(r) for r in J.false_links(docs, links, 85, 4).orderBy("a").collect()] == [(0, 81), (95, 96)]
    seen, check = [], J.false_links
    monkeypatch.setattr(J, "false_links", lambda own, links, *a: (seen.append(links.count()), links if len(seen) == 1 else check(own, links, *a))[1])
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.linked(table(spark, rows))).items()}
    assert got == brute_classes(rows) and len(seen) == 2 and seen[1] == len(rows) - len({c for _, c in got.values()})


def test_a_large_family_is_dealt_to_many_tasks(spark):
    cands = J.LEAST_BLOCK // 150 * 6
    base = [f"b{k}" for k in range(150)]
    rows = [(i, " ".join([*base[: i % 150], f"e{i}", *base[i % 150 + 1 :]])) for i in range(cands)]
    seen, joined = [], J._joined
    try:
        J._joined = lambda r, *keys, **kw: (seen.append(r.groupBy(*keys).count().agg(F.max("count")).first()[0]), joined(r, *keys, **kw))[1]
        got = by_id(J.linked(table(spark, rows)))
    finally:
        J._joined = joined
    assert {r.component_id for r in got.values()} == {0} and seen[0] < cands / 3


@pytest.mark.parametrize(("block", "rows_of_a_block"), [(None, 2000), (3_000, 2000), (900, 2000), (900, 3)])
def test_families_beyond_a_block_lose_no_link(spark, block, rows_of_a_block, monkeypatch):
    monkeypatch.setattr(J, "PAIR_ROWS", rows_of_a_block)
    monkeypatch.setattr(J, "PIECE_ROWS", 2 * rows_of_a_block)
    rows = near_copies()
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.linked(table(spark, rows), block_tokens=block)).items()}
    assert got == brute_classes(rows)


@pytest.mark.parametrize("block", [4_000_000, 900])
def test_ngram_join_with_other_shingles_and_similarity(spark, block):
    rows = near_copies()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and parent[a] != parent[b]:
                x, y = sorted((parent[a], parent[b]))
                parent = {i: x if c == y else c for i, c in parent.items()}
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.linked(table(spark, rows), block_tokens=block, n_words=5, percent=80)).items()}
    assert got == {i: (len(s), parent[i]) for i, s in sets.items()}


def test_near_duplicate_stage_takes_five_words_and_80_percent(spark):
    base = [f"b{k}" for k in range(100)]
    copy = lambda n: " ".join([f"n{k}" if 40 <= k < 40 + n else w for k, w in enumerate(base)])
    rows = [(1, " ".join(base)), (2, copy(6)), (3, copy(9).replace("b", "c")), (4, copy(20).replace("b", "c"))]
    # 1 and 2: 86 of 106 shingles are shared, 0.81; of four words 88 of 106, 0.83; 3 and 4: less
    assert {r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, table(spark, rows), "").collect()} == {1, 3, 4}


def test_the_last_step_alone_finds_all_links(spark, monkeypatch):
    """Blocks of one set each: no links but those of the joins by shingle."""
    monkeypatch.setattr(J, "PAIR_ROWS", 4)
    monkeypatch.setattr(J, "PIECE_ROWS", 3)
    rows = near_copies(20)
    joined = J._joined
    monkeypatch.setattr(J, "_joined", lambda r, *keys, **kw: joined(r, *keys, **kw) if "token" in keys else joined(r.withColumn("alone", F.col("doc")), "alone", **kw))
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(J.linked(table(spark, rows), block_tokens=100)).items()}
    assert got == brute_classes(rows)


def test_trie_equals_brute_force():
    for seed in range(150):
        rnd = random.Random(seed)
        base = [set(rnd.sample(range(60), rnd.randint(1, 40))) for _ in range(3)]
        sets = []
        for _ in range(rnd.randint(1, 25)):
            b = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                b.discard(rnd.choice(sorted(b))) if rnd.random() < 0.5 and len(b) > 1 else b.add(rnd.randint(0, 80))
            sets.append(b)
        ids = rnd.sample(range(1000), len(sets))
        want = brute_sets(ids, sets)
        got, links = J.classes(ids, np.array([len(s) for s in sets]), [np.array(sorted(s)) for s in sets])
        of = dict(zip(ids, sets, strict=True))
        assert got == want and len(links) == len(sets) - len(set(want)) and all(100 * len(of[a] & of[b]) >= 85 * len(of[a] | of[b]) for a, b in links)


def brute_sets(ids, sets):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in zip(ids, sets, strict=True):
        for b, y in zip(ids, sets, strict=True):
            if 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return [find(i) for i in ids]


def test_ngram_join_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "c d"), (5, "e"), (5, "f"), (5, "f"), (None, a)]
    got = sorted((r.doc_id, r.component_id) for r in J.linked(table(spark, rows)).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 5), (5, 5), (5, 5)]
    kept = J.one_of_each(table(spark, rows))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 5, 5]


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)] + [(7, 7)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for n in {x for e in links for x in e}}


def brute_repeats(rows, k):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for x in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][x : x + k]), i)
    out = {}
    for i, w in words.items():
        lost = set()
        for x in range(len(w) - k + 1):
            if first[tuple(w[x : x + k])] < i:
                lost |= set(range(x, x + k))
        out[i] = (len(w), len(lost), b" ".join(x for j, x in enumerate(w) if j not in lost))
    return out


@pytest.mark.parametrize(("stretch", "buckets"), [(S.STRETCH, None), (700, None), (700, 1), (S.STRETCH, 3), (300, 4)])
def test_substring_dedup(spark, stretch, buckets, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    rows = corpus(4)
    got = by_id(S.without_repeats(table(spark, rows), keep_text=True, buckets=buckets))
    want = brute_repeats(rows, 13)
    assert {i: (r.n_words, r.n_removed, r.kept_text.encode()) for i, r in got.items()} == want
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got.values())


def frequent_phrase(n=300):
    """Texts full of one phrase in ever new surroundings, whose windows would share its minimiser."""
    rnd = random.Random(7)
    phrase = ["in", "the", "case", "of"]
    rows = [(i, " ".join(w for _ in range(12) for w in [*phrase, *(f"x{rnd.randrange(4000)}" for _ in range(9))])) for i in range(n)]
    return [*rows, *((n + i, rows[i * 3][1] + " and more") for i in range(20))]


def test_frequent_runs_of_words_are_no_minimisers(spark, monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 20_000)
    monkeypatch.setattr(S, "MINIMISER", 4)
    rows = frequent_phrase()
    docs = S.marked(table(spark, rows), True, "doc_id", "text")
    hot = S.frequent_runs(docs, S.text_bytes(docs, "text"), 40, id_col="id")
    buf, off = flat(pa.array(["in the case of"]))
    h = S.gram_hashes(S.word_hashes(buf, *S.words(buf, off)[:2]), 4)
    assert set(h.tolist()) <= set(hot.tolist()) and len(hot) < 20

    def largest(hot):
        order, size = S.Order(hot), {}
        buf, off = flat(pa.array([t for _, t in rows]))
        for bucket, *_, packed in S.stretch_rows(np.arange(len(rows)), np.zeros(len(rows), np.int64), buf, off, 13, 41, order):
            if packed:
                size[bucket] = size.get(bucket, 0) + len(S.unpack(packed)[3])
        return max(size.values()) / sum(size.values())

    lowest = np.uint64(0)
    real = S.Order.of
    monkeypatch.setattr(S.Order, "of", lambda self, g: np.where(real(self, g) == h[0] >> np.uint64(1), lowest, real(self, g)))  # the phrase as the least hash of all
    assert largest(np.zeros(0, np.uint64)) > 0.5 > 0.15 > largest(hot)
    for given in (None, 2):
        got = by_id(S.without_repeats(table(spark, rows), keep_text=True, buckets=given))
        assert {i: (r.n_words, r.n_removed, r.kept_text.encode()) for i, r in got.items()} == brute_repeats(rows, 13)


def test_sampled_runs_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE_BYTES", 4_000)
    rows = corpus(5, 90)
    got = by_id(S.without_repeats(table(spark, rows), keep_text=True))
    assert {i: (r.n_words, r.n_removed, r.kept_text.encode()) for i, r in got.items()} == brute_repeats(rows, 13)


def test_substring_dedup_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.without_repeats(table(spark, [(1, a), (3, a), (3, b), (3, b), (None, a)])).collect())
    assert got == [(1, 20, 0), (3, 20, 0), (3, 20, 0), (3, 20, 20)]


def dynamic(item, text):
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        cur = [i + 1]
        for j, b in enumerate(text):
            cur.append(min(prev[j] + (a != b), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_bit_vectors_equal_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(300):
        item = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 80))]
        text = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 120))]
        distance, end = D.best_match(item, text)
        assert distance == dynamic(item, text) == dynamic(item, text[:end]) or distance == len(item)


def best_window(item, text):
    """(least distance, start, length) of all windows of a text: the leftmost end, then the shortest window."""
    best = (len(item), 0, 0)
    for start in range(len(text)):
        prev = list(range(len(item) + 1))
        for k, w in enumerate(text[start : start + 2 * len(item)]):
            cur = [k + 1]
            for j, x in enumerate(item):
                cur.append(min(prev[j] + (x != w), prev[j + 1] + 1, cur[j] + 1))
            prev = cur
            if (prev[-1], start + k + 1, k + 1) < (best[0], best[1] + best[2], best[2]):
                best = (prev[-1], start, k + 1)
    return best


def edited(rnd, letters, n, new):
    letters = list(letters)
    for _ in range(n):
        x = rnd.randrange(max(1, len(letters)))
        letters[x : x + 1] = rnd.choice([[], [new()], [letters[x], new()]] if letters else [[new()]])
    return letters


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 6, 9, 10, 13, 17, 24, 31])))) for k in range(14)] + [(50, ""), (51, None), (None, "x y z")]
    rows = []
    for i in range(70):
        host = [rnd.choice(words) for _ in range(rnd.randint(0, 60))]
        for _ in range(i % 3):  # none, one or two passages, perhaps of the same item
            w = rnd.choice(items[:14])[1].split()
            at = rnd.randint(0, len(host))
            host[at:at] = edited(rnd, w, rnd.randint(0, D.allowed(len(w))), lambda: rnd.choice([*words, "new"]))
        rows.append((i, " ".join(host).upper() if i % 2 == 0 else ", ".join(host)))
    rows += [(90, None), (91, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word, r.n_words, r.similarity) for r in D.find_leaks(table(spark, rows), bench).collect() if r.distance <= D.allowed(r.item_words)}
    want = {}
    for i, t in rows:
        text = re.findall(r"\w+", (t or "").lower())
        for k, item in items[:14]:
            own = item.split()
            d, start, n = best_window(own, text)
            if d <= D.allowed(len(own)) and n:
                want[i, k] = (d, start, n, round(1 - d / len(own), 6))
    assert len(want) > 60 and set(got) <= set(want) and len(got) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in got)
    left = {r.doc_id for r in D.clean(table(spark, rows), bench).collect()}
    assert left == {i for i, _ in rows} - {i for i, _ in got}


def vocabulary(rnd, n=400):
    return ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(n)]


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.2])
@pytest.mark.parametrize("by", ["words", "characters"])
def test_recall_at_each_edit_rate(by, rate):
    rnd = random.Random(11)
    words = vocabulary(rnd)
    items = [" ".join(rnd.choice(words) for _ in range(n)) for n in (10, 12, 16, 22, 30, 42, 59, 90) for _ in range(3)]
    index, texts, truth = D.Index(list(range(len(items))), items), [], []
    for k in range(96):
        own = list(items[k % len(items)]) if by == "characters" else items[k % len(items)].split()
        new = (lambda: rnd.choice("etaoinshrdluxyz")) if by == "characters" else (lambda: rnd.choice(words))
        w = edited(rnd, own, int(rate * len(own) + 1e-9), new)
        host = [rnd.choice(words) for _ in range(rnd.randint(0, 200))]
        at = rnd.randint(0, len(host))
        host[at:at] = ["".join(w)] if by == "characters" else w
        texts.append(" ".join(host))
        truth.append(k % len(items))
    got = {(r, i): s for r, i, *_, s in index.matches(*flat(pa.array(texts, pa.string())))}
    assert sum((r, i) in got for r, i in enumerate(truth)) >= 0.95 * len(truth)
    assert all(s >= 0.8 - 1e-6 for s in got.values()) and sum(i != truth[r] for r, i in got) <= 2


def test_misspelt_passages_have_the_place_and_similarity_of_their_characters():
    rnd = random.Random(4)
    words = vocabulary(rnd)
    items = [" ".join(rnd.choice(words) for _ in range(35)) for _ in range(10)]
    hosts = [[rnd.choice(words) for _ in range(rnd.randint(0, 40))] for _ in range(30)]
    texts = [" ".join([*h, "".join("q" if c != " " and rnd.random() < 0.16 else c for c in items[i % 10]), *h]) for i, h in enumerate(hosts)]
    got = {(r, i): x for r, i, *x in D.Index(list(range(10)), items).matches(*flat(pa.array(texts, pa.string())))}
    assert set(got) == {(i, i % 10) for i in range(30)}
    for (r, i), (distance, n, start, length, similarity) in got.items():
        item, text = items[i], texts[r]
        edits = D.best_match(item, text)[0]
        assert distance > D.allowed(n) and similarity == pytest.approx(1 - edits / len(item), abs=1e-6) and edits <= D.allowed(len(item))
        assert abs(start - len(hosts[r])) <= 2 and abs(length - 35) <= 3


def misspell(rnd, text, share=0.16):
    return "".join("q" if c != " " and rnd.random() < share else c for c in text)


def test_misspelt_passages_are_found_however_many_items_hold_their_grams(monkeypatch):
    rnd = random.Random(8)
    words = vocabulary(rnd)
    own, other = ([rnd.choice(words) for _ in range(35)] for _ in range(2))
    copies = [" ".join(own)] * 7
    near = [" ".join([*other[:k], f"z{k}", *other[k + 1 :]]) for k in range(9)]
    periodic = " ".join(["tra la li lo lum"] * 9)
    items = [*copies, *near, periodic]
    texts = [" ".join([*rnd.sample(words, 20), misspell(rnd, t), *rnd.sample(words, 20)]) for t in (copies[0], near[0], periodic)]
    want = {(0, i) for i in range(7)} | {(1, i) for i in range(7, 16)} | {(2, 16)}
    for told, common in ((1 << 20, 64), (1, 64), (300, 4)):  # stretches, and grams left out with their share of the need
        monkeypatch.setattr(D, "TOLD", told, raising=False)
        monkeypatch.setattr(D, "COMMON", common, raising=False)
        got = {(r, i) for r, i, *_ in D.Index(list(range(17)), items).matches(*flat(pa.array(texts * 3, pa.string())))}
        assert got == {(r + 3 * k, i) for r, i in want for k in range(3)}


def test_misspelt_passages_are_found_where_other_items_are():
    rnd = random.Random(9)
    words = vocabulary(rnd)
    own = [rnd.choice(words) for _ in range(36)]
    text = misspell(rnd, " ".join(own), 0.12)
    short = [" ".join(text.split()[k : k + 4]) for k in range(0, 36, 4)]  # stand in the text as they are, all over the passage
    like = " ".join(w if k % 7 else "other" for k, w in enumerate(text.split()))  # an item that is found by its words there
    got = {i: (distance, n) for _, i, distance, n, *_ in D.Index(list(range(11)), [" ".join(own), *short, like]).matches(*flat(pa.array([f"before {text} after"], pa.string())))}
    assert set(got) == set(range(11)) and got[0][0] > D.allowed(36) and got[10][0] <= D.allowed(36)


def test_walks_are_as_long_as_the_items():
    rnd = random.Random(5)
    words = vocabulary(rnd)
    items = [" ".join(rnd.choice(words) for _ in range(n)) for n in range(1, 120)]
    index = D.Index(list(range(len(items))), items)
    held = []
    for group in index.by_words:
        lengths = [len(index.words[i]) for i in group.items]
        held += lengths
        assert group.walks.length == min(lengths) >= max(lengths) / D.RATIO - 1
        assert max(p[-1] for p in group.walks.picks) >= 1.4 * group.walks.length  # samples from all over the walk
    assert sorted(held) == list(range(D.SHORT + 1, 120))


def test_items_of_few_words_are_found():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    for n in range(1, 10):
        items = [" ".join(rnd.sample(words, n)) for _ in range(20)]
        texts, want = [], {}
        for i, item in enumerate(items * 3):
            w = item.split()
            if n >= 5 and i >= 20:  # the one edit that is allowed
                x = rnd.randrange(n)
                w[x : x + 1] = rnd.choice([[], ["new"], [w[x], "more"]])
            host = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
            at = rnd.randint(0, len(host))
            host[at:at] = w
            texts.append(" ".join(host))
            for k, own in enumerate(items):
                d = dynamic(own.split(), host)
                if d <= D.allowed(n):
                    want[i, k] = d
        got = {(r, k): d for r, k, d, *_ in D.Index(list(range(20)), items).matches(*flat(pa.array(texts, pa.string())))}
        assert set(want) <= set(got) and {k for k, d in got.items() if d <= D.allowed(n)} <= set(want) and {(i, i % 20) for i in range(60)} <= set(want)


def test_benchmark_in_parts(spark):
    items = spark.createDataFrame([(k, f"alpha beta gamma delta epsilon zeta eta theta item{k}") for k in range(30)], "item_id long, text string")
    parts = list(D.indexes(items, part_bytes=1000))
    assert len(parts) > 2 and sorted(i for p in parts for i in p.ids) == list(range(30))


@pytest.mark.parametrize("run", [E.exact_groups, J.linked, S.without_repeats])
def test_empty_tables(spark, run):
    assert run(table(spark, [(1, "a")]).where("doc_id < 0")).count() == 0


def test_empty_benchmark_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, [(1, "a b c"), (None, "d")])
    assert D.find_leaks(docs, none).count() == 0 and D.clean(docs, none).count() == 2
    assert D.find_leaks(docs.where("false"), none).count() == 0
    assert D.find_leaks(docs, spark.createDataFrame([(5, "a b c"), (6, "d")], none.schema)).select(F.sum("item_id")).first()[0] == 11
