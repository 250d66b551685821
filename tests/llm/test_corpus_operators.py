"""Deduplication, decontamination and language-model scoring against plain versions."""

from __future__ import annotations

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import decontaminate, eliasfano, lm, minhash, sentences, suffixes
from cadenza.llm.components import components
from cadenza.llm.vectext import Texts

from .conftest import table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def copies(seed: int = 6):
    """Texts with exact and near copies, shared passages and loners."""
    rng = random.Random(seed)
    rows, near, passage = [], [], " ".join(words(rng, 70, 5000))
    base = words(rng, 200, 5000)
    rows += [(i, " ".join(base), "en", "s") for i in (5, 3, 9)]
    for i in range(20, 32):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"edit{rng.random()}"
        rows.append((i, " ".join(w), "en", "s"))
        near.append(i)
    rows += [(i, " ".join(words(rng, 60, 5000)) + " " + passage + " " + " ".join(words(rng, 60, 5000)), "en", "s") for i in range(40, 46)]
    rows += [(i, " ".join(words(rng, 150, 5000)), "en", "s") for i in range(60, 80)]
    return rows


def shingles(text: str | None) -> Counter:
    w = (text or "").lower().split()
    return Counter(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def weighted_jaccard(a: Counter, b: Counter) -> float:
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 0.0


def classes(rows) -> dict[int, int]:
    ids = sorted({i for i, *_ in rows if i is not None})
    text = {i: t for i, t, *_ in rows}
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = {i: shingles(text[i]) for i in ids}
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and weighted_jaccard(s[a], s[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_near_classes_are_those_of_all_pairs(spark, odd_rows):
    rows = copies() + [(i + 1000 if i is not None else None, t, x, s) for i, t, x, s in odd_rows]
    got = minhash.near_classes(table(spark, rows, clashes=True)).collect()
    assert {r.doc_id: r.class_id for r in got} == classes(rows) and len(got) == len(classes(rows))
    text, firsts = {i: shingles(t) for i, t, *_ in rows if i is not None}, {}
    for i in sorted(text):
        firsts.setdefault(frozenset(text[i].items()) or i, i)
    assert {r.doc_id: r.text_id for r in got} == {i: firsts[frozenset(x.items()) or i] for i, x in text.items()}
    known = classes(rows)
    assert all((r.n_links > 0) == any(known[j] == r.class_id and firsts[frozenset(text[j].items()) or j] != r.text_id for j in text) for r in got)
    left = {r.doc_id for r in minhash.one_of_each(table(spark, rows)).collect()}
    assert left == {k for k, v in classes(rows).items() if k == v} | {None}
    assert minhash.near_classes(table(spark, [])).count() == 0


def test_left_over_misses_no_near_pair(spark):
    """Around one original, every pair at the threshold with a document outside the original's component comes up."""
    rng = np.random.default_rng(21)
    base = rng.choice(2**32, 120, replace=False)
    docs = {0: base}
    for i in range(1, 40):
        keep = rng.random(120) > rng.choice([0.02, 0.1, 0.2, 0.3])
        docs[i] = np.concatenate([base[keep], rng.choice(2**32, int(rng.choice([0, 5, 20, 40])), replace=False)])
    for i in range(40, 60):  # near others than the original
        other = docs[int(rng.integers(1, 40))]
        docs[i] = np.concatenate([other[rng.random(len(other)) > 0.05], rng.choice(2**32, 4, replace=False)])
    docs = {i: np.unique(x).astype("<u4") for i, x in docs.items()}

    def near(a, b):
        n = len(np.intersect1d(docs[a], docs[b]))
        return n >= 0.8 * (len(docs[a]) + len(docs[b]) - n) - 1e-9

    comp = {i: 0 if near(i, 0) else i for i in docs}
    pairs = spark.createDataFrame([(0, i, comp[i], comp[i] != 0) for i in docs if i], "pivot long, doc long, comp long, rest boolean")
    held = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in docs.items()], "doc_id long, print binary")
    got = {tuple(sorted((r.a, r.b))) for r in minhash.left_over(pairs, held, 0.8).collect()}
    want = {(a, b) for a in docs for b in docs if 0 < a < b and comp[a] != comp[b] and near(a, b)}
    assert want and want <= got
    assert len(got) < len(docs) * (len(docs) - 1) / 8


def test_multiplicities_count(spark):
    """Equal sets of shingles with other multiplicities aren't near."""
    one, many = "a b c d e f g h", "a b c d e f g h " * 6
    assert weighted_jaccard(shingles(one), shingles(many)) < 0.8
    got = {r.doc_id: r.class_id for r in minhash.near_classes(table(spark, [(1, one, "en", "s"), (2, many, "en", "s"), (3, many, "en", "s")])).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(8)
    m = 4096
    for _ in range(3):
        keys = rng.integers(1, 2**63, 60).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
        a = minhash.signatures(keys[wa > 0], np.zeros((wa > 0).sum(), np.int64), wa[wa > 0], 1, m)[0]
        b = minhash.signatures(keys[wb > 0], np.zeros((wb > 0).sum(), np.int64), wb[wb > 0], 1, m)[0]
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert (a == b).mean() == pytest.approx(want, abs=4 * math.sqrt(0.25 / m))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (21, 21)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 7, 8, 9)) and got[20] == got[21] == 20
    assert all(got[100 + i] == 100 for i in range(31))


def norm_words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def leak_pairs(docs, bench) -> set[tuple[int, int]]:
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    out = set()
    for d, t, *_ in docs:
        w = norm_words(t)
        for k, b in bench:
            item = norm_words(b)
            if d is None or not item or not w:
                continue
            n = len(item)
            if any(weighted_jaccard(grams(w[s : s + n]), grams(item)) >= 0.8 for s in range(max(1, len(w) - n + 1))):
                out.add((d, k))
    return out


def test_leaks_are_those_of_all_windows(spark, odd_rows):
    rng = random.Random(9)
    bench = [(k, " ".join(words(rng, n, 3000))) for k, n in enumerate((6, 20, 35, 35, 60))] + [(10, None), (11, ""), (12, "two words")]
    bench.append((13, bench[1][1]))
    docs = [(i + 1000 if i is not None else None, t, x, s) for i, t, x, s in odd_rows]
    for i in range(30):
        w = words(rng, 120, 3000)
        if i % 2:
            item = norm_words(bench[i // 2 % 5][1])
            at = rng.randrange(100)
            w[at:at] = item if i % 4 == 1 else [*item[:-1], "changed"]
        docs.append((i, (" ".join(w)).replace("x w", "x, W", i), "en", "s"))
    docs.append((50, "Two WORDS!", "en", "s"))
    docs.append((51, " ".join(norm_words(bench[4][1])[:-2]), "en", "s"))
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.leaks(table(spark, docs, clashes=True), items)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    want = leak_pairs(docs, bench)
    assert found == want and len(want) > 10
    left = decontaminate.clean(table(spark, docs), items)
    assert {r.doc_id for r in left.collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontaminate.leaks(table(spark, []), items).count() == 0
    assert decontaminate.leaks(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_the_index_reaches_the_whole_radius():
    """Two fingerprints within the radius agree in a block up to its errors."""
    rng = random.Random(3)
    masks = set(decontaminate._neighbourhood())
    for _ in range(300):
        flips = rng.sample(range(64), decontaminate.LeakRules().radius)
        x = sum(1 << b for b in flips)
        assert any((x >> 16 * j & 0xFFFF) in masks for j in range(4))


def sentence_list(text: str) -> list[list[str]]:
    out, now = [], []
    for line in (text or "").split("\n"):
        at = 0  # words since the last stop
        for w in WORD.findall(line):
            now.append(w)
            b = w.encode()
            if w[-1] in ".!?" or (at >= 24 and (5 * len(b) + b[0]) % 8 == 0):
                out.append(now)
                now = []
            at = 0 if w[-1] in ".!?" else at + 1
        if now:
            out.append(now)
            now = []
    return out


def removed(rows, k=2, n=20) -> dict[int, list[int]]:
    first: dict = {}
    spans = []
    for d, t in sorted({(d, t) for d, t, *_ in rows if d is not None and t is not None}):
        s = sentence_list(t)
        for i in range(len(s)):
            j = i + k
            while j <= len(s) and sum(map(len, s[i:j])) < n:
                j += 1
            if j <= len(s):
                key = tuple(w for x in s[i:j] for w in x)
                first.setdefault(key, (d, i))
                spans.append((key, d, i, j))
    out: dict[int, set] = {}
    for key, d, i, j in spans:
        if first[key] != (d, i):
            out.setdefault(d, set()).update(range(i, j))
    return {d: sorted(x) for d, x in out.items()}


def prose(rng, n):
    return [" ".join(words(rng, rng.randrange(1, 12), 900)) + rng.choice(".!?") for _ in range(n)]


def test_sentence_spans(spark, odd_rows):
    rng = random.Random(10)
    shared = prose(rng, 8)
    rows = [(i + 1000 if i is not None else None, t, x, s) for i, t, x, s in odd_rows]
    for i in range(12):
        s = prose(rng, 20)
        if i % 3 == 0:
            s[5:5] = shared
        if i == 7:
            s += s[:6]
        rows.append((i, "\n".join([" ".join(s[:9]), " ".join(s[9:])]), "en", "s"))
    df = table(spark, rows, clashes=True)
    got = {r.doc_id: list(r.sentences) for r in sentences.removals(df).collect()}
    want = removed(rows)
    assert got == want and set(want) >= {3, 6, 9, 7}
    out = {r.doc_id: r.text for r in sentences.cleaned(df).collect() if r.doc_id in want or r.doc_id in range(12)}
    for i, t, *_ in rows:
        if i in range(12):
            keep = [s for k, s in enumerate(sentence_list(t)) if k not in want.get(i, [])]
            assert sentence_list(out[i]) == keep
    assert sentences.removals(table(spark, [])).count() == 0


def test_passages_without_stops_are_found(spark):
    """Fifty words and more, pasted into the middle of sentences, with one stop, two or none inside."""
    rng, rows, planted = random.Random(41), [], set()
    for k in range(30):
        passage = words(rng, 60 + k, 5000)
        for at in range(20, (0, 40, 60)[k % 3], 20):
            passage[at] += "."
        for d in (2 * k, 2 * k + 1):
            rows.append((d, " ".join(words(rng, rng.randrange(5, 40), 5000) + passage + words(rng, rng.randrange(5, 40), 5000)) + ".", "en", "s"))
        planted.add(2 * k + 1)
    got = {r.doc_id for r in sentences.removals(table(spark, rows)).collect()}
    assert got <= planted and len(got) >= 0.95 * len(planted)


def matched_words(rows, n=50) -> dict[int, set[int]]:
    """Word places of each text inside a run of n words that another text has too."""
    where: dict = {}
    for d, t in {(d, t) for d, t, *_ in rows if d is not None}:
        w = WORD.findall(t or "")
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    out: dict[int, set[int]] = {}
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                out.setdefault(d, set()).update(range(i, i + n))
    return out


def places(spans) -> set[int]:
    return {i for a, b in spans for i in range(a, b)}


def test_suffix_repeats_cover_all_shared_runs(spark, odd_rows):
    rows = copies() + [(i + 1000 if i is not None else None, t, x, s) for i, t, x, s in odd_rows]
    got = suffixes.repeats(table(spark, rows, clashes=True)).collect()
    assert {r.doc_id: places(r.repeated) for r in got} == matched_words(rows)
    assert any(r.removable for r in got) and any(not r.removable for r in got)
    assert suffixes.repeats(table(spark, [])).count() == 0


def test_hot_grams_miss_no_shared_run(spark):
    """Texts that share what stands before a hot line, but not what follows, in any number of partitions."""
    rng = random.Random(21)
    line, lead = words(rng, 24, 5000), [words(rng, 40, 5000) for _ in range(10)]
    rows = [(i, " ".join(words(rng, 30, 5000) + lead[i % 10] + line + words(rng, 40, 5000)), "en", "s") for i in range(60)]
    want = matched_words(rows)
    assert len(want) == 60
    for parts in ("3", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.doc_id: r for r in suffixes.repeats(table(spark, rows), suffixes.SuffixRules(block_rows=4)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert {i: places(r.repeated) for i, r in got.items()} == want
        assert {i for i, r in got.items() if not places(r.removable)} == set(range(10))  # the first text of each lead keeps the passage


def test_matches_of_sorted_suffixes_extend_both_ways():
    """Suffixes of one gram, in any order: two match where what they share before and after the gram makes up the length."""
    rng, rules = random.Random(23), suffixes.SuffixRules()
    lead, trail = words(rng, 30, 50), words(rng, 30, 50)
    rows = []
    for i in range(200):
        k, m = rng.randrange(31), rng.randrange(31)
        rows.append((i // 2, 1000 * (i % 2) + 100, words(rng, 30 - k, 9) + lead[30 - k :], trail[:m] + words(rng, 30 - m, 9)))
    number = {w: n + 1 for n, w in enumerate(sorted({w for r in rows for w in r[2] + r[3]}))}
    blob = lambda ws: b"".join(number[w].to_bytes(4, "big") for w in ws)
    want: dict = {}
    for d, p, b, a in rows:
        for k in range(31):
            window = (*b[30 - k :], *a[: 30 - k])
            want.setdefault((k, window), []).append((d, p, k))
    shared = {(d, x) for (k, _), at in want.items() if len({d for d, *_ in at}) > 1 or len(at) > 1 for d, p, _ in at for x in range(p - k, p - k + 50)}
    for order in (rows, sorted(rows, key=lambda r: blob(r[3]))):
        doc, pos = (np.array([r[c] for r in order]) for c in (0, 1))
        got = suffixes.matches(np.full(len(order), 7), [blob(r[3]) for r in order], [blob(r[2][::-1]) for r in order], doc, pos, rules, presorted=order is not rows)
        assert {(d, x) for d, s, e, _, _ in got for x in range(s, e)} == shared


def test_removable_spans_leave_a_copy(spark):
    """Whatever is removed, every shared run stays somewhere."""
    rows = [(i, t, x, s) for i, t, x, s in copies(11)]
    gone = {r.doc_id: places(r.removable) for r in suffixes.repeats(table(spark, rows)).collect()}
    left = Counter()
    for d, t, *_ in rows:
        w = WORD.findall(t)
        left.update(x for k, x in enumerate(w) if k not in gone.get(d, ()))
    assert set(left) == {w for _, t, *_ in rows for w in WORD.findall(t)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_shared_windows_share_a_minimiser(seed):
    rng = random.Random(seed)
    rules = suffixes.SuffixRules()
    shared = words(rng, 50)
    a, b = words(rng, 20) + shared + words(rng, 9), words(rng, 3) + shared + words(rng, 30)
    t = Texts(pa.array([" ".join(a), " ".join(b)]))
    s, e, d = t.words()
    pos, _ = suffixes.minimisers(t.span_hash(s, e), d, rules)
    inside = lambda doc, lo, start: {int(p) - lo - start for p in pos if d[p] == doc and lo + start <= p <= lo + start + 30}
    assert inside(0, 0, 20) & inside(1, len(a), 3)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=200), st.integers(0, 100))
def test_elias_fano(values, extra):
    values = np.array(sorted(values), np.uint64)
    universe = int(values[-1] if len(values) else 0) + 1 + extra
    ef = eliasfano.EliasFano.encode(values, universe)
    back = eliasfano.read(eliasfano.load(eliasfano.dump(ef.parts())))
    if len(values):
        assert back.access(np.arange(len(values))).tolist() == values.tolist()
    ask = np.arange(universe)
    assert back.successor(ask).tolist() == np.searchsorted(values, ask, side="left").tolist()


def lm_rows(seed=12):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(30)]
    return [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(30)], k=rng.randrange(0, 40))) + (" Rare%d" % i if i % 5 == 0 else ""), "en", "s") for i in range(150)]


def plain_lm(rows, rules: lm.LMRules) -> dict:
    """The model with plain dictionaries, without quantisation."""
    texts = [(i, t or "") for i, t, *_ in rows]
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    train = [WORD.findall(lower(t)) for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for x in train for w in [*x, None])
    n, v = sum(c.values()), len(c)
    uni = lambda w: (c[w] + 1) / (n + v + 1)
    bi = Counter(p for x in train for p in zip(["^", *x], [*x, None], strict=True))
    bi = {k: m for k, m in bi.items() if m >= rules.min_count}
    tri = Counter(p for x in train for p in zip(["^", *x], x, [*x[1:], None], strict=False) if p[:2] in bi and p[1:] in bi)
    tri = {k: m for k, m in tri.items() if m >= rules.min_count}
    total = lambda u: c[None] if u == "^" else c[u]
    d = rules.discount

    def p2(u, w):
        back = 1 - sum(m - d for (a, _), m in bi.items() if a == u) / max(1, total(u))
        return max(bi.get((u, w), 0) - d, 0) / max(1, total(u)) + back * uni(w)

    def p3(t, u, w):
        if (t, u) not in bi:
            return p2(u, w)
        back = 1 - sum(m - d for (a, b, _), m in tri.items() if (a, b) == (t, u)) / bi[t, u]
        return max(tri.get((t, u, w), 0) - d, 0) / bi[t, u] + back * p2(u, w)

    out = {}
    for i, t in texts:
        x = WORD.findall(lower(t))
        score, before = 0.0, ["^", *x]
        for k, w in enumerate([*x, None]):
            score += math.log10(p3(before[k - 1], before[k], w) if k else p2("^", w))
        toks = [*x, None]
        out[i, t] = (len(toks), sum(c[w] > 0 for w in toks), n, sum(math.log10(uni(w)) for w in toks), score)
    return out


@pytest.mark.parametrize("head", [1 << 18, 12])
def test_lm_scores(spark, odd_rows, head):
    rows = lm_rows() + [(i + 1000 if i is not None else None, t, x, s) for i, t, x, s in odd_rows if not t or len(t) < 1000]
    rules = lm.LMRules(head=head, vocabulary=min(head, 1 << 13))
    rows += rows[:7]  # repeated rows come back as often
    got = lm.score(table(spark, rows, clashes=True), rules).collect()
    want = plain_lm(rows, rules)
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    text = {i: t or "" for i, t, *_ in rows}
    for r in got:
        w = want[r.doc_id, text[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], abs=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        if head > 100:  # with a small head the trie leaves words out
            assert r.score == pytest.approx(w[4], abs=0.02 * r.n_tokens)
        else:
            assert math.isfinite(r.score)


@pytest.mark.parametrize("sizes", [{}, {"batch_bytes": 400, "piece": 64, "shard": 300}])
def test_lm_keeps_n_grams_of_rare_words(spark, sizes):
    """Scores are those of the whole model however few words every task holds, and don't depend on batches and shards."""
    rows = lm_rows(seed=21)
    rows += [(2000 + i, f"so the odd Pair{k} Follows{k} now and pair{k} follows{k} here", "en", "s") for i, k in enumerate([*range(40)] * 2)]
    rules = lm.LMRules(head=8, vocabulary=8, **sizes)
    got = lm.score(table(spark, rows), rules).collect()
    want = plain_lm(rows, rules)
    assert len(got) == len(rows)
    whole = {r.doc_id: r.score for r in lm.score(table(spark, rows)).collect()}
    text = {i: t for i, t, *_ in rows}
    for r in got:
        w = want[r.doc_id, text[r.doc_id]]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], abs=1e-9)
        assert r.score == pytest.approx(w[4], abs=0.0005 * r.n_tokens)
        assert r.score == pytest.approx(whole[r.doc_id], abs=1e-9)


def test_lm_of_an_empty_table(spark):
    assert lm.score(table(spark, [])).count() == 0


def test_lm_tokens_of_a_batch_take_little_memory():
    """A batch's tokens are those of its texts one by one, and few texts' bytes are in arrays at once."""
    rng = random.Random(3)
    texts = [" ".join(f"Word{rng.randrange(5000)}" for _ in range(400)) for _ in range(1200)]
    texts[5:5] = [None, "", " \t", "x" * 700_000, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    lm.tokens(batch.slice(0, 2))
    tracemalloc.start()
    try:
        h, doc, n = lm.tokens(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(texts)
    assert peak < 12 * batch.nbytes
    one = [lm.tokens(batch.slice(i, 1))[0] for i in range(n)]
    assert h.tolist() == np.concatenate(one).tolist()
    assert doc.tolist() == np.repeat(np.arange(n), [len(x) for x in one]).tolist()


def test_lm_rows_of_many_bytes_go_one_by_one(spark):
    """Spark neither sorts the answers and texts, which holds a task's rows in memory, nor reads them by columns of thousands of rows."""
    plan = lm.score(table(spark, lm_rows()), lm.LMRules(batch_bytes=400, piece=64, shard=300))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    assert "Sort" not in plan and "parquet" not in plan.lower()


def test_quantised_probabilities_add_up():
    """Over all words and any context the interpolated model is a distribution, to within its codes."""
    rng = np.random.default_rng(1)
    v, n = 12, 5000
    seq = rng.choice(np.arange(2, v), n, p=np.arange(1, v - 1) / np.arange(1, v - 1).sum())
    g2, c2 = np.unique(seq[:-1] * v + seq[1:], return_counts=True)
    g3, c3 = np.unique((seq[:-2] * v + seq[1:-1]) * v + seq[2:], return_counts=True)
    counts = np.bincount(seq, minlength=v)
    uni = (counts + 1) / (n + v)
    keep2, keep3 = c2 >= 2, c3 >= 2
    keep3 &= np.isin(g3 // v, g2[keep2]) & np.isin(g3 % (v * v), g2[keep2])
    t = lm.Trie(lm.mapped(lm.build(v, uni, (g2[keep2], c2[keep2]), (g3[keep3], c3[keep3]), counts, 0.75)))
    w = np.arange(v)
    for a, b in ((-1, 5), (4, 5), (9, 11), (11, 2)):
        p = 10 ** t.logs(w, np.full(v, b), np.full(v, a), np.log10(uni))
        assert p.sum() == pytest.approx(1, abs=0.08)
