"""The training-data operators against brute force, round trips and held-out rows, with odd inputs."""

import hashlib
import io
import math
import re
import wave
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweave.llm import chat, labelled, linkgraph, media, mixing, oracle, packing, quality, queries, simhash, tokens, topk, toxicity
from pixelweave.llm.labelled import held_out

from ..oracle import same

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string, fp string, rank string, label string, score string, host string"
TEXTS = [None, "", "  \n", "one", "Ein Wort ", "a b c d e f", "a b c d e f", "x" * 3000, "lorem ipsum dolor " * 4000, "naïve café's 中文 ½ 😀", "end<|endoftext|>s"]


def odd(spark):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None, ["s0", None, "s1"][i % 3], None, *["clash"] * 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows + rows[5:6] + rows[5:6], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), oracle.oracle_sql()[name], sf)


# ---- 1


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(n)), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i, n in enumerate(rng.lognormal(3, 1, 600))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(3)).collect()))
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r.source] += r.size * r.times
        size[r.source] += r.size
        target[r.source] = r.target
        assert 0 <= r.times <= 3
    assert all(abs(taken[s] - target[s]) <= max(3, 0.01 * target[s]) for s in target)
    assert math.isclose(sum(target.values()), sum(size.values()))


def test_documents_are_drawn_with_their_own_probabilities(spark):
    rng = np.random.default_rng(14)
    rows = [(i, " ".join(["w"] * int(n)), "a" if i % 2 else "b") for i, n in enumerate(rng.lognormal(3, 1, 12_000))]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    drawn = defaultdict(list)
    for r in got:
        if r.size:
            drawn[r.source, len(bin(r.size)) - 2, round(r.p, 9)].append(r.times)
    checked, probabilities = 0, set()
    for (source, _, p), times in drawn.items():
        if p and len(times) >= 200:
            rate = np.mean([t - min(times) for t in times]) if len(set(times)) == 2 else float(p > 0.5)
            assert max(times) - min(times) <= 1 and abs(rate - p) < 4 * math.sqrt(p * (1 - p) / len(times)) + 0.01
            probabilities.add((source, p))
            checked += 1
    assert checked >= 6 and len(probabilities) == checked  # they differ by document


def test_equal_rows_do_not_overshoot(spark):
    rows = [(1, "w " * 50, "a")] * 40 + [(k, "w " * (20 + k), "b") for k in range(30)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source, bound in (("a", 1000), ("b", 25)):  # all equal rows are taken alike, so a can be half of them off
        own = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.times for r in own) - own[0].target) <= bound


def _targets(sizes, weights=(5, 2, 1), cap=3):
    """Share, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        share = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            out[s] += share[s]
            if out[s] > cap * sizes[s]:
                left += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                open_.discard(s)
    return out


def test_targets_share_the_excess_again(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8):
        sizes = {f"s{i}" if i else None: int(v) for i, v in enumerate(rng.lognormal(3, 2, n))}
        df = spark.createDataFrame(list(sizes.items()), "src string, source_size long")
        got = {r.src: r.target for r in mixing.targets(df).collect()}
        want = _targets(sizes)
        assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in sizes)


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == 13 and {r.size for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mix(empty(spark)).count() == 0 and mixing.repeat(empty(spark)).columns == empty(spark).columns
    assert mixing.repeat(odd(spark)).count() == sum(r.times for r in got)


# ---- 2


def _print(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + n]), seed=42).intdigest() for i in range(max(1, len(w) - n + 1))]
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def _classes(prints, radius):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            parent[find(int(j))] = find(i)
    return [find(i) for i in range(len(a))]


def test_components_equal_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [_print(r.text) for r in rows]
    root = _classes(prints, 2)
    least = defaultdict(lambda: 1 << 60)
    for r, c in zip(rows, root):
        least[c] = min(least[c], r.doc_id)
    want = {(r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, root)}
    assert {tuple(r) for r in queries.op2_simhash_bktree(spark, sf).collect()} == want


def test_a_dense_group_larger_than_a_shard_loses_no_link(spark):
    rng = np.random.default_rng(2)
    base, values = int(rng.integers(0, 2**63)), set()
    while len(values) < 700:
        v = base
        for b in rng.integers(0, 64, size=rng.integers(0, 6)):
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, 2, shard=40)).collect()}
    root = _classes(values, 2)
    groups = defaultdict(set)
    for v, c in zip(values, root):
        groups[c].add(simhash.signed(v))
    assert {frozenset(k for k in got if got[k] == r) for r in set(got.values())} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 2**12, (300, 2), dtype=np.uint64)
    q, node = simhash.BKTree(v).within(v[:50], 5)
    want = {(i, j) for i in range(50) for j in range(300) if np.bitwise_count(v[i] ^ v[j]).sum() <= 5}
    assert set(zip(q.tolist(), node.tolist())) == want
    assert simhash.BKTree(v[:0]).within(v[:3], 5)[0].size == 0


def test_near_copies_go_and_others_stay(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(4000)]
    rows, groups = [], []
    for g in range(60):
        text = rng.choice(words, 300).tolist()
        ids = []
        for k in range(1 + 5 * (g < 20)):
            t = list(text)
            for i in rng.choice(300, k % 4, replace=False):
                t[i] = "changed"
            ids.append(len(rows))
            rows.append((len(rows), " ".join(t)))
        groups.append(ids)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {g[0] for g in groups}


def _sets(texts):
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]


def _firsts(texts, similarity=0.8):
    """The least index of each group of near copies, by all pairs."""
    sets, root = _sets(texts), list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 10 * similarity * len(sets[i] | sets[j]) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def _kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.keep_one(df).collect()}


def test_near_copies_close_to_the_threshold_equal_all_pairs(spark):
    rng = np.random.default_rng(11)
    texts = []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(220)]
        tail = int(round(216 * (0.78 + 0.07 * g / 150)))  # the copy has the base's first shingles only
        texts += [" ".join(base), " ".join(base[: tail + 4])]
    likeness = [len(a & b) / len(a | b) for a, b in zip(_sets(texts)[::2], _sets(texts)[1::2])]
    assert min(likeness) < 0.79 and max(likeness) > 0.84
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    assert _kept(spark, texts) == _firsts(texts)


def test_crowds_that_share_a_passage_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    passage, texts = [f"p{i}" for i in range(200)], []
    for g in range(40):  # similar to others at about 0.67, or at 0.82 and more to one
        own = [f"g{g}w{i}" for i in range(50)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *own[:25], *[f"h{g}w{i}" for i in range(16)]])]
    texts += [" ".join([*passage, *[f"k{g}w{i}" for i in range(24)]]) for g in range(40)]
    assert _kept(spark, texts) == _firsts(texts)


def test_near_copies_under_clashing_names_nulls_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(100))
    names = ["__mark", "__k_id", "row", "doc_id", "mark", "id", "root", "gd", "text", "key", "n"]
    rows = [(k, 7, "x", i, 1, 2, 3, 4, t, 5, 6) for k, (i, t) in enumerate([(3, text), (2, text + " more"), (2, text + " more"), (None, text), (9, None), (8, " "), (7, "other words here"), (None, "other words here")])]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c in ('row', 'text') else 'long'}" for c in names))
    got = simhash.keep_one(df)
    assert got.columns == names and sorted((r.doc_id, r.text) for r in got.collect()) == [(2, text + " more"), (7, "other words here"), (8, " ")]


def test_a_gradient_of_near_copies_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 16)
    monkeypatch.setattr(simhash, "SHINGLES", 3000)
    rng = np.random.default_rng(15)
    base, texts = [f"b{i}" for i in range(150)], []
    for k in range(240):  # similar to some of the group, and less than the threshold to most
        w = list(base)
        for i in rng.choice(150, rng.integers(1, 9), replace=False):
            w[i] = f"x{rng.integers(40)}"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    want = _firsts(texts)
    assert 10 < len(want) < 200 and _kept(spark, texts) == want


def test_near_copies_of_documents_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 20000")
    rows = [(r.doc_id, re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), r.text or "").strip(" \t\n\v\f\r"))) for r in docs.select("doc_id", "text").collect()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, w in rows]
    at = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            at[x].append(k)
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    seen = set()
    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[:i]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                        root[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 60)
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least[top(k)], i)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(least.values())


def test_fingerprints_of_similar_sets_are_within_the_radius():
    rng, most = np.random.default_rng(16), {True: 0, False: 0}
    for n in (5, 6, 9, 10, 18, 31, 40, 100, 400):
        for _ in range(300):
            shared = rng.integers(0, 2**63, n, dtype=np.uint64)
            apart = int(n / 0.8 - n + 1e-9)  # of the least similarity that counts
            own = int(rng.integers(0, apart + 1))
            a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in (own, apart - own))
            assert simhash.similar(a, b)
            few = min(len(a), len(b)) < simhash.FEW
            most[few] = max(most[few], int(np.bitwise_count((simhash.set_print(a) ^ simhash.set_print(b)).view(np.uint64)).sum()))
    assert most[True] <= simhash.FEW_RADIUS and most[False] <= simhash.NEAR_RADIUS


def test_a_link_between_two_closer_pairs_stays(spark):
    texts = []
    for g in range(60):  # a-b and c-e are closest, b-c is within the threshold, and no other pair is
        w = [f"g{g}w{i}" for i in range(300)]
        texts += [" ".join(w[k : k + 204]) for k in (0, 31, 43, 12)]
    assert _firsts(texts) == set(range(0, 240, 4))
    assert _kept(spark, texts) == _firsts(texts)


def test_one_of_each_odd_group_stays(spark):
    out = simhash.keep_one(odd(spark))
    assert out.columns == odd(spark).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, i) for i in (0, 3, 5, 7, 8, 9, 10)] + [(True, 0)]
    assert simhash.keep_one(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd(spark)).collect()}
    assert {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5)} <= got


# ---- 3


def test_top_k_equals_a_scan_with_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 64)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 0.2, (400, 8)).round(1))]
    rows[7] = (7, None)
    rows[8] = (8, [None, *rows[8][1][1:]])
    rows[9] = (9, [float("nan")] * 8)
    rows[50] = (50, [float("inf")] * 8)
    rows += [(1000 + i, rows[100][1]) for i in range(30)] + [(1, rows[1][1]), (100, rows[3][1]), (2001, [0.5, 0.5]), (2050, [0.25, 1.0]), (None, rows[4][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, row int, shard int, asks int")
    asked = F.col("vec_id") % 50 == 0
    got = sorted(tuple(r) for r in topk.top_k(df, asked).collect())
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, own) in enumerate(good):
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(own, v)), i) for k, (i, v) in enumerate(good) if k != at and len(v) == len(own))
            want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s[:5])]
    assert got == sorted(want) and [g[1] for g in got if g[0] == 2050] == [1] and sum(g[0] == 100 for g in got) == 10
    assert topk.top_k(df.limit(0), asked).count() == 0


# ---- 4


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_counts_of_every_prefix_are_the_librarys(library):
    t = tokens.PrefixCounts(tokens.vocabulary())
    samples = ["Hello, it's we'll don't 'S x'RE ''s !'t", "a\x1cb \x1d", "½ ² ١٢ 中文字 日本", "😀😀 _a_b__ 1_2", "thnthatble erntionou " * 3, "!?" * 40, "<|endoftext|> a<|startoftext|>'s b", "naïve café’s", "ŉ Ŀ ŀ ſ ı ª µ"]
    for s in samples:
        bare, prefix = "".join(tokens.chunks(s)), t.every_prefix(s)
        ends = [i + 1 for i, c in enumerate(s) if tokens.chunks(c)]
        assert len(prefix) == len(bare) + 1
        assert prefix == [0, *(len(library.encode(s[:e], add_special_tokens=False).ids) for e in ends)]
        for budget in (0, 1, 3, 1000):
            n, c = t.longest_prefix(s, budget)
            assert prefix[n] == c <= budget and (n == len(bare) or prefix[n + 1 :][0] > budget or max(prefix[n + 1 :]) >= prefix[n])


def test_totals_and_budgets_count_each_word_once_without_its_prefixes(library):
    t = tokens.PrefixCounts(tokens.vocabulary())
    samples = [None, "", " \t\n", "a", "Straße déjà-vu,", "Hello, it's we'll don't 'S x'RE ''s !'t 12.5", "a\x1cb \x1d", "½ ² ١٢ 中文字 日本", "<|endoftext|> a<|startoftext|>'s b"]
    samples += [" thnthatble\nerntionou, öachpf-éréen's " * 40, "x" * 200 + " thndererinti " * 30, "İstanbul ﬁ " * 50]
    one_by_one = tokens.PrefixCounts(tokens.vocabulary())
    for budget in (0, 1, 7, 60, 2048):
        got = list(zip(*(v.tolist() for v in t.all_longest(samples, budget))))
        assert got == [(len(library.encode(x or "", add_special_tokens=False).ids), *one_by_one.longest_prefix(x, budget)) for x in samples]
    t = tokens.PrefixCounts(tokens.vocabulary())
    assert t.total("thnthatble erntionou thndererinti") == len(library.encode("thnthatble erntionou thndererinti", add_special_tokens=False).ids)
    assert len(t.wholes) == 3 and not t.words and not any(len(s) > tokens.HEAD for s in t.heads)
    t.all_longest(["thnthatble erntionou thndererinti " * 9], 20)
    assert len(t.wholes) == 3 and len(t.words) == 1  # the word at the budget


def test_counts_and_ids_are_the_librarys(spark, sf, library):
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_prefix_token_counts(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) and r.fit_tokens <= 2048 for r in got)
    ids, counts = tokens.Ids(tokens.vocabulary()), tokens.PrefixCounts(tokens.vocabulary())
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():  # one at a time and with blanks around it, too
        for t in (r.text, f" {r.text} \n\t"):
            assert array("I", ids.encode(t)).tolist() == library.encode(t, add_special_tokens=False).ids and counts.total(t) == want[r.doc_id]
    rows = tokens.token_counts(odd(spark), tokens.vocabulary(), prefixes=True).collect()
    assert len(rows) == 13 and {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {0}
    for r in rows:
        if r.doc_id is not None:
            assert r.n_tokens == len(library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids) == r.prefix_tokens[-1]
            assert r.n_bytes == len((TEXTS[r.doc_id] or "").encode())
    assert tokens.token_counts(empty(spark), tokens.vocabulary()).count() == 0


# ---- 5


def test_rules_and_parts_of_urls(spark):
    cases = {
        "https://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/en/2#x": ("example.org", "/en/2", "org/", "allow"),
        "http://badexample.org": ("badexample.org", "", None, "allow"),
        "http://x.com/de/?q": ("x.com", "/de/", "com/de/", "block"),
        "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
        "x.com/fr/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://y.net?a/b://c": ("y.net", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judge(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert linkgraph.judge(df.limit(0)).count() == 0


def test_propagation_equals_power_iteration(spark):
    rng = np.random.default_rng(6)
    n = 12
    w = rng.integers(0, 4, (n, n)) * (rng.random((n, n)) < 0.3)
    np.fill_diagonal(w, 0)
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i in range(n) for j in range(n) if w[i, j]], "src string, dst string, links long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h1", 0, 2), ("h2", 1, 1)], "host string, allowed long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in linkgraph.spread(edges, seeds).collect()}
    for k, (m, start) in enumerate(((w, [3, 0, 1]), (w.T, [0, 2, 1]))):
        s = np.array(start + [0] * (n - 3)) * 0.15 / 7
        share = m / np.maximum(m.sum(axis=1, keepdims=True), 1)
        x = s.copy()
        for _ in range(linkgraph.ROUNDS):
            x = s + 0.85 * x @ share
        assert np.allclose([got.get(f"h{i}", (0, 0))[k] for i in range(n)], x)


def test_links_to_blocked_hosts_block(spark):
    html = lambda *hosts: " ".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [(0, "http://bad.com/de/1", ""), (1, "http://farm.net/1", html("bad.com", "bad.com")), (2, "http://good.org/1", html("fine.net")), (3, "http://fine.net/1", html("good.org", "/own"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in linkgraph.judge(df).collect()} == {0: "block", 1: "block", 2: "allow", 3: "allow"}


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 18
    rows = [(i, f"http://c{i}.net/1", f'<a href="http://c{i + 1}.net/1">') for i in range(n)] + [(n, f"http://c{n}.net/1", '<a href="http://bad.com/de/1">'), (n + 1, "http://bad.com/de/1", "")]
    got = linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.verdict for r in got} == {"block"}
    assert all(np.isclose(r.distrust, 0.15 * 0.85 ** (n + 1 - r.page_id), rtol=1e-9, atol=0) for r in got)


def test_converged_propagation_solves_the_equations(spark):
    w = np.array([[0, 2, 0, 1], [1, 0, 3, 0], [1, 0, 0, 1], [0, 1, 1, 0]])
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(w[i, j])) for i in range(4) for j in range(4) if w[i, j]], "src string, dst string, links long")
    seeds = spark.createDataFrame([("h0", 3, 0), ("h1", 0, 2)], "host string, allowed long, blocked long")
    got = {r.host: (r.trust, r.distrust) for r in linkgraph.spread(edges, seeds, damping=0.5, rounds=None).collect()}
    for k, (m, start) in enumerate(((w, [3, 0, 0, 0]), (w.T, [0, 2, 0, 0]))):
        share = m / m.sum(axis=1, keepdims=True)
        want = np.linalg.solve(np.eye(4) - 0.5 * share.T, 0.5 / 5 * np.array(start))
        assert np.allclose([got[f"h{i}"][k] for i in range(4)], want, rtol=0, atol=1e-11)


# ---- 6, 10


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_cnn_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_scores_do_not_depend_on_batches_or_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, n)) + (" awful" if k % 2 else "") for k, n in enumerate(rng.integers(1, 400, 60))]
    m = toxicity.train(texts, np.array([k % 2 for k in range(60)], float))
    whole = toxicity.Scorer(m).scores([*texts, None, "", "x " * 5000])
    monkeypatch.setattr(toxicity, "BLOCK", 100)
    monkeypatch.setattr(toxicity, "CHARACTERS", 500)
    assert np.allclose(whole, toxicity.Scorer(m).scores([*texts, None, "", "x " * 5000]), atol=1e-5)
    assert np.allclose(whole[:60], [toxicity.Scorer(m).scores([t])[0] for t in texts], atol=1e-5)
    assert np.mean([(s >= 0.5) == bool(k % 2) for k, s in enumerate(whole[:60])]) > 0.9


def test_scores_equal_nested_loops():
    rng = np.random.default_rng(21)
    texts = [" ".join(rng.choice(["ab", "awful", "Cde!", "longerword", "x"], n)) for n in (1, 2, 3, 7, 12)] + ["", None]
    m = toxicity.train([t or "" for t in texts], np.array([0, 1, 0, 1, 0, 1, 0.0]))
    want = []
    for t in texts:
        vectors = []
        for w in (t or "").split() or [None]:
            ids = [i for i in toxicity.parts(w) if i] if w else []
            vectors.append(sum((m.embedding[i] for i in ids), np.zeros(toxicity.DIM)) / max(len(ids), 1))
        blank = [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1)
        x, k = m.offset, 0
        for f in m.filters:
            for c in range(toxicity.FILTERS):
                best = max(sum(float((vectors + blank)[i + j] @ f[j][:, c]) for j in range(len(f))) for i in range(len(vectors)))
                x += max(best + m.bias[k], 0) * m.weights[k]
                k += 1
        want.append(1 / (1 + math.exp(-x)))
    assert np.allclose(toxicity.Scorer(m).scores(texts), want, atol=1e-4)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(22)
    n, size = len(toxicity.WIDTHS) * toxicity.FILTERS, 40
    filters = [rng.normal(0, 0.5, (w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    m = toxicity.Model(rng.normal(0, 0.5, (size, toxicity.DIM)), filters, rng.normal(0, 0.2, n), rng.normal(0, 0.5, n), 0.1, {})
    m.embedding[0] = 0
    table = np.concatenate([np.zeros((1, toxicity.PARTS), np.int32), rng.integers(0, size, (12, toxicity.PARTS)).astype(np.int32)])
    streams = [np.array([*rng.integers(1, 13, k), 0, 0]) for k in (1, 2, 5, 9)]
    y = np.array([0, 1, 1, 0.0])
    loss, grads = toxicity.gradients(m, table, streams, y)
    for values, grad in zip([m.embedding, *m.filters, m.bias, m.weights], grads):
        for _ in range(25):
            at = tuple(int(rng.integers(0 if k else int(values is m.embedding), d)) for k, d in enumerate(values.shape))
            kept, around = values[at], []
            for e in (1e-6, -1e-6):
                values[at] = kept + e
                around.append(toxicity.gradients(m, table, streams, y)[0])
            values[at] = kept
            assert abs((around[0] - around[1]) / 2e-6 - grad[at]) < 1e-5
    m.offset += 1e-6
    assert abs((toxicity.gradients(m, table, streams, y)[0] - loss) / 1e-6 - grads[-1]) < 1e-4


def test_classifiers_take_odd_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    none = labels.limit(0)
    for op in (toxicity.classify, quality.classify):
        assert op(odd(spark), labels).count() == 13 and op(odd(spark), none).count() == 13 and op(empty(spark), labels).count() == 0
    assert toxicity.keep_clean(odd(spark), none).count() == 13 and quality.keep_good(odd(spark), none).columns == odd(spark).columns
    got = {r.doc_id: r.held_out for r in toxicity.classify(odd(spark), none).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 5 == 0) for k, v in got.items() if k is not None)
    assert labels.where(held_out(F.col("doc_id"))).count() < labels.count()


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_hierarchical_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.98 * len(rows)


def _posteriors(rows, rate):
    """Host and path posteriors and scores by plain sums over the other rows."""
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    p = [sigmoid(r[2] + math.log(rate / (1 - rate))) for r in rows]

    def strength(groups):  # groups of groups of probabilities
        between = noise = weight = total = common = 0.0
        for group in groups:
            flat = [x for part in group for x in part]
            mean = sum(flat) / len(flat)
            between += sum(len(part) * (sum(part) / len(part) - mean) ** 2 for part in group)
            noise += (len(group) - 1) * mean * (1 - mean)
            weight += len(flat) - sum(len(part) ** 2 for part in group) / len(flat)
            total, common = total + len(flat), common + len(flat) * mean * (1 - mean)
        spread = (between - noise) / max(weight, 1e-9)
        if max(map(len, groups)) < 2 or spread <= 0:
            return quality.MOST
        return min(max(common / total / spread - 1, quality.LEAST), quality.MOST)

    by = defaultdict(lambda: defaultdict(list))
    for r, x in zip(rows, p):
        by[r[0]][r[1]].append(x)
    a = strength([[[x for part in paths.values() for x in part] for paths in by.values()]])
    b = strength([list(paths.values()) for paths in by.values()])
    out = []
    for i, r in enumerate(rows):
        others = [(q[0], q[1], x) for k, (q, x) in enumerate(zip(rows, p)) if k != i]
        mean = lambda xs, m, prior: (sum(xs) + m * prior) / (len(xs) + m)
        every = min(max(mean([x for _, _, x in others], 1, rate), 1e-3), 1 - 1e-3)
        host = mean([x for h, _, x in others if h == r[0]], a, every)
        path = mean([x for h, q, x in others if (h, q) == r[:2]], b, host)
        out.append((host, path, sigmoid(r[2] + math.log(path / (1 - path)))))
    return out


def test_posteriors_equal_plain_sums_over_the_other_documents(spark):
    rng = np.random.default_rng(12)
    rows = []
    for host, paths in (("a", 4), ("b", 2), (None, 2), ("c", 1), ("d", 3)):
        level = rng.normal(0, 0.6)
        for k in range(paths):
            rows += [(host, None if k == 1 else f"p{k}", float(x)) for x in rng.normal(level + rng.normal(0, 0.8), 1, int(rng.integers(1, 60)))]
    rows += [("lonely", "p", -3.0), ("a", "p0", rows[0][2])]
    df = spark.createDataFrame(rows, "host string, path string, llr double")
    by = quality.sites(df, 0.7)
    got = sorted((r.llr, r.host_posterior, r.path_posterior, r.score) for r in quality._combined(df, by).collect())
    want = sorted((r[2], *w) for r, w in zip(rows, _posteriors(rows, 0.7)))
    assert np.allclose(got, want, atol=1e-9) and any(quality.LEAST < x < quality.MOST for x in by.strengths)
    alone = quality._combined(df.where("host = 'lonely'"), by).first()  # no other document there: the global prior
    assert np.isclose(alone.path_posterior, alone.host_posterior) and 0.3 < alone.path_posterior < 0.9


def test_the_prior_and_samples_leave_out_held_out_labels(spark):
    labels = spark.createDataFrame([(i, int(zlib.crc32(str(i).encode()) % 5 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    assert quality._prior(labels) == 0.01
    docs = spark.createDataFrame([(i, "x" * (i % 7 * 10)) for i in range(100, 300)], "doc_id long, text string")
    got = labelled.sample(docs, labels, "quality", size=30).collect()
    assert len(got) == 30 and {r.label for r in got} == {0}  # as many as asked for, though half of the labels have no text
    short = labelled.sample(docs, labels, "quality", size=30, chars=500).collect()
    assert [r.text for r in short] == [r.text for r in got][: len(short)] and sum(len(r.text) for r in short) <= 500 < sum(len(r.text) for r in got[: len(short) + 1])


# ---- 7


def test_escapes_are_reversible_and_hide_control_strings():
    for t in (chat.START, "<\\|", "<\\\\|im_end|>", "<|<|", "a<b|c<", "|>", "", chat.SEP + chat.END):
        e = chat.escape(t)
        assert chat.unescape(e) == t and "<|" not in e


def test_masks_by_search_equal_a_scan():
    rng = np.random.default_rng(8)
    for _ in range(50):
        cuts = np.sort(rng.choice(60, 12, replace=False))
        spans = cuts.reshape(-1, 2)
        starts = np.sort(rng.integers(0, 60, 25))
        ends = np.minimum(starts + rng.integers(1, 4, 25), 60)
        want = [any(a < e and s < b for s, e in spans) for a, b in zip(starts, ends)]
        assert chat.loss_tokens(starts, ends, spans).tolist() == want


def test_conversations_in_runs_read_back(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "\n\nhello 😀.<"), (1, 2, "assistant", None), (1, None, None, probe), (1, 1, "assistant", "\n\nhello 😀.<"), (2, 0, "user", "x"), (None, 0, "assistant", probe)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    path = tokens.vocabulary("byte_bpe_50k.json")
    for run in (5, 1_000_000):
        formatted = chat.format_conversations(df, path, run=run)
        got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
        for c in (1, 2, None):
            turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
            loss = "".join(t for *_, r, t in turns if r == "assistant")
            assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
            assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in formatted.collect():
        assert all(len(x) == len(r.token_ids) for x in (r.token_starts, r.token_ends, r.loss_mask)) and r.turns == len(r.spans)
    assert chat.read_back(chat.format_conversations(df.limit(0), path)).count() == 0


# ---- 8


def test_clips_hold_the_texts(spark):
    rows = {r.doc_id: r for r in media.store(odd(spark)).collect()}
    found = {r.doc_id: r for r in media.fingerprints(odd(spark)).collect()}
    for i, t in enumerate(TEXTS):
        if i == 4:
            continue
        data = (t or "").encode()
        payload = data + b" " * (max(192, -(-len(data) // 192) * 192) - len(data))
        with wave.open(io.BytesIO(bytes(rows[i].media))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == payload
        f = found[i]
        assert (f.n_bytes, f.payload_bytes, f.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-16:]))
        assert f.payload_sha256 == hashlib.sha256(payload).hexdigest() and f.media_sha256 == hashlib.sha256(bytes(rows[i].media)).hexdigest()
        assert len(f.fp_times) == len(f.fp_codes) and f.fp_times == sorted(f.fp_times)
    assert found[5].fp_codes == found[6].fp_codes and media.fingerprints(empty(spark)).count() == 0


def _landmarks(payload):
    """Pairs of spectral peaks by a direct transform and plain loops."""
    n = -(-len(payload) // media.HOP)
    x = np.full(n * media.HOP + media.FRAME, 128.0)
    x[: len(payload)] = list(payload)
    angle = 2j * np.pi * np.outer(np.arange(1, media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    rows = []
    for k in range(n):
        frame = x[k * media.HOP : k * media.HOP + media.FRAME] - 128
        rows.append(np.abs(np.exp(-angle) @ ((frame - frame.mean()) * hann)))
    power, peaks = np.array(rows), []
    for t in range(n):
        for f in range(power.shape[1]):
            around = power[max(t - 1, 0) : t + 2, max(f - media.REACH, 0) : f + media.REACH + 1]
            if power[t, f] > 0.05 and power[t, f] >= around.max() - 1e-9:
                peaks.append((t, f, media.STEPS * math.log2(power[t, f])))
    out = set()
    for i, (t, f, level) in enumerate(peaks):
        for u, g, other in peaks[i + 1 : i + 1 + media.FAN]:
            out.add((t, f, g, u - t, other - level))
    return out


def test_fingerprints_equal_a_direct_transform(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars between 200 and 1500").limit(10).collect()]
    payloads = [(b := t.encode()) + b" " * (-len(b) % 192) for t in texts]
    for payload, (times, codes) in zip(payloads, media.fingerprint(payloads)):
        got = {(int(t), int(c) >> 17, int(c) >> 12 & 31, int(c) >> 6 & 63): (int(c) & 63) - 32 for t, c in zip(times, codes)}
        want = {w[:4]: w[4] for w in _landmarks(payload)}
        # magnitudes are rounded to tenths, so that a few close neighbours are equal
        both = got.keys() & want.keys()
        assert len(both) >= 0.9 * max(len(got), len(want)) and all(abs(got[k] - min(max(want[k], -32), 31)) <= 1.1 for k in both)


def test_fingerprints_do_not_depend_on_other_clips_or_blocks(monkeypatch):
    rng = np.random.default_rng(13)
    payloads = [bytes(rng.integers(32, 127, 192 * k).astype(np.uint8)) for k in (1, 5, 2, 40, 1)] + [b" " * 192]
    whole = media.fingerprint(payloads)
    monkeypatch.setattr(media, "BLOCK", 7)
    for p, a, b in zip(payloads, whole, media.fingerprint(payloads)):
        alone = media.fingerprint([p])[0]
        assert all((x == y).all() and (x == z).all() for x, y, z in zip(a, b, alone))
    assert [len(t) > 0 for t, _ in whole] == [True] * 5 + [False]


def test_distinct_short_texts_have_distinct_fingerprints(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").where("text is not null").collect()]
    texts = list(dict.fromkeys(t for x in texts for t in (x[:4000], " ".join(x.split()[:6]), " ".join(x.split()[6:13])) if len(t.encode()) >= 32))
    payloads = [(b := t.encode()) + b" " * (-len(b) % 192) for t in texts]
    codes = [(t.tobytes(), c.tobytes()) for t, c in media.fingerprint(payloads)]
    assert len(texts) > 1500 and len(set(codes)) >= 0.99 * len(texts)


# ---- 9


def test_packing_is_gapless_whole_and_tight(spark, sf, library):
    rows = queries.op9_residual_packing(spark, sf).collect()
    want, total = set(), 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = array("I", [*library.encode(r.text or "", add_special_tokens=False).ids, 0])
        total += len(ids)
        want |= {(r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(total / 2048) * 1.02 + 1


def test_packing_in_a_tree_is_as_good_as_in_one(spark):
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 1500, 3000).tolist()
    items = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(40)
    for least, loss in ((50, 1.03), (packing.LEAST, 1.0)):
        got = packing.pack(items, 2048, fan=3, least=least).collect()
        bins = defaultdict(int)
        for r in got:
            bins[r.sequence_id] += r.length
        assert len(got) == 3000 and max(bins.values()) <= 2048
        assert len(bins) <= len(packing.best_fit(sizes, 2048)) * loss


def test_packing_odd_rows(spark):
    got = packing.pack_documents(odd(spark), tokens.vocabulary()).collect()
    assert len({r.doc_id for r in got}) == 11 and {r.length for r in got if r.doc_id in (0, 1, 2)} == {1}
    assert packing.pack_documents(empty(spark), tokens.vocabulary()).count() == 0
