"""Nulls, empty and very long texts, repeated rows, empty tables, clashing names: defined results, no crash."""

import re

import numpy as np
import pytest

from pyspark.sql import functions as F
from test_queries import luhn, pii_base

from tessera.llm import components, decontam, embedding_dedup, kneser_ney, mixing, pii, ppm, secret_scan, sharding, simhash, toxicity
from tessera.llm.common import LOWER


FIRST = "the quick brown fox jumps over the lazy dog and runs away from it all"


@pytest.fixture(params=["odd", "empty", "clash"])
def docs(request):
    return request.getfixturevalue(request.param)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_secrets(docs):
    found = secret_scan.find_secrets(docs).select("doc_id", "secrets").collect()
    assert len(found) == docs.count() and all(r["secrets"] is not None for r in found)


def test_entropy_spans_and_allow_list():
    hot = b"key 9fK2xLq8ZtR4vB7nM1cW6 end"
    (kind, a, b), = secret_scan.scan(hot)
    assert kind == "entropy_base64" and hot[a:b] == b"9fK2xLq8ZtR4vB7nM1cW6"
    for harmless in (b"123e4567-e89b-12d3-a456-426614174000", b"example9fK2xLq8ZtR4vB7nM1c", b"1234567890123456789012", b"thehingthatoneringthesewords", b"xyz1xyz1xyz1xyz1xyz1xyz1"):
        assert secret_scan.scan(harmless) == []


def test_allow_list_spares_what_is_around():
    """A harmless word hides itself, not the whole run; keys of letters alone are found."""
    key = "9fK2xLq8ZtR4vB7nM1cW6pJ3sD5gH0yTqE8uXaNz"
    for run in (f"/srv/sample/keys/{key}", f"{key}/test_key/{key[::-1]}", f"{key}{key[::-1]}xxxxxx{key}", "qWzRtYpLkJhGfDsAxCvBnM"):
        text = f"see {run} end"
        spans = secret_scan.scan(text.encode())
        assert spans and all(4 <= a < b <= 4 + len(run) and "sample" not in text[a:b] and "test_key" not in text[a:b] for _, a, b in spans)
    for harmless in ("/srv/sample/dir/plain_words_in_lower_case", "getUserAccountInformationByIdentifier"):
        assert secret_scan.scan(harmless.encode()) == []


def test_entropy_is_exact():
    import math
    import random

    rng = random.Random(3)
    run = "".join(rng.choice("abcdef0123456789"[: rng.choice((2, 16))]) for _ in range(400))
    hot = set()
    for i in range(len(run) - 19):
        w = run[i : i + 20]
        h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
        if h >= 2.9:
            hot |= set(range(i, i + 20))
    assert {i for a, b in secret_scan.hot_windows(run, 20, 2.9) for i in range(a, b)} == hot


def test_ppm(docs):
    scored = ppm.score(docs, docs["doc_id"] != 2).collect()
    assert len(scored) == docs.count()
    for r in scored:
        assert r["n_known"] <= r["n_tokens"] and r["score"] <= 0 and np.isfinite(r["base_score"])
    empty = [r for r in scored if r["doc_id"] in (3, 4, 5)]
    assert all(r["n_tokens"] == 1 for r in empty)


def counted_windows(texts, order):
    from tessera.llm import ngrams

    counter = ngrams.Counter()
    for codes, _ in ngrams.chunks(texts, order):
        counter.add(codes)
    return counter.take()


def test_ppm_is_a_distribution():
    """The probabilities of all bytes after any context sum to one."""
    from tessera.llm import ngrams

    trie = ppm.Trie(3, *counted_windows([b"abracadabra", b"banana band", b"cabana"], 3))
    for context in (b"abr", b"ban", b"zzz", b"zan", bytes([ngrams.PAD]) * 3):
        base = int.from_bytes(context, "big") << 8
        p = 10 ** trie.logp(np.array([base + s for s in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-9) and (p > 0).all()


def brute_ppm(training, texts, order):
    """log10 probability of each text, byte by byte, with sets of excluded bytes."""
    from collections import Counter
    from math import log10

    from tessera.llm import ngrams

    seen = {}
    for t in training:
        s = [ngrams.PAD] * order + list(t) + [ngrams.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    out = []
    for t in texts:
        s, total = [ngrams.PAD] * order + list(t) + [ngrams.END], 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                here = {b: n for b, n in seen.get(tuple(s[i - k : i]), {}).items() if b not in gone}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                total += log10((here[s[i]] if s[i] in here else len(here)) / whole)
                if s[i] in here:
                    break
                gone |= set(here)
            else:
                total -= log10(256 - len(gone))
        out.append(total)
    return out


def test_ppm_against_brute_force(spark):
    """Scores are those of the whole trie, however few windows and words are broadcast."""
    assert ppm.ORDER == 6 and ppm.MAX_NODES == 1_000_000
    rows = [(i, w) for i, w in enumerate(["abracadabra banana", "banana band zebra", "a cabana bar", "", "zzz abracadabrb bananc \u00e9", "band abra", None])]
    docs = spark.createDataFrame([*rows, rows[4], (None, "band abra")], "doc_id long, text string")
    plain = [(t or "").encode() for _, t in rows]
    for order in (2, 3, 6):
        want = brute_ppm(plain[:3], plain, order)
        for most in (0, 5, 10_000):
            got = ppm.score(docs, docs["doc_id"] < 3, order=order, max_nodes=most, max_words=most).collect()
            assert len(got) == 9
            for r in got:
                assert r["score"] == pytest.approx(want[5 if r["doc_id"] is None else r["doc_id"]])
    named = docs.selectExpr("concat('n', doc_id) AS doc_id", "text")
    assert {r["doc_id"] for r in ppm.score(named, named["doc_id"] < "n3").collect()} == {None, *(f"n{i}" for i in range(7))}


def test_ppm_long_frequent_words(spark):
    """A word too long to be broadcast counts like any other."""
    from math import log10

    long = "=" * 1000
    docs = spark.createDataFrame([(i, f"{long} w{i % 3}") for i in range(60)], "doc_id long, text string")
    n, v = 3 * 60, 5
    for r in ppm.score(docs, docs["doc_id"] >= 0).collect():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 3, n)
        assert r["base_score"] == pytest.approx(sum(log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in (60, 20, 60)))


def test_ppm_groups_and_requests(spark, monkeypatch):
    """Small buffers and groups of texts change nothing."""
    from tessera.llm import ngram_shards, ngrams

    rows = [(i, " ".join(f"w{(i * j) % 37}x{j % 5}" for j in range(40))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole = {r["doc_id"]: r for r in ppm.score(docs, docs["doc_id"] % 2 == 0, max_nodes=50, max_words=5).collect()}
    want = brute_ppm([t.encode() for i, t in rows if i % 2 == 0], [t.encode() for _, t in rows], 6)
    for i, _ in rows:
        assert whole[i]["score"] == pytest.approx(want[i])
    # what a task hands on is cut at these sizes
    codes = counted_windows([t.encode() for _, t in rows], 6)[0]
    parts = list(ngram_shards.by_shard(codes, 6, 8, np.arange(len(codes))))
    assert sorted(np.concatenate([p[1] for p in parts]).tolist()) == sorted(codes.tolist())
    assert all((np.diff(p[1].astype(np.int64)) > 0).all() and (codes[p[2]] == p[1]).all() for p in parts)
    assert (ngram_shards.unpack(ngram_shards.pack(np.sort(codes), True), np.uint64, True) == np.sort(codes)).all()
    monkeypatch.setattr(ngrams, "CHUNK", 64)
    counter = ngram_shards.GramSink(6, 8)
    counter.counter.limit, counter.counter.buffer = 16, 16
    batches = [*counter.add([t.encode() for _, t in rows]), *counter.rest()]
    assert len(batches) > 1 and sum(ngram_shards.unpack(b.as_py(), np.int64).sum() for x in batches for b in x.column("b")) == sum(len(t) + 1 for _, t in rows)


def test_ppm_adaptive():
    assert ppm.adaptive_code_length(b"abab" * 200) < ppm.adaptive_code_length(bytes(range(97, 123)) * 31) < 8 * 806
    assert ppm.adaptive_code_length(b"") == pytest.approx(8)


def test_mix(docs):
    planned = mixing.mix(docs)
    rows = planned.collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    places = [r["position"] for r in rows if r["position"] is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mix_nulls_are_a_source(odd):
    rows = mixing.mix(odd).collect()
    assert {r["source_size"] for r in rows if r["source"] is None} == {15} and {r["size"] for r in rows if r["doc_id"] == 3} == {0}


def brute_targets(sizes, limit=3):
    """Targets by the rule's words: share, stop those above their limit, share again."""
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes))}
    full, total = set(), sum(sizes.values())
    while True:
        left, w = total - sum(limit * sizes[s] for s in full), sum(weight[s] for s in sizes if s not in full)
        want = {s: float(limit * sizes[s]) if s in full else left * weight[s] / w for s in sizes}
        over = {s for s in sizes if s not in full and want[s] > limit * sizes[s]}
        if not over:
            return want
        full |= over


def test_mix_targets_of_many_sources(spark):
    """Thousands of sources of very different sizes, some of them empty."""
    rng = np.random.default_rng(8)
    sizes = {f"s{i:05d}": int(x) for i, x in enumerate(rng.pareto(0.8, 3000) * 10)}
    rows = spark.createDataFrame([(s, n // 2 + k * (n % 2)) for s, n in sizes.items() for k in (0, 1)], "source string, size long").repartition(7)
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mixed_documents_are_as_planned(spark):
    """Every document comes out as often as the plan takes it, equal rows too, in the order of positions."""
    from collections import Counter

    rows = [(i, f"text {i} " + "w " * (i % 17), "en", ("a", "b", None, "c")[i % 4], 1) for i in range(400)]
    rows += [(1, "text 1 again and again", "en", "b", 1)] * 50 + [(None, "no id", "en", "a", 1)] * 2500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs).collect()
    planned = Counter()
    for r in mixing.plan_mix(docs).collect():
        planned[r["source"]] += r["taken"]
    words = Counter()
    for r in out:
        words[r["source"]] += len(r["text"].split())
    targets = {r["source"]: (r["target"], max(len(t.split()) for _, t, _, s, _ in rows if s == r["source"])) for r in mixing.plan_mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(words[s] - t) <= largest and abs(planned[s] - t) <= largest for s, (t, largest) in targets.items())
    single = Counter((r["doc_id"], r["text"], r["source"]) for r in out)
    assert all(n <= 3 * rows.count((i, t, "en", s, 1)) for (i, t, s), n in single.items())


def test_schedule_inverse(spark):
    """Integrating the schedule up to the position gives back the share."""
    rows = spark.range(101).select((F.col("id") / 100).alias("q")).crossJoin(spark.createDataFrame([([1.5, 1.0, 0.5],), ([1.0, 1.0],), ([0.0, 2.0, 0.0],)], "rates array<double>"))
    for r in rows.select("q", "rates", mixing.position_at(F.col("q"), F.col("rates")).alias("t")).collect():
        knots = np.linspace(0, 1, len(r["rates"]))
        grid = np.linspace(0, 1, 20_001)
        rate = np.interp(grid, knots, r["rates"])
        area = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2)])
        assert np.interp(r["t"], grid, area / area[-1]) == pytest.approx(r["q"], abs=1e-3)


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (4, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["toxicity"]["score"] <= 1 for r in rows)


def test_toxicity_against_brute_force(spark):
    """Token scores by their formula, the best passage among all passages, and the score from both."""
    import random
    from collections import Counter
    from math import log, sqrt

    rng = random.Random(9)
    plain, bad = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(60)], ["vile", "foul", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randrange(1, 40))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (0, 0), (None, 1), (2, None), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    part = {r["doc_id"]: r["p"] for r in docs.select("doc_id", F.expr("pmod(xxhash64(doc_id, 'half'), 3)").alias("p")).collect()}
    text, label = dict(rows), {i: y for i, y in labels if i != 0}  # id 0 is labelled both ways
    counts = {1: Counter(), 0: Counter()}
    for i, y in label.items():
        if part[i] != 0:
            counts[y].update(set(text[i].split()))
    total = {y: sum(c.values()) for y, c in counts.items()}
    share = toxicity.PRIOR_SHARE
    want = {}
    for w in {*counts[0], *counts[1]}:
        alpha = share * (counts[0][w] + counts[1][w])
        mass = share * (total[0] + total[1])
        odds = [log((counts[y][w] + alpha) / (total[y] + mass - counts[y][w] - alpha)) for y in (0, 1)]
        score = odds[1] - odds[0]
        if abs(score / sqrt(1 / (counts[1][w] + alpha) + 1 / (counts[0][w] + alpha))) >= toxicity.MIN_Z:
            want[w.encode()] = score
    assert model.scores == pytest.approx(want) and {w.encode() for w in bad} <= set(want)
    for r in toxicity.score_toxicity(docs, model).collect():
        words = [w.encode() for w in text[r["doc_id"]].split()]
        each = [model.scores.get(w, model.neutral) for w in words]
        best = max((sum(each[a:b]) for a in range(len(each)) for b in range(a + 1, len(each) + 1)), default=0.0)
        assert r["toxicity"]["best"] == pytest.approx(max(0.0, best))
        assert r["toxicity"]["score"] == pytest.approx(model.probability(max(0.0, best), len(words)))


def test_segments_are_all_maximal_ones():
    """Against the definition: scan for the best segment, then on both sides of it."""
    import random

    def best(scores, a, b):
        top = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not top or top[0] <= 0:
            return []
        s, _, i, j = top
        return [*best(scores, a, i), (i, j, s), *best(scores, j, b)]

    rng = random.Random(5)
    for _ in range(200):
        scores = [rng.choice((-1.37, -1.37, -0.61, 1.13, 2.29, 3.71)) + rng.random() * 1e-3 for _ in range(rng.randrange(1, 16))]
        hits = [(i, s) for i, s in enumerate(scores)]
        got = toxicity.segments(hits, -1.0)
        want = best(scores, 0, len(scores))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    if rows:
        assert {r["doc_id"] for r in kept.collect()} == {1, 3, None, 6, 7, 8, 9, 2} and kept.count() == 8
        zero = [r for r in rows if r["doc_id"] in (3, 4, 5)]
        assert {(r["fp"], r["component_id"]) for r in zero} == {(0, 3)}


def groups_of(nodes, near):
    """Components by brute force."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                root[find(b)] = find(a)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(g) for g in out.values()}


def components_of(nodes, edges):
    linked = {frozenset(e) for e in edges}
    return groups_of(nodes, lambda a, b: frozenset((a, b)) in linked)


@pytest.mark.parametrize(("pairwise", "block"), [(1024, 4_000_000), (4, 4_000_000), (4, 60), (1024, 60)])
def test_simhash_links_in_crowded_keys(spark, pairwise, block):
    """Fingerprints around a few: components are those of all pairs, whichever path a key takes."""
    rng = np.random.default_rng(1)
    prints = set()
    for _ in range(3):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(90):
            p = base
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                p ^= 1 << int(b)
            prints.add(p)
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    frame = spark.createDataFrame([(p, p) for p in signed], "node long, w0 long")
    got = [tuple(r) for r in simhash.links(frame, bits=32, radius=3, block=block, pairwise=pairwise).collect()]
    assert components_of(signed, got) == groups_of(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3)


def test_simhash_dense_group_gives_a_forest(spark):
    """5,000 fingerprints within a few bits: every key gives at most one link a row."""
    rng = np.random.default_rng(3)
    prints = {0}
    while len(prints) < 5000:
        prints.add(int(sum(1 << int(b) for b in rng.choice(40, 3, replace=False))))
    frame = spark.createDataFrame([(p, p) for p in prints], "node long, w0 long")
    got = simhash.links(frame, bits=32, radius=3)
    assert got.count() <= 34 * len(prints)
    assert components.connected_components(got).select("component").distinct().count() == 1


def test_simhash_crowded_links_leave_no_pair_out():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, (12, 1)).astype(np.uint64)
    prints = np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for _ in range(40)], np.uint64)[:, None] for c in centres])
    own = rng.random(len(prints)) < 0.5
    forest = simhash.crowded_links(prints, own, 3)
    got = {}
    for i, r in enumerate(forest.root):
        got.setdefault(int(r), set()).add(i)
    want = groups_of(range(len(prints)), lambda a, b: (own[a] or own[b]) and int(prints[a, 0] ^ prints[b, 0]).bit_count() <= 3)
    assert {frozenset(g) for g in got.values()} == want


def test_deduplicate_many_null_ids_and_repeated_rows(spark):
    """Rows without ids are texts of their own; equal rows count once; nothing is a product."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(1500)]
    rows = [(None, t, "en", "a", 1) for t in texts] + [(None, texts[0], "en", "a", 1)] * 30 + [(7, "only text", "en", "a", 1)] * 5 + [(8, "only text", "en", "b", 1), (9, None, None, None, None), (None, None, None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.deduplicate(docs).collect()
    assert sorted(str(r["text"]) for r in kept) == sorted([*texts, "only text", "None"])
    assert {r["doc_id"] for r in kept} == {None, 7, 9}


def test_deduplicate_by_similarity(spark):
    """Texts far above a similarity of 0.8 are one, those far below are not; spaces and capitals don't matter."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], set()
    for g in range(60):
        base = list(rng.choice(words, 200))
        near, far = list(base), list(base)
        near[int(rng.integers(0, 200))] = "changed"
        for at in rng.choice(200, 60, replace=False):
            far[at] = f"other{at}"
        rows += [(3 * g, " ".join(base)), (3 * g + 1, "  ".join(near).upper()), (3 * g + 2, " ".join(far))]
        want |= {3 * g, 3 * g + 2}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.deduplicate(docs).collect()} == want


def test_deduplicate_links_texts_whose_segments_all_differ(spark):
    """Pairs of the larger table within the radius, no 16-bit segment of which differs in one bit or none."""
    ids = (1212, 6252, 4832, 5011, 7446, 9953)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(*ids))
    prints = {r["doc_id"]: simhash.wide_print((r["text"] or "").encode().translate(LOWER).split(), {})[:-1] for r in docs.collect()}
    for a, b in zip(ids[::2], ids[1::2], strict=True):
        assert np.bitwise_count(prints[a] ^ prints[b]).sum() <= simhash.RADIUS
        assert (np.bitwise_count(prints[a].view(np.uint16) ^ prints[b].view(np.uint16))[: 4 * simhash.INDEXED] > 1).all()
    assert sorted(r["doc_id"] for r in simhash.deduplicate(docs).collect()) == sorted(ids[::2])


@pytest.mark.parametrize("block", [1 << 18, 70, 9])
def test_simhash_all_links_against_all_pairs(spark, block):
    """Wide fingerprints just within and just beyond the radius, however many blocks there are."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(70):
        base = rng.integers(0, 2, 256)
        for far in (0, 44, 45, 30):
            p = base.copy()
            p[rng.choice(256, far, replace=False)] ^= 1
            rows.append(np.packbits(p).view(np.int64))
    frame = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(rows)], "node long, w0 long, w1 long, w2 long, w3 long")
    got = [tuple(r) for r in simhash.all_links(frame, 44, block).collect()]
    prints = np.stack(rows).view(np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= 44
    assert components_of(range(len(rows)), got) == groups_of(range(len(rows)), lambda a, b: near[a, b])
    assert all(near[a].sum() > 1 for a, _ in got)


def test_simhash_all_links_of_a_dense_group_are_a_forest(spark):
    rng = np.random.default_rng(9)
    prints = np.zeros((3000, 4), np.int64)
    prints[:, 3] = rng.choice(1 << 40, 3000, replace=False)
    frame = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints)], "node long, w0 long, w1 long, w2 long, w3 long")
    got = simhash.all_links(frame, 44, 1000)
    assert got.count() <= 4 * len(prints)
    assert components.connected_components(got).select("component").distinct().count() == 1


def test_components_with_hubs(spark):
    """Stars of thousands of edges and what hangs on them."""
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(5001, 8000)] + [(i, i + 10_000) for i in range(1, 3000, 7)] + [(5003, 20_000), (20_000, 20_001)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got.keys() == {x for e in edges for x in e}
    assert all(c == (5000 if 5000 <= n < 8000 or n >= 20_000 else 0) for n, c in got.items())


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(None, 3), (5, 5)] + [(1000 + i, 1000 + i + 1) for i in range(40)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_decontamination(spark, docs):
    bench = items(spark, [(1, "Quick brown fox jumps over the lazy dog, and runs!"), (2, "id here"), (None, "word"), (3, None), (4, " ,"), (2, "id here")])
    rows = {r["doc_id"]: r for r in decontam.decontaminate(docs, bench).collect()}
    if rows:
        assert rows[1]["items"] == ["1"] and rows[None]["items"] == ["2"] and rows[3]["n_words"] == 0 and not rows[7]["contaminated"]
        span = rows[1]["spans"][0]
        assert FIRST[span["start"] : span["end"]] == "quick brown fox jumps over the lazy dog and runs"
    assert decontam.decontaminate(docs, items(spark, [])).where("contaminated").count() == 0


def test_decontamination_in_packs(spark, sf):
    """A benchmark beyond one automaton's size gives the same result."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    keys = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    one = decontam.decontaminate(docs, bench).select(keys).orderBy("doc_id").collect()
    many = decontam.decontaminate(docs, bench, max_bytes=3000).select(keys).orderBy("doc_id").collect()
    assert one == many and any(r["contaminated"] for r in one)


def test_pii(docs):
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()


def test_pii_rules_on_hard_texts(spark):
    texts = [
        "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1-2-3-4-5-6-7-8-", "é@a.b é1.2.3.4",
        "@@a@b@c.d", "a@b", "+1(((((2", "4111111111111111 4111111111111111", "\U0001f600 x@y.zz 12.34.56.78", "a@b.c@d.e", "1" * 5000, "a." * 5000 + "@x.y",
    ]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        got = [(k, s["start"], s["end"]) for k in pii.KINDS for s in rows[i][k]]
        assert got == pii_base(t), t
        assert all(s["value"] == t[s["start"] : s["end"]] for k in pii.KINDS for s in rows[i][k])
    assert luhn("4111111111111111")


def test_pii_context(spark):
    """A word that introduces known cards introduces an unknown number too; copies and other words don't."""
    def card(n):
        body = f"4{n:014d}"
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    rows = [(i, f"please charge account {card(i * 7919)} today") for i in range(12)]
    rows += [(100, "please charge account 4000000000000001 today"), (101, "the number 4000000000000001 stays"), (102, "see page 12345678 there")]
    got = {r["doc_id"]: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s["value"] for s in got[100]["context"]] == ["4000000000000001"] and got[102]["context"] == []
    assert all(len(got[i]["card"]) == 1 and not got[i]["context"] for i in range(12))


def test_pii_finds_kinds_that_no_rule_knows(spark):
    """Patterns learned from rules' finds discover numbers of another shape; those bring patterns of their own."""
    def card(n):
        body = f"4{n:014d}"
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    ssn = [f"{100 + i}-{10 + i}-{1000 + 37 * i}" for i in range(20)]
    rows = [(i, f"member {card(i * 7919)} joined") for i in range(60)]
    rows += [(100 + i, f"member {s} joined") for i, s in enumerate(ssn[:12])]  # found by a pattern of the rules
    rows += [(200 + i, f"social: {s} on file") for i, s in enumerate(ssn[:12])]  # which makes a pattern
    rows += [(300 + i, f"social {s} on file") for i, s in enumerate(ssn[12:16])]  # that finds others
    rows += [(400 + i, f"page {30000 + i} of it") for i in range(8)] + [(500, "member 4111 1111 1111 1112 joined"), (501, "member " + "9" * 100)]
    got = {r["doc_id"]: [s["value"] for s in r["context"]] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == [s] for i, s in enumerate(ssn[:12]))
    assert all(got[300 + i] == [s] for i, s in enumerate(ssn[12:16]))
    assert not any(got[400 + i] for i in range(8))
    assert got[500] == ["4111 1111 1111 1112"] and got[501] == ["9" * 100]


def test_pii_of_a_long_table_of_numbers(spark):
    """Tens of thousands of matches in one text take seconds."""
    import time

    text = " ".join(f"{i}.{i % 256}.3.4" for i in range(50_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.find_personal_data(frame).select(F.size("ip").alias("n"), F.element_at("ip", -1).alias("last")).collect()
    assert row["n"] == 256 and text[row["last"]["start"] : row["last"]["end"]] == row["last"]["value"]
    assert time.time() - began < 60


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(1,), (None,), (2,), (2,), (99,)], "doc_id long")
    rows = kneser_ney.classify(docs, kneser_ney.fit(docs, trusted)).collect()
    assert len(rows) == docs.count() and all(r["accepted"] is not None for r in rows)
    none = kneser_ney.fit(docs, trusted.where("false"))
    assert kneser_ney.classify(docs, none).where("NOT accepted").count() == 0


def brute_kneser_ney(texts, order):
    """p(gram, k) of the interpolated modified model, from its formulas."""
    from collections import Counter, defaultdict

    from tessera.llm import ngrams

    grams = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = [ngrams.PAD] * order + list(t.encode()) + [ngrams.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                grams[k][tuple(s[i - k : i + 1])] += 1
    adjusted = [None] * (order + 1)
    adjusted[order] = dict(grams[order])
    for k in range(order):
        before = Counter(g[1:] for g in grams[k + 1])
        adjusted[k] = {g: n if g[0] == ngrams.PAD else before[g] for g, n in grams[k].items()}
    discount = [kneser_ney.discounts(*(sum(n == x for n in adjusted[k].values()) for x in (1, 2, 3, 4))) for k in range(order + 1)]
    contexts = [defaultdict(list) for _ in range(order + 1)]
    for k in range(order + 1):
        for g, n in adjusted[k].items():
            contexts[k][g[:-1]].append(n)

    def p(g, k):
        if k < 0:
            return 1 / 256
        g = g[len(g) - k - 1 :]
        counts = contexts[k].get(g[:-1])
        if not counts:
            return p(g, k - 1)
        d = discount[k]
        off = lambda n: d[min(n, 3) - 1]
        n = adjusted[k].get(g, 0)
        return (max(n - off(n), 0) / sum(counts) if n else 0) + sum(off(c) for c in counts) / sum(counts) * p(g, k - 1)

    return p


@pytest.mark.parametrize("order", [2, 3, 6])
def test_kneser_ney_against_its_formulas(spark, order):
    """Every document's perplexity is the model's, however few windows are broadcast; the model is a distribution."""
    from math import log

    from tessera.llm import ngrams

    texts = ["abracadabra", "banana band", "a cabana bar", "abba", "abracadabra bananas", "cab and band and abra"]
    p = brute_kneser_ney(texts, order)
    for context in (b"ab", b"an", b"zz", b"za", bytes([ngrams.PAD] * 2)):
        assert sum(p((*([ngrams.PAD] * (order - 2)), *context, s), order) for s in range(256)) == pytest.approx(1)
    seen = [*texts, "zebra cab", "", "caf\u00e9"]
    want = {}
    for t in seen:
        s = [ngrams.PAD] * order + list(t.encode()) + [ngrams.END]
        want[t] = -sum(log(p(tuple(s[i - order : i + 1]), order)) for i in range(order, len(s)))
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate([*seen, seen[0], None])], "id long, text string").withColumn("t", F.col("text"))
    for most in (0, 5, 10_000):
        model = kneser_ney.train(docs, order=order, max_grams=most)
        got = kneser_ney.score(asked, model).collect()
        assert len(got) == len(seen) + 2
        for r in got:
            assert r["__nll"] == pytest.approx(want[r["t"] or ""]) and r["__bytes"] == len((r["t"] or "").encode()) + 1


def test_quality_thresholds_are_quantiles_of_held_out_texts(spark):
    """Perplexities of all trusted texts that gave no counts, by language, by brute force."""
    rng = np.random.default_rng(10)
    words = {"en": [f"en{i}" for i in range(40)], "de": [f"de{i}" for i in range(40)]}
    rows = [(i, " ".join(rng.choice(words[lang], rng.integers(3, 30))), lang) for i in range(900) for lang in (("en", "de")[i % 3 == 0],)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    got = kneser_ney.judge(docs, trusted, sample=100, quantile=0.9).collect()
    drawn = kneser_ney._trusted(kneser_ney._keyed(docs, "doc_id", "text", "lang"), trusted, "doc_id", 100).collect()
    held = {r["__member"] for r in drawn if not r["__counted"]}
    assert 200 < len(held) < 300 and len(drawn) == 450
    for lang in ("en", "de"):
        values = sorted(r["log_perplexity"] for r in got if r["__lang"] == lang and r["__id"] in held)
        limit = values[int(np.ceil(0.9 * len(values))) - 1] + kneser_ney.MARGIN
        assert all(r["threshold"] == pytest.approx(limit) for r in got if r["__lang"] == lang)
    assert all(r["accepted"] == (r["log_perplexity"] <= r["threshold"]) for r in got)


def test_quality_counts_and_thresholds_come_from_all_trusted_texts(spark, monkeypatch):
    """Texts that aren't trusted are scored by the model of all trusted ones, those by the half without them; all give the threshold."""
    from math import log

    from tessera.llm import ngrams

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choice(words, rng.integers(2, 9))) for i in range(130)}
    docs = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    trusted = docs.where("doc_id < 90").select("doc_id")
    drawn = kneser_ney._trusted(kneser_ney._keyed(docs, "doc_id", "text", "lang"), trusted, "doc_id", None).collect()
    first = {r["__member"] for r in drawn if r["__counted"]}
    assert len(drawn) == 90 and 30 < len(first) < 60
    order = 3
    models = {half: brute_kneser_ney([t for i, t in texts.items() if i < 90 and half in (None, i in first)], order) for half in (None, True, False)}
    nll = {}
    for i, t in texts.items():
        p = models[None if i >= 90 else i not in first]
        s = [ngrams.PAD] * order + list(t.encode()) + [ngrams.END]
        nll[i] = -sum(log(p(tuple(s[at - order : at + 1]), order)) for at in range(order, len(s)))
    size = {i: len(t) + 1 for i, t in texts.items()}
    mean = sum(nll[i] for i in range(90)) / sum(size[i] for i in range(90))
    want = {i: (nll[i] + kneser_ney.SMOOTHING * mean) / (size[i] + kneser_ney.SMOOTHING) for i in texts}
    limit = sorted(want[i] for i in range(90))[int(np.ceil(0.9 * 90)) - 1] + kneser_ney.MARGIN
    for broadcast in (1000, 10):
        monkeypatch.setattr(kneser_ney, "BROADCAST_TRUSTED", broadcast)
        got = {r["__id"]: r for r in kneser_ney.judge(docs, trusted, order=order, quantile=0.9).collect()}
        assert {i: r["log_perplexity"] for i, r in got.items()} == pytest.approx(want)
        assert all(r["threshold"] == pytest.approx(limit) for r in got.values())


def test_quality_judges_each_row_once(spark, docs):
    """What is judged in one pass is what fit and classify say."""
    trusted = docs.where("doc_id IS NULL OR doc_id <> 2").select("doc_id").distinct()
    one = kneser_ney.marked(docs, kneser_ney.judge(docs, trusted))
    two = kneser_ney.classify(docs, kneser_ney.fit(docs, trusted))
    key = lambda r: tuple(str(r[c]) if not isinstance(r[c], float) else round(r[c], 9) for c in two.columns)
    assert sorted(map(key, one.select(two.columns).collect())) == sorted(map(key, two.collect()))


def test_quality_thresholds_of_rare_languages(spark):
    """A language with a small share of the trusted texts has its own threshold, whatever the sample."""
    rows = [(i, f"{'plain english words' if i % 10 else 'wenige deutsche saetze'} {i * 7919 % 1009}", "en" if i % 10 else "de") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(kneser_ney.fit(docs, docs.select("doc_id"), sample=20).by_language) == {"en", "de"}


def test_ngram_chunks_see_long_texts_once(monkeypatch):
    from tessera.llm import ngrams

    texts = [b"abc", None, b"x" * 1000 + b"yz", b""]
    whole = np.concatenate([c for c, _ in ngrams.chunks(texts, 3)])
    monkeypatch.setattr(ngrams, "CHUNK", 64)
    parts = list(ngrams.chunks(texts, 3))
    assert np.array_equal(np.sort(whole), np.sort(np.concatenate([c for c, _ in parts])))
    assert all(sum(n for _, n in owners) == len(c) for c, owners in parts)


def test_shards(docs):
    out = sharding.histogram_shard(docs, 4)
    rows = out.collect()
    assert len(rows) == docs.count() and set(out.columns) == {*docs.columns, "shard", "slot"}
    for s in range(4):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_shards_with_a_hot_text(spark):
    """A third of all rows are one text; shards stay equal and each row has a slot of its own."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("t"), F.col("id") % 1000 + 1000)).alias("text"))
    got = sharding.histogram_shard(rows, 8)
    per = got.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b"), F.count_distinct("slot").alias("n"), F.max("slot").alias("m"), F.count(F.lit(1)).alias("rows")).collect()
    mean = sum(r["b"] for r in per) / 8
    assert len(per) == 8 and all(abs(r["b"] - mean) < 0.02 * mean and r["n"] == r["rows"] == r["m"] + 1 for r in per)


@pytest.mark.parametrize(("run_bytes", "broadcast_runs"), [(1 << 23, 20_000), (300, 20_000), (300, 0)])
def test_a_thousand_shards(spark, run_bytes, broadcast_runs):
    """Cuts, runs and offsets hold for any number of shards and runs, whether their tables are broadcast or joined."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("a long copied text")).otherwise(F.repeat(F.lit("x"), (F.col("id") % 40).cast("int"))).alias("text"))
    rows = rows.withColumn("__run", F.lit(1)) if run_bytes > 1000 else rows
    got = sharding.histogram_shard(rows.drop("__run"), 1000, run_bytes=run_bytes, broadcast_runs=broadcast_runs)
    per = got.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("b"), F.count_distinct("slot").alias("n"), F.max("slot").alias("m"), F.count(F.lit(1)).alias("rows")).collect()
    total = sum(r["b"] for r in per)
    assert len(per) == 1000 and sum(r["rows"] for r in per) == 20_000
    assert all(abs(r["b"] - total / 1000) <= 2 * 41 and r["n"] == r["rows"] == r["m"] + 1 for r in per)


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(40)]
    rows += [(100, rows[3][1]), (101, [x + 0.01 for x in rows[3][1]]), (102, None), (103, [0.0] * 8), (104, [1.0, None] + [0.0] * 6), (105, [nan] * 8), (106, [inf] + [0.0] * 7), (107, [1.0, 2.0]), (None, rows[5][1]), (3, rows[3][1]), (108, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = [tuple(r) for r in embedding_dedup.near_duplicates(frame).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert by[100][1:] == (3, 3, False) and by[3][1:] == (3, 3, True) and by[None][1:] == (1, 5, False)
    for odd in (102, 103, 104, 105, 106, 107, 108):
        assert by[odd][1:] == (0, odd, True)
    assert embedding_dedup.near_duplicates(frame.where("false")).count() == 0


def test_embeddings_of_many_lengths(spark):
    """Vectors of different lengths never link; a length costs no jobs of its own."""
    rows = [(3 * w + k, [1.0 + k % 2 * x for x in range(w)]) for w in range(1, 200) for k in (0, 1, 2)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for w in range(1, 200):
        a, b, c = (got[3 * w + k] for k in (0, 1, 2))
        assert a["component_id"] == c["component_id"] == 3 * w
        x = np.arange(w) + 1.0
        linked = x.sum() / (np.sqrt(w) * np.linalg.norm(x)) >= 0.9
        assert b["component_id"] == (3 * w if linked else 3 * w + 1) and b["n_links"] == 2 * linked


@pytest.mark.parametrize(("small", "pairs"), [(2048, 200_000), (100, 200_000), (100, 0)])
def test_embeddings_in_many_blocks(spark, monkeypatch, small, pairs):
    """Dense groups across block borders, against the whole matrix."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(600, 32)), rng.normal(size=(1, 32)) + 0.05 * rng.normal(size=(300, 32)), rng.normal(size=(1, 32)) + 0.25 * rng.normal(size=(300, 32))])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 150)
    monkeypatch.setattr(embedding_dedup, "BLOCK_VALUES", 150 * 32)
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    monkeypatch.setattr(embedding_dedup, "STRIPE", 64)
    monkeypatch.setattr(embedding_dedup, "BROADCAST_PAIRS", pairs)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    label = np.arange(len(x))
    while True:
        lower = np.minimum(label, np.where(linked, label[None], len(x)).min(axis=1))
        if np.array_equal(lower, label):
            break
        label = lower
    assert [got[i]["n_links"] for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_normal_words_are_ascii_folded():
    assert ppm.normal("ÄB Ab c".encode()) == ["Äb".encode(), "ab c".encode()]
    assert not re.search("[A-Z]", "".join(w.decode() for w in decontam.words_of("A-B c_D")))
