"""The registered queries against brute-force versions over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import queries, simhash

Q = queries.queries()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def by_id(spark, sf, name):
    rows = Q[name](spark, sf).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_embeddings(spark, sf):
    raw = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()]
    x = np.array([r[1] for r in raw], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    comp = components(len(raw), np.argwhere(linked))
    got = {r["vec_id"]: r for r in Q["op1_embedding_dedup"](spark, sf).collect()}
    for i, (v, _) in enumerate(raw):
        assert (got[v]["n_links"], got[v]["component_id"], got[v]["kept"]) == (linked[i].sum(), raw[comp[i]][0], comp[i] == i)


def test_secrets(spark, sf, texts):
    assign = re.compile(r'(password|passwd|secret|token|api_?key)["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', re.I | re.A)
    got, order = by_id(spark, sf, "op2_secrets"), {"assign": 0, "access": 1, "hex": 2}
    for i, t, *_ in texts:
        base = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda s: (s[1], order[s[0]]))
        n = Counter(k for k, *_ in base)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        r = got[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == (n["assign"], n["access"], n["hex"], sha(",".join(listed)))
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_lm(spark, sf, texts):
    tokens = {i: [*words(lower(t)), ""] for i, t, *_ in texts}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = by_id(spark, sf, "op3_ppm")
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r["score"] < 0


def test_mix(spark, sf, texts):
    got = by_id(spark, sf, "op4_mixing")
    size = {i: len(words(t)) for i, t, *_ in texts}
    source = {i: s for i, _, _, s in texts}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(total))}
    want, full = {}, set()
    while True:  # share what is left, stop those above their limit, again
        left = sum(total.values()) - sum(3 * total[s] for s in full)
        w = sum(weight[s] for s in total if s not in full)
        want = {s: 3.0 * total[s] if s in full else left * weight[s] / w for s in total}
        over = {s for s in total if want[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    largest = {s: max(size[i] for i in source if source[i] == s) for s in total}
    for i, r in got.items():
        assert (r["size"], r["source_size"]) == (size[i], total[source[i]])
        assert r["target"] == pytest.approx(want[source[i]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
    for s in total:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert Q["op4_mixing"](spark, sf).orderBy("doc_id").collect() == Q["op4_mixing"](spark, sf).orderBy("doc_id").collect()


def test_toxicity_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in Q["op5_toxicity"](spark, sf).collect()]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    right = Counter(held)
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.85
    assert right[1, 1] / (right[1, 1] + right[0, 1]) > 0.7
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_simhash(spark, sf, texts):
    prints = {}
    for i, t, *_ in texts:
        ws = words(lower(t))
        shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    linked = [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 3]
    comp = components(len(ids), linked)
    got = by_id(spark, sf, "op6_simhash")
    for k, i in enumerate(ids):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[i]:016x}", ids[comp[k]])


def test_decontamination(spark, sf, texts):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        ws = split(r["text"])
        n = min(10, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows[tuple(ws[k : k + n])].add(r["item_id"])
    sizes = {len(w) for w in windows}
    got = by_id(spark, sf, "op7_decontamination")
    for i, t, *_ in texts:
        ws, hit, items = split(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if found := windows.get(tuple(ws[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(ws), len(hit), len(items), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(map(str, items))))


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, t) if ok(m[0])]


def test_pii(spark, sf, texts):
    got = by_id(spark, sf, "op8_pii")
    for i, t, *_ in texts:
        base = pii_base(t)
        n = Counter(k for k, *_ in base)
        r = got[i]
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [n[k] for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))


def test_quality_keeps_good_and_drops_junk(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = Counter((labels[r["doc_id"]], r["accepted"]) for r in Q["op9_quality"](spark, sf).collect() if r["doc_id"] in labels)
    assert seen[1, True] / (seen[1, True] + seen[1, False]) > 0.99
    assert seen[0, False] / (seen[0, True] + seen[0, False]) > 0.8


def test_shards(spark, sf, texts):
    got = by_id(spark, sf, "op10_sharding")
    text = {i: t for i, t, *_ in texts}
    load, slots = Counter(), defaultdict(list)
    for i, r in got.items():
        raw = text[i].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(load) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got.values())
    assert max(load.values()) - min(load.values()) <= 2 * largest


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tessera.llm.queries import table

    docs = table(spark, sf, "documents")
    out = Q["pipeline"](spark, sf)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) > 0
    quality, dedup, clean, mix, _ = [f for _, f in corpus_pipeline.STAGES]
    kept = quality(spark, docs, sf)
    single = dedup(spark, kept, sf)
    # one document of each group of near-duplicates, by brute force
    alive = {r["doc_id"]: r["text"] for r in kept.collect()}
    prints = {i: simhash.wide_print([w.encode() for w in words(lower(t))], {}) for i, t in sorted(alive.items())}
    ids = sorted(prints)
    wide = np.array([prints[i][:-1] for i in ids])
    parts = np.stack([(wide[:, w] >> np.uint64(at)) & np.uint64(0xFFFF) for w in range(simhash.INDEXED) for at in range(0, 64, 16)], axis=1)
    group = list(range(len(ids)))
    for x in range(len(ids)):
        near = (np.bitwise_count(wide ^ wide[x]).sum(axis=1) <= simhash.RADIUS) & (np.bitwise_count(parts ^ parts[x]) <= 1).any(axis=1)
        for y in np.flatnonzero(near):
            old, new = max(group[x], group[y]), min(group[x], group[y])
            group = [new if g == old else g for g in group]
    ids = sorted(ids[g] for g in set(group))
    assert ids == sorted(r["doc_id"] for r in single.collect())
    left = clean(spark, single, sf)
    leaks = {r["doc_id"] for r in Q["op7_decontamination"](spark, sf).collect() if r["contaminated"]}
    assert {r["doc_id"] for r in left.collect()} == set(ids) - leaks
    assert mix(spark, left, sf).columns == docs.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    answer = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    df = Q[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(answer.fetchall())
