"""SimHash near-duplicates by multi-index hashing.

A fingerprint is the bitwise majority of the hashes of a text's word shingles.
Every segment of a fingerprint is the key of an index table; every fingerprint
looks up the ball of radius 1 around each of its segments, and complete distances
are verified on what comes back.  Only distinct fingerprints take part: a group
of copies is one fingerprint however large.

Two fingerprints meet at a key if one has the segment itself and the other is one
bit away.  Of two segments a bit apart one has that bit, so only unset bits are
flipped: half a ball each.  A key's rows come sorted, are compared as arrays, and
leave as a forest: at most one link a row, never all pairs.  In a crowded key a
fingerprint that is linked is in its leader's component; only rows of different
components are compared further, so a dense group costs a pass for each leader.

:func:`near_duplicates` is the 64-bit form with two 32-bit segments: a distance of
3 leaves at most one bit for one of them, so no link is missed.
:func:`deduplicate` compares five-word shingles at a similarity of 0.8 and more,
which is many bits apart: 256-bit fingerprints tell such similarities.  No index
of short segments finds all pairs so far apart, so all pairs of distinct
fingerprints meet, block by block: the first half of a fingerprint sifts, on what
passes complete distances are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, cut
from .components import connected_components

SEED = 42
#: Words of a shingle, 64-bit words of a fingerprint and how many of them sift, for near-duplicates.
SHINGLE, WIDE, INDEXED = 5, 4, 2
#: Differing bits at most.  A similarity of 0.8 differs in 39 of 256 bits on average, give or take 6.
RADIUS = 44
#: Most rows that are broadcast because they are there very often, and most crowded keys that are.
REPEATED, CROWDED = 10_000, 50_000
#: Rows of a key that are compared pair by pair, rows that are compared at once, and rows of a key that one task compares.
PAIRWISE, STRIPE, BLOCK = 1024, 1 << 19, 4_000_000
#: Where all pairs are compared: rows of a block at most; rows of one at least, and how many blocks at most, while blocks are smaller; pairs at a time.
COMPARED, LEAST, BLOCKS, SIFTED = 1 << 18, 1024, 32, 1 << 16

_MIX1, _MIX2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def fingerprint_of(text: bytes | None, shingle: int = 3) -> int:
    """64-bit fingerprint of a text as an unsigned number; 0 for a null text or one without words."""
    words = text.translate(LOWER).split() if text else ()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1]
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    return int(majority(hashes.reshape(-1, 1))[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits that more than half of the rows have set."""
    width = hashes.shape[1]
    counts = np.zeros(64 * width, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        bits = np.unpackbits(np.ascontiguousarray(hashes[part : part + (1 << 16)]).view(np.uint8).reshape(-1, 8 * width), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def wide_print(words: list[bytes], known: dict[bytes, int], shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of a text's distinct shingles, ``WIDE`` words, and a hash of all its words; zeros without words."""
    if not words:
        return np.zeros(WIDE + 1, np.uint64)
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w, SEED)
    each = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(shingle, len(words))):
        rolled = rolled * _ODD + each[j : j + n]
    rolled = np.unique(rolled)[:, None]
    return np.append(majority(_mixed(rolled ^ (np.arange(WIDE, dtype=np.uint64) * _ODD))), np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)))


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit fingerprint of a text column as a signed number."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint_of(t.as_py(), shingle) for t in texts.cast(pa.binary())), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return run(text)


_WIDE = [f"w{i}" for i in range(WIDE)]


def wide_fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """(w0, ..., words) of a text column: the wide fingerprint and the hash of the words, as signed numbers."""

    @F.arrow_udf(", ".join(f"{c} long" for c in [*_WIDE, "words"]))
    def run(texts: pa.Array) -> pa.Array:
        known: dict[bytes, int] = {}
        rows = np.zeros((len(texts), WIDE + 1), np.uint64)
        for i, t in enumerate(texts.cast(pa.binary())):
            rows[i] = wide_print(t.as_py().translate(LOWER).split() if t.is_valid else [], known, shingle)
        return pa.StructArray.from_arrays([pa.array(rows[:, i].view(np.int64)) for i in range(WIDE + 1)], [*_WIDE, "words"])

    return run(text)


def probes(prints: DataFrame, bits: int, indexed: int, block: int = BLOCK) -> DataFrame:
    """Rows (segment, key, first, second, own, node, w0, ...) of (node, w0, ...): each segment's key and the keys with one unset bit more.

    Segments are those of the first ``indexed`` words.  Keys with more than ``block`` rows are dealt to pairs of blocks (first,
    second): own rows of the one meet all rows of the other.
    """
    words = [c for c in prints.columns if c != "node"]
    keys = [F.shiftrightunsigned(w, at).bitwiseAND(F.lit((1 << bits) - 1)) for w in words[:indexed] for at in range(0, 64, bits)]
    segments = F.array(*[F.struct(F.lit(i).alias("segment"), k.alias("key")) for i, k in enumerate(keys)])
    own = prints.select("node", *words, F.inline(segments))
    flips = F.array(*[F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(bits)]])
    ball = F.filter(flips, lambda m: F.col("key").bitwiseAND(m) == 0)
    rows = own.select("segment", (F.explode(ball).alias("flip")), "key", "node", *words)
    rows = rows.select("segment", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"), "node", *words)
    # rows of a key: its own, and those of the keys with one set bit less
    sizes = own.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("n"))
    sums = sizes.select("segment", "n", "key", F.explode(ball).alias("flip")).groupBy("segment", F.col("key").bitwiseXOR(F.col("flip")).alias("key")).agg(F.sum("n").alias("n"))
    crowded = cut(sums.where(F.col("n") > block).select("segment", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    many = crowded.limit(CROWDED + 1).count()
    if not many:
        return rows.select("segment", "key", F.lit(0).alias("first"), F.lit(0).alias("second"), "own", "node", *words)
    rows = rows.join(F.broadcast(crowded) if many <= CROWDED else crowded, ["segment", "key"], "left").withColumns({"blocks": F.coalesce("blocks", F.lit(1))})
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pair = lambda a, b, o: F.struct(a.alias("first"), b.alias("second"), o.alias("own"))
    # an own row asks every block of rows, every row answers every block that asks
    asks = F.when(F.col("own"), F.transform(every, lambda j: pair(mine, j, F.lit(True)))).otherwise(F.array().cast("array<struct<first:int,second:int,own:boolean>>"))
    answers = F.transform(F.filter(every, lambda i: ~F.col("own") | (i != mine)), lambda i: pair(i, mine, F.lit(False)))
    return rows.select("segment", "key", "node", *words, F.inline(F.concat(asks, answers))).select("segment", "key", "first", "second", "own", "node", *words)


class Forest:
    """Roots of a growing graph; whole arrays of links at a time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            x, y = self.root[i], self.root[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            # hook every root to the smallest one it is linked with, then shorten all paths
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(shorter := self.root[self.root], self.root):
                self.root = shorter


def _near(prints: np.ndarray, i, j, radius: int) -> np.ndarray:
    return np.bitwise_count(prints[i] ^ prints[j]).sum(axis=-1, dtype=np.int64) <= radius


def crowded_links(prints: np.ndarray, own: np.ndarray, radius: int) -> Forest:
    """Components of a key's rows: pairs with at least one own row within ``radius``, each tested unless it can't matter."""
    forest = Forest(len(prints))
    led = np.zeros(len(prints), bool)
    mine, leaders = np.flatnonzero(own), []
    for x in mine:
        if led[x]:
            continue
        near = np.flatnonzero(_near(prints, x, slice(None), radius))
        forest.link(np.full(len(near), x), near)
        led[near] = True
        leaders.append(x)
    # what is left: a led own row, and a row that is led in another component or by none
    left = np.setdiff1d(np.flatnonzero(led), leaders)
    groups = [left[forest.root[left] == r] for r in np.unique(forest.root[left])]
    alone = np.flatnonzero(~led)
    for n, a in enumerate(groups):
        for b in [*groups[n + 1 :], alone]:
            if not len(b) or (b is not alone and forest.root[a[0]] == forest.root[b[0]]):
                continue
            for p, q in ((a[own[a]], b), (b[own[b]], a[~own[a]])):
                step = max(1, STRIPE // max(1, len(q)))
                for at in range(0, len(p), step):
                    i, j = np.nonzero(_near(prints, p[at : at + step, None], q[None, :], radius))
                    forest.link(p[at + i], q[j])
    return forest


def _forests(rows: DataFrame, radius: int, pairwise: int) -> DataFrame:
    """(src, dst): links that join the components of every key."""
    width = len(rows.columns) - 6

    def key_links(node: np.ndarray, own: np.ndarray, prints: np.ndarray, start: np.ndarray):
        """Links of consecutive keys, whose rows begin at ``start``."""
        size = np.diff(np.append(start, len(node)))
        small = np.flatnonzero((size > 1) & (size <= pairwise))
        # every own row with every row of its key
        of_key = np.repeat(np.arange(len(start)), size)
        asking = np.flatnonzero(own & np.isin(of_key, small))
        at = 0
        while at < len(asking):
            many = np.cumsum(size[of_key[asking[at : at + (1 << 16)]]])
            end = at + max(1, int(np.searchsorted(many, STRIPE, "right")))
            part = asking[at:end]
            n = size[of_key[part]]
            i = np.repeat(part, n)
            j = np.repeat(start[of_key[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            keep = _near(prints, i, j, radius) & (node[i] != node[j])
            yield node[i[keep]], node[j[keep]]
            at = end
        for k in np.flatnonzero(size > pairwise):
            rows_ = slice(start[k], start[k] + size[k])
            root = crowded_links(prints[rows_], own[rows_], radius).root
            apart = root != np.arange(len(root))
            yield node[rows_][apart], node[rows_][root[apart]]

    def forest_of(pairs):
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        if not len(a):
            return a, b
        names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(names))
        forest.link(ends[: len(a)], ends[len(a) :])
        apart = forest.root != np.arange(len(names))
        return names[apart], names[forest.root[apart]]

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("segment", "key", "first", "second")], axis=1)
            rest = (batch.column("node").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False), np.stack([batch.column(f"w{w}").to_numpy().view(np.uint64) for w in range(width)], axis=1))
            if kept:
                key, rest = np.concatenate([kept[0], key]), tuple(np.concatenate(x) for x in zip(kept[1], rest, strict=True))
            start = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
            # the last key may go on in the next batch
            last = start[-1]
            if last:
                yield _edges(*forest_of([(np.empty(0, np.int64),) * 2, *key_links(*(x[:last] for x in rest), start[:-1])]))
            kept = key[last:], tuple(x[last:] for x in rest)
        if kept:
            yield _edges(*forest_of([(np.empty(0, np.int64),) * 2, *key_links(*kept[1], np.array([0]))]))

    where = ["segment", "key", "first", "second"]
    return rows.repartition(*where).sortWithinPartitions(*where).mapInArrow(run, "src long, dst long")


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["src", "dst"])


def links(prints: DataFrame, *, bits: int, radius: int, indexed: int = 1, block: int = BLOCK, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (src, dst) between nodes of (node, w0, ...) that join what is within ``radius`` and meets at a key.

    Nodes meet if one of their segments of ``bits`` bits differs in one bit at
    most; with fewer than twice as many differing bits as segments all do.
    """
    return _forests(probes(prints, bits, indexed, block), radius, pairwise)


def compared(a: np.ndarray, b: np.ndarray | None, radius: int, sifting: int = INDEXED) -> np.ndarray:
    """Roots of the rows of ``a`` and then ``b``: all pairs of a row of each within ``radius`` are joined, or all pairs of ``a`` without a ``b``.

    A pair whose first ``sifting`` words differ in more bits is not within; the others' complete distances are verified.
    """
    prints = a if b is None else np.concatenate([a, b])
    forest, columns = Forest(len(prints)), np.ascontiguousarray(prints.T[:sifting])
    step = max(1, SIFTED // len(prints))
    for at in range(0, len(a), step):
        first = at if b is None else len(a)
        mine, others = columns[:, at : min(at + step, len(a)), None], columns[:, None, first:]
        bits = np.bitwise_count(mine[0] ^ others[0])
        for p, q in zip(mine[1:], others[1:], strict=True):
            bits += np.bitwise_count(p ^ q)  # three words have less than 256
        i, j = np.divmod(np.flatnonzero(bits <= radius), bits.shape[1])
        i, j = at + i, first + j
        near = _near(prints, i, j, radius)
        forest.link(i[near], j[near])
    return forest.root


def all_links(prints: DataFrame, radius: int, block: int = COMPARED) -> DataFrame:
    """Links (src, dst) that join all nodes of (node, w0, ...) within ``radius``: every two blocks of at most about ``block`` rows meet.

    Two blocks give a forest, at most one link a row.
    """
    words = [c for c in prints.columns if c != "node"]
    n = prints.count()
    blocks = max(1, min(BLOCKS, n // LEAST), -(-n // block))

    def pack(table: pa.Table) -> pa.Table:
        rows = np.stack([table.column(c).to_numpy() for c in ["node", *words]], axis=1)
        return pa.table({"block": table.column("block")[:1], "rows": pa.array([rows.tobytes()], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(r.as_py(), np.int64).reshape(-1, len(words) + 1) for r in table.column("rows")]
        node, prints = np.concatenate([r[:, 0] for r in rows]), [r[:, 1:].view(np.uint64) for r in rows]
        root = compared(prints[0], prints[1] if len(prints) > 1 else None, radius)
        apart = root != np.arange(len(root))
        return pa.table({"src": node[apart], "dst": node[root[apart]]})

    packed = cut(prints.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, rows binary"))
    other = packed.select("block", "rows", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    pairs = other.select(F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "rows")
    # few bytes, much to compare: tasks by pairs of blocks, not by size
    return pairs.repartition(max(1, blocks * (blocks + 1) // 4), "first", "second").groupBy("first", "second").applyInArrow(meet, "src long, dst long")


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node, w0, ..., least) with ``component`` and the component's least ``best``."""
    comp = connected_components(edges)
    named = nodes.join(comp.withColumnRenamed("node", "__node"), F.col("node") == F.col("__node"), "left").withColumn("component", F.coalesce("component", "node")).drop("__node")
    return named.join(named.groupBy("component").agg(F.min("least").alias("best")), "component")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row a document; fingerprints link at ``radius`` (3 or less) differing bits.

    ``component_id`` is the smallest id reachable by links, itself included;
    null ids count as larger than all and a component of null ids alone has a
    null one.  Null and empty texts have fingerprint zero and link like any
    other; repeated rows stay; an empty table gives an empty result.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two halves with balls of radius 1 find distances up to 3")
    prints = cut(docs.select(docs[id_col].alias("doc_id"), fingerprint(docs[text_col], shingle).alias("fp")))
    nodes = cut(prints.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")).withColumn("w0", F.col("node")))
    named = cut(_components(nodes, links(nodes.select("node", "w0"), bits=32, radius=radius, block=block)).select(F.col("node").alias("__fp"), F.col("best").alias("component_id")))
    return prints.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, block: int = COMPARED) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Texts link whose 256-bit fingerprints of distinct shingles differ in
    ``radius`` bits or fewer, all pairs.  Of several rows with this id, that with
    the smallest hash of its text is kept, and one of equal rows.  A group whose ids are all null keeps one row.  All
    null and empty texts are one group; an empty table gives an empty result.
    """
    text_hash = F.xxhash64(docs[text_col])
    prints = docs.select(docs[id_col].alias("id"), text_hash.alias("hash"), wide_fingerprint(docs[text_col], shingle).alias("p")).select("id", "hash", "p.*")
    # equal rows first, so that a text's rows are few where it is copied often under one id
    rows = cut(prints.groupBy("id", "hash", "words", *_WIDE).agg(F.count(F.lit(1)).alias("rows")))
    nodes = rows.groupBy("words", *_WIDE).agg(F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "hash", "rows")).alias("least"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), *_WIDE, "least"))
    chosen = _components(nodes, all_links(nodes.select("node", *_WIDE), radius, block)).where(F.col("least").eqNullSafe(F.col("best")))
    chosen = cut(chosen.select(_text(F.col("best.id")).alias("__id"), F.col("best.hash").alias("__hash"), F.col("best.rows").alias("__rows")))
    keyed = docs.withColumns({"__a": _text(docs[id_col]), "__b": text_hash})
    same = (F.col("__a") == F.col("__id")) & (F.col("__b") == F.col("__hash"))
    # a row that is there very often is taken out without gathering it; there are REPEATED such rows at most
    total = rows.agg(F.sum("rows")).first()[0] or 0
    often = F.col("__rows") > max(1000, total // REPEATED)
    once = Window.partitionBy("__a", "__b").orderBy(F.lit(0))
    kept = keyed.join(chosen.where(~often), same).withColumn("__n", F.row_number().over(once)).where(F.col("__n") == 1).select(*docs.columns)
    if chosen.where(often).isEmpty():
        return kept
    return kept.unionByName(keyed.join(F.broadcast(chosen.where(often)), same).dropDuplicates(["__a", "__b"]).select(*docs.columns))


def _text(id_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), id_.cast("string")), F.lit(""))
