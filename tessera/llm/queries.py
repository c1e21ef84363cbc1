"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embedding_dedup, kneser_ney, mixing, pii, ppm, secret_scan, sharding, simhash, toxicity
from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def _listed(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    some = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans, base = F.col("secrets"), secret_scan.KINDS[:3]
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(_listed(spans, base), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = ppm.score(docs, fold(docs["doc_id"], 5) != 1)
    return scored.select("doc_id", (fold(scored["doc_id"], 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(fold(labels["doc_id"], 4) != 2))
    scored = toxicity.score_toxicity(docs, model)
    score = F.col("toxicity.score")
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"),
        F.size("toxicity.passages").alias("n_passages"), F.col("toxicity.best").alias("best_segment"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return scanned.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.concat(*[pii.listed(F.col(k), k) for k in pii.KINDS])
    every = F.concat(base, pii.listed(F.col("context"), "context"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(every, ",").alias("spans"),
    )


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the texts that the labels call good."""
    return table(spark, sf_dir, "labels").where(F.col("quality") == 1).select("doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = kneser_ney.judge(docs, trusted_ids(spark, sf_dir))
    return found.select(F.col("__id").alias("doc_id"), F.col("__lang").alias("lang"), F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("limit"), "accepted")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = sharding.histogram_shard(docs, 8)
    text = F.coalesce("text", F.lit(""))
    return sized.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_embedding_dedup, op2_secrets, op3_ppm, op4_mixing, op5_toxicity, op6_simhash, op7_decontamination, op8_pii, op9_quality, op10_sharding,
        pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL exists for the queries whose whole result SQL can state; the others are tested against brute force."""
    return dict(ORACLE)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE: dict[str, str] = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS s FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.9::DOUBLE * a.s * b.s),
reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.vec_id)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id)::BIGINT AS n_links, min(r)::BIGINT AS component_id, v.vec_id = min(r) AS kept
FROM v JOIN reach ON reach.vec_id = v.vec_id GROUP BY v.vec_id
""",
    "op4_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(doc_id::VARCHAR || ':mix'), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT AS weight FROM d GROUP BY source),
l AS (SELECT *, (sum(source_size) OVER () - 3.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM s WINDOW before AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, weight, least((SELECT max(level) FROM l WHERE level * weight <= 3.0::DOUBLE * source_size) * weight, 3.0::DOUBLE * source_size) AS target FROM s),
p AS (SELECT d.*, source_size, weight, target, floor(target / source_size)::INT AS passes, sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size) - size AS f
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(3, passes + (f + size / 2.0::DOUBLE <= target - passes * source_size)::INT) AS copies, least(1.0::DOUBLE, f / target) AS share,
             [[1.5, 1.0, 0.5], [1.0, 1.0, 1.0], [0.5, 1.0, 1.5]][weight]::DOUBLE[] AS r FROM p),
q AS (SELECT *, share * ((r[1] + r[2]) / 2 + (r[2] + r[3]) / 2) AS want, CASE WHEN share * ((r[1] + r[2]) / 2 + (r[2] + r[3]) / 2) >= (r[1] + r[2]) / 2 THEN 2 ELSE 1 END AS k FROM c),
z AS (SELECT *, want - CASE WHEN k = 2 THEN (r[1] + r[2]) / 2 ELSE 0 END AS rest, sqrt(greatest(0.0::DOUBLE, r[k] * r[k] + 2 * (r[k + 1] - r[k]) * (want - CASE WHEN k = 2 THEN (r[1] + r[2]) / 2 ELSE 0 END))) AS root FROM q)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies, CASE WHEN copies > 0 THEN least(1.0::DOUBLE, (k - 1 + least(1.0::DOUBLE, 2 * rest / (r[k] + root))) / 2) END AS position FROM z
""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
