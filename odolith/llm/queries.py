"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, packing, pii, preference, quantize, secret_scan, sharding, simhash, suffix, toxicity, vectors, whitening, wordpiece
from .store import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Content of a public tokenizer's file: a fixed size, read on the driver and sent to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def _counts(kinds: tuple[str, ...]) -> list:
    """How many base spans there are of each kind. (A second parameter of a lambda, even one with a default, would be the index.)"""
    return [F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(kinds)]  # noqa: B023


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counts(secret_scan.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each pair that ``preference.sample_pairs`` makes of the conversations."""
    return preference.records(preference.sample_pairs(_table(spark, sf_dir, "conversations")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_file()))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents read back from where compaction left them after three arrivals, and whether their shards keep to the target."""
    store = sharding.ShardStore(spark, new_path(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    for k in range(3):  # together the whole table
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == k))
    store.compact()
    store.vacuum(older_than=0)  # this store has one writer
    return store.snapshot(places=True).select("doc_id", F.md5("text").alias("text_md5"), (F.col("_size") <= sharding.TARGET).alias("within_target"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantize.codes(_table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *_counts(pii.KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secret_scan": op2_secret_scan,
    "op3_preference_format": op3_preference_format,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_personal_data": op13_personal_data,
}

def _rounds_sql(rounds: int = 2) -> str:
    """CTEs from ``c0``, the first codebooks, to ``c<rounds>`` and ``a<rounds>``, the last assignment."""
    gap = "list_sum(list_transform(range(len(z)), lambda j: (y[j + 1] - z[j + 1]) * (y[j + 1] - z[j + 1])))"
    mean = "list_transform(range(len(z)), lambda j: CAST(floor(list_sum(list_transform(ys, lambda v: v[j + 1])) / len(ys)) AS BIGINT))"
    assigned = lambda k: f"a{k} AS (SELECT vec_id, label, part, any_value(y) AS y, min(struct_pack(d := {gap}, e := entry)) AS best FROM p JOIN c{k} USING (part) GROUP BY vec_id, label, part)"
    moved = lambda k: f"m{k} AS (SELECT part, best.e AS entry, list(y) AS ys FROM a{k} GROUP BY ALL), c{k + 1} AS (SELECT part, entry, CASE WHEN ys IS NULL THEN z ELSE {mean} END AS z FROM c{k} LEFT JOIN m{k} USING (part, entry))"
    return ", ".join([f"{assigned(k)}, {moved(k)}" for k in range(rounds)] + [assigned(rounds)])


ORACLES: dict[str, str] = {
    "op11_vector_codes": f"""
        WITH v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda c: CAST(floor(256 * c) AS BIGINT)) AS x FROM embeddings WHERE len(list_filter(CAST(embedding AS DOUBLE[]), lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
        p AS (SELECT vec_id, label, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS y FROM v, range(16) AS t(part)),
        c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, y AS z FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)),
        {_rounds_sql()},
        books AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
        coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, books
    """,
    "op3_preference_format": """
        WITH c AS (SELECT conv_id AS pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        answers AS (SELECT pair_id, turn AS last, max(text) AS answer FROM c WHERE role = 'assistant' AND turn = (SELECT max(d.turn) FROM c AS d WHERE d.pair_id = c.pair_id AND d.role = 'assistant') GROUP BY ALL),
        t AS (SELECT *, 'chosen' AS side FROM c
              UNION ALL SELECT c.*, 'rejected' FROM c LEFT JOIN answers a USING (pair_id) WHERE a.last IS NULL OR turn < a.last OR pair_id % 10 = 5
              UNION ALL SELECT a.pair_id, a.last, 'assistant', b.answer, 'rejected' FROM answers a JOIN answers b ON b.pair_id = a.pair_id + 1 WHERE a.pair_id % 10 NOT IN (0, 5)),
        cells AS (SELECT pair_id, turn, role, text, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS j FROM t GROUP BY ALL),
        ends AS (SELECT pair_id, min(turn) AS first_turn FROM cells WHERE c <> j GROUP BY pair_id),
        kept AS (SELECT t.*, CASE WHEN e.first_turn IS NULL OR turn < e.first_turn THEN 'prompt' ELSE side END AS segment FROM t LEFT JOIN ends e USING (pair_id)),
        r AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || chr(10) || '<|end|>' || chr(10) AS rest FROM kept WHERE segment <> 'prompt' OR side = 'chosen'),
        m AS (SELECT *, CASE WHEN role = 'assistant' AND segment <> 'prompt' THEN '0:' || length(head) || ',1:' || length(rest) ELSE '0:' || (length(head) + length(rest)) END AS mask FROM r)
        SELECT pair_id, CAST(0 AS BIGINT) AS from_turn, coalesce(string_agg(head || rest, '' ORDER BY turn, role, text) FILTER (segment = 'prompt'), '') AS prompt,
               coalesce(string_agg(head || rest, '' ORDER BY turn, role, text) FILTER (segment = 'chosen'), '') AS chosen, coalesce(string_agg(mask, ',' ORDER BY turn, role, text) FILTER (segment = 'chosen'), '') AS chosen_mask,
               coalesce(string_agg(head || rest, '' ORDER BY turn, role, text) FILTER (segment = 'rejected'), '') AS rejected, coalesce(string_agg(mask, ',' ORDER BY turn, role, text) FILTER (segment = 'rejected'), '') AS rejected_mask
        FROM m GROUP BY pair_id
    """,
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
        comp AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
        deg AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN deg USING (vec_id)
    """,
    "op10_sharding": "SELECT doc_id, md5(text) AS text_md5, true AS within_target FROM documents",
}
