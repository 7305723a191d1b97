"""The registered query of each corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.llm import bpe, centroids, divergence, exact_dedup, html_extract, lm_score, mixing, packing, pii, quality, simhash, toxicity, url_filter

RULES = (
    url_filter.Rule(url_filter.ALLOW, "com", "/"),
    url_filter.Rule(url_filter.BLOCK, "example.com", "/en/"),
    url_filter.Rule(url_filter.ALLOW, "www.example.com", "/en/"),
    url_filter.Rule(url_filter.BLOCK, "net", "/es/"),
    url_filter.Rule(url_filter.BLOCK, "net", "/fr/"),
)
HELD_OUT_PARTS = 5


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo HELD_OUT_PARTS; 0 is held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(HELD_OUT_PARTS))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), RULES)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train_toxicity(docs, labels.where(fold() != 0))
    scores = toxicity.score_toxicity(docs, model)
    return scores.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op11_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)
    return centroids.with_inertia(found).select(F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode_documents(bpe.encode_documents(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_url_filter, op3_html_extract, op4_mixing, op5_exact_dedup, op6_lm_score, op7_pii, op8_toxicity, op9_simhash, op10_quality, op11_ns_bounds, op12_divergence, op13_byte_bpe, pipeline)
    return {f.__name__: f for f in found}


_UPPER, _LOWER = url_filter.UPPER, url_filter.LOWER


def _ns_bounds_sql(k: int = 40, rounds: int = 5) -> str:
    """The rounds written out one after the other; integers in doubles are exact at these sizes."""
    kept = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    steps = [
        f"x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {kept})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, v AS c FROM x ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'j': j}}) AS best FROM
            (SELECT rid, vec_id, v, j, CAST(list_sum(list_transform(list_zip(v, c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS BIGINT) AS d FROM x, c{n}) GROUP BY rid)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (SELECT j, coalesce(m, c) AS c FROM c{n} LEFT JOIN (SELECT j, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS m FROM
                (SELECT j, i, sum(e) AS s, count(*) AS n FROM (SELECT best.j AS j, unnest(v) AS e, unnest(range(64)) AS i FROM a{n}) GROUP BY j, i) GROUP BY j) USING (j))""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(j AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM (SELECT vec_id, best.j AS j, best.d AS d FROM a{rounds}) JOIN c{rounds} USING (j)"""


def _divergence_sql(least_docs: int = 10, top: int = 10) -> str:
    share = lambda c, total: f"CAST(1 + CAST(1000000000 AS HUGEINT) * ({c} + 2) // ({total} + 2 * terms) AS BIGINT)"
    gap = "CAST((CAST(p AS HUGEINT) - q) * (p - q) // (p + q) AS BIGINT)"
    return rf"""WITH words AS MATERIALIZED (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM words),
        kept AS (SELECT lang, term, count(*) OVER (PARTITION BY lang) AS terms FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM words) GROUP BY lang, term HAVING count(*) >= {least_docs}),
        counts AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM words) GROUP BY ALL),
        filled AS MATERIALIZED (SELECT g.lang, g.source, k.term, terms, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, g.source) AS total,
            sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, k.term) AS in_all, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang) AS lang_total
            FROM groups g JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
        shares AS MATERIALIZED (SELECT lang, source, term, c, {share("c", "total")} AS p, {share("in_all", "lang_total")} AS q FROM filled),
        sums AS (SELECT lang, source, item, sum({gap}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source) GROUP BY ALL),
        parts AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, {gap} FROM shares WHERE c > 0 AND p > q)
        SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts
        QUALIFY part = 'pair' OR rank <= {top}"""


def oracle_sql() -> dict[str, str]:
    """SQL for what it can express: URL rules, exact groups, clusters and divergences; the others are tested against brute force."""
    host = rf"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    path = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    by_length = sorted(RULES, key=lambda r: -len(r.host + r.path))
    fits = [(f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')", r) for r in by_length]
    case = lambda pick, other: "CASE " + " ".join(f"WHEN {c} THEN '{pick(r)}'" for c, r in fits) + f" ELSE {other} END"
    return {
        "op2_url_filter": f"""
            WITH parts AS (SELECT page_id, {host} AS host, {path} AS path FROM pages)
            SELECT page_id, host, path, {case(lambda r: r.host + r.path, 'NULL')} AS rule, {case(lambda r: r.verdict, "'allow'")} AS verdict FROM parts""",
        "op5_exact_dedup": f"""
            WITH rows AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, text_sha256
            FROM rows WINDOW same AS (PARTITION BY text_sha256)""",
        "op11_ns_bounds": _ns_bounds_sql(),
        "op12_divergence": _divergence_sql(),
    }
