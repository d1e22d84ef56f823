"""The registered queries of the operators, over whole tables.

Each query calls its operator with production parameters and derives the
digest columns from what the operator returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaytrace.llm import bpe, collocation, decontaminate, hard_negatives, html_text, licenses, pii, quality, secrets, simhash, token_counts, token_store, warc
from relaytrace.llm.common import joined_spans
from relaytrace.sources.tables import read_table

#: Tokens from which a text is over the limit of a context.
TOKEN_LIMIT = 4096


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(read_table(spark, sf_dir, "documents"), raw=True)
    both = bpe.decode(ids)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = token_counts.count_tokens(read_table(spark, sf_dir, "documents"))
    return n.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def _span_columns(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    base = found.select("doc_id", "spans", F.filter("spans", lambda s: s["base"]).alias("base"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return base.select("doc_id", *map(count, kinds), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(pii.find(read_table(spark, sf_dir, "documents")), pii.KINDS[:4])


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write_store(read_table(spark, sf_dir, "documents"))
    return token_store.read_store(spark, folder, with_ids=False)


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_warc(read_table(spark, sf_dir, "pages"))
    return warc.read_warc(spark, folder, with_payload=False).drop("url")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_columns(secrets.scan(read_table(spark, sf_dir, "documents")), secrets.KINDS[:3])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(read_table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    starts = F.transform(base, lambda m: m["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"))


QUERIES = {f.__name__: f for f in (
    op1_bpe_round_trip, op2_benchmark_leaks, op3_token_counts, op4_personal_data, op5_token_files, op6_warc_archives,
    op7_secrets, op8_quality_rules, op9_main_text, op10_simhash_groups, op11_collocations, op12_hard_negatives, op13_licenses)}

#: DuckDB's SQL for the same rows, where SQL can express them.
ORACLE_SQL = {
    "op6_warc_archives": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first IS DISTINCT FROM d.page_id AND f.first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
    """,
    "op11_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
             p AS (SELECT d, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM d),
             q AS (SELECT d, p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
             v AS (SELECT d, p, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q),
             l AS (SELECT lang, w AS g1, g1 || ' ' || lead(w, 1) OVER o AS g2, g2 || ' ' || lead(w, 2) OVER o AS g3,
                          g3 || ' ' || lead(w, 3) OVER o AS g4, g4 || ' ' || lead(w, 4) OVER o AS g5
                   FROM v WINDOW o AS (PARTITION BY d, p ORDER BY i)),
             g AS MATERIALIZED (SELECT lang, m, phrase, CAST(count(*) AS BIGINT) AS f
                   FROM (SELECT lang, unnest([1, 2, 3, 4, 5]) AS m, unnest([g1, g2, g3, g4, g5]) AS phrase FROM l)
                   WHERE phrase IS NOT NULL GROUP BY ALL),
             n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY lang),
             c AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS ws, f AS a FROM g WHERE m > 1 AND f >= 100),
             f AS MATERIALIZED (SELECT lang || chr(10) || phrase AS part, f FROM g WHERE f >= 100),
             t AS MATERIALIZED (SELECT c.lang, phrase, a, n, k, c.lang || chr(10) || array_to_string(ws[1:k], ' ') AS head,
                                       c.lang || chr(10) || array_to_string(ws[k + 1:], ' ') AS tail
                                FROM c JOIN n ON n.lang = c.lang JOIN (SELECT unnest([1, 2, 3, 4]) AS k) AS ks ON k < c.m),
             s AS (SELECT lang, phrase, a, k, x.f AS l, y.f AS r, n,
                          CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
                   FROM t JOIN f AS x ON x.part = head JOIN f AS y ON y.part = tail),
             b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             e AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:j], ' ') AS phrase, c.a
                   FROM c JOIN (SELECT unnest([1, 2, 3, 4]) AS i) AS b1 ON i < c.m
                   JOIN (SELECT unnest([2, 3, 4, 5]) AS j) AS b2 ON j > i AND j <= c.m AND j - i + 1 < c.m),
             o AS (SELECT * FROM b WHERE (lang, phrase, a) NOT IN (SELECT b.lang, b.phrase, b.a FROM b JOIN e ON e.lang = b.lang AND e.phrase = b.phrase WHERE 100 * e.a >= 100 * b.a))
        SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score
        FROM o QUALIFY rank <= 2000
    """,
    "op12_hard_negatives": """
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
                          CAST(list_sum(list_transform(list_zip(a.vec, r.vec), lambda z: z[1] * z[2])) AS BIGINT) AS score
                   FROM v AS a JOIN v AS r ON a.id % 100 = 0 AND a.id <> r.id),
             p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
               id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id
        WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score QUALIFY rank <= 5
    """,
}
