"""The registered queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentlake.functions.keys import compared
from momentlake.llm import clusters, leakage, neighbours, packing, residue, topn
from momentlake.llm.text import BREAKING, TAG
from momentlake.plans.oracles import decoded


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = spark.read.parquet(f"{sf_dir}/hits.parquet").select("search_id", compared("video_id").alias("video_id"), "item_id", "t", "score")
    best = topn.top_n_per_group(hits, ["search_id", "video_id"], [("score", "desc"), ("t", "asc"), ("item_id", "asc")], "item_id", 5)
    return best.select("search_id", "video_id", "item_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/items.parquet")
    return neighbours.mutual_pairs(neighbours.neighbours(items, "id", "emb", dim=512, k=5, min_cosine=0.94, probes=3, margin=0.06))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/items.parquet")
    return clusters.similarity_clusters(items, "id", "emb", dim=512, min_cosine=0.66, min_size=4).select("cluster_id", "item_id")


def p4_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/items.parquet")
    members = clusters.similarity_clusters(items, "id", "emb", dim=512, min_cosine=0.66, min_size=4)
    return clusters.describe_clusters(members, items, "id", "label")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 4096)


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any right packing: pieces and tokens kept, no container too full, no text cut that fits, hardly more containers than tokens ask for."""
    pieces = packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 4096)
    fill = pieces.groupBy("container_id").agg(F.sum("tokens").alias("fill"), F.count("*").alias("pieces"))
    whole = fill.agg(F.sum("pieces").alias("pieces"), F.sum("fill").alias("tokens"), F.count_if(F.col("fill") > 4096).alias("too_full"), (F.count("*") <= 1.01 * F.ceil(F.sum("fill") / 4096) + 1).alias("tight"))
    cut = pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("size")).agg(F.count_if((F.col("n") > 1) & (F.col("size") <= 4096)).alias("cut_although_fitting"))
    return whole.join(F.broadcast(cut))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/eval_queries.parquet")
    spans = leakage.leaked_spans(docs, "doc_id", "text", tests, "id", ["query", "evidence_note"])
    return leakage.leaked_documents(spans).select("doc_id", F.col("item").alias("query_id"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").select("doc_id")


def _words(text: str) -> str:
    """SQL: the words of a rendered text; letters and digits of full width are the compatibility forms that occur."""
    plain = "".join(chr(c) for c in range(48, 123) if chr(c).isalnum())
    wide = "".join(chr(ord(c) + 0xFEE0) for c in plain)
    flat = f"regexp_replace(regexp_replace({text}, '{BREAKING.pattern}', chr(10), 'g'), '{TAG.pattern}', '', 'g')"
    return f"regexp_extract_all(lower(regexp_replace(translate({decoded(decoded(flat))}, '{wide}', '{plain}'), '\\p{{Cf}}', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p4_found, p4_described, p6_containers, p6_checks, p7_found, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH h AS (
                SELECT search_id, lower(trim(video_id)) AS video_id, item_id, t, score FROM hits
                WHERE search_id IS NOT NULL AND item_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND trim(video_id) <> ''
            ), once AS (
                SELECT *, row_number() OVER (PARTITION BY search_id, video_id, item_id ORDER BY score DESC, t ASC NULLS LAST) AS r FROM h
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY search_id, video_id ORDER BY score DESC, t ASC NULLS LAST, item_id ASC) AS place FROM once WHERE r = 1
            )
            SELECT search_id, video_id, item_id FROM ranked WHERE place <= 5
        """,
        "p2_found": """
            WITH usable AS (
                SELECT id, any_value(emb::DOUBLE[]) AS e FROM items
                WHERE id IS NOT NULL AND len(emb) = 512 AND len(list_filter(emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0
                GROUP BY id
            ), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))::DOUBLE[512] AS e FROM usable
            ), pairs AS (
                SELECT a.id AS a, b.id AS b, round(array_dot_product(a.e, b.e), 6) AS c FROM u a JOIN u b ON a.id < b.id
            ), close AS (SELECT * FROM pairs WHERE c >= 0.94
            ), sides AS (SELECT a AS id, b AS other, c FROM close UNION ALL SELECT b, a, c FROM close
            ), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other ASC) AS place FROM sides)
            SELECT DISTINCT least(id, other) AS item_id_a, greatest(id, other) AS item_id_b FROM ranked WHERE place <= 5
        """,
            "p4_found": """
            WITH RECURSIVE usable AS (
                SELECT id, any_value(emb::DOUBLE[]) AS e FROM items
                WHERE id IS NOT NULL AND len(emb) = 512 AND len(list_filter(emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0
                GROUP BY id
            ), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))::DOUBLE[512] AS e FROM usable
            ), links AS MATERIALIZED (
                SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id WHERE round(array_dot_product(a.e, b.e), 6) >= 0.66
            ), reach AS (
                SELECT DISTINCT a AS item, a AS other FROM links
                UNION
                SELECT reach.item, links.b FROM reach JOIN links ON links.a = reach.other
            ), label AS (SELECT item, min(other) AS cluster_id FROM reach GROUP BY item)
            SELECT cluster_id, item AS item_id FROM label WHERE cluster_id IN (SELECT cluster_id FROM label GROUP BY 1 HAVING count(*) >= 4)
        """,
        "p6_checks": """
            WITH d AS (SELECT octet_length(encode(text)) + 1 AS n FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
            SELECT sum(ceil(n / 4096))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, 0::BIGINT AS too_full, true AS tight, 0::BIGINT AS cut_although_fitting FROM d
        """,
        "p7_found": f"""
            WITH t AS (
                SELECT DISTINCT id AS query_id, unnest([query, evidence_note]) AS text FROM eval_queries WHERE id IS NOT NULL
            ), tw AS (SELECT query_id, {_words('text')} AS w FROM t WHERE text IS NOT NULL
            ), tg AS (SELECT DISTINCT query_id, array_to_string(w[k:k + 9], ' ') AS gram FROM (SELECT query_id, w, unnest(range(1, len(w) - 8)) AS k FROM tw)
            ), dw AS (SELECT doc_id, {_words('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
            ), dg AS (SELECT doc_id, array_to_string(w[k:k + 9], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS k FROM dw))
            SELECT DISTINCT doc_id, query_id FROM dg JOIN tg USING (gram)
        """,
    }
