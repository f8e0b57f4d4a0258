"""Queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievefold.llm import chat, clusters, decontam, negatives, packing, pii, quality, secrets, simhash, substrings, tokens, urls, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.format_chats(chat.planted(_read(spark, sf_dir, "conversations"))))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(_read(spark, sf_dir, "documents")))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept_text")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(_read(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"))[1].withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(_read(spark, sf_dir, "documents")))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").cast("long").alias("score"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages")).drop("tried")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(_read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_chat, op3_secrets, op4_substrings, op5_warc, op6_packing, op7_simhash, op8_pii, op9_tokens, op10_decontam, op11_urls, op12_negatives, op13_clusters)}

_RULES = decontam.DecontamRules()


def _masked(words: str, at: str, mask: str) -> str:
    """SQL for the words under a mask's ones, from place ``at``."""
    return "concat_ws(' ', " + ", ".join(f"{words}[{at} + {k}]" for k, c in enumerate(mask) if c == "1") + ")"


def _windows(table: str) -> str:
    """SQL for (id, which mask, at, key) of each window of a table with id and ws."""
    return " UNION ALL ".join(f"SELECT id, {m} AS m, i AS at, {_masked('ws', 'i', mask)} AS key FROM (SELECT id, ws, unnest(range(1, len(ws) - {len(mask)} + 2)) AS i FROM {table} WHERE len(ws) >= {len(mask)})" for m, mask in enumerate(_RULES.masks))


def _split(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_RULES_SQL = ", ".join(f"('{r.host}', '{r.path}', '{r.action}')" for r in urls.HOST_RULES)


def _pattern_cases(value) -> str:
    """CASE branches over all patterns, allowing ones first; each pattern runs on every URL."""
    ordered = sorted(urls.PATTERNS, key=lambda p: p.action != "allow")
    return " ".join(f"WHEN regexp_matches(low, '{p.expression}') THEN '{value(p)}'" for p in ordered)


_WHOLE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_NUMBERS = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"


def _round(n: int) -> str:
    """SQL for a round: centroids c{n} from the vectors v and centroids c{n - 1}."""
    return f"""
        a{n} AS (SELECT id, e, k FROM (SELECT id, e, k, list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS d FROM v, c{n - 1}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1),
        s{n} AS (SELECT k, i, floor(sum(x) / count(*)) AS m FROM (SELECT k, unnest(e) AS x, unnest(range(1, 65)) AS i FROM a{n}) GROUP BY k, i),
        m{n} AS (SELECT k, list(m ORDER BY i) AS m FROM s{n} GROUP BY k),
        c{n} AS (SELECT c.k, coalesce(m, c) AS c FROM c{n - 1} AS c LEFT JOIN m{n} AS m ON c.k = m.k)"""


ORACLE_SQL: dict[str, str] = {
    "op11_urls": f"""
        WITH r(host, path, action) AS (VALUES {_RULES_SQL}),
        u AS (SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                     CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
        p AS (SELECT *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
        f AS (SELECT p.page_id, r.host || r.path AS rule, r.action FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
              QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) = 1),
        t AS (SELECT page_id, CASE {_pattern_cases(lambda p: p.action)} ELSE 'allow' END AS verdict, CASE {_pattern_cases(lambda p: p.line)} END AS pattern FROM p)
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.action, t.verdict) AS verdict, CASE WHEN f.rule IS NULL THEN t.pattern END AS pattern
        FROM p JOIN t ON p.page_id = t.page_id LEFT JOIN f ON p.page_id = f.page_id""",
    "op12_negatives": f"""
        WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_NUMBERS} AS e FROM embeddings WHERE label IS NOT NULL AND {_WHOLE}),
        s AS (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v AS a JOIN v AS b ON a.id % 100 = 0 AND a.id <> b.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
        n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    "op13_clusters": f"""
        WITH v AS (SELECT vec_id AS id, {_NUMBERS} AS e FROM embeddings WHERE len(embedding) = 64 AND {_WHOLE}),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || id)) - 1 AS k, e AS c FROM v QUALIFY k < 40),
        {",".join(_round(n) for n in range(1, 7))},
        d AS (SELECT id, a.k, CAST(list_inner_product(e, e) - 2 * list_inner_product(e, c) + list_inner_product(c, c) AS BIGINT) AS distance,
                     sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS h FROM a6 AS a JOIN c5 ON a.k = c5.k)
        SELECT id AS vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM d""",
    "op4_substrings": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
        e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
        s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN g USING (doc_id, i) GROUP BY 1)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN s ON w.doc_id = s.doc_id""",
    "op10_decontam": f"""
        WITH d AS (SELECT doc_id AS id, {_split("text")} AS ws FROM documents), b AS (SELECT item_id AS id, {_split("text")} AS ws FROM benchmark),
        dw AS ({_windows("d")}), bw AS ({_windows("b")}),
        a AS (SELECT DISTINCT dw.id AS doc_id, bw.id AS item_id, CAST(dw.at - bw.at AS BIGINT) AS shift FROM dw JOIN bw ON dw.m = bw.m AND dw.key = bw.key),
        x AS (SELECT doc_id, item_id, shift, len(b.ws) AS n, unnest(range(1, len(b.ws) + 1)) AS i, d.ws AS dws, b.ws AS bws FROM a JOIN d ON a.doc_id = d.id JOIN b ON a.item_id = b.id),
        p AS (SELECT doc_id, item_id, shift, n, i, sum(CASE WHEN i + shift >= 1 AND dws[i + shift] = bws[i] THEN 1 ELSE -{_RULES.penalty} END) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS p FROM x),
        q AS (SELECT doc_id, item_id, n, p - least(0, coalesce(min(p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS score FROM p)
        SELECT doc_id, item_id, CAST(max(score) AS BIGINT) AS score FROM q GROUP BY doc_id, item_id, n HAVING max(score) >= least({_RULES.min_score}, n)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, max(page_id) OVER (PARTITION BY b) AS target FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> target THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> target THEN target END AS refers_to, true AS verified
        FROM d""",
}
