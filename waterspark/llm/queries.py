"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waterspark.llm import pii, quality, url_filter
from waterspark.llm.alignment import align
from waterspark.llm.exact_dedup import exact_duplicates
from waterspark.llm.html_text import extract_text
from waterspark.llm.knn import top_k
from waterspark.llm.mixing import mix
from waterspark.llm.pieces import encode
from waterspark.llm.pitman_yor import language_scores
from waterspark.llm.registry import ORACLES, QUERIES, query
from waterspark.llm.shared import crc_fold, table
from waterspark.llm.simhash import near_duplicates
from waterspark.llm.turns import damage, repair_conversations
from waterspark.llm.vector_join import near_vectors

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A public model; another path can be given to the operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op5_exact_dedup",
    """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t FROM documents
    ), n AS (
        SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM d
    ), r AS (
        SELECT *, row_number() OVER o AS place, first(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
        FROM n WINDOW o AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id ASC NULLS LAST)
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
)
def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(table(spark, sf, "documents"))


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    made = encode(table(spark, sf, "documents"), tokenizer_path())
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_source_mix")
def op6_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix(table(spark, sf, "documents"))


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    made = near_duplicates(table(spark, sf, "documents"))
    return made.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_url_filter", url_filter.oracle_sql())
def op9_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf, "pages"))


@query(
    "op3_voronoi_knn",
    """
    WITH v AS (
        SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT a.row, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 50 = 0
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s
    )
    SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op3_voronoi_knn(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "embeddings"), F.col("id") % 50 == 0)


#: Documents of this fold are held out from learning.
FOLDS = 5


def quality_model(spark: SparkSession, sf: str) -> quality.LineModel:
    labels = table(spark, sf, "labels").filter(crc_fold("doc_id", FOLDS) != 0)
    return quality.train(table(spark, sf, "documents"), labels)


@query("op2_quality")
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    made = quality.score_quality(table(spark, sf, "documents"), quality_model(spark, sf))
    return made.select(
        "doc_id",
        (crc_fold("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op10_html_text")
def op10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    made = extract_text(table(spark, sf, "pages"))
    return made.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    made = pii.find_pii(docs, pii.train(docs))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.BASE]
    return made.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op7_pitman_yor")
def op7_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    return language_scores(table(spark, sf, "documents"), crc_fold("doc_id", 7) == 2)


@query(
    "op13_vector_join",
    """
    WITH RECURSIVE v AS (
        SELECT row_number() OVER () AS node, vec_id, embedding::DOUBLE[] AS e,
               embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine
        FROM embeddings
    ), u AS (
        SELECT node, e, len(e) AS dims, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE fine
    ), links AS (
        SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.node <> b.node AND a.dims = b.dims
        WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
    ), reach AS (
        SELECT node AS a, node AS b FROM v
        UNION
        SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
    ), least AS (
        SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.node = reach.b GROUP BY a
    ), n AS (
        SELECT a, count(*) AS n_links FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
    FROM v JOIN least ON least.a = v.node LEFT JOIN n ON n.a = v.node
    """,
)
def op13_vector_join(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings"))


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align(table(spark, sf, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


@query(
    "op11_turn_repair",
    """
    WITH RECURSIVE crc AS (
        SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
    ), given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS named
        FROM conversations
    ), fated AS (
        SELECT given.*, xor(list_reduce(list_prepend(4294967295, named), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 20 AS fate FROM given, crc
    ), damaged AS (
        SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
               CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
        FROM fated WHERE fate <> 0
    ), ordered AS (
        SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged
    ), faults AS (
        SELECT conv_id, turn, i, role, text, role[1] AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault,
               lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair
        FROM ordered
    ), inserts(s, t, roles) AS (
        VALUES (0, 0, []::VARCHAR[]), (0, 2, ['user']), (0, 3, ['user', 'assistant']), (1, 1, []), (1, 2, ['user']), (1, 3, ['user', 'assistant']),
               (2, 2, []), (2, 3, ['assistant']), (3, 3, []), (3, 2, ['user'])
    ), leads(s, initial, t) AS (
        VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
    ), moves AS (
        SELECT s, roles, 'D' AS edit, NULL AS initial, t FROM inserts
        UNION ALL SELECT i.s, roles, 'K', initial, l.t FROM inserts i JOIN leads l ON l.s = i.t
        UNION ALL SELECT i.s, roles, 'R', initial, l.t FROM inserts i JOIN leads l ON l.s = i.t WHERE initial <> 's'
    ), solve AS (
        SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM (SELECT DISTINCT conv_id FROM conversations)
        UNION ALL
        SELECT w.conv_id, f.i, m.t, min({
            'cost': way.cost + 3 * len(roles) + CASE edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END,
            'audit': way.audit || repeat('I', len(roles)) || edit,
            'lines': list_concat(list_concat(way.lines, list_transform(roles, lambda r: r || ':')),
                CASE edit WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END)})
        FROM solve w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN moves m ON m.s = w.s
        WHERE edit = 'D' OR (coalesce(fault, '') NOT IN ('blank', 'duplicate') AND (edit = 'R' OR m.initial = f.initial))
        GROUP BY w.conv_id, f.i, m.t
    ), sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
               count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (i > 1 AND coalesce(pair, '') NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
        FROM faults GROUP BY conv_id
    ), ends AS (
        SELECT w.conv_id, min({'cost': way.cost + 3 * len(roles), 'audit': way.audit || repeat('I', len(roles)), 'lines': list_concat(way.lines, list_transform(roles, lambda r: r || ':'))}) AS way
        FROM solve w LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM w.conv_id JOIN inserts m ON m.s = w.s AND m.t IN (0, 3)
        WHERE w.i = coalesce(n, 0) GROUP BY w.conv_id
    )
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, way.cost AS cost, way.audit AS audit, sha256(array_to_string(way.lines, chr(10))) AS repaired_sha256
    FROM ends e LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
)
def op11_turn_repair(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations")
    return repair_conversations(damage(given), given)
