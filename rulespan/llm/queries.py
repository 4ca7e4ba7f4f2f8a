"""The queries of the operators and of the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship
from .collocations import collocations
from .common import materialise, read_table
from .exact_dedup import exact_groups
from .language_id import fit, identify
from .license_scan import license_scan
from .mixing import mix
from .packing import pack_documents
from .quality_rules import fit_rules, statistics, verdict
from .secret_scan import KINDS, secret_scan
from .set_join import shingle_groups
from .simhash import near_groups
from .spelling import spelling_variants
from .token_files import read_token_files, write_token_files
from .warc import read_archives, write_archives


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents"))
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    starts = F.col("base.start")
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"),
        labels(F.col("base.label"), F.col("spans.label")).alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(read_table(spark, sf_dir, "documents"))
    return read_token_files(manifest, ids=False).withColumnRenamed("key", "doc_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = fit(docs.filter(~held))
    found = identify(docs.select("doc_id", "text"), model).withColumnRenamed("key", "doc_id")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", F.array_join(F.array_sort(F.map_keys("mixture")), ",").alias("languages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(statistics(read_table(spark, sf_dir, "documents")), "quality-statistics")
    rules = fit_rules(stats, read_table(spark, sf_dir, "labels"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (verdict(rules) == 0)).alias("kept"), verdict(rules).alias("rule")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("key").alias("doc_id"), *(count(k) for k in KINDS[:3]), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read_table(spark, sf_dir, "documents"), k=3, radius=2)
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), "source", "size", "source_size", "target", "taken")


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_groups(read_table(spark, sf_dir, "documents")).select(F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (op1_license_scan, op2_token_files, op3_language_id, op4_quality_rules, op5_exact_dedup, op6_warc, op7_secret_scan, op8_packing, op9_simhash, op10_mixing, op11_shingle_join, op12_spelling, op13_collocations)
}

SQL = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, h, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
        SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> keep THEN keep END AS refers_to
        FROM q""",
    "op11_shingle_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda x: x <> '') AS l
            FROM documents),
        u AS (SELECT doc_id, len(l) AS m, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM w),
        s AS (SELECT doc_id, m, i, w || coalesce(' ' || lead(w) OVER o, '') || coalesce(' ' || lead(w, 2) OVER o, '') || coalesce(' ' || lead(w, 3) OVER o, '') || coalesce(' ' || lead(w, 4) OVER o, '') AS s
              FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        e AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM s WHERE i + 4 <= m OR i = 1),
        n AS (SELECT doc_id, count(e.s) AS m FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id),
        h AS MATERIALIZED (SELECT * FROM e SEMI JOIN (SELECT s FROM e GROUP BY s HAVING count(*) > 1) USING (s)),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM h x JOIN h y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        p AS (SELECT a, b FROM c JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * common >= 80 * (i.m + j.m - common)),
        links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT n.doc_id, n.m AS n_shingles, least_id AS component_id FROM n JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) ON a = n.doc_id""",
    "op13_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        q AS (SELECT lang, row_number() OVER () AS p, list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '') AS l FROM p),
        u AS (SELECT lang, p, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM q),
        g AS (SELECT lang, w, w || ' ' || lead(w) OVER o AS w2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS w3,
                     w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4,
                     w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS w5
              FROM u WINDOW o AS (PARTITION BY p ORDER BY i)),
        f AS MATERIALIZED (
            SELECT lang, 1 AS size, w AS phrase, count(*) AS a FROM g GROUP BY ALL UNION ALL SELECT lang, 2, w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 3, w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 4, w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, 5, w5, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL),
        t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
        c AS (SELECT * FROM f WHERE size > 1 AND a >= 100),
        k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = c.lang AND o.size > c.size AND o.a >= c.a AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
        d AS (SELECT lang, phrase, a, size, unnest(range(1, size)) AS cut, string_split(phrase, ' ') AS l FROM k),
        v AS (
            SELECT d.lang, d.phrase, d.a, d.cut, l1.a AS l, r1.a AS r, t.n, (1000 * d.a::HUGEINT * t.n) // (l1.a::HUGEINT * r1.a) AS score
            FROM d JOIN t USING (lang)
            JOIN f l1 ON l1.lang = d.lang AND l1.phrase = array_to_string(d.l[1:d.cut], ' ') AND l1.size = d.cut
            JOIN f r1 ON r1.lang = d.lang AND r1.phrase = array_to_string(d.l[d.cut + 1:], ' ') AND r1.size = d.size - d.cut),
        b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
}
