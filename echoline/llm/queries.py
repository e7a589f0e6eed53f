"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, importance, language, lexical, lines, media, minhash, mixing, packing, sharding, substrings, topk, warc
from .common import materialize, table

#: Bytes of text in a shard of op8.
SHARD_BYTES = 1 << 20


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_classes(table(spark, sf_dir, "documents")).drop("t", "again")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe())


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.decode(materialize(media.encode(table(spark, sf_dir, "documents")), "zstd")).drop("clips")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("t", "first")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    return sharding.assign(sized, limit=SHARD_BYTES)


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select(
        warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number("refers_to_id").alias("refers_to"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.duplicate_spans(table(spark, sf_dir, "documents")).drop("t")


def op10_line_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain form of the method: whole lines of any length."""
    return substrings.duplicate_spans(table(spark, sf_dir, "documents"), unit="line", min_words=1).drop("t")


def op10_paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole paragraphs of any length."""
    return substrings.duplicate_spans(table(spark, sf_dir, "documents"), unit="paragraph", min_words=1).drop("t")


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of ``op10_substring_dedup`` and repeated passages at arbitrary places."""
    return substrings.passage_spans(table(spark, sf_dir, "documents")).drop("t")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).drop("template_subtrees")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of raw pages: models from labelled documents; evidence from the html element, the address and its host."""
    fields = language.page_fields(table(spark, sf_dir, "pages"))
    labelled = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"), "text")
    found = language.identify(fields, labelled=labelled, id_col="page_id", declared_col="declared", url_col="url", host_col=None)
    return found.withColumnRenamed("doc_id", "page_id").drop("text_hash")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_source_mix": op3_source_mix,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_media_columns": op6_media_columns,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_warc_zip": op9_warc_zip,
    "op10_substring_dedup": op10_substring_dedup,
    "op10_line_units": op10_line_units,
    "op10_paragraph_units": op10_paragraph_units,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_html_extraction": op13_html_extraction,
    "pages_language_id": pages_language_id,
}

def _units_sql(gap: str, tail: str, min_words: int) -> str:
    """Spans of repeated units: ``gap`` ends a unit, ``tail`` is what of a gap follows it."""
    return rf"""
        WITH cut AS (
            SELECT doc_id, generate_subscripts(u, 1) AS i, unnest(u) AS piece
            FROM (SELECT doc_id, string_split(regexp_replace(text, '({gap})', '\1' || chr(1), 'g'), chr(1)) AS u FROM documents)
        ), placed AS (
            SELECT doc_id, piece, CAST(coalesce(sum(length(piece)) OVER (
                PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM cut
        ), norm AS (
            SELECT doc_id, start, CAST(start + length(regexp_replace(piece, '{tail}', '')) AS BIGINT) AS "end",
                   lower(trim(regexp_replace(piece, '\s+', ' ', 'g'))) AS n
            FROM placed
        ), wide AS (
            SELECT *, CAST(len(string_split(n, ' ')) AS BIGINT) AS words FROM norm WHERE n <> '' AND len(string_split(n, ' ')) >= {min_words}
        ), ranked AS (
            SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
            FROM wide WINDOW w AS (PARTITION BY n ORDER BY doc_id, start)
        )
        SELECT doc_id, start, "end", words, kept_doc_id, kept_start FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start
    """


ORACLES = {
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op8_sharding": f"""
        WITH b AS (
            SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
                   lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits
            FROM documents
        ), levels AS (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS depth),
        sums AS (
            SELECT depth, substr(bits, 1, depth) AS shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n
            FROM b, levels GROUP BY 1, 2
        ), fits AS (SELECT * FROM sums WHERE shard_bytes <= {SHARD_BYTES} OR n = 1),
        best AS (
            SELECT doc_id, n_bytes, shard, depth, shard_bytes,
                   row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
            FROM b JOIN fits ON substr(b.bits, 1, fits.depth) = fits.shard
        )
        SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_bytes > {SHARD_BYTES} AS oversize FROM best WHERE k = 1
    """,
    "op9_warc_zip": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT *, array_to_string(list_transform(range(1, 41),
                lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS bits,
                max(page_id) OVER (PARTITION BY h) AS best
            FROM p
        )
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(
                   list_transform(range(0, 5), lambda t: (ascii(substr(bits, 5 * k + t + 1, 1)) - 48) * (1 << (4 - t)))) AS BIGINT), 1)), '')
                   AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM d
    """,
    "op10_substring_dedup": _units_sql(r"\n+|[.!?]\s+", r"\s+$", 8),
    "op10_line_units": _units_sql(r"\n+", r"\n+$", 1),
    "op10_paragraph_units": _units_sql(r"\n[ \t]*\n\s*", r"\n[ \t]*\n\s*$", 1),
    "op11_lexical_search": r"""
        WITH cut AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
        ), posting AS (SELECT doc_id, term, count(*) AS tf FROM cut GROUP BY 1, 2),
        long AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY 1),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM long),
        freq AS (SELECT term, count(*) AS df FROM posting GROUP BY 1),
        asked AS (
            SELECT item_id, term, count(*) AS q FROM (
                SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2
        ), scored AS (
            SELECT item_id, p.doc_id, CAST(sum(q * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
                * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // words))))) AS BIGINT) AS score
            FROM asked JOIN posting p USING (term) JOIN freq USING (term) JOIN long USING (doc_id) CROSS JOIN whole GROUP BY 1, 2
        ), ranked AS (
            SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op12_importance_resampling": r"""
        WITH byte_table AS (
            SELECT list_transform(range(0, 256), lambda c: list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, c)) AS x
        ), doc_words AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
        ), target_words AS (
            SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
        ), words AS (SELECT DISTINCT w FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM target_words)),
        bytes AS (
            SELECT w, list_transform(range(0, octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM words
        ), hashed AS (
            SELECT w, xor(list_reduce(b, lambda a, v: xor(x[CAST(xor(a, v) & 255 AS BIGINT) + 1], a >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM bytes, byte_table
        ), of_docs AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (w) GROUP BY 1),
        of_target AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (w) GROUP BY 1),
        totals AS (SELECT (SELECT count(*) FROM doc_words) AS all_s, (SELECT count(*) FROM target_words) AS all_t),
        gain AS (
            SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS g
            FROM of_docs LEFT JOIN of_target USING (bucket) CROSS JOIN totals
        ), weighed AS (
            SELECT doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS total FROM doc_words JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY 1
        ), scored AS (
            SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(total AS DOUBLE) / n_features), 0) AS BIGINT) AS weight,
                   CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
            FROM documents LEFT JOIN weighed USING (doc_id)
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r FROM scored WHERE n_features >= 20
        )
        SELECT s.doc_id, s.n_features, s.weight, s.weight + s.noise AS score,
               CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM ranked) THEN r END AS rank
        FROM scored s LEFT JOIN ranked USING (doc_id)
    """,
    # holds for pages marked up as this table's are: one article, and in it no other tags than these
    "op13_html_extraction": r"""
        WITH body AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
        plain AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|br|h1)>', ' ', 'g'), '</?b>', '', 'g') AS h FROM body),
        decoded AS (
            SELECT page_id, url, regexp_replace(replace(replace(replace(replace(h, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS h
            FROM plain
        ), single AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM decoded)
        SELECT page_id, url, text, length(text) AS n_chars FROM single
    """,
}
