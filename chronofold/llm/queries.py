"""The registered query of each operator, over its whole table, and the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import audit, bpe, chat, licenses, neardup, negatives, packing, quality_classifier, quality_rules, shards, topk, unigram, url_reputation


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.read_back(chat.conversation_blocks(chat.format_turns(turns, ordered=True), ordered=True))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_digest(_table(spark, sf_dir, "documents"))


def pack_digest(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.write_shards(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge_documents(docs, quality_rules.train(docs, _table(spark, sf_dir, "labels")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(_table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of a page is the quality label of the document whose number its path ends with."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_reputation.split_url(F.col("url"))
    number = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    named = pages.select(host.alias("host"), F.when(number != "", number).cast("long").alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").where("quality in (0, 1)").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    outcomes = named.join(labels, "doc_id", "left").select("host", "bad")
    judged = url_reputation.judge_urls(pages, outcomes)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_rate_bound")})


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score_documents(docs, quality_classifier.train(docs, _table(spark, sf_dir, "labels")))


def op10_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ids`` are little-endian 32-bit, by scores estimated on all documents; ``decoded_sha256`` digests what decoding them gives."""
    docs = _table(spark, sf_dir, "documents")
    return unigram.round_trip(docs, scores=unigram.estimate_scores(docs)).select("doc_id", "n_ids", "n_byte_ids", "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text that decoding them gives."""
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"))
    written = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = negatives.prepared(vectors.withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")))
    return negatives.hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_packing": op2_packing,
    "op3_training_order": op3_training_order,
    "op4_quality_rules": op4_quality_rules,
    "op5_top_k": op5_top_k,
    "op6_license_scan": op6_license_scan,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_reputation": op8_url_reputation,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_unigram_pieces": op10_unigram_pieces,
    "op11_bpe": op11_bpe,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '<\\*[|]im_start[|]>|<\\*[|]im_end[|]>|<\\*[|]endoftext[|]>|<\\*s>|<\\*/s>|[[]\\*INST[]]|[[]\\*/INST[]]|<\\*<SYS>>|<\\*</SYS>>')) AS escaped FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|im_start|>') + length(role) + 1 + escaped + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        q AS (SELECT DISTINCT vec_id, w FROM v WHERE vec_id % 50 = 0),
        scored AS (
            SELECT q.vec_id AS query_id, q.w, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
            FROM q JOIN v c ON q.vec_id <> c.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 5
    """,
    "op7_near_duplicates": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS x
            FROM d),
        n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n_shingles FROM s),
        e AS (SELECT doc_id, hash(unnest(x)) AS h FROM s),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM shared JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
            WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM n
            UNION
            SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT n.doc_id, n_shingles, m AS component_id, n.doc_id = m AS kept FROM n JOIN least ON n.doc_id = least.a
    """,
    "op8_url_reputation": r"""
        WITH p AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        q AS (SELECT doc_id, 1 - min(quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
        o AS (SELECT host, bad FROM p LEFT JOIN q ON doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT)),
        h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), ':\d*$', '') AS bare FROM o GROUP BY host),
        s AS (SELECT *, string_split(bare, '.') AS part FROM h),
        t AS (
            SELECT host, n, bad, CASE WHEN regexp_matches(bare, '^[\d.]+$') OR len(part) <= 2 THEN bare
                WHEN length(part[len(part)]) = 2 AND part[len(part) - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN array_to_string(part[len(part) - 2:], '.')
                ELSE array_to_string(part[len(part) - 1:], '.') END AS domain
            FROM s),
        hosts AS (SELECT *, regexp_extract(domain, '^[^.]*\.(.*)$', 1) AS suffix FROM t),
        domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
        suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
        overall AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
        s1 AS (SELECT suffix, n, bad, m FROM suffixes, overall),
        k1 AS (SELECT greatest(0, coalesce(sum(n * (bad / n - m) ** 2 / greatest(m * (1 - m), 1e-6)), 0) - count(*)) AS ov, coalesce(sum(n - 1), 0) AS more FROM s1 WHERE n > 0),
        g1 AS (SELECT least(200, greatest(2, CASE WHEN ov * 200 <= more THEN 200 ELSE more / ov - 1 END)) AS k FROM k1),
        r1 AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s1, g1),
        s2 AS (SELECT domain, n, bad, m FROM domains JOIN r1 USING (suffix)),
        k2 AS (SELECT greatest(0, coalesce(sum(n * (bad / n - m) ** 2 / greatest(m * (1 - m), 1e-6)), 0) - count(*)) AS ov, coalesce(sum(n - 1), 0) AS more FROM s2 WHERE n > 0),
        g2 AS (SELECT least(200, greatest(2, CASE WHEN ov * 200 <= more THEN 200 ELSE more / ov - 1 END)) AS k FROM k2),
        r2 AS (SELECT domain, (bad + k * m) / (n + k) AS m FROM s2, g2),
        s3 AS (SELECT host, n, bad, m FROM hosts JOIN r2 USING (domain)),
        k3 AS (SELECT greatest(0, coalesce(sum(n * (bad / n - m) ** 2 / greatest(m * (1 - m), 1e-6)), 0) - count(*)) AS ov, coalesce(sum(n - 1), 0) AS more FROM s3 WHERE n > 0),
        g3 AS (SELECT least(200, greatest(2, CASE WHEN ov * 200 <= more THEN 200 ELSE more / ov - 1 END)) AS k FROM k3),
        r3 AS (SELECT host, n, k, (bad + k * m) / (n + k) AS m FROM s3, g3),
        b AS (SELECT host, CAST(n AS BIGINT) AS n_outcomes, m AS bad_rate, m - sqrt(m * (1 - m) / (n + k + 1)) AS bound FROM r3),
        rule AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) x(rh, rp, rv)),
        fit AS (
            SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
            FROM p JOIN rule ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.rv, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
            n_outcomes, round(bad_rate, 6) AS bad_rate, round(bound, 6) AS bad_rate_bound
        FROM p LEFT JOIN fit USING (page_id) LEFT JOIN b ON b.host = p.host
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        a AS (SELECT *, row_number() OVER () AS anchor FROM (SELECT DISTINCT vec_id, label, w FROM v WHERE vec_id % 100 = 0)),
        s AS (
            SELECT anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
            FROM a CROSS JOIN v c),
        p AS (
            SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS place
            FROM s WHERE same AND vec_id <> anchor_id QUALIFY place <= 5),
        n AS (
            SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                row_number() OVER (PARTITION BY anchor, place ORDER BY score DESC, vec_id) AS rank
            FROM p JOIN s USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
    "op13_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
                list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        f AS (
            SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails,
                coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM d LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
        i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
        o AS (
            SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e
            WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
        m AS (
            SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, i AS step, o[i] AS own, n, good, toxic, fails[o[i]] AS failed,
                len(list_filter(o[1:i - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
            FROM c, o, i),
        g AS (
            SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failed), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failed), 0) AS removed,
                coalesce(sum(n) FILTER (gone AND failed), 0) AS redundant, coalesce(sum(n) FILTER (failed AND alone), 0) AS unique_fails,
                coalesce(sum(good) FILTER (NOT gone AND failed), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND failed), 0) AS toxic_lost
            FROM m GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM g
    """,
}
