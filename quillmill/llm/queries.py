"""The thin queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, licenses, line_dedup, mixing, ngram_join, quality_model, quality_rules, secrets, warc
from .frames import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: A public tokenizer's vocabulary with word ends; its words serve the guess costs.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"), words=secrets.ranked_words(VOCABULARY))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, ("assign", "access", "hex", "guess")),
        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        F.round(F.array_max("spans.log10_guesses"), 3).alias("log10_guesses"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    own, more = F.col("base.label"), F.col("detections.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(own).alias("base_labels"),
        labels(F.concat(own, more)).alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.sure"), F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = quality_model.score(docs, quality_model.fit(docs, labels))
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language_id.fit(docs.filter(~quality_model.held_out(F.col("doc_id"))))
    return language_id.predict(docs, profiles).select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ppl"
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(_table(spark, sf_dir, "pages"), shared_folder(spark))
    return back.filter(F.col("kind") != "gap").select(
        F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to")
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.later_lines(_table(spark, sf_dir, "documents"))


#: Target weights of the mix; sources that aren't named weigh 1.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2, "src3": 2}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), MIX_WEIGHTS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_secret_scan,
        op3_license_scan,
        op4_quality_classifier,
        op5_language_id,
        op6_quality_rules,
        op7_warc,
        op8_decontamination,
        op9_line_dedup,
        op10_mixing,
    )
}

ORACLES = {
    "op1_ngram_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS root, doc_id FROM documents UNION SELECT r.root, e.y FROM r JOIN e ON e.x = r.doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.root)::BIGINT AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY ALL
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
             last AS (SELECT sha, max(page_id) AS last_id FROM p GROUP BY sha)
        SELECT p.page_id,
               strlen(p.html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                          1 + ((('0x' || substr(p.sha, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN p.page_id = last.last_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN p.page_id = last.last_id THEN NULL ELSE last.last_id END AS refers_to
        FROM p JOIN last USING (sha)
    """,
    "op9_line_dedup": """
        WITH a AS (
            SELECT doc_id, string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS xs
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        b AS (SELECT doc_id, unnest(xs) AS x, (generate_subscripts(xs, 1) - 1)::INT AS line FROM a),
        s AS (SELECT DISTINCT doc_id, line, list_sort(list_distinct(regexp_extract_all(x, '[^ \\x09-\\x0D]+'))) AS ws FROM b),
        g AS (SELECT ws, len(ws) AS n, min({'d': doc_id, 'l': line}) AS place FROM s WHERE len(ws) > 0 GROUP BY ws),
        c AS (SELECT row_number() OVER (ORDER BY place) AS cid, * FROM g),
        t AS (SELECT cid, n, unnest(ws) AS w FROM c),
        f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
        r AS (SELECT cid, n, w, row_number() OVER (PARTITION BY cid ORDER BY df, w) AS pos FROM t JOIN f USING (w)),
        p AS (SELECT cid, n, w FROM r WHERE pos <= n - (4 * n + 4) // 5 + 1),
        pairs AS (SELECT DISTINCT p.cid AS x, q.cid AS y FROM p JOIN p AS q ON p.w = q.w AND p.cid <> q.cid AND 5 * p.n >= 4 * q.n AND 5 * q.n >= 4 * p.n),
        k AS (SELECT x, y, len(list_intersect(cx.ws, cy.ws)) AS common, cx.n + cy.n AS total, cy.place AS other
              FROM pairs JOIN c AS cx ON cx.cid = x JOIN c AS cy ON cy.cid = y),
        m AS (SELECT x AS cid, count(*) AS n_links, min({'e': other, 's': common / (total - common)}) AS best FROM k WHERE 5 * common >= 4 * (total - common) GROUP BY x),
        o AS (SELECT s.doc_id, s.line, c.place, coalesce(m.n_links, 0) AS n_links, best,
                     coalesce(best.e < c.place, false) AS linked FROM s JOIN c USING (ws) LEFT JOIN m USING (cid)),
        z AS (SELECT *, CASE WHEN linked THEN best.e ELSE place END AS e FROM o)
        SELECT doc_id, line, e.d AS earlier_doc_id, e.l AS earlier_line, CASE WHEN linked THEN best.s ELSE 1.0::DOUBLE END AS similarity,
               place.d AS class_doc_id, place.l AS class_line, n_links::BIGINT AS n_links
        FROM z WHERE e < {'d': doc_id, 'l': line}
    """,
    "op10_mixing": """
        WITH RECURSIVE n AS (
            SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5(concat('17:', doc_id))) - 1 AS number FROM documents),
        s AS (SELECT source, CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 WHEN 'src3' THEN 2 ELSE 1 END AS weight,
                     (max(number) // 16 + 1 + weight - 1) // weight AS turns FROM n GROUP BY source),
        q AS (SELECT *, row_number() OVER (PARTITION BY weight ORDER BY turns DESC, source) - 1 AS rank FROM s),
        ph AS (SELECT until, coalesce(lag(until) OVER (ORDER BY until), 0) AS since, (SELECT sum(weight) FROM s WHERE turns >= until) AS length
               FROM (SELECT DISTINCT turns AS until FROM s)),
        j AS (SELECT until, length, weight, k, rank, k * length // weight AS release, ((k + 1) * length + weight - 1) // weight AS due
              FROM ph JOIN q ON q.turns >= ph.until, unnest(range(0, weight)) AS u(k)),
        l AS (SELECT until, list({'w': weight, 'k': k, 'r': rank, 'release': release} ORDER BY due, weight DESC, k, rank) AS jobs FROM j GROUP BY until),
        sim AS (
            SELECT until, -1 AS slot, jobs, jobs[1] AS pick FROM l
            UNION ALL
            SELECT until, slot, list_filter(jobs, lambda x: x <> pick), pick FROM (
                SELECT until, slot + 1 AS slot, jobs, list_filter(jobs, lambda x: x.release <= slot + 1)[1] AS pick FROM sim WHERE len(jobs) > 0)),
        st AS (SELECT *, coalesce(sum((until - since) * length) OVER (ORDER BY until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ph)
        SELECT n.doc_id, n.source, n.n_chars, (st.start + (n.number // 16 // q.weight - st.since) * st.length + sim.slot)::BIGINT AS mix_slot, (n.number % 16)::INT AS mix_place
        FROM n JOIN q USING (source)
        JOIN st ON n.number // 16 // q.weight >= st.since AND n.number // 16 // q.weight < st.until
        JOIN sim ON sim.until = st.until AND sim.slot >= 0 AND sim.pick.w = q.weight AND sim.pick.r = q.rank AND sim.pick.k = (n.number // 16) % q.weight
    """,
}
