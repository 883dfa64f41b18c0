"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import (
    context_tree,
    decontaminate,
    exact_dedup,
    language_id,
    near_dedup,
    sentencepiece_viterbi,
    sharding,
    substring_dedup,
    token_orc,
    toxicity,
)
from marginalia.llm.common import shared_dir, table


def _remainder(n: int):
    """crc32 of doc_id as text mod n; a null doc_id is empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(_remainder(4) != 2))
    return language_id.predict(docs, model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


#: The label columns as categories, in the chain's order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.predict(docs, model).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.dedup(table(spark, sf_dir, "documents"), percent=85)


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = token_orc.new_path(spark)
    token_orc.write(table(spark, sf_dir, "documents"), at)
    return token_orc.digest(token_orc.read(spark, at))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.digest(sentencepiece_viterbi.encode(table(spark, sf_dir, "documents")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("kept", ~F.col("contaminated"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"), _remainder(7) != 2)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


#: Arrivals that the sharding query appends one after the other; a document belongs to that of its doc_id's remainder.
ARRIVALS = 6


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.ShardTable(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)).cast("long")
    rows = table(spark, sf_dir, "documents").withColumn("arrival", arrival)
    for k in range(ARRIVALS):
        shards.append(rows.where(F.col("arrival") == k))
        shards.compact()
        shards.vacuum()
    return shards.read().select("doc_id", "arrival", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_language_id,
        op2_toxicity,
        op3_substring_dedup,
        op4_near_dedup,
        op5_token_orc,
        op6_sentencepiece,
        op7_decontaminate,
        op8_context_tree,
        op9_exact_dedup,
        op10_sharding,
    )
    return {f.__name__: f for f in every}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = r"[^\x20\x09-\x0D]+"


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
            t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
            y AS (SELECT doc_id, p, string_agg(word, ' ') OVER v AS k, count(*) OVER v AS n FROM t
                  WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
            f AS (SELECT k, min(doc_id) AS first FROM y WHERE n = 13 GROUP BY k),
            z AS (SELECT DISTINCT y.doc_id, y.p + j AS p FROM y JOIN f ON y.k = f.k CROSS JOIN range(13) r(j) WHERE n = 13 AND first < y.doc_id),
            g AS (SELECT t.doc_id, sum(CASE WHEN z.p IS NULL THEN 0 ELSE 1 END) AS gone, string_agg(CASE WHEN z.p IS NULL THEN word END, ' ' ORDER BY t.p) AS kept
                  FROM t LEFT JOIN z ON t.doc_id = z.doc_id AND t.p = z.p GROUP BY t.doc_id)
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
        "op4_near_dedup": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
            t AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
            y AS (SELECT doc_id, least(n, 5) AS k, string_agg(word, ' ') OVER v AS s, count(*) OVER v AS n FROM t
                  WINDOW v AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
            s AS (SELECT DISTINCT doc_id, k, s FROM y WHERE n = k),
            c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s AS a JOIN s AS b ON a.s = b.s AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM i JOIN c AS x ON x.doc_id = a JOIN c AS y ON y.doc_id = b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
            e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT doc_id AS doc, doc_id AS comp FROM d UNION SELECT e.b, r.comp FROM r JOIN e ON r.doc = e.a),
            m AS (SELECT doc, min(comp) AS comp FROM r GROUP BY doc)
            SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, comp AS component_id, d.doc_id = comp AS kept FROM d LEFT JOIN c ON c.doc_id = d.doc_id JOIN m ON m.doc = d.doc_id""",
        # Of 13 words at least 11 agree, so four in a row do; of a shorter item two in a row do, or its one word.
        "op7_decontaminate": f"""
            WITH dl AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
            bl AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
            dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dl),
            bw AS (SELECT item_id, len(w) AS size, least(len(w), {decontaminate.WINDOW}) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM bl),
            dr AS (SELECT doc_id, p, word, lead(word, 1) OVER v AS w1, lead(word, 2) OVER v AS w2, lead(word, 3) OVER v AS w3 FROM dw WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
            br AS (SELECT item_id, size, q, word, lead(word, 1) OVER v AS w1, lead(word, 2) OVER v AS w2, lead(word, 3) OVER v AS w3 FROM bw WINDOW v AS (PARTITION BY item_id ORDER BY q)),
            h AS (SELECT doc_id, item_id, p - q AS shift FROM dr JOIN br ON size >= 13 AND dr.word = br.word AND dr.w1 = br.w1 AND dr.w2 = br.w2 AND dr.w3 = br.w3
                  UNION SELECT doc_id, item_id, p - q FROM dr JOIN br ON size < 13 AND dr.word = br.word AND dr.w1 = br.w1
                  UNION SELECT doc_id, item_id, p - q FROM dr JOIN br ON size = 1 AND dr.word = br.word),
            o AS (SELECT h.doc_id, h.item_id, n, sum(CASE WHEN dw.word = bw.word THEN 1 ELSE 0 END) OVER (v ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS same,
                         count(*) OVER (v ROWS BETWEEN CURRENT ROW AND n - 1 FOLLOWING) AS there
                  FROM h JOIN bw ON bw.item_id = h.item_id JOIN dw ON dw.doc_id = h.doc_id AND dw.p = q + shift
                  WINDOW v AS (PARTITION BY h.doc_id, h.item_id, shift, n ORDER BY q)),
            o9 AS (SELECT * FROM o WHERE there = n AND same * 100 >= {decontaminate.PERCENT} * n),
            f AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, max(same * 100e0 / n) AS best_percent FROM o9 GROUP BY doc_id)
            SELECT dl.doc_id, item_ids IS NOT NULL AS contaminated, item_ids, best_percent, item_ids IS NULL AS kept FROM dl LEFT JOIN f ON f.doc_id = dl.doc_id""",
        "op9_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM d WINDOW w AS (PARTITION BY t)""",
        "op10_sharding": f"SELECT doc_id, coalesce(doc_id, 0) % {ARRIVALS} AS arrival, source, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    }
