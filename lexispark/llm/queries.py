"""The registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import (
    decontaminate, fill_middle, filter_audit, html_extract, language_id, line_dedup, ngram_join, nn_graph, packing, quality, simhash, substring_dedup, token_counts,
)
from lexispark.llm.common import cut, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    length = token_counts.encoded_length(F.col("text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    # Written once, as both levels of the suffix sums read it; else every text would be encoded twice.
    return token_counts.suffix_sums(cut(token_counts.length_histogram(docs, length), "lengths"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontaminate.find(docs, decontaminate.prepare(table(spark, sf_dir, "benchmark")))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs, min_line_pages=line_dedup.LINE_PAGES).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_graph.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP4_SQL = f"""
WITH pages AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
once AS (SELECT source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
freq AS (SELECT source, line, count(*) AS n_pages FROM once WHERE trim(line) <> '' GROUP BY source, line),
bad AS (SELECT f.source, f.line FROM freq f JOIN pages p ON p.source IS NOT DISTINCT FROM f.source
        WHERE n_pages >= {line_dedup.LINE_PAGES} AND n_pages > host_pages * {line_dedup.RATIO}::DOUBLE),
marked AS (SELECT l.doc_id, l.line, l.pos, b.line IS NOT NULL AS dropped
           FROM lines l LEFT JOIN bad b ON b.source IS NOT DISTINCT FROM l.source AND b.line = l.line),
kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
                coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS text
         FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out("doc_id", 5, 0)
    labels = table(spark, sf_dir, "labels").where(~apart)
    model = quality.fit(docs, labels)
    scored = docs.select("doc_id", apart.alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    scored = cut(scored, "scores")  # the quantile reads the scores once more
    scored = scored.withColumn("predicted", F.when(F.col("score") >= quality.PREDICT_AT, 1).otherwise(0))
    return quality.keep_above_quantile(scored, 0.1)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", "url", html_extract.extract(F.col("html"), html_extract.fit(pages)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out("doc_id", 3, 1)
    model = language_id.fit(docs.where(~apart))
    found = docs.select("doc_id", apart.alias("held_out"), language_id.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.accepted")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return packing.pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    f = fill_middle.arrange(F.col("text"), F.col("doc_id"), outputs=False)
    return docs.select("doc_id", f.alias("f")).select("doc_id", "f.n", "f.form", "f.prefix_chars", "f.middle_chars", "f.output_sha256", "f.restored_sha256")


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP11_SQL = rf"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
num AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM cut),
parts AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[1 + least(h1 % (n + 1), h2 % (n + 1)):greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
  array_to_string(u[1 + greatest(h1 % (n + 1), h2 % (n + 1)):n], '') AS s FROM num),
made AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN regexp_replace(o, '^<P>(.*)<S>(.*)<M>(.*)$', '\1\3\2', 's') ELSE regexp_replace(o, '^<S>(.*)<P>(.*)<M>(.*)$', '\2\3\1', 's') END) AS restored_sha256
FROM made
"""


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: By order and document, without coalitions.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, t, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS MATERIALIZED (SELECT f.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
  || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END) || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN f.doc_id > first THEN 'E' ELSE '' END) AS bad FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
grid AS (SELECT part, filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM (SELECT DISTINCT part FROM d), orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
kinds AS MATERIALIZED (SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM fails GROUP BY part, bad),
seen AS (SELECT g.*, k.*, bad <> '' AND regexp_matches(bad, '[' || own || ']') AS hit, earlier <> '' AND bad <> '' AND regexp_matches(bad, '[' || earlier || '#]') AS gone FROM grid g JOIN kinds k USING (part)),
counted AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, CAST(sum(n) FILTER (WHERE NOT hit AND NOT gone) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (WHERE hit AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE bad = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(n_good) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n_toxic) FILTER (WHERE hit AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
"""


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_suffix_array_dedup": op3_suffix_array_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
        "op7_html_extraction": op7_html_extraction,
        "op8_language_id": op8_language_id,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_filter_interaction_audit": op12_filter_interaction_audit,
        "op13_simhash_near_dedup": op13_simhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4_SQL, "op11_fill_in_middle": OP11_SQL, "op12_filter_interaction_audit": OP12_SQL}
