"""Registered queries of the text operators, with the SQL that their rows must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    decontaminate,
    fill_middle,
    hamming_search,
    html_crf,
    language_id,
    line_dedup,
    packing,
    periodic_runs,
    simhash,
    source_mix,
    suffix_dedup,
    token_counts,
    url_rules,
)
from barloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "byte_bpe_50k.json"
QUERY_EVERY = 20


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_crf.extract_text(table(spark, sf_dir, "pages"), keep=("page_id", "url"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), keep_ids=False)
    return pieces.withColumnRenamed("id", "doc_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "dedup.n_lines", "dedup.n_dropped", digest.alias("kept_sha256"))


def learned_languages(spark: SparkSession, sf_dir: str) -> tuple:
    """Languages of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))), "text", "lang")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(
        table(spark, sf_dir, "documents"), learned_languages(spark, sf_dir), new_col="found", keep=("doc_id",)
    )
    return found.select(
        "doc_id",
        language_id.held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def labelled_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages whose document has labels; a page shows the document that its path names.

    Toxic documents and those of low quality are to be blocked.
    """
    pages = table(spark, sf_dir, "pages").select("url")
    number = F.regexp_extract("url", r"://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    named = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return named.join(labels, "doc_id").select("url", "blocked")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    mined = url_rules.mine(labelled_addresses(spark, sf_dir))
    judged = url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), mined)
    return judged.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op9_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming_search.sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming_search.search(codes, codes.filter(F.col("id") % QUERY_EVERY == 0))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary())
    return counted.withColumnRenamed("id", "doc_id")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    units, sources, mixed = source_mix.mix_documents(table(spark, sf_dir, "documents"))
    return source_mix.taken_words(units, sources, mixed).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), keep=("doc_id",))
    flat = made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output")
    back = fill_middle.restore(flat.withColumn("output_sha256", F.sha2("output", 256)))
    return back.withColumn("restored_sha256", F.sha2("restored", 256)).drop("restored")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the ids become periodic from some word on; null ids and texts without words stay."""
    hashed = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(source_mix.WORD), 0)

    def planted(v):
        n, g = F.size(v["words"]).cast("long"), v["g"]
        a = F.pmod(g, n)
        p = F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))) + 1
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(
            F.transform(places, lambda i: F.get(v["words"], F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " "
        )

    given = F.struct(words.alias("words"), F.floor(hashed / 10).alias("g"))
    some = F.regexp_like("text", F.lit(source_mix.WORD))
    text = F.when((F.pmod(hashed, F.lit(10)) == 0) & some, source_mix.let(given, planted)).otherwise(F.col("text"))
    return docs.withColumn("text", text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs, keep=("doc_id",)).select("doc_id", "periodic.*")
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP4_SQL = """
WITH lines AS (
  SELECT doc_id, pos, line, lower_key AS key FROM (
    SELECT doc_id, pos, line,
           translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
judged AS (
  SELECT l.doc_id, l.pos, l.line, s.key IS NOT NULL AND s.keeper <> l.doc_id AS dropped
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS gram FROM (
    SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
    FROM items WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS gram FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM words, sizes WHERE len(w) >= size)
),
hits AS (SELECT g.doc_id, g.size, g.p, i.item_id FROM grams g JOIN windows i ON g.size = i.size AND g.gram = i.gram),
places AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM hits) GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM words d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP9_SQL = """
WITH signs AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << (64 - i) ELSE CAST(0 AS HUGEINT) END
                          FOR i IN range(1, 65)]) AS code
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
),
codes AS (SELECT vec_id, CAST(code AS UBIGINT) AS code FROM signs)
SELECT query_id, rank, neighbor_id, distance FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS rank
  FROM codes q, codes c WHERE q.vec_id % 20 = 0)
WHERE rank <= 10
"""

OP11_SQL = r"""
WITH units AS (
  SELECT source, doc_id, coalesce(md5(text), '') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         row_number() OVER (PARTITION BY source, doc_id, text) - 1 AS copy
  FROM documents
),
weighted AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, number) AS place FROM (
    SELECT *, [3, 1, 2][number % 3 + 1] AS weight FROM (
      SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM (
        SELECT source, sum(size) AS source_size FROM units GROUP BY source)))
),
filled AS (
  SELECT *, 150 * sum(source_size) OVER ()
            - 200 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         100 * sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
  FROM weighted
),
level AS (
  SELECT place AS first, rest, shares FROM filled WHERE rest * weight <= 2 * source_size * shares ORDER BY place LIMIT 1
),
sources AS (
  SELECT source, number, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN place < first THEN CAST(2 * source_size AS DOUBLE) ELSE level.rest * weight / level.shares END AS target
  FROM filled, level
),
blocks AS (
  SELECT u.source, doc_id, key, copy, target, pass, block, least(512, size - 512 * block) AS words,
         md5(concat_ws(':', '42', pass, coalesce(CAST(doc_id AS VARCHAR), 'null'), key, copy, block)) AS digest
  FROM (SELECT *, unnest(range(0, CAST(ceil(size / 512) AS BIGINT))) AS block FROM units) u
  JOIN sources s ON u.source IS NOT DISTINCT FROM s.source, range(0, 2) passes(pass)
  WHERE target > pass * source_size
),
taken AS (
  SELECT source, doc_id, key, copy, greatest(0, least(words, floor(target) - before)) AS words FROM (
    SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY pass, digest
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks)
),
sums AS (SELECT source, doc_id, key, copy, CAST(sum(words) AS BIGINT) AS taken FROM taken GROUP BY ALL)
SELECT u.doc_id, u.size, s.source_size, s.target, coalesce(t.taken, 0) AS taken
FROM units u JOIN sources s ON u.source IS NOT DISTINCT FROM s.source
LEFT JOIN sums t ON u.source IS NOT DISTINCT FROM t.source AND u.doc_id IS NOT DISTINCT FROM t.doc_id
                 AND u.key = t.key AND u.copy = t.copy
"""

OP12_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents
),
numbers AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM hashed
),
parts AS (
  SELECT doc_id, text, n,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS suffix FROM numbers
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

QUERIES: dict[str, Query] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_url_filters": op7_url_filters,
    "op8_simhash": op8_simhash,
    "op9_hamming_search": op9_hamming_search,
    "op10_token_counts": op10_token_counts,
    "op11_source_mix": op11_source_mix,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": OP2_SQL,
    "op4_line_dedup": OP4_SQL,
    "op9_hamming_search": OP9_SQL,
    "op11_source_mix": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
