"""One query for each training-text operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import ann, chat, decontam, eftrie, langid, linedup, mixing, pfor, pii, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.token_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (places of deleted lines, comma-joined), kept_sha256."""
    found = linedup.without_common_blocks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.array_join("deleted", ",").alias("deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, distance=4, segments=3)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op7_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.windows(turns))


def held_out(spark: SparkSession, sf_dir: str, mod: int, rest: int) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % mod
    return table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder == rest, F.lit(False)))


def op6_elias_fano_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(spark, sf_dir, 10, 0)
    return eftrie.scores(docs, eftrie.train(docs.where("not held_out")))


def op8_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = held_out(spark, sf_dir, 4, 2)
    model = langid.fit(docs.where("not held_out"))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id and the figures of each leak."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.vectors_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = ann.fit(vectors, k=5)
    return ann.search(vectors, vectors.where(F.col("id") % 50 == 0), 5, index)


QUERIES = {
    "op1_pfor_tokens": op1_pfor_tokens,
    "op2_patience_line_dedup": op2_patience_line_dedup,
    "op3_skip_chain_pii": op3_skip_chain_pii,
    "op4_simhash_variants": op4_simhash_variants,
    "op5_systematic_mix": op5_systematic_mix,
    "op6_elias_fano_scores": op6_elias_fano_scores,
    "op7_budgeted_chat": op7_budgeted_chat,
    "op8_naive_bayes_language": op8_naive_bayes_language,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_posting_list_search": op10_posting_list_search,
}

#: The water filling as a sorted scan, the draw as row numbers: the same order, the same arithmetic.
_OP5 = """
WITH sized AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents
), classed AS (
  SELECT *, length(bin(size)) * 32 + CASE WHEN length(bin(size)) >= 5 THEN size >> (length(bin(size)) - 5) ELSE size << (5 - length(bin(size))) END AS class
  FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source
), rated AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size * 2.0::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM sources
), goal AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(rate, cap / weight) FROM rated WHERE rate * weight <= cap)) AS target FROM rated
), placed AS (
  SELECT c.doc_id, c.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY c.source ORDER BY class, place, doc_id) AS i,
    ('0x' || substr(md5('7:' || coalesce('s' || c.source, 'n')), 1, 5))::BIGINT::DOUBLE / 1048576.0::DOUBLE AS start
  FROM classed c JOIN goal g ON c.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (least(floor(start + rate * i) - floor(start + rate * (i - 1)), 2) * size)::BIGINT AS taken FROM placed
"""

#: Windows as a recursion over turns; rendered lengths by counting what is escaped.
_CONTROL_COUNT = " + ".join(f"2 * (length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
_OP7 = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(turn, role, text)
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, role, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {chat.PER_TURN} AS tokens,
    {len(chat.TURN) + 1 + len(chat.END)} + length(role) + length(text) + (SELECT length(x) - length(replace(x, '\\', '')) + {_CONTROL_COUNT} FROM (SELECT role AS x)) + (SELECT length(x) - length(replace(x, '\\', '')) + {_CONTROL_COUNT} FROM (SELECT text AS x)) AS size
  FROM said
), p AS (
  SELECT *, sum(tokens) OVER w - tokens AS p0, sum(tokens) OVER w AS p1, sum(size) OVER w - size AS z0, first_value(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w AS sys, first_value(tokens) OVER w AS t0, first_value(size) OVER w AS size0
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
), c AS (SELECT conv_id, any_value(sys) AS b0, {chat.BUDGET} - any_value(sys * t0) AS room, any_value(sys * size0) AS size0, max(i) AS last FROM p GROUP BY conv_id
), f AS (
  SELECT conv_id, b0::BIGINT AS j, b0::BIGINT AS first, 0::BIGINT AS hist, 1::BIGINT AS windows FROM c
  UNION ALL
  SELECT n.conv_id, n.j, CASE WHEN n.fits THEN n.first ELSE n.back END, n.hist + CASE WHEN n.fits THEN 0 ELSE n.z0 - (SELECT z0 FROM p WHERE p.conv_id IS NOT DISTINCT FROM n.conv_id AND p.i = n.back) END, n.windows + CASE WHEN n.fits THEN 0 ELSE 1 END
  FROM (
    SELECT f.conv_id, x.i AS j, f.first, f.hist, f.windows, x.z0, x.p1 - a.p0 <= c.room AS fits,
      CASE WHEN h2.p0 IS NOT NULL AND x.i - 2 >= c.b0 AND h2.p0 + {int(chat.BUDGET * chat.HISTORY_SHARE)} >= x.p0 THEN CASE WHEN x.p1 - h2.p0 <= c.room THEN x.i - 2 ELSE x.i END
        WHEN x.i - 1 >= c.b0 AND h1.p0 + {int(chat.BUDGET * chat.HISTORY_SHARE)} >= x.p0 THEN CASE WHEN x.p1 - h1.p0 <= c.room THEN x.i - 1 ELSE x.i END ELSE x.i END AS back
    FROM f JOIN c ON c.conv_id IS NOT DISTINCT FROM f.conv_id JOIN p x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.j + 1 JOIN p a ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND a.i = f.first
      JOIN p h1 ON h1.conv_id IS NOT DISTINCT FROM f.conv_id AND h1.i = x.i - 1 LEFT JOIN p h2 ON h2.conv_id IS NOT DISTINCT FROM f.conv_id AND h2.i = x.i - 2
  ) n
), w AS (SELECT conv_id, arg_max(hist, j) AS hist, arg_max(windows, j) AS windows FROM f GROUP BY conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS loss, sum(size)::BIGINT AS total FROM t GROUP BY conv_id
)
SELECT g.conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, (total + hist + (windows - 1) * c.size0)::BIGINT AS formatted_chars
FROM g JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id JOIN c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
"""

ORACLES: dict[str, str] = {
    "op7_budgeted_chat": _OP7,
    "op5_systematic_mix": _OP5,
}
