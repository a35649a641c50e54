"""The registered queries of this folder and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.licenses import scan_licenses

    scanned = scan_licenses(_table(spark, sf_dir, "documents"))
    firsts = F.transform("base", lambda b: b["first"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(firsts).cast("long").alias("first_word"),
        F.array_max(firsts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "labels")), ",").alias("labels"),
        F.greatest("score", F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
        "detections",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm._shared import held_out
    from clausewise.llm.lexicon import fit, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm._shared import held_out
    from clausewise.llm.quality import fit, score

    docs = _table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.mixing import mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, repetition=2.0).select("doc_id", "source", "mix_block", "mix_key", "mix_weight", "mix_tokens")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.linededup import dedup_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "removed_chunks", "removed_chars", "text")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from clausewise.llm.packing import pack, with_crc32

    return with_crc32(pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1))


def op7_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.audio import audio_columns, store_as_audio

    read = audio_columns(store_as_audio(_table(spark, sf_dir, "documents")))
    return read.select(
        "doc_id",
        F.col("tags")["bytes"].cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string(
            "frames=%d;samples=%d;hz=%d;bad_crc=%d;seek=%d-%d",
            "frames", "samples", "hz", "bad_crc", F.get("seek", F.lit(0)), F.element_at("seek", -1),
        ).alias("feature"),
        "frames",
        (F.col("samples") / F.col("hz")).alias("duration_s"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.caps import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.chat import format_conversations, read_back

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit(hard).alias("text"))
    back = read_back(format_conversations(turns.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.ordermin import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), threshold=0.8)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.filteraudit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.whitening import whiten

    done = whiten(_table(spark, sf_dir, "embeddings"))
    # an exact sum that a long can't hold stays in the decimal column
    return done.withColumns({"deviation_exact": F.col("deviation"), "deviation": F.expr("try_cast(deviation AS long)")})


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.llm.secretscan import BASE, scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:2] == "op" and k[2].isdigit()}


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
         sum(length('<turn role="">' || '</turn>') + 2
             + length(replace(replace(replace(role, '\', '\s'), '"', '\q'), '<', '\l'))
             + length(regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g'))) AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END,
                    '' ORDER BY turn NULLS FIRST, role, text) AS path
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars,
       regexp_full_match(path, 's?(ua(t+a)*)+') AS valid
FROM w
"""


OP9_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM e
  UNION
  SELECT reach.vec_id, l.b FROM reach JOIN l ON l.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
f AS (
  SELECT doc_id, part,
         concat(CASE WHEN len(words) < 200 THEN 'A' END,
                CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' END,
                CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) THEN 'C' END,
                CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
                CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS mask
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT k1.x || k2.x || k3.x || k4.x || k5.x AS filter_order
  FROM k k1, k k2, k k3, k k4, k k5 WHERE len(list_distinct([k1.x, k2.x, k3.x, k4.x, k5.x])) = 5),
s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, '[' || substr(filter_order, 1, step - 1) || '0]' AS earlier
  FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (
  SELECT *, contains(mask, letter) AS fails, regexp_matches(mask, earlier) AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
       CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
       CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
       CAST(sum(CASE WHEN mask = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
       CAST(sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
       CAST(sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
       CAST(sum(CASE WHEN fails THEN n * 120 // length(mask) ELSE 0 END) AS BIGINT) AS shapley
FROM m GROUP BY part, filter_order, step
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_embedding_dedup": OP9_SQL, "op8_chat_format": OP8_SQL, "op11_filter_audit": OP11_SQL}
