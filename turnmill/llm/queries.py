"""The queries over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import chat, codes, exact_dedup, langid, line_dedup, lm, media, minhash, mixing, packing, secrets, sharding, trie
from turnmill.llm.common import crc_fold, cut_lineage, documents, small_batches, word_count

SHARDS = 40


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = chat.preference_format(chat.pairs_from_conversations(turns))

    def spans(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        F.col("rest.conv_id").alias("conv_id"),
        "n_prompt_turns",
        "prompt",
        "chosen",
        "rejected",
        spans("chosen_mask").alias("chosen_mask"),
        spans("rejected_mask").alias("rejected_mask"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")).select(F.col("doc_id").alias("id"), "lang", "text"))
    found = langid.identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "bits_per_byte")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_media(documents(spark, sf_dir))).drop("error")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", word_count(F.col("text")).alias("words"))
    plan = mixing.systematic_mix(cut_lineage(docs), size=F.col("words"))
    return plan.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(documents(spark, sf_dir))
    removed = F.size("removed").cast("long")
    return found.select("doc_id", "n_lines", removed.alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.lattice_scores(documents(spark, sf_dir), crc_fold(F.col("doc_id"), 5) != 1, reestimate=True, whole_words=True)
    return scores.select("doc_id", (~F.col("training")).alias("held_out"), *scores.columns[2:])


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return codes.compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    kinds = [rule.kind for rule in secrets.BASE]

    def of(*chosen: str):
        return F.filter("spans", lambda s: s["kind"].isin(*chosen))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds],
        F.sha2(listed(of(*kinds)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return trie.prefix_trie(trie.with_shared_heads(trie.turn_sequences(turns)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format,
        "op2_language_id": op2_language_id,
        "op3_media": op3_media,
        "op4_mixing": op4_mixing,
        "op5_near_dedup": op5_near_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_packing": op7_packing,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_sharding": op10_sharding,
        "op11_vector_codes": op11_vector_codes,
        "op12_secret_scan": op12_secret_scan,
        "op13_prefix_trie": op13_prefix_trie,
    }


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '<|' || regexp_replace(coalesce(role, ''), '<(\\*)\|', '<\\\1|', 'g') || '|>' || chr(10) AS head,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' || chr(10) AS body
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(k) AS last, list(k ORDER BY k) AS replies FROM t WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT conv_id, last, replies[conv_id % len(replies) + 1] AS astray, conv_id + 1 - 2 * (conv_id % 2) AS neighbour FROM l),
c AS (SELECT t.* FROM t JOIN l ON l.conv_id = t.conv_id AND t.k <= l.last),
r AS (
  SELECT a.conv_id, c.k, c.role, c.text, c.head, c.body FROM a JOIN c ON c.conv_id = a.conv_id AND c.k < a.astray
  UNION ALL
  SELECT a.conv_id, c.k, c.role, c.text, c.head, c.body FROM a JOIN c ON c.conv_id = a.neighbour AND c.k >= a.astray),
d AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.k, r.k) AS k
  FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.k = c.k
  WHERE c.k IS NULL OR r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text),
n AS (SELECT a.conv_id, coalesce(min(d.k) - 1, any_value(a.last)) AS n FROM a LEFT JOIN d ON d.conv_id = a.conv_id GROUP BY a.conv_id),
s AS (
  SELECT side, x.conv_id, x.k, n.n, x.role, x.head, x.body,
         sum(length(x.head) + length(x.body)) OVER (PARTITION BY side, x.conv_id, x.k > n.n ORDER BY x.k) AS hi
  FROM (SELECT 'c' AS side, * FROM c UNION ALL SELECT 'r', * EXCLUDE (turn_) FROM (SELECT conv_id, role, text, k, head, body, 0 AS turn_ FROM r)) x
  JOIN n ON n.conv_id = x.conv_id),
o AS (
  SELECT side, conv_id, any_value(n) AS n, coalesce(string_agg(head || body, '' ORDER BY k) FILTER (k <= n), '') AS prompt,
         coalesce(string_agg(head || body, '' ORDER BY k) FILTER (k > n), '') AS completion,
         coalesce(string_agg((hi - length(body))::BIGINT || '-' || hi::BIGINT, ',' ORDER BY k) FILTER (k > n AND role = 'assistant'), '') AS mask
  FROM s GROUP BY side, conv_id)
SELECT c.conv_id, c.n::INT AS n_prompt_turns, c.prompt, c.completion AS chosen, coalesce(r.completion, '') AS rejected,
       c.mask AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM o c LEFT JOIN o r ON r.side = 'r' AND r.conv_id = c.conv_id WHERE c.side = 'c'
"""

OP8_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY n) AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY n) AS kept,
       sha256(n) AS text_sha256
FROM t
"""

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
c AS (
  SELECT *, floor(ln(size + 1.0::DOUBLE) * 20)::INT AS class,
         coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 1024, 0) AS bin
  FROM d),
s AS (
  SELECT no_source, source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY no_source, source) - 1 AS k
  FROM c GROUP BY no_source, source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][k % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
g AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS lv FROM l),
t AS (
  SELECT no_source, source, source_size,
         CASE WHEN lv IS NULL THEN cap ELSE least(cap, weight * lv) END AS target,
         floor(('0x' || substr(md5('mix|' || no_source::VARCHAR || '|' || source), 1, 8))::BIGINT / 4096.0::DOUBLE)
           / 1048576.0::DOUBLE AS u
  FROM g),
r AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY c.no_source, c.source
                            ORDER BY c.class, c.bin, c.doc_id NULLS FIRST, c.size) - 1 AS rank
  FROM c JOIN t ON c.no_source = t.no_source AND c.source = t.source)
SELECT doc_id, size, source_size, target,
       size * least((floor(u + (rank + 1) * rate) - floor(u + rank * rate))::BIGINT, 2) AS taken
FROM r
"""




def _op11_sql() -> str:
    """Lloyd's rounds, one after the other: b0 are the first entries, a_r the assignments, b_r the entries after round r."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT num, part, arg_min(entry, far * {entries} + entry) AS entry, min(far) AS far
  FROM (SELECT c.num, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS far
        FROM c JOIN b{r} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL) GROUP BY num, part)"""
    entries = """b{next} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(((s - ((s % n) + n) % n) / n)::BIGINT, b.x) AS x
  FROM b{r} b LEFT JOIN (
    SELECT a.part, a.entry, c.pos, sum(c.x)::BIGINT AS s, count(*) AS n
    FROM a{r} a JOIN c ON c.num = a.num AND c.part = a.part GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""
    steps = []
    for r in range(codes.ROUNDS + 1):
        steps.append(nearest.format(r=r, entries=codes.ENTRIES))
        if r < codes.ROUNDS:
            steps.append(entries.format(r=r, next=r + 1))
    last = codes.ROUNDS
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {codes.SCALE})::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
o AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS num FROM v
  WHERE len(v) = (SELECT len(v) FROM v GROUP BY len(v) ORDER BY count(*) DESC, len(v) DESC LIMIT 1)),
f AS (SELECT num, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) // {codes.PARTS} AS width FROM o),
c AS MATERIALIZED (SELECT num, i // width AS part, i % width AS pos, x FROM f),
b0 AS MATERIALIZED (SELECT part, num - 1 AS entry, pos, x FROM c WHERE num <= {codes.ENTRIES}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS name FROM b{last}),
e AS (SELECT num, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{last} GROUP BY num)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.name AS codebooks_sha256
FROM o JOIN e ON e.num = o.num CROSS JOIN h
"""


def _op12_sql() -> str:
    """Places of matches, from the lengths of what lies between them. `least` and `holds` are conditions on a match."""
    key = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    value = r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = (key + value + "+" if rule.kind == "assign" else rule.pattern).replace("'", "''")
        fits = f"regexp_full_match(m, '{(key + value + '{6,}').replace(chr(39), chr(39) * 2)}')" if rule.holds else f"length(m) >= {rule.least}"
        parts.append(f"""
  SELECT doc, {k} AS k, '{rule.kind}' AS kind, low AS start, low + length(m) AS stop FROM (
    SELECT doc, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low
    FROM (SELECT doc, unnest(regexp_split_to_array(text, '{pattern}')) AS gap, unnest(regexp_extract_all(text, '{pattern}')) AS m,
                 unnest(range(len(regexp_split_to_array(text, '{pattern}')))) AS i FROM t)
    WINDOW w AS (PARTITION BY doc ORDER BY i)) WHERE m IS NOT NULL AND {fits}""")
    base = len(secrets.BASE)
    counts = ", ".join(f"count(k) FILTER (k = {k}) AS n_{rule.kind}" for k, rule in enumerate(secrets.BASE))
    span = "kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, k"
    return f"""
WITH t AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({span}) FILTER (k < {base}), '')) AS base_sha256,
       coalesce(string_agg({span}), '') AS spans
FROM t LEFT JOIN s ON s.doc = t.doc GROUP BY t.doc
"""


OP13_SQL = """
WITH t AS (
  SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS h,
         length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({'h': h, 'n': n} ORDER BY turn NULLS FIRST, h, n) AS own FROM t GROUP BY conv_id),
k AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
                                                  lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END + z)
                         ) , 4294967295) % 6 AS h
  FROM s),
r AS (
  SELECT k.conv_id, list_concat(coalesce(list_slice(b.own, 1, k.h), []), coalesce(list_slice(k.own, k.h + 1, len(k.own)), [])) AS seq
  FROM k LEFT JOIN s b ON b.conv_id = k.base),
p AS (
  SELECT conv_id, d, len(seq) AS size, list_aggregate(list_transform(list_slice(seq, 1, d), lambda x: x.h || x.n || ';'), 'string_agg', '') AS key,
         coalesce(seq[d].n, 0) AS n
  FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM r)),
n AS (
  SELECT coalesce(key, '') AS key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM p GROUP BY ALL),
l AS (SELECT n.*, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND starts_with(c.key, n.key)) AS n_children FROM n)
SELECT a.conv_id, a.depth, any_value(u.conv_id) AS parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (x.n_children = 0) AS n_leaves,
       sum((x.n_convs - 1) * x.n)::BIGINT AS saved_tokens, a.ends_sha256
FROM l a JOIN l x ON x.depth >= a.depth AND starts_with(x.key, a.key)
LEFT JOIN l u ON u.depth = a.depth - 1 AND starts_with(a.key, u.key)
GROUP BY a.key, a.conv_id, a.depth, a.n_convs, a.n_children, a.ends_sha256
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": OP1_SQL,
        "op4_mixing": OP4_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_vector_codes": _op11_sql(),
        "op12_secret_scan": _op12_sql(),
        "op13_prefix_trie": OP13_SQL,
    }
