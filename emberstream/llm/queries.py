"""The queries of this subpackage, op<N>_<name>, over whole tables, with their SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, byte_bpe, chat, content_sort, hmm, langid, mixing, near_vectors, repair, shingle_join, substrings, toxicity, warc
from .workspace import crc_fold, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> tuple[str, str]:
    """The path of a rank file and the pattern that goes with it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.resolve(warc.read(spark, path)).select(F.col("id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers").alias("refers_to"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM g
"""


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = shingle_join.Rule(words=4, num=85, den=100)
    return shingle_join.components(table(spark, sf_dir, "documents"), rule).withColumnRenamed("id", "doc_id")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(t[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.k >= 85 * (x.n + y.n - c.k)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= CAST(0.93 AS DOUBLE)),
r AS (SELECT vec_id AS node, vec_id AS reached FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c JOIN embeddings ON node = vec_id LEFT JOIN k ON k.a = vec_id
"""


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer("byte_bpe_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, pattern)


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(docs), keep=["doc_id"])
    return out.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.mark_copies(table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


#: A conversation that says the template's own control strings.
SPECIAL_ID, SPECIAL_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    special = spark.range(2).select(F.lit(SPECIAL_ID).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPECIAL_TEXT).alias("text"))
    return chat.read_back(chat.format_turns(chat.conversation_turns(own.unionByName(special))))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, length('### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') || ': '
    || replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') || ' </turn>' || chr(10)) AS chars FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""


def op10_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s AS (
  SELECT source, source_size, rk, CASE rk % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source)),
c AS (
  SELECT *, coalesce(sum(source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(source_size) OVER () AS total FROM s),
t AS (
  SELECT source, source_size, rk, total,
         least(2.0::DOUBLE * source_size, w * max((1.5::DOUBLE * total - 2.0::DOUBLE * before) / rest) OVER ()) AS target FROM c),
q AS (
  SELECT d.doc_id, d.u, d.size, t.source_size, t.rk, t.total, t.target,
         sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.u, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, (upto + epoch * source_size)::DOUBLE / target AS f FROM q, (VALUES (0), (1)) AS v(epoch) WHERE target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY f, rk, epoch, u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached FROM e),
k AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM r WHERE reached <= 1.5::DOUBLE * total GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken FROM q LEFT JOIN k USING (doc_id)
"""


def op11_edit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(repair.damaged(table(spark, sf_dir, "conversations")))


#: Row by row, the best (cost, audit, said) of each state of the grammar: 0 nothing yet, 1 system, 2 user, 3 a pair.
OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END)) AS tab),
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)) AS bytes
  FROM conversations),
e AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda r, x: xor(r >> 8, tab[xor(r & 255, x) + 1])), CAST(4294967295 AS BIGINT)) % 20 AS code
  FROM c, tab),
f AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM e, range(2) AS copies(n) WHERE code <> 0 AND (n = 0 OR code = 3)),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM f),
h AS (
  SELECT *, left(role, 1) AS letter, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM g),
k AS (SELECT *, CASE WHEN core = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'o' END AS fault FROM h),
counts AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM k GROUP BY conv_id),
step(q, c, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, p, cost, audit, said) AS (VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']),
  (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
edit AS (
  SELECT conv_id, i, q, p, CASE fault WHEN 't' THEN 3 ELSE 0 END AS cost, 'K' AS audit, [role || ':' || text] AS said FROM k JOIN step ON c = letter WHERE fault IN ('o', 't')
  UNION ALL SELECT conv_id, i, q, p, CASE fault WHEN 't' THEN 6 ELSE 3 END, 'R', [CASE c WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] FROM k JOIN step ON c <> 's' WHERE fault IN ('o', 't')
  UNION ALL SELECT conv_id, i, q, q, 4, 'D', [] FROM k, range(4) AS states(q)),
best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM conversations UNION ALL
  SELECT conv_id, i, q, cost, audit, said FROM (
    SELECT b.conv_id, e.i, e.p AS q, b.cost + n.cost + e.cost AS cost, b.audit || n.audit || e.audit AS audit, b.said || n.said || e.said AS said,
           row_number() OVER (PARTITION BY b.conv_id, e.p ORDER BY b.cost + n.cost + e.cost, b.audit || n.audit || e.audit) AS rk
    FROM best b JOIN ins n ON n.q = b.q JOIN edit e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.q = n.p) WHERE rk = 1),
done AS (
  SELECT conv_id, cost, audit, said FROM (
    SELECT b.conv_id, b.cost + n.cost AS cost, b.audit || n.audit AS audit, b.said || n.said AS said, row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + n.cost, b.audit || n.audit) AS rk
    FROM best b LEFT JOIN counts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id JOIN ins n ON n.q = b.q WHERE b.i = coalesce(t.n, 0) AND n.p IN (0, 3)) WHERE rk = 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM done d LEFT JOIN counts t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op12_seed_and_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP12_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (
  SELECT doc_id, i, array_to_string(t[i : i + 19], ' ') AS g
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - 18)) AS i FROM w WHERE len(t) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS rk FROM s) WHERE rk > 1),
x AS (SELECT doc_id, p FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r)),
k AS (SELECT w.doc_id, list(u.word ORDER BY u.p) AS kept
  FROM w, (SELECT doc_id, unnest(t) AS word, unnest(range(1, len(t) + 1)) AS p FROM w) u
  WHERE u.doc_id = w.doc_id AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = u.doc_id AND x.p = u.p) GROUP BY w.doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(len(t) - coalesce(len(kept), 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def op13_overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    (a, pattern), (b, _) = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")
    return align.align(table(spark, sf_dir, "documents"), a, b, pattern).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {
        "op1_warc_chain": op1_warc_chain,
        "op2_subword_toxicity": op2_subword_toxicity,
        "op3_parity_join": op3_parity_join,
        "op4_hidden_markov": op4_hidden_markov,
        "op5_int8_tiles": op5_int8_tiles,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_byte_cnn": op7_byte_cnn,
        "op8_content_sort": op8_content_sort,
        "op9_chat_format": op9_chat_format,
        "op10_fair_queue": op10_fair_queue,
        "op11_edit_lattice": op11_edit_lattice,
        "op12_seed_and_extend": op12_seed_and_extend,
        "op13_overlap_groups": op13_overlap_groups,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_chain": OP1_SQL, "op3_parity_join": OP3_SQL, "op5_int8_tiles": OP5_SQL, "op8_content_sort": OP8_SQL, "op9_chat_format": OP9_SQL, "op10_fair_queue": OP10_SQL, "op11_edit_lattice": OP11_SQL, "op12_seed_and_extend": OP12_SQL}
