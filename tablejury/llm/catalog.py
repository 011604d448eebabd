"""The operators' queries, each over its whole table."""

from pyspark.sql import functions as F

from tablejury.llm import (
    binpack,
    chat,
    fingerprints,
    lm_scoring,
    near_dedup,
    packing,
    pii,
    prefix_trie,
    quality,
    sentencepiece_fst,
    sharding,
    topk,
    vector_codes,
)

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark, sf_dir):
    return packing.pack_digest(packing.pack(table(spark, sf_dir, "documents")))


@query("op2_sharding")
def op2_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op3_topk", """
WITH q AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def op3_topk(spark, sf_dir):
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_near_dedup")
def op8_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_pii")
def op5_pii(spark, sf_dir):
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op9_fingerprints")
def op9_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    return lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op10_chat", """
WITH t AS (
    SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS c
    FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
last AS (
    SELECT conv_id AS pair_id, max({'turn': turn, 'text': text}) AS reply
    FROM conversations WHERE role = 'assistant' GROUP BY ALL),
swap AS (
    SELECT a.pair_id, a.reply['turn'] AS spot, b.reply['text'] AS other, b.pair_id IS NOT NULL AS has_other
    FROM last a LEFT JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
r AS (
    SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, ''), 'text': coalesce(CASE WHEN turn = spot THEN other ELSE text END, '')}) AS r
    FROM conversations LEFT JOIN swap ON pair_id = conv_id
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND (spot IS NULL OR turn <> spot OR has_other) GROUP BY ALL),
b AS (SELECT pair_id, turn, c, r FROM t FULL JOIN r USING (pair_id, turn)),
cut AS (SELECT pair_id, min(turn) AS cut FROM b WHERE c IS DISTINCT FROM r GROUP BY ALL),
rows AS (
    SELECT pair_id, 'prompt' AS part, turn, c AS said FROM b LEFT JOIN cut USING (pair_id) WHERE cut IS NULL OR turn < cut
    UNION ALL SELECT pair_id, 'chosen', turn, c FROM b JOIN cut USING (pair_id) WHERE turn >= cut AND c IS NOT NULL
    UNION ALL SELECT pair_id, 'rejected', turn, r FROM b JOIN cut USING (pair_id) WHERE turn >= cut AND r IS NOT NULL)
SELECT pair_id, part, turn, said['role'] AS role,
       '<|' || said['role'] || '|>' || chr(10) || said['text'] || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND said['role'] = 'assistant' AS trained
FROM rows""")
def op10_chat(spark, sf_dir):
    return chat.preference_pairs(*chat.swapped_replies(table(spark, sf_dir, "conversations")))


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    encoded = sentencepiece_fst.encode(table(spark, sf_dir, "documents"))
    return sentencepiece_fst.digest(sentencepiece_fst.decode(encoded))


@query("op11_binpack")
def op11_binpack(spark, sf_dir):
    return binpack.pack_digest(binpack.pack(table(spark, sf_dir, "documents")))


def _codes_sql(rounds=2):
    """Each round as a pair of tables: parts with their nearest entry (a0, a1, ..), then the next codebooks (c1, c2, ..)."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT r, part, min({{'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': entry}}) AS m
    FROM p JOIN c{k} USING (part) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""s{k} AS (
    SELECT part, m['e'] AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
    FROM a{k} JOIN p USING (r, part), range(1, 65) t(i) WHERE i <= len(x) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(any_value(m.c), any_value(o.c)) AS c FROM c{k} o LEFT JOIN (
        SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY ALL) m USING (part, entry) GROUP BY ALL)""")
    return ",\n".join(steps)


@query("op12_vector_codes", f"""
WITH k AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 16) + 1:(part + 1) * (len(v) // 16)] AS x FROM k, range(16) t(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 64),
{_codes_sql()},
coded AS (
    SELECT r, string_agg(printf('%02x', m['e']), '' ORDER BY part) AS code, CAST(sum(m['d']) AS BIGINT) AS error FROM a2 GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN coded USING (r), books""")
def op12_vector_codes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op13_prefix_trie", r"""
WITH t AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS tid,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'tid': tid, 'words': words} ORDER BY pos) AS said FROM t GROUP BY c),
h AS (
    SELECT c, said, xor(4294967295, list_reduce(
        list_transform(range(8 * length(CAST(c AS VARCHAR))), lambda k: (ord(CAST(c AS VARCHAR)[k // 8 + 1]) >> (k % 8)) & 1),
        lambda crc, b: xor(crc >> 1, CASE WHEN xor(crc & 1, b) = 1 THEN 3988292384 ELSE 0 END), 4294967295)) % 4 AS h
    FROM own),
seq AS (
    SELECT a.c, list_concat(coalesce(b.said[1:a.h], []), a.said[a.h + 1:]) AS said
    FROM h a LEFT JOIN h b ON b.c = a.c - a.c % 20),
steps AS (
    SELECT c, d, len(said) AS len, coalesce(said[d]['words'], 0) AS words, array_to_string(list_transform(said[1:d], lambda x: x['tid']), ',') AS path
    FROM seq, range(0, 10000) r(d) WHERE d <= len(said)),
node AS (
    SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256
    FROM steps GROUP BY ALL),
linked AS (SELECT a.*, p.conv_id AS parent_conv_id, p.path AS up FROM node a LEFT JOIN node p ON p.d = a.d - 1 AND p.path = left(a.path, greatest(0, 65 * p.d - 1))),
kids AS (SELECT d - 1 AS d, up AS path, count(*) AS n FROM linked WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT r.d, left(a.path, greatest(0, 65 * r.d - 1)) AS path,
           count(*) FILTER (k.n IS NULL) AS n_leaves, sum((a.n_convs - 1) * a.words) AS saved
    FROM node a LEFT JOIN kids k USING (d, path), range(0, 10000) r(d) WHERE r.d <= a.d GROUP BY ALL)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, coalesce(n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM linked LEFT JOIN kids USING (d, path) JOIN below USING (d, path)""")
def op13_prefix_trie(spark, sf_dir):
    turns = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.shared_heads(turns))
