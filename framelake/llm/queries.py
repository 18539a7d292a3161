"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framelake.session import scratch_path

from . import bpe, chatformat, collocations, embedding_dedup, filter_audit, fingerprints, hilbert_ann, packing, reshard, secret_scan, simhash_dedup, toxicity, warc
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary() -> str:
    """The public vocabulary file; every host has it at this path."""
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_chat_formatting", r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, length(role) + len(regexp_extract_all(role, '[\\\n]')) + len(regexp_extract_all(role, '<\\*\|'))
         + length(text) + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_start|>') + length('<|im_end|>') + 2 AS chars FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""")
def op1(spark, sf_dir):
    """All conversations and one whose texts look like control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    more = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', :t), (-1L, 1L, 'assistant', :t) AS v(conv_id, turn, role, text)", args={"t": odd})
    return chatformat.digests(chatformat.formatted(stored(chatformat.thread(turns.unionByName(more)))))


@query("op2_flow_resharding")
def op2(spark, sf_dir):
    """From twelve shards by checksum of the id to sixteen of equal bytes; affected shards are written and read back."""
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(12))
    docs = reshard.from_files(table(spark, sf_dir, "documents"))
    placed = reshard.resharded(docs, F.coalesce(old, F.lit(0)), 16, scratch_path(spark, "shards"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary())


@query("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    return simhash_dedup.classes(table(spark, sf_dir, "documents"))


@query("op5_bpe_codec")
def op5(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op6_document_fingerprints")
def op6(spark, sf_dir):
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_secret_scans")
def op8(spark, sf_dir):
    """A source owns its documents; its languages are its repositories."""
    return secret_scan.scanned(table(spark, sf_dir, "documents"), F.col("source"), F.concat_ws("/", "source", "lang"))


@query("op9_warc_fixity", r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
b AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 5 THEN html || '!' ELSE html END AS html FROM a WHERE page_id % 389 <> 7
  UNION ALL SELECT page_id + 1000000000, url, html FROM a WHERE page_id % 997 = 11),
said AS (
  SELECT side, page_id, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || url || nl || 'WARC-Record-ID: <urn:page:' || page_id || '>' || nl
    || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(html) || nl || nl || html || nl || nl AS r
  FROM (SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b), (SELECT chr(13) || chr(10) AS nl)),
recs AS (SELECT side, page_id, page_id // 4096 AS file, sha256(r) AS h, strlen(r) AS length, count(*) AS copies FROM said GROUP BY ALL),
placed AS (SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY side, file ORDER BY page_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM recs),
ids AS (SELECT side, page_id, file, min(o) AS s, max(o + length * copies)::BIGINT AS e, sha256(string_agg(h || ':' || copies, ',' ORDER BY h, copies)) AS hash FROM placed GROUP BY ALL)
SELECT coalesce(x.page_id, y.page_id) AS page_id, CASE WHEN y.page_id IS NULL THEN 'missing' WHEN x.page_id IS NULL THEN 'extra' ELSE 'altered' END AS fault,
  coalesce(x.file, y.file) AS file, x.s AS start_a, x.e AS end_a, y.s AS start_b, y.e AS end_b, x.hash AS hash_a, y.hash AS hash_b
FROM (SELECT * FROM ids WHERE side = 'a') x FULL JOIN (SELECT * FROM ids WHERE side = 'b') y ON x.page_id = y.page_id
WHERE x.hash IS DISTINCT FROM y.hash""")
def op9(spark, sf_dir):
    """The pages against a replica in which some were altered, some lost and some added."""
    a = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bad = F.when(F.col("page_id") % 97 == 5, F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html"))
    b = a.filter("page_id % 389 != 7").withColumn("html", bad).union(a.filter("page_id % 997 = 11").withColumn("page_id", F.col("page_id") + 1_000_000_000))
    return warc.audit(a, b)


@query("op10_hilbert_neighbours")
def op10(spark, sf_dir):
    """Every twentieth vector against all others."""
    return hilbert_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings
LEFT JOIN (SELECT u AS vec_id, count(*) AS n FROM pairs GROUP BY u) USING (vec_id)
LEFT JOIN (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u) USING (vec_id)""")
def op11(spark, sf_dir):
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings"))


@query("op12_phrase_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
said AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM said GROUP BY lang),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, (len(w) - k + 2)::BIGINT), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM said, range(1, 5) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
candidate AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_phrase AS (
  SELECT lang, a, unnest(list_transform(range(1, k - j + 2), lambda i: array_to_string(w[i:i + j - 1], ' '))) AS phrase FROM candidate, range(2, 4) AS t(j) WHERE j < k),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_phrase GROUP BY ALL),
kept AS (SELECT lang, phrase, a, k, w FROM candidate LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT),
cut AS (
  SELECT kept.lang, kept.phrase, kept.a, c, x.a AS l, y.a AS r, ((2000000 * kept.a::HUGEINT) // (x.a + y.a))::BIGINT AS score
  FROM kept JOIN range(1, 4) AS t(c) ON c < k JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(w[c + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) JOIN total USING (lang) WHERE rank <= 2000""")
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
failed AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e FROM worded),
masked AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(bad, false) AS bad
  FROM failed LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1) USING (doc_id)),
counted AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM masked GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, range(1, 6) AS r(step)),
found AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM found""")
def op13(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
