"""The corpus operators as queries over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, gru_lm, langid, maxscore, mixing, pii, secret_scan, simhash, spelling,
    suffix_dedup, token_store, turn_repair, urls,
)
from tidemark.llm.common import written
from tidemark.llm.spans import joined
from tidemark.plans.registry import Query
from tidemark.sources.writers import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def counted(spans: str, kind: str) -> Column:
    of_kind = F.filter(spans, lambda s: s["kind"] == kind)
    return F.size(of_kind).cast("long").alias(f"n_{kind}")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents."""
    found = simhash.near_duplicates(documents(spark, sf_dir), shingle=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                        "component_id")


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all vectors for every fiftieth."""
    vectors = maxscore.scaled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return maxscore.search(vectors, vectors.where("vec_id % 50 = 0"), k=5)


MAXSCORE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by its bytes."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, by patterns and by boosted trees."""
    found = pii.with_spans(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return found.select("doc_id", *[counted("_base", kind) for kind in pii.KINDS],
                        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
                        joined(F.col("_spans")).alias("spans"))


def op5_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents by a recurrent language model."""
    return gru_lm.score_documents(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, by patterns and by tests of randomness."""
    found = secret_scan.with_spans(documents(spark, sf_dir).select("doc_id", "text"))
    n = [counted("_base", kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *n, F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
                        joined(F.col("_spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    found = mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5, limit=2.0)
    return found.select("doc_id", "size", "source_size", "target", "taken")


# The limits are applied by rounds, as the words of the contract have it: each round fixes the
# sources that their share would lift above their limit.
MIXING_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, source, md5(coalesce(doc_id::varchar, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint AS size
  FROM documents),
sizes AS (
  SELECT source, sum(size)::bigint AS source_size,
         [5.0::double, 2.0::double, 1.0::double][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM base GROUP BY source),
total AS (SELECT 1.5::double * sum(source_size)::double AS t FROM sizes),
rounds AS (
  SELECT source, source_size, w, false AS capped, t AS rest, (SELECT sum(w) FROM sizes) AS ws, 0 AS n
  FROM sizes, total
  UNION ALL
  SELECT source, source_size, w, now, t - coalesce(sum(CASE WHEN now THEN 2.0::double * source_size END) OVER (), 0),
         sum(CASE WHEN now THEN 0 ELSE w END) OVER (), n + 1
  FROM (SELECT r.*, t, r.capped OR rest * w / ws > 2.0::double * source_size AS now FROM rounds r, total)
  WHERE n < 60),
targets AS (
  SELECT source, source_size,
         CASE WHEN capped THEN 2.0::double * source_size ELSE rest * w / ws END AS target
  FROM rounds WHERE n = 60),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::bigint AS words,
         (sum(size) OVER (PARTITION BY b.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::bigint - size AS begun
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, words - begun))
        + greatest(0, least(size, words - source_size - begun)))::bigint AS taken
FROM placed"""


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 50 bytes that smaller documents have."""
    found = suffix_dedup.deduplicated(documents(spark, sf_dir), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans",
                        F.sha2("kept", 256).alias("kept_sha256"))


RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL judged by rules, or by its words."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urls.judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by windows of ten words."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.overlaps(documents(spark, sf_dir), bench, window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


WINNOWING_SQL = """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT item_id::varchar AS item, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS v
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS v
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
hits AS (SELECT r, i, d.n, item FROM doc_windows d JOIN item_windows b ON d.n = b.n AND d.v = b.v),
places AS (SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list_distinct(list(item))) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit,
       coalesce(len(ids), 0)::bigint AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""


def crc32_sql(text: str, table: str) -> str:
    """The CRC-32 of the UTF-8 bytes of ``text``, by the table of remainders of all bytes."""
    return (f"xor(list_reduce([4294967295::bigint] || list_transform(range(1, strlen({text}) + 1),"
            f" lambda nth: ('0x' || hex(encode({text}))[2 * nth - 1:2 * nth])::bigint),"
            f" lambda crc, byte: xor(crc >> 8, {table}[(xor(crc, byte) & 255) + 1])), 4294967295::bigint)")


# The remainders of all bytes; 3988292384 is the polynomial with its bits reversed.
CRC_TABLE_SQL = """SELECT list_transform(range(256), lambda byte: list_reduce([byte::bigint] || range(8),
    lambda crc, bit: CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::bigint) ELSE crc >> 1 END)) AS t"""

def op11_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the commoner spellings one edit away."""
    return spelling.variants(documents(spark, sf_dir))


# Words that differ in one letter are equal with that letter masked; of two words that differ by an
# inserted letter, the longer without it is the shorter.
SPELLINGS_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
runs AS (
  SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
keyed AS (SELECT id || ':' || run AS key, run, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (SELECT run, c, {crc32_sql("key", "crc.t")} AS h FROM keyed, crc),
spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c
  FROM hashed),
words AS (
  SELECT word, sum(c)::bigint AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
masked AS (SELECT word, n, word[:i - 1] || '*' || word[i + 1:] AS mask FROM places),
shorter AS (SELECT DISTINCT word, n, word[:i - 1] || word[i + 1:] AS less FROM places),
longer AS (SELECT s.word, s.n, w.word AS less, w.n AS less_n FROM shorter s JOIN words w ON s.less = w.word),
near AS (
  SELECT a.word, b.word AS other, b.n FROM masked a JOIN masked b ON a.mask = b.mask AND a.word <> b.word
  UNION ALL SELECT word, less, less_n FROM longer
  UNION ALL SELECT less, word, n FROM longer),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, struct_pack(a := -n, b := other)) AS other
  FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::bigint AS n_near,
         CASE WHEN best_n >= 2 * w.n THEN other END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chains AS (
  SELECT word, word AS root, form AS further FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.further = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c ON f.word = c.word AND c.further IS NULL"""


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, audited and repaired."""
    turns = turn_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turn_repair.digests(turns, written(turn_repair.audits(turns), "audits"))


# The costs go by places in the grammar, one turn after another from the last: v has the cheapest
# (cost, audit) from the places U, A, T and S on, where turns may also be inserted first.
TURNS_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key
  FROM conversations),
raw AS (
  SELECT conv_id, turn, role, text, {crc32_sql("key", "crc.t")} % 20 AS harm
  FROM keyed, crc),
harmed AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM raw WHERE harm <> 0),
seen AS (
  SELECT *, sha256(text) AS digest,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS final
  FROM harmed),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w || role[1] AS pair
  FROM seen WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, digest)),
faulty AS (
  SELECT *, CASE WHEN final = '' THEN 'b'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations),
steps AS (
  SELECT conv_id, 0::bigint AS k, {{c: 0, p: ''}} AS u, {{c: 5, p: 'I'}} AS a,
         {{c: 10, p: 'II'}} AS t, {{c: 1000000000, p: ''}} AS s
  FROM every
  UNION ALL
  SELECT conv_id, k, ru AS u, list_min([ra, {{c: 5 + ru.c, p: 'I' || ru.p}}]) AS a,
         list_min([rt, {{c: 5 + ra.c, p: 'I' || ra.p}}]) AS t, rs AS s
  FROM (
    SELECT conv_id, k, list_min([ru, {{c: 5 + ra.c, p: 'I' || ra.p}}]) AS ru, ra, rt, rs
    FROM (
      SELECT d.conv_id, d.k + 1 AS k,
             list_min([{{c: 2 + u.c, p: 'D' || u.p}}, {{c: a.c + pay + (NOT f.role ^@ 'u')::int,
                       p: CASE WHEN f.role ^@ 'u' THEN 'K' ELSE 'R' END || a.p}}]) AS ru,
             list_min([{{c: 2 + a.c, p: 'D' || a.p}}, {{c: u.c + pay + (NOT f.role ^@ 'a')::int,
                       p: CASE WHEN f.role ^@ 'a' THEN 'K' ELSE 'R' END || u.p}}]) AS ra,
             list_min([{{c: 2 + t.c, p: 'D' || t.p}}, {{c: a.c + pay + (NOT f.role ^@ 'u')::int,
                       p: CASE WHEN f.role ^@ 'u' THEN 'K' ELSE 'R' END || a.p}}]) AS rt,
             list_min([{{c: 2 + s.c, p: 'D' || s.p}},
                       {{c: t.c + pay + CASE WHEN f.role ^@ 's' THEN 0 ELSE 1000000000 END, p: 'K' || t.p}}]) AS rs
      FROM steps d JOIN (
        SELECT *, CASE fault WHEN 'b' THEN 1000000000 WHEN 'd' THEN 1000000000 WHEN 't' THEN 5 ELSE 0 END AS pay
        FROM faulty) f
      ON d.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = f.n - d.k))),
repairs AS (
  SELECT d.conv_id, list_min([u, s]) AS best
  FROM steps d LEFT JOIN (SELECT conv_id, max(n) AS n FROM faulty GROUP BY conv_id) f
  ON d.conv_id IS NOT DISTINCT FROM f.conv_id WHERE d.k = coalesce(n, 0)),
edits AS (
  SELECT conv_id, t, best.p[t] AS edit, length(replace(best.p, 'D', '')) % 2 AS odd,
         t - length(replace(best.p[:t], 'I', '')) AS added, length(replace(best.p[:t], 'D', '')) AS j
  FROM (SELECT conv_id, best, unnest(range(1, length(best.p) + 1)) AS t FROM repairs)),
lines AS (
  SELECT e.conv_id, t, CASE
    WHEN edit = 'K' THEN f.role || ':' || f.text
    WHEN (j - odd) % 2 = 1 THEN 'user:' ELSE 'assistant:' END
    || CASE WHEN edit = 'R' THEN f.text ELSE '' END AS line
  FROM edits e LEFT JOIN faulty f ON e.conv_id IS NOT DISTINCT FROM f.conv_id
    AND f.i = e.t - e.added AND e.edit <> 'I'
  WHERE edit <> 'D'),
whole AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY t) AS body FROM lines GROUP BY conv_id)
SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c::bigint AS cost,
       best.p AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM repairs r LEFT JOIN counts c ON r.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN whole w ON r.conv_id IS NOT DISTINCT FROM w.conv_id"""


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of all documents, written in planes and read back."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    token_store.write(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = token_store.documents(spark, path, token_store.crc32_of)
    return found.withColumnRenamed("value", "ids_crc32")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash, op2_maxscore, op3_langid, op4_pii, op5_gru, op6_secrets, op7_mixing, op8_suffixes, op9_urls, op10_winnowing,
    op11_spellings, op12_turn_repair, op13_token_planes)}

ORACLE: dict[str, str] = {"op2_maxscore": MAXSCORE_SQL, "op7_mixing": MIXING_SQL,
                          "op10_winnowing": WINNOWING_SQL, "op11_spellings": SPELLINGS_SQL,
                          "op12_turn_repair": TURNS_SQL}
