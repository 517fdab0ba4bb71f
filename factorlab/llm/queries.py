"""The corpus operators as registered queries with production parameters, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlab.llm import chat, decontaminate, jaccard, language, licenses, lm, packing, pii, ranked, repeats, search, trie
from factorlab.llm.common import table


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.suffix_automata(table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.suffix_ranges(table(spark, sf_dir, "documents"))
    return left.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), language.crc_class(7) == 2)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(search.quantised(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0, 20)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict(table(spark, sf_dir, "documents"))


def tokenizer_paths() -> tuple[str, str]:
    """Vocabulary file and split pattern of the public tokenizer that the packing contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), *tokenizer_paths())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.family_trie(table(spark, sf_dir, "conversations"))


#: The conversation that the contract adds: control strings, escaped and not, inside texts.
PLANTED = r"\### Assistant: </turn> ok"


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.assemble(turns, *tokenizer_paths()), *tokenizer_paths())


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_substring_dedup": op1,
    "op2_pii": op2,
    "op3_ngram_jaccard_join": op3,
    "op4_suffix_array_dedup": op4,
    "op5_lm_scoring": op5,
    "op6_topk_search": op6,
    "op7_language_id": op7,
    "op8_decontamination": op8,
    "op9_best_fit_packing": op9,
    "op10_license_scan": op10,
    "op11_prefix_trie": op11,
    "op12_chat_format": op12,
    "op13_ranked_search": op13,
}

def _license_sql() -> str:
    """Every unit against every template, without pruning."""
    rows = ", ".join(f"('{n}', [{', '.join(repr(g) for g in licenses.template_bigrams(t))}])" for n, t in licenses.TEMPLATES)
    return rf"""
WITH tpl(license, tg) AS (VALUES {rows}),
unit AS (
  SELECT doc_id, row_number() OVER () AS u, trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS n FROM (
    SELECT doc_id, unnest(list_concat(string_split(text, chr(10)),
      list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10))))) AS x FROM documents) q),
word AS (SELECT doc_id, u, string_split(n, ' ') AS w FROM unit WHERE n <> ''),
gram AS (
  SELECT doc_id, u, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM word),
hit AS (SELECT doc_id, u, license, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM gram, tpl),
best AS (
  SELECT doc_id, license, dice FROM (
    SELECT *, row_number() OVER (PARTITION BY u ORDER BY dice DESC, license) AS r FROM hit WHERE dice >= 0.8 - 1e-12) q WHERE r = 1),
doc AS (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT license)), ',') AS l, round(max(dice), 6) AS b FROM best GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(l, '') AS licenses, coalesce(b, 0.0::DOUBLE) AS best_dice
FROM documents LEFT JOIN doc USING (doc_id)"""


SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM d),
one AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sh),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
edge AS (
  SELECT a, b FROM inter JOIN sh p ON p.doc_id = a JOIN sh q ON q.doc_id = b
  WHERE 100 * i >= 85 * (len(p.s) + len(q.s) - i)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT sh.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, CAST(low AS BIGINT) AS component_id
FROM sh JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) r ON r.a = sh.doc_id""",
    "op10_license_scan": _license_sql(),
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS key FROM spot),
first AS (SELECT key, min(doc_id) AS low FROM win GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (key) WHERE low < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op4_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
spot AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS key FROM spot),
first AS (SELECT key, min(doc_id) AS low FROM win GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (key) WHERE low < doc_id),
runs AS (
  SELECT doc_id, count(*) AS n_removed, sum(CAST(fresh AS BIGINT)) AS n_spans FROM (
    SELECT doc_id, p - lag(p, 1, -2) OVER (PARTITION BY doc_id ORDER BY p) > 1 AS fresh FROM gone) g GROUP BY doc_id),
byte AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2), '' ORDER BY p) AS k FROM byte ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op6_topk_search": """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) r
WHERE rank <= 20""",
    "op11_prefix_trie": r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
convs AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
head AS (
  SELECT c, c - c % 100 AS b, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, x: xor(s >> 8, tab[1 + (xor(s, x) & 255)])), 4294967295) % 6 AS h FROM convs, crc),
own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS t,
    {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
line AS (
  SELECT h.c, o.t, o.turn, 0 AS part FROM head h JOIN own o ON o.c = h.b AND o.t <= h.h
  UNION ALL SELECT h.c, o.t, o.turn, 1 FROM head h JOIN own o ON o.c = h.c AND o.t > h.h),
whole AS (SELECT convs.c, coalesce(list(turn ORDER BY part, t) FILTER (WHERE turn IS NOT NULL), []) AS l FROM convs LEFT JOIN line USING (c) GROUP BY convs.c),
pre AS (SELECT c, len(l) AS size, d, l[1:d] AS p, CASE WHEN d > 0 THEN length(l[d].x) ELSE 0 END AS chars FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM whole) w),
node AS (
  SELECT d, p, min(c) AS c, count(*) AS n, max(chars) AS chars,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '')) AS ends FROM pre GROUP BY d, p),
kid AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS kids FROM node WHERE d > 0 GROUP BY 1, 2),
fact AS (SELECT node.*, coalesce(kids, 0) AS kids FROM node LEFT JOIN kid USING (d, p)),
up AS (SELECT kids, (n - 1) * chars AS saved, unnest(range(0, d + 1)) AS a, p FROM fact),
total AS (SELECT a AS d, p[1:a] AS p, sum((kids = 0)::BIGINT) AS leaves, sum(saved) AS saved FROM up GROUP BY 1, 2)
SELECT f.c AS conv_id, f.d AS depth, o.c AS parent_conv_id, f.n AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM fact f JOIN total USING (d, p) LEFT JOIN node o ON o.d = f.d - 1 AND o.p = f.p[1:f.d - 1]""",
    "op12_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) g(i)),
esc AS (
  SELECT *, r = 'assistant' AS own,
    regexp_replace(regexp_replace(x, '(\\*)(### (System|User|Assistant|Role):|</role>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS e,
    regexp_replace(regexp_replace(r, '(\\*)(### (System|User|Assistant|Role):|</role>|</turn>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS q
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(sum(CASE WHEN own THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (WHERE own), '')) AS loss_sha256,
  CAST(sum(length(e) + 8 + CASE r WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 18 + length(q) END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id""",
    "op13_ranked_search": r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM low WHERE t IS NOT NULL),
held AS (SELECT u, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM held),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark),
tf AS (SELECT u, x, count(*) AS tf FROM (SELECT u, unnest(w) AS x FROM held) o GROUP BY u, x),
df AS (SELECT x, count(*) AS df FROM tf GROUP BY x),
wt AS (SELECT x, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS wt FROM df, total),
scored AS (
  SELECT item_id, doc_id, u, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (x) JOIN wt USING (x) JOIN held USING (u), total GROUP BY item_id, doc_id, u)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) r
WHERE rank <= 10""",
}
