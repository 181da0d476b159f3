"""The queries that apply this package's operators to whole tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, id_shards, image_copies, language_id, line_dedup, near_dup, phrase_dedup, pii, token_counts
from .shared import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return id_shards.encode_to_shards(docs, vocabulary("word_bpe_49k.json"))


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_repeated_phrases(table(spark, sf_dir, "documents"), kept_text=False)


def op6_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), ids=False, decoded=False)


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so each vector of embeddings gives one. Of every row whose id is divisible
    by 20, an edited crop is looked up among the images of all rows. Rows with a query are the copies found,
    rows with an image tell its class."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    images = image_copies.rendered(vectors, "vec_id", "embedding")
    asked = image_copies.rendered(vectors.where("vec_id % 20 = 0"), "vec_id", "embedding", edited=True)
    return image_copies.copies_and_members(asked, images, "id", "image")


def op3_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"), redact=False)


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.held_out(F.col("doc_id"))
    profiles = language_id.learn(docs.where(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_chosen_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("n_links")


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS number
  FROM documents),
words AS (
  SELECT doc_id, number, line, list_filter(string_split(lower(line), ' '), lambda w: w <> '') AS w FROM lines),
sets AS (
  SELECT row_number() OVER (ORDER BY doc_id, number) AS r, doc_id, number, line,
         CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM words),
tokens AS (SELECT r, len(s) AS n, unnest(s) AS t FROM sets),
shared AS (
  SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
gone AS (SELECT DISTINCT b AS r FROM shared WHERE 100 * c >= 75 * (na + nb - c)),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(gone.r) AS n_removed,
         string_agg(line, chr(10) ORDER BY number) FILTER (WHERE gone.r IS NULL) AS t
  FROM sets LEFT JOIN gone USING (r) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN f USING (k) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.p IS NULL) AS t
         FROM each LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS k FROM sets),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON a.k = b.k AND a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u AS doc_id, min(v) AS m FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_id_shards,
        op2_image_copies,
        op3_boosted_pii,
        op4_suffix_arrays,
        op5_phrase_automata,
        op6_bpe_pair_index,
        op7_trie_counts,
        op8_hyperdimensional,
        op9_chosen_paths,
        op10_line_join,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_suffix_arrays": OP4_SQL, "op5_phrase_automata": OP5_SQL, "op9_chosen_paths": OP9_SQL, "op10_line_join": OP10_SQL}
