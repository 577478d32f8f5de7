"""Queries of the corpus operators on the test tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from followgraph.llm import bit_sliced, boundary_bpe, decontaminate, html_extract, huffman, language_id, license_scan, ngram_join, packing, quality
from followgraph.llm import spelling, substring_dedup, whitening
from followgraph.llm.common import table
from followgraph.session import new_path

WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and the smallest doc_id that its links lead to."""
    return ngram_join.link_components(table(spark, sf_dir, "documents"))


OP1_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * common >= 75 * (s.n + t.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE a = d.doc_id) AS component_id,
  (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word spans of each document that repeat in other documents, and which of them are removed."""
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place of each benchmark item in each document that contains it."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_MASKED = [
    f"concat_ws(' ', {number}, {', '.join(f'w[i + {p + 1}]' for p, c in enumerate(mask) if c == '1')})"
    for number, mask in enumerate(decontaminate.MASKS)
]
_PLAIN_WORDS = r"list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"

OP7_SQL = f"""
WITH docs AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_PLAIN_WORDS} AS w FROM benchmark),
places AS (
  SELECT doc_id, w, unnest(range(0, len(w) - {decontaminate.SPAN - 1})) AS i FROM docs WHERE len(w) >= {decontaminate.SPAN}),
doc_seeds AS (SELECT doc_id, i, unnest([{', '.join(_MASKED)}]) AS s FROM places),
item_places AS (
  SELECT item_id, w, unnest(range(0, len(w) - {decontaminate.SPAN - 1})) AS i FROM items WHERE len(w) >= {decontaminate.SPAN}),
item_seeds AS (SELECT item_id, i, unnest([{', '.join(_MASKED)}]) AS s FROM item_places),
diagonals AS (SELECT DISTINCT doc_id, item_id, d.i - t.i AS start FROM doc_seeds d JOIN item_seeds t ON d.s = t.s),
equal AS (
  SELECT g.doc_id, g.item_id, g.start, len(t.w) AS item_words,
    list_transform(range(greatest(0, -start), least(len(t.w), len(d.w) - start)), lambda k: t.w[k + 1] = d.w[k + start + 1]) AS e
  FROM diagonals g JOIN docs d ON d.doc_id = g.doc_id JOIN items t ON t.item_id = g.item_id),
steps AS (
  SELECT *, unnest(e) AS same, unnest(range(0, len(e))) AS k FROM equal),
summed AS (
  SELECT *, sum(CASE WHEN same THEN 1 ELSE -2 END) OVER (PARTITION BY doc_id, item_id, start ORDER BY k) AS total FROM steps),
lowest AS (
  SELECT *, least(0, min(total) OVER (PARTITION BY doc_id, item_id, start ORDER BY k)) AS least_total FROM summed),
scored AS (
  SELECT doc_id, item_id, start, item_words, count(*) FILTER (same) AS matched, max(total - least_total) AS score
  FROM lowest GROUP BY doc_id, item_id, start, item_words),
best AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, score DESC, start) AS r
  FROM scored WHERE 100 * matched >= {decontaminate.PERCENT} * item_words OR score >= {decontaminate.SCORE})
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(item_words AS INT) AS item_words, CAST(matched AS INT) AS matched,
  CAST(score AS INT) AS score FROM best WHERE r = 1
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids."""
    return packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as read back from their Huffman-coded files."""
    path = new_path(spark, "token-files")
    huffman.write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return huffman.read_files(spark, path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learnt from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~language_id.held_out())
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows with the greatest integer inner product for every row whose vec_id is divisible by 50."""
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP4_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document from two co-trained views."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's first 32 whitened components, with the measured error of the whitening."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its usual form and the root that forms lead to."""
    return spelling.variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
  FROM documents),
counted AS (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY ALL),
crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS b(i)),
bytes AS (
  SELECT doc_id, r, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS h FROM counted),
coded AS (
  SELECT r, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT))),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS code
  FROM bytes, crc_table),
damaged AS (
  SELECT CASE WHEN code % 97 = 0 THEN substr(r, 1, CAST(code % length(r) AS BIGINT)) || substr(r, CAST(code % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM coded),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM shorter x JOIN shorter y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM shorter x JOIN words y ON x.s = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM shorter x JOIN words y ON x.s = y.word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chains AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    ids = boundary_bpe.encode(table(spark, sf_dir, "documents"), tokenizer)
    ids = ids.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    texts = boundary_bpe.decode(ids, tokenizer)
    return texts.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_license_scan": op6_license_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_packing": op8_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_files": op10_token_files,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op4_exact_top_k": OP4_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op12_spelling_variants": OP12_SQL,
}
