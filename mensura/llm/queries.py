"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from mensura.llm import alignment, bpe, decontamination, exact_dedup, html_extraction, jaccard_join, language, language_model, prefix_trie, quality, suffix_dedup, token_output, toxicity
from mensura.llm.common import fold, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the 50k byte ranks, and back to bytes; digests of both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of which a document has three quarters of the shingles, over all documents."""
    return decontamination.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _classified(scores: DataFrame, folds: int, held: int, least: float) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return _classified(toxicity.toxicity(docs, docs, labels), 5, 0, 0.5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    found = language.identified(docs, language.train(docs.where(fold("doc_id", 3) != 1)))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings removed from all documents; sizes and digests of what is kept."""
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; of each the largest doc_id stays."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over all documents."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of four folds of five."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return _classified(quality.quality(docs, docs, labels), 5, 0, 0.3)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, read back: where each document starts, its ids' length and crc."""
    folder = token_output.new_folder(spark)
    token_output.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return token_output.read_shards(spark, folder)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extraction.extracted(pages, html_extraction.train(pages))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document by a bigram model of six folds of seven."""
    return language_model.scored(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and piece tokens of every document, aligned; links and the corpus-wide counts of their pairs."""
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prefixes of all conversations, whose first turns are those of the conversation before by twenties."""
    conv = F.col("conv_id")
    turns = prefix_trie.turn_digests(table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(prefix_trie.with_shared_heads(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to token ids."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_token_output": op9_token_output,
    "op10_html_extraction": op10_html_extraction,
    "op11_language_model": op11_language_model,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

#: DuckDB: the distinct five-word shingles s of each row of a table of (id, text).
SHINGLES_SQL = """
    SELECT id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s
    FROM (SELECT id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM ({0}))
"""

#: DuckDB: the unsigned CRC-32 of an integer's decimal digits, bit by bit.
CRC32_SQL = """xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""

ORACLES = {
    "op2_decontamination": f"""
        WITH d AS ({SHINGLES_SQL.format("SELECT doc_id AS id, text FROM documents")}),
             b AS ({SHINGLES_SQL.format("SELECT item_id AS id, text FROM benchmark")}),
             n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
        SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_item_shingles, count(*) AS n_shared, count(*) / any_value(n.n) AS containment
        FROM d JOIN b USING (s) JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING 100 * count(*) >= 75 * any_value(n.n)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op7_jaccard_join": f"""
        WITH RECURSIVE d AS MATERIALIZED ({SHINGLES_SQL.format("SELECT doc_id AS id, text FROM documents")}),
             n AS MATERIALIZED (SELECT id, count(*) AS n FROM d GROUP BY id),
             c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
             e AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
             u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r AS (SELECT a AS id, a AS reached FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reached)
        SELECT documents.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(least(min(r.reached), documents.doc_id), documents.doc_id) AS component_id
        FROM documents LEFT JOIN n ON n.id = documents.doc_id LEFT JOIN r ON r.id = documents.doc_id GROUP BY documents.doc_id
    """,
    "op13_prefix_trie": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
             g AS (SELECT conv_id, turn, md5(concat(strlen(r), ':', r, x)) AS g, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM t),
             own AS (SELECT conv_id, list({{'g': g, 'w': w}} ORDER BY turn NULLS FIRST, g) AS l FROM g GROUP BY conv_id),
             h AS (SELECT *, {CRC32_SQL.format("conv_id")} % 4 AS h FROM own),
             b AS (SELECT h.conv_id, list_concat(coalesce(o.l, []), [])[1:h] || h.l[h + 1:] AS s FROM h LEFT JOIN own o ON o.conv_id = h.conv_id - h.conv_id % 20),
             m AS (SELECT conv_id, d, list_transform(s[1:d], lambda e: e.g) AS k, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w, d = len(s) AS last FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM b)),
             n AS (SELECT k, d, any_value(w) AS w, min(conv_id) AS c, count(*) AS many, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends FROM m GROUP BY k, d),
             f AS (SELECT n.*, coalesce(q.kids, 0) AS kids FROM n LEFT JOIN (SELECT k[1:d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1) q USING (k)),
             a AS (SELECT k[1:up] AS k, sum((many - 1) * w) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM f) GROUP BY 1)
        SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.many AS n_convs, f.kids AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN a USING (k) LEFT JOIN n p ON f.d > 0 AND p.k = f.k[1:f.d - 1]
    """,
}
