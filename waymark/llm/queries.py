"""The queries of these operators on the driver's tables, and their SQL where there is one."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat_format, lattice_lm, mincut_html, mixing, ngram_jaccard, piece_bpe, quality_classifier, quality_rules, spot_signatures, substring_dedup
from waymark.llm.common import load



def _tokenizers() -> str:
    """The folder of public vocabularies on the machine that starts the query."""
    if folder := os.environ.get("WAYMARK_TOKENIZERS"):
        return folder
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return "/opt/tokenizers"
    return os.path.dirname(public_tokenizers.path("piece_bpe_32k.model"))


TOKENIZERS = _tokenizers()


def sha(column) -> F.Column:
    return F.sha2(F.encode(column, "utf-8"), 256)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.NgramJaccardJoin(size=3, num=90, den=100).run(load(spark, sf_dir, "documents"))


def op2_spot_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spot_signatures
    e = s.edits(load(spark, sf_dir, "documents"))
    return e.select("doc_id", "n_chars", sha("edited").alias("edited_sha256"), s.fingerprint(F.col("sigs")).alias("fingerprint"), s.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), s.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), s.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


#: A conversation whose text holds the template's own control strings.
PLANTED = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = turns.schema
    planted = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"].dataType).alias("conv_id"), F.col("id").cast(kinds["turn"].dataType).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    chats = chat_format.proven(chat_format.format_chats(turns.unionByName(planted))).withColumn("loss", F.array_join(chat_format.loss_spans(F.col("parsed")), ""))
    whole = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("parsed").cast("long").alias("n_turns"), sha(whole).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha("loss").alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
chats AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    bool_or(contains(' ' || text, ' </turn>' || chr(10)) OR contains(role, ': ') OR contains(' ' || role, ' </turn>' || chr(10)) OR role LIKE '%!') AS escaped,
    sum(length(role) + length(text) + 15) AS plain_chars,
    sum(length(regexp_replace(role || text, '[^\\/:!#]', '', 'g')) + 1) AS more
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(plain_chars + CASE WHEN escaped THEN more ELSE 0 END AS BIGINT) AS formatted_chars FROM chats
"""


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_bpe.encode_decode(load(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
toks AS (SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM docs),
grams AS (SELECT r, i, w[i:i + 4] AS g FROM toks, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM often, unnest(range(0, 5)) AS v(k) GROUP BY r),
lines AS (SELECT r, source, text, unnest(string_split(trim(regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\t\x0B\f\r]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), ' '), chr(10))) AS line FROM toks),
having_ AS (SELECT source, line, count(DISTINCT text) AS n FROM lines WHERE line <> '' GROUP BY source, line),
hosts AS (SELECT source, count(DISTINCT text) AS texts FROM docs GROUP BY source),
boiler AS (SELECT h.source, h.line FROM having_ h JOIN hosts USING (source) WHERE h.n > greatest(5, 0.05 * texts)),
gone AS (SELECT r, sum(len(regexp_extract_all(l.line, '[^\x20\x09-\x0D]+'))) AS n FROM lines l JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line GROUP BY r),
counts AS (SELECT t.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(gone.n, 0) AS n_gone
  FROM toks t LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_gone >= 0.3 * n_words AS kept FROM counts
"""


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(load(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rk FROM d GROUP BY source),
c AS (SELECT *, [3, 1, 2][rk % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM c),
v AS (SELECT *, (total - CAST(capped AS DOUBLE)) / CAST(open AS DOUBLE) AS lev FROM o),
lv AS (SELECT arg_min(lev, (CAST(cap AS DOUBLE) / weight, rk)) AS level FROM v WHERE cap >= lev * weight),
t AS (SELECT source, source_size, CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target FROM v, lv),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS run, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE run // source_size * size + greatest(0, least(fin, run % source_size) - (fin - size)) END AS BIGINT) AS taken FROM p
"""


def op3_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_html.extract_pages(load(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lattice_lm.score_documents(load(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality_classifier.QualityClassifier(docs, load(spark, sf_dir, "labels")).classify(docs).select("doc_id", F.col("host").alias("source"), "evidence", "score", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.SubstringDedup().run(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM t, unnest(range(1, greatest(len(w) - 48, 1))) AS u(i)),
firsts AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
late AS (SELECT r, i FROM win JOIN firsts USING (h) WHERE doc_id > m),
gone AS (SELECT DISTINCT r, i + k AS p FROM late, unnest(range(0, 50)) AS v(k)),
left_ AS (SELECT t.r, p, w[p] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
kept AS (SELECT l.r, count(*) AS n, string_agg(word, ' ' ORDER BY l.p) AS text FROM left_ l ANTI JOIN gone g ON l.r = g.r AND l.p = g.p GROUP BY l.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""

QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_spot_fingerprints, op3_mincut_html, op4_chat_format, op5_lattice_lm, op6_piece_bpe, op7_quality_rules, op8_quality_classifier, op9_substring_dedup, op10_mix_sources)}
SQL = {"op4_chat_format": OP4_SQL, "op7_quality_rules": OP7_SQL, "op9_substring_dedup": OP9_SQL, "op10_mix_sources": OP10_SQL}
