"""Registered queries of the training-data operators; thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeweave.llm import language, toxicity
from tomeweave.llm._sample import held_out
from tomeweave.llm.exact_dedup import exact_dedup
from tomeweave.llm.mixing import mix, word_tokens
from tomeweave.llm.packing import pack
from tomeweave.llm.quality import quality_rules
from tomeweave.llm.simhash import near_duplicates
from tomeweave.llm.suffix_dedup import remove_repeats
from tomeweave.llm.token_counts import token_counts
from tomeweave.llm.token_tables import read_tables, write_tables


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources flattened to 95 % of the largest entropy, each read at least once and at most 4 times."""
    docs = _documents(spark, sf_dir).select("doc_id", "source", word_tokens(F.col("text")).alias("n_tokens"))
    return mix(docs, target_entropy=0.95, max_repetition=4.0, tokens=F.col("n_tokens")).select(
        "doc_id", "source", "n_tokens", "mix_epoch", "mix_block", "mix_block_order", "mix_doc_order"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.fit(docs.where(~held_out(F.col("doc_id"))))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op7_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tables(write_tables(_documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir)).drop("n_bytes")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    grammar = toxicity.fit(docs, labels)
    return toxicity.score(docs, grammar).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mix_sources, op2_simhash, op3_language, op4_suffix_dedup, op5_pack,
        op6_quality, op7_token_tables, op8_exact_dedup, op9_toxicity, op10_token_counts,
    )
}

#: Permuted order and quota as op1_mix_sources defines them; the exponent is bisected in a recursive query.
_OP1 = r"""
WITH RECURSIVE light AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS s, coalesce(CAST(doc_id AS VARCHAR), 'null') AS i,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents),
keyed AS (SELECT *, ('0x' || substr(md5('42:' || i), 1, 15))::BIGINT AS k FROM light),
totals AS (SELECT s, sum(n)::BIGINT AS t FROM light GROUP BY s),
corpus AS (SELECT sum(t)::DOUBLE AS c FROM totals),
shares AS (SELECT s, t, ln(t / c) AS lp FROM totals, corpus WHERE t > 0),
entropy(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS m,
          (SELECT ln(sum(exp((lo + hi) / 2 * lp))) - sum(exp((lo + hi) / 2 * lp) * (lo + hi) / 2 * lp) / sum(exp((lo + hi) / 2 * lp))
                  < 0.95 * ln(count(*)) - 1e-12 FROM shares) AS ok FROM entropy WHERE step < 44)),
ratio(step, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END
  FROM (SELECT step, lo, hi, (lo + hi) / 2 AS m,
          (SELECT exp(((lo + hi) / 2 - 1) * (min(lp) - max(lp))) <= 4 * (1 + 1e-9) FROM shares) AS ok FROM ratio WHERE step < 44)),
flat AS (SELECT ln(sum(1)) < 0.95 * ln(count(*)) - 1e-12 AS h0, exp(-(min(lp) - max(lp))) <= 4 * (1 + 1e-9) AS r0 FROM shares),
chosen AS (SELECT greatest(
    (SELECT CASE WHEN h0 THEN 0.0 ELSE (SELECT hi FROM entropy WHERE step = 44) END FROM flat),
    (SELECT CASE WHEN r0 THEN 0.0 ELSE (SELECT hi FROM ratio WHERE step = 44) END FROM flat)) AS a),
quotas AS (SELECT s, t, CAST(round(exp(a * lp) * c * exp((1 - a) * (SELECT max(lp) FROM shares))) AS BIGINT) AS q FROM shares, chosen, corpus),
plan AS (
  SELECT s, t, q // t AS epochs, q % t AS rest, CAST(ceil(t / 262144.0) AS BIGINT) AS blocks FROM quotas
  UNION ALL SELECT s, t, 1, 0, 1 FROM totals WHERE t = 0),
blocked AS (SELECT keyed.*, epochs, rest, blocks, k % blocks AS b FROM keyed JOIN plan USING (s)),
ordered AS (
  SELECT s, b, epochs, blocks, sum(n)::BIGINT AS n, ('0x' || substr(md5('42:' || epochs || ':' || s || ':' || b), 1, 15))::BIGINT AS o
  FROM blocked GROUP BY s, b, epochs, blocks),
starts AS (
  SELECT s, b, coalesce(sum(n) OVER (PARTITION BY s ORDER BY o % CAST(ceil(blocks / 1024.0) AS BIGINT), o, b
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ordered),
last AS (
  SELECT doc_id, source, n, s, b, i, epochs, rest, start,
         ('0x' || substr(md5('42:' || epochs || ':' || i), 1, 15))::BIGINT AS o FROM blocked JOIN starts USING (s, b)),
taken AS (
  SELECT *, start + coalesce(sum(n) OVER (PARTITION BY s, b ORDER BY o RANGE UNBOUNDED PRECEDING), 0)
              - sum(n) OVER (PARTITION BY s, b, o) < rest AS extra FROM last),
copies AS (SELECT *, unnest(range(0, epochs + CASE WHEN extra THEN 1 ELSE 0 END)) AS e FROM taken)
SELECT doc_id, source, n AS n_tokens, e AS mix_epoch, b AS mix_block,
       ('0x' || substr(md5('42:' || e || ':' || s || ':' || b), 1, 15))::BIGINT AS mix_block_order,
       ('0x' || substr(md5('42:' || e || ':' || i), 1, 15))::BIGINT AS mix_doc_order
FROM copies
"""

_OP8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL: dict[str, str] = {"op1_mix_sources": _OP1, "op8_exact_dedup": _OP8}
