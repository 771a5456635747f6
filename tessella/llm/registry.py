"""The thin queries over the driver's tables, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import split_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _held_out(parts: int, fold: int) -> Column:
    return F.coalesce(split_bucket("doc_id", parts) == fold, F.lit(False))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.html import extract

    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.bpe import digests

    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~_held_out(4, 2)))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import quality

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~_held_out(4, 2))
    return quality.predict(docs, model, ["doc_id"]).select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import chat

    said = "</s>[INST] ok [/INST]"
    turns = chat.all_turns(table(spark, sf_dir, "conversations"), [(-1, 0, "user", said), (-1, 1, "assistant", said)])
    return chat.read_back(chat.format_windows(turns, chat.bpe_counter(tokenizer_path())), in_order=True)


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.linededup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import rules

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = rules.fit(docs, labels, ~_held_out(4, 2))
    return rules.apply(docs, model, ["doc_id"])


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.llm import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = lm.score(docs, ~_held_out(5, 1), ["doc_id"])
    return scores.select("doc_id", _held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_html": op2_html,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_linededup": op7_linededup,
    "op8_rules": op8_rules,
    "op9_lm": op9_lm,
    "op10_decontaminate": op10_decontaminate,
}

#: A window of 13 tokens with two substitutions, or of 8 to 12 with one, holds
#: four equal tokens in a row, so all candidates share such a run: this SQL
#: finds what the seeds must find, in another way; shorter items match whole.
_OP10_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE doc_id IS NOT NULL),
have AS (SELECT doc_id, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda x: x <> '') AS h FROM lowered),
want AS (
  SELECT * FROM (SELECT DISTINCT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0),
hg AS (SELECT doc_id, i, h[i] || ' ' || h[i + 1] || ' ' || h[i + 2] || ' ' || h[i + 3] AS g FROM (SELECT doc_id, h, unnest(range(1, len(h) - 2)) AS i FROM have)),
wg AS (SELECT item_id, j, w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS j FROM want WHERE len(w) >= 8)),
pairs AS (SELECT DISTINCT doc_id, item_id, i - j AS d FROM hg JOIN wg USING (g)),
marks AS (
  SELECT doc_id, item_id, d, len(w) AS n, least(len(w), 13) AS k,
         list_transform(range(1, len(w) + 1), lambda j: CASE WHEN j + d >= 1 AND j + d <= len(h) AND h[j + d] = w[j] THEN 1 ELSE 0 END) AS m
  FROM pairs JOIN have USING (doc_id) JOIN want USING (item_id) WHERE len(w) >= 8),
scored AS (
  SELECT doc_id, item_id, d, n, k, list_sum(m) AS total,
         list_max(list_transform(range(1, n - k + 2), lambda s: list_sum(m[s:s + k - 1]))) AS best
  FROM marks),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY total DESC, greatest(d, 0), n DESC) AS r FROM scored WHERE best >= k - least(2, (n * 2) // 13))
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_tokens, CAST(total AS BIGINT) AS n_matched, CAST(greatest(d, 0) AS BIGINT) AS first_token
FROM kept WHERE r = 1
UNION ALL
SELECT doc_id, item_id, CAST(len(w) AS BIGINT), CAST(len(w) AS BIGINT), CAST(min(i) - 1 AS BIGINT)
FROM (SELECT doc_id, h, unnest(range(1, len(h) + 1)) AS i FROM have) JOIN (SELECT * FROM want WHERE len(w) < 8) ON h[i] = w[1] AND list_slice(h, i, i + len(w) - 1) = w
GROUP BY doc_id, item_id, w
"""

ORACLES: dict[str, str] = {"op10_decontaminate": _OP10_SQL}
