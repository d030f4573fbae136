"""Statistics of documents, scores and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import pairs as J
from pairloom.operators import stats as A
from workload.registry import query
from workload.text import _SENTENCES
from workload.views import IMP, SCORES, imp_pairs, long_scores, texts

_MEASURED = rf"""measured AS (
  SELECT lang, length(text)::DOUBLE AS chars,
    len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))::DOUBLE AS words,
    len(s)::DOUBLE AS sentences,
    (CASE WHEN len(s) = 0 THEN 0 ELSE list_avg(list_transform(s,
      lambda x: len(regexp_split_to_array(x, '[ \t\n\r]+')))) END)::DOUBLE AS sentence_words
  FROM (SELECT lang, text, {_SENTENCES} AS s FROM documents))"""


def _stats_sql(by: str) -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    return f"WITH {_MEASURED} " + " UNION ALL ".join(
        f"SELECT {head}count(*) AS n_passages, '{m}' AS metric, round(avg({m}), 6) AS mean, "
        f"round(stddev_pop({m}), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM measured {group}"
        for m in A.MEASURES
    )


def _rounded(stats, by):
    numbers = [F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")]
    return stats.select(*by, "n_passages", "metric", *numbers)


@query("corpus_stats", _stats_sql(""))
def corpus_stats(spark, sf):
    return _rounded(A.corpus_stats(texts(spark, sf)), [])


@query("corpus_stats_by_language", _stats_sql("lang"))
def corpus_stats_by_language(spark, sf):
    return _rounded(A.corpus_stats(texts(spark, sf), by=["lang"]), ["lang"])


_TOKENS = r"""tokens AS (
  SELECT lang, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS token FROM documents)"""


@query(
    "type_token_ratio",
    f"""WITH {_TOKENS}
SELECT count(*) AS tokens, count(DISTINCT token) AS types, round(count(DISTINCT token) / count(*), 6) AS ttr FROM tokens""",
)
def type_token_ratio(spark, sf):
    rows = A.type_token_ratio(texts(spark, sf))
    return rows.select("tokens", "types", F.round("ttr", 6).alias("ttr"))


@query(
    "type_token_ratio_by_language",
    f"""WITH {_TOKENS}
SELECT lang, count(*) AS tokens, count(DISTINCT token) AS types, round(count(DISTINCT token) / count(*), 6) AS ttr
FROM tokens GROUP BY lang""",
)
def type_token_ratio_by_language(spark, sf):
    rows = A.type_token_ratio(texts(spark, sf), by=["lang"])
    return rows.select("lang", "tokens", "types", F.round("ttr", 6).alias("ttr"))


_LONG = r"""long_ones AS (
  SELECT doc_id, lang, length(text)::INTEGER AS original_length,
         length(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')))::INTEGER AS cleaned_length
  FROM documents WHERE length(text) > 500)"""


@query(
    "long_passages",
    f"WITH {_LONG} SELECT doc_id, original_length, cleaned_length, original_length - cleaned_length AS reduction FROM long_ones",
)
def long_passages(spark, sf):
    rows = A.long_passages(texts(spark, sf))
    return rows.select("doc_id", "original_length", "cleaned_length", "reduction")


@query(
    "long_passage_summary",
    f"""WITH {_LONG}
SELECT lang, count(*) AS n_long, round(avg(original_length), 6) AS original_length_mean,
  min(original_length) AS original_length_min, max(original_length) AS original_length_max,
  round(avg(cleaned_length), 6) AS cleaned_length_mean, min(cleaned_length) AS cleaned_length_min,
  max(cleaned_length) AS cleaned_length_max, round(avg(original_length - cleaned_length), 6) AS reduction_mean
FROM long_ones GROUP BY lang""",
)
def long_passage_summary(spark, sf):
    rows = A.long_passage_summary(A.long_passages(texts(spark, sf)), ["lang"])
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_mean") else F.col(c) for c in rows.columns])


@query(
    "rubric_means",
    f"""WITH {SCORES}, cells AS (SELECT r.rubric, m.model FROM (SELECT DISTINCT rubric FROM long) r, (SELECT DISTINCT model FROM long) m)
SELECT c.rubric, c.model, round(coalesce(avg(score), 0.0), 6) AS mean
FROM cells c LEFT JOIN long l ON l.rubric = c.rubric AND l.model = c.model GROUP BY ALL""",
)
def rubric_means(spark, sf):
    """A row per cell."""
    return A.rubric_mean_rows(long_scores(spark, sf)).withColumn("mean", F.round("mean", 6))


@query(
    "overall_means",
    f"""WITH {SCORES}, per AS (SELECT model, rubric, avg(score) AS mean, count(*) AS n FROM long GROUP BY ALL)
SELECT model, round(sum(mean) / 6, 6) AS overall_mean, sum(n)::BIGINT AS n_scores FROM per GROUP BY model""",
)
def overall_means(spark, sf):
    rows = A.overall_means(long_scores(spark, sf))
    return rows.select("model", F.round("overall_mean", 6).alias("overall_mean"), "n_scores")


_GAPS = f"""{SCORES}, gaps AS (
  SELECT a.rubric, a.source_key, a.score AS high_score, b.score AS low_score, a.score - b.score AS margin
  FROM long a JOIN long b ON a.rubric = b.rubric AND a.source_key = b.source_key AND a.score - b.score >= 1)"""

_PAIR_STATS = f"""WITH {_GAPS}
SELECT rubric, 'margin' AS kind, margin AS value, count(*) AS n_pairs FROM gaps GROUP BY rubric, margin UNION ALL
SELECT rubric, 'high_score', high_score, count(*) FROM gaps GROUP BY rubric, high_score UNION ALL
SELECT rubric, 'low_score', low_score, count(*) FROM gaps GROUP BY rubric, low_score"""


@query("score_gap_stats", _PAIR_STATS.replace("count(*)", "count(*)::BIGINT"))
def score_gap_stats(spark, sf):
    """Pair statistics from level sizes: no pair is built."""
    return A.pair_stats(J.score_gap_counts(long_scores(spark, sf)))


@query("pair_stats", _PAIR_STATS)
def pair_stats(spark, sf):
    """The same statistics counted over the pairs themselves, in their lists."""
    return A.pair_stats(A.pair_levels(J.pairs_by_score_gap(long_scores(spark, sf), together=True)))


@query(
    "top_sources",
    f"""WITH {_GAPS}, c AS (SELECT rubric, source_key, count(*) AS n_pairs FROM gaps GROUP BY ALL)
SELECT * FROM (SELECT rubric, source_key, n_pairs,
  CAST(row_number() OVER (PARTITION BY rubric ORDER BY n_pairs DESC, source_key) AS INTEGER) AS place FROM c)
WHERE place <= 5""",
)
def top_sources(spark, sf):
    return A.top_sources(J.score_gap_counts(long_scores(spark, sf)))


@query(
    "dataset_stats",
    f"""WITH {IMP}, c AS (SELECT rubric, count(*) AS n FROM imp GROUP BY rubric)
SELECT rubric, n::BIGINT AS n_pairs, 1::BIGINT AS n_rubrics, n::DOUBLE AS mean_per_rubric FROM c UNION ALL
SELECT 'total', sum(n)::BIGINT, count(*), sum(n) / count(*) FROM c""",
)
def dataset_stats(spark, sf):
    return A.dataset_stats(imp_pairs(spark, sf))
