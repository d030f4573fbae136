"""Text functions over whole documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as T
from pairloom.functions.edits import edit_distance_within, similarity_within
from pairloom.operators.responses import context_block
from pairloom.operators.stats import distinct_tokens
from workload.registry import query
from workload.views import numbered, texts

# The documents hold no white space beyond blank, tab and line ends, so the
# ASCII classes of the SQL find what the Unicode ones of the library find.
_SQUEEZE = r"trim(regexp_replace({0}, '[ \t\n\r]+', ' ', 'g'))"


@query(
    "clean_brackets",
    "SELECT page_id, md5(c) AS cleaned, length(c)::INTEGER AS n FROM (SELECT page_id, "
    + _SQUEEZE.format(
        r"regexp_replace(regexp_replace(regexp_replace(html, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '\{[^}]*\}', '', 'g')"
    )
    + " AS c FROM pages)",
)
def clean_brackets(spark, sf):
    c = texts(spark, sf, "pages").select("page_id", T.clean_brackets("html").alias("c"))
    return c.select("page_id", F.md5("c").alias("cleaned"), F.length("c").alias("n"))


@query(
    "remove_title",
    r"""
SELECT doc_id, md5(regexp_replace(trim(t, E' \t\n\r'), '\n+', ' ', 'g')) AS body FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    CASE WHEN contains(s, '[지문]:') THEN trim(string_split(s, '[지문]:')[2], E' \t\n\r') ELSE s END,
    '(?m)^\*\*제목:.*?\*\*\s*\n+', '', 'g'), '(?m)^제목:.*?\n+', '', 'g'),
    '(?m)^\*\*.*?\*\*\s*\n+', '', 'g'), '(?m)^Title:.*?\n+', '', 'g'), '(?m)^#.*?\n+', '', 'g') AS t
  FROM (SELECT doc_id, CASE doc_id % 5
      WHEN 0 THEN '머리말 [지문]: ' || E'\n제목: ' || source || E'\n\n' || text
      WHEN 1 THEN '**제목: ' || source || '**' || E' \n\n' || text
      WHEN 2 THEN E'# ' || source || E'\nTitle: ' || lang || E'\n' || text
      WHEN 3 THEN '**' || source || '**' || E'\n' || text
      ELSE text END AS s FROM documents))""",
)
def remove_title(spark, sf):
    d = texts(spark, sf)

    def lit(x):
        return F.lit(x)

    kind = F.col("doc_id") % 5
    s = (
        F.when(kind == 0, F.concat(lit("머리말 [지문]: \n제목: "), "source", lit("\n\n"), "text"))
        .when(kind == 1, F.concat(lit("**제목: "), "source", lit("** \n\n"), "text"))
        .when(kind == 2, F.concat(lit("# "), "source", lit("\nTitle: "), "lang", lit("\n"), "text"))
        .when(kind == 3, F.concat(lit("**"), "source", lit("**\n"), "text"))
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", F.md5(T.remove_title(s)).alias("body"))


@query("normalize_ws", f"SELECT doc_id, md5({_SQUEEZE.format('text')}) AS body FROM documents")
def normalize_ws(spark, sf):
    return texts(spark, sf).select("doc_id", F.md5(T.normalize_ws("text")).alias("body"))


_SENTENCES = (
    r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[ \t\n\r]*'), "
    r"lambda s: trim(s, E' \t\n\r')), lambda s: length(s) > 0)"
)


@query(
    "split_sentences",
    f"SELECT doc_id, len(s)::INTEGER AS n, md5(array_to_string(s, '|')) AS sentences "
    f"FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)",
)
def split_sentences(spark, sf):
    s = texts(spark, sf).select("doc_id", T.split_sentences("text").alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences"))


@query(
    "text_counts",
    rf"""
SELECT doc_id, length(text)::INTEGER AS chars,
  len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> ''))::INTEGER AS words,
  len(s)::INTEGER AS sentences,
  round(CASE WHEN len(s) = 0 THEN 0 ELSE list_avg(list_transform(s,
    lambda x: len(regexp_split_to_array(x, '[ \t\n\r]+')))) END, 6) AS sentence_words
FROM (SELECT doc_id, text, {_SENTENCES} AS s FROM documents)""",
)
def text_counts(spark, sf):
    counts = T.text_counts("text")
    counts["sentence_words"] = F.round(counts["sentence_words"], 6)
    return texts(spark, sf).select("doc_id", *[c.alias(n) for n, c in counts.items()])


@query(
    "length_gate",
    "SELECT doc_id, CASE WHEN length(text) < 300 THEN 'too_short' WHEN length(text) > 500 THEN 'too_long' "
    "ELSE 'ok' END AS gate FROM documents",
)
def length_gate(spark, sf):
    return texts(spark, sf).select("doc_id", T.length_gate("text").alias("gate"))


@query(
    "truncate_at_period",
    """
SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS body FROM (SELECT doc_id,
  CASE WHEN length(text) <= 500 THEN text
       WHEN strpos(reverse(text), '.') > 0 AND length(text) - strpos(reverse(text), '.') < 500
         THEN substr(text, 1, length(text) - strpos(reverse(text), '.') + 1)
       ELSE substr(text, 1, 500) END AS t FROM documents)""",
)
def truncate_at_period(spark, sf):
    t = texts(spark, sf).select("doc_id", T.truncate_at_period("text").alias("t"))
    return t.select("doc_id", F.length("t").alias("n"), F.md5("t").alias("body"))


# What a corrected text has instead of a letter; no text holds it.
NEW = "\ue000"

# By the document's number: nothing changes, full stops, stops and no commas, a fifth or a half of the letters.
CORRECTED_SQL = f"""CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN translate(text, '.', '{NEW}') WHEN 2 THEN translate(text, '.,', '{NEW}')
  WHEN 3 THEN translate(text, 'e', '{NEW}') ELSE translate(text, 'aeinr', '{NEW * 5}') END"""


def corrected():
    """A document's text with some letters replaced by one that occurs in no text, and some taken out.

    Each new letter is one edit at least and so is each that is missing, so
    SQL can tell the distance from counts alone.
    """
    letters = [(".", NEW), (".,", NEW), ("e", NEW), ("aeinr", NEW * 5)]
    out = F.when(F.col("doc_id") % 5 == 0, F.col("text"))
    for i, (old, new) in enumerate(letters, 1):
        out = out.when(F.col("doc_id") % 5 == i, F.translate("text", old, new))
    return out


def distance_sql(a: str, b: str) -> str:
    """Edits between a text and a corrected one: its new letters, and those it has less."""
    return f"(length({b}) - length(replace({b}, '{NEW}', '')) + length({a}) - length({b}))"


@query(
    "edit_distance",
    f"""
SELECT doc_id, CASE WHEN d <= floor(0.2::DOUBLE * n) + 1 THEN d::INTEGER END AS distance,
  CASE WHEN d <= floor(0.2::DOUBLE * n) + 1 THEN round(s, 6) END AS similarity,
  CASE WHEN s >= 0.99 THEN 5 WHEN s >= 0.95 THEN 4 WHEN s >= 0.90 THEN 3 WHEN s >= 0.80 THEN 2 ELSE 1 END AS grade
FROM (SELECT doc_id, d, n, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - d::DOUBLE / n END AS s
  FROM (SELECT doc_id, {distance_sql("text", "b")} AS d, length(text) AS n FROM (SELECT doc_id, text, {CORRECTED_SQL} AS b FROM documents)))""",
)
def edit_distance(spark, sf):
    """Whole texts and corrected ones, in the band that grades depend on."""
    docs = texts(spark, sf).select("doc_id", "text", corrected().alias("b"))
    docs = docs.withColumn("distance", edit_distance_within("text", "b"))
    s = F.col("s")  # a column of its own: each use of the expression would measure both texts again
    return docs.withColumn("s", similarity_within(F.col("text"), F.col("b"), F.col("distance"))).select(
        "doc_id", "distance", F.round(s, 6).alias("similarity"), F.coalesce(T.scale_1_5(s), F.lit(1)).alias("grade")
    )


# Page addresses are ASCII: DuckDB counts bytes, Spark code points.
_URL = "regexp_replace(replace(lower(url), 'http://', 'https://'), '[?#].*$', '')"


def normal_url():
    """A page address in one spelling."""
    return F.regexp_replace(F.replace(F.lower("url"), F.lit("http://"), F.lit("https://")), "[?#].*$", "")


@query(
    "edit_distance_short",
    f"""
SELECT page_id, d AS distance, round(s, 6) AS similarity,
  CASE WHEN s >= 0.99 THEN 5 WHEN s >= 0.95 THEN 4 WHEN s >= 0.90 THEN 3 WHEN s >= 0.80 THEN 2 ELSE 1 END AS grade
FROM (SELECT page_id, d, 1.0::DOUBLE - d::DOUBLE / n AS s FROM (SELECT page_id,
  levenshtein(url, {_URL})::INTEGER AS d, greatest(length(url), length({_URL})) AS n FROM pages))""",
)
def edit_distance_short(spark, sf):
    """Addresses: short texts, by the built-in matrix."""
    pages = texts(spark, sf, "pages").withColumn("b", normal_url())
    s = T.normalized_similarity("url", "b")
    return pages.select(
        "page_id",
        T.edit_distance("url", "b").alias("distance"),
        F.round(s, 6).alias("similarity"),
        T.scale_1_5(s).alias("grade"),
    )


@query(
    "preview",
    "SELECT doc_id, substr(text, 1, 50) || '...' AS always, "
    "CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS longer FROM documents",
)
def preview(spark, sf):
    return texts(spark, sf).select(
        "doc_id", T.preview("text", 50).alias("always"), T.preview("text", 200, always=False).alias("longer")
    )


@query(
    "topic_from_name",
    """
SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN source || '_' || lang END AS topic FROM documents""",
)
def topic_from_name(spark, sf):
    label = F.element_at(
        F.array(F.lit("고품질"), F.lit("저품질"), F.lit("다른")), (F.col("doc_id") % 3 + 1).cast("int")
    )
    name = F.concat_ws("_", label, "doc_id", "source", "lang")
    return texts(spark, sf).select("doc_id", T.topic_from_name(name).alias("topic"))


@query(
    "distinct_tokens",
    r"SELECT DISTINCT unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS token FROM documents",
)
def vocabulary(spark, sf):
    return distinct_tokens(texts(spark, sf))


_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(
    "context_block",
    f"""
WITH p AS (
  SELECT {_HOST} AS topic, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, html AS summary,
         row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages)
SELECT topic, md5(string_agg('문서 제목: ' || title || E'\\n내용: ' || substr(summary, 1, 500) || '...',
                             E'\\n\\n---\\n\\n' ORDER BY n)) AS context
FROM p WHERE n <= 5 GROUP BY topic""",
)
def context(spark, sf):
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    pages = texts(spark, sf, "pages").select(
        host.alias("topic"),
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("summary"),
    )
    places = numbered(pages, ["topic"], ["page_id"], "page_id").withColumn("pos", F.col("pos") - 1)
    topics = pages.select("topic").distinct()
    return context_block(places, topics).select("topic", F.md5("context").alias("context"))
