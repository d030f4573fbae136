"""The operators of this folder as queries over the given tables, and SQL with the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import bpe, exact, language, licenses, merkle, packing, pieces, pii, quality, resampling, shards, simhash, tokens
from pairloom.llm.common import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query()
def op1_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Base spans of every document, and the terms that disclose them."""
    return pii.scan(documents(spark, sf), everywhere=True, error=pii.ERROR).drop("h")


def quality_sql() -> str:
    """The same counts, tests and verdicts in SQL."""
    n_rules = len(quality.RULES)
    rate = quality.MAX_FALSE_REJECTION / n_rules
    cutoffs = ", ".join(f"('{r}', {i}, {float(c)}::DOUBLE)" for r, cs in quality.RULES.items() for i, c in enumerate(cs))
    shares = {
        "symbol_share": ("n_symbols", "word_chars"),
        "upper_share": ("n_upper", "word_chars"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "mean_word_chars": ("word_chars", "n_words"),
    }
    long = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{r}' AS rule, CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END AS value FROM counted"
        for r, (a, b) in shares.items()
    )
    return rf"""
    WITH split AS (
      SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
             regexp_extract_all(t, '[^ 	-
]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) > 3)),
    again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
    inside AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM again, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
    counted AS (
      SELECT doc_id, stratum, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM split LEFT JOIN inside USING (doc_id)),
    failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
    long AS ({long}),
    good AS (
      SELECT l.* FROM long l JOIN failed f USING (doc_id)
      JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1) USING (doc_id) WHERE NOT base_failed),
    cells AS (
      SELECT stratum, rule, place, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS k
      FROM good JOIN (VALUES {cutoffs}) c(rule, place, cutoff) USING (rule) GROUP BY ALL),
    tested AS (
      SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
               exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) END
             <= {quality.ERROR} / ((SELECT count(DISTINCT stratum) FROM good) * {n_rules}) AS ok FROM cells),
    series AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY place) AS holds FROM tested),
    proven AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM series WHERE holds GROUP BY ALL),
    hit AS (SELECT DISTINCT doc_id FROM long JOIN proven USING (stratum, rule) WHERE value > cutoff)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept
    FROM failed"""


@query(quality_sql())
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document, by cutoffs that labels prove for each language."""
    measured = staged(quality.measure(documents(spark, sf)), "measures")
    cutoffs = quality.learn(measured, spark.read.parquet(f"{sf}/labels.parquet"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(measured, cutoffs).select(columns)


@query(
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """
)
def op3_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The group of equal texts of every document, and which one stays."""
    return exact.exact_duplicates(documents(spark, sf))


@query()
def op4_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document; over the limit beyond 512."""
    counted = tokens.count_tokens(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


@query()
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    return language.identify(documents(spark, sf))


@query()
def op6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    found = pieces.digests(public_tokenizers.path("piece_bpe_32k.model"), F.col("text")).alias("d")
    return documents(spark, sf).select("doc_id", found).select("doc_id", "d.*")


@query()
def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and notices of every document."""
    return licenses.scan(documents(spark, sf))


@query()
def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(documents(spark, sf))
    return found.select("doc_id", simhash.hexadecimal(F.col("f")).alias("fingerprint"), "component_id")


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a time."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    digits = rf"string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\2\1', 'g'), '')"
    numbers = f"list_transform({digits}, lambda d: strpos('0123456789ABCDEF', d)::BIGINT - 1)"
    step = f"xor(({table}::BIGINT[])[(xor(a, d) & 15) + 1], a >> 4)"
    return f"CASE WHEN {text} = '' THEN 0 ELSE xor(4294967295, list_reduce({numbers}, lambda a, d: {step}, 4294967295::BIGINT)) END"


def shards_sql(k: int, seed: int = 0, buckets: int = shards.BUCKETS) -> str:
    """The same numbers, network and walk in SQL."""
    rounds = "SELECT row_number, step, x // b AS l, x % b AS r FROM walk, sides WHERE step = 0 OR x >= n"
    for i, (add, times) in enumerate(shards.round_keys(seed)):
        into, side, of = ("l", "a", "r") if i % 2 == 0 else ("r", "b", "l")
        square = f"(({of} + {add}) % {shards.PRIME}) * (({of} + {add}) % {shards.PRIME}) % {shards.PRIME}"
        new = f"({into} + {square} * {times} % {shards.PRIME}) % {side}"
        kept = "r" if into == "l" else "l"
        rounds = f"SELECT row_number, step, {new} AS {into}, {kept} FROM ({rounds}), sides"
    return f"""
    WITH RECURSIVE summed AS (
      SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size, {crc32_sql("coalesce(text, '')")} AS crc FROM documents),
    numbered AS (
      SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws(':', doc_id, size, crc)), 1, 8))::BIGINT % {buckets},
                                   doc_id NULLS FIRST, size, crc) - 1 AS row_number FROM summed),
    sides AS (
      SELECT n, a, (n + a - 1) // a AS b
      FROM (SELECT n, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM (SELECT count(*) AS n FROM documents))),
    walk AS (
      SELECT row_number, 0 AS step, row_number AS x FROM numbered
      UNION ALL SELECT row_number, step + 1, l * b + r FROM ({rounds}), sides)
    SELECT doc_id, size, crc AS text_crc32, row_number, 'rows' AS law, (x % {k})::INTEGER AS shard, x // {k} AS slot, NULL::INTEGER AS grown_shard
    FROM numbered JOIN walk USING (row_number), sides WHERE step > 0 AND x < n"""


@query(shards_sql(24))
def op9_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of every document."""
    return shards.shard(documents(spark, sf), 24)


@query()
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every piece in sequences of 4096 tokens."""
    return packing.pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"), end=1)


def resampling_sql(buckets: int = resampling.BUCKETS, seed: int = resampling.SEED) -> str:
    """The same buckets, gains and draw in SQL, for n-grams of up to two words; each distinct n-gram is hashed once."""

    def grams(table: str, id_: str) -> str:
        return rf"""
          SELECT {id_} AS id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS gram
          FROM (SELECT {id_}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM {table} WHERE text IS NOT NULL)"""

    return f"""
    WITH own AS ({grams("documents", "doc_id")}), aim AS ({grams("benchmark", "item_id")}),
    each AS (SELECT gram, {crc32_sql("gram")} % {buckets} AS bucket FROM (SELECT gram FROM own UNION SELECT gram FROM aim)),
    raw AS (SELECT bucket, count(*) AS s FROM own JOIN each USING (gram) GROUP BY bucket),
    target AS (SELECT bucket, count(*) AS t FROM aim JOIN each USING (gram) GROUP BY bucket),
    sums AS (SELECT (SELECT count(*) FROM own)::DOUBLE AS s_all, (SELECT count(*) FROM aim)::DOUBLE AS t_all),
    gains AS (
      SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + {buckets}) / ((s + 1.0::DOUBLE) * (t_all + {buckets}))))::BIGINT AS gain
      FROM raw LEFT JOIN target USING (bucket), sums),
    weights AS (
      SELECT id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight, (count(*) + 1) // 2 AS n_words
      FROM own JOIN each USING (gram) JOIN gains USING (bucket) GROUP BY id),
    scored AS (
      SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(n_words, 0) AS n_words,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                        / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN weights ON doc_id = id),
    placed AS (
      SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
      FROM scored WHERE n_words >= {resampling.LEAST})
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END AS rank
    FROM scored LEFT JOIN placed USING (doc_id)"""


@query(resampling_sql())
def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of every document by what benchmark texts look like, and the rank of those drawn."""
    return resampling.resample(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query()
def op12_word_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    found = bpe.digests(public_tokenizers.path("word_bpe_49k.json"), F.col("text")).alias("d")
    return documents(spark, sf).select("doc_id", found).select("doc_id", "d.*")


#: Documents whose id has a CRC-32 that this divides are taken for tampered with.
TAMPERED = 7


def manifest_sql(deep: int = 40) -> str:
    """The same trees in SQL: nodes level by level, then each leaf's siblings and the fold over them."""

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(map(field, ['doc_id', 'source', 'lang', n_chars, 'text']))})"

    return f"""
    WITH RECURSIVE leaves AS (
      SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
             CASE WHEN {crc32_sql("doc_id::VARCHAR")} % {TAMPERED} = 0 THEN {leaf("(n_chars + 1)")} END AS forged FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
    nodes AS (
      SELECT lang AS g, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM placed
      UNION ALL
      SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM nodes
      WHERE n > 1 AND level < {deep} GROUP BY g, level, pos // 2),
    subroots AS (SELECT g, node, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
    uppers AS (
      SELECT 0 AS level, pos, node, n FROM subroots
      UNION ALL
      SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM uppers
      WHERE n > 1 AND level < {deep} GROUP BY level, pos // 2),
    steps AS (
      SELECT doc_id, p.lang, p.pos, l.level, CASE WHEN s.node IS NULL THEN '' WHEN l.pos % 2 = 0 THEN 'R' || s.node ELSE 'L' || s.node END AS step
      FROM placed p JOIN nodes l ON l.g IS NOT DISTINCT FROM p.lang AND l.n > 1 AND l.pos = p.pos >> l.level
      LEFT JOIN nodes s ON s.g IS NOT DISTINCT FROM l.g AND s.level = l.level AND s.pos = xor(l.pos, 1::BIGINT)),
    paths AS (SELECT lang, pos, list(step ORDER BY level) AS path FROM steps GROUP BY lang, pos),
    upper_steps AS (
      SELECT g, l.level, CASE WHEN s.node IS NULL THEN '' WHEN l.pos % 2 = 0 THEN 'R' || s.node ELSE 'L' || s.node END AS step
      FROM subroots r JOIN uppers l ON l.n > 1 AND l.pos = r.pos >> l.level
      LEFT JOIN uppers s ON s.level = l.level AND s.pos = xor(l.pos, 1::BIGINT)),
    upper_paths AS (SELECT g, list(step ORDER BY level) AS path FROM upper_steps GROUP BY g),
    proven AS (
      SELECT p.doc_id, p.leaf, coalesce(p.forged, p.leaf) AS start, r.node AS subroot, (SELECT node FROM uppers WHERE n = 1) AS root,
             list_concat(coalesce(a.path, []::VARCHAR[]), coalesce(b.path, []::VARCHAR[])) AS path
      FROM placed p JOIN subroots r ON r.g IS NOT DISTINCT FROM p.lang
      LEFT JOIN paths a ON a.lang IS NOT DISTINCT FROM p.lang AND a.pos = p.pos
      LEFT JOIN upper_paths b ON b.g IS NOT DISTINCT FROM p.lang),
    done AS (
      SELECT *, list_reduce(path, lambda own, s: sha256(
        CASE WHEN s = '' THEN own WHEN s[1] = 'L' THEN substr(s, 2) || own ELSE own || substr(s, 2) END), start) AS folded_root FROM proven)
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256,
           folded_root, folded_root = root AS verified FROM done"""


@query(manifest_sql())
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered one's proof leads to."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    forged = F.when(hit, merkle.digest(*map(merkle.field, changed)))
    found = merkle.manifest(documents(spark, sf), columns, carry={"forged": forged})
    folded = merkle.folded(F.coalesce("forged", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline, one after the other."""
    return corpus_pipeline.run(spark, sf)
