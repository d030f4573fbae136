"""What large tables need: even tasks, little moved and written, whole results."""

import gzip
import json
import os
import random
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from pairloom.operators import pairs as J
from pairloom.operators import records as R
from pairloom.operators import stats as A
from pairloom.operators.scoring import score_with, score_with_each
from pairloom.plans import datasets as D
from pairloom.plans import evaluation as E
from pairloom.sources import files as S
from pairloom.storage import shared_dir
from pairloom.values import RUBRICS
from workload.sources import written_evaluations

QUERIES = queries()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """A folder with small tables of documents and nations."""
    root = tmp_path_factory.mktemp("tables")
    langs = ["en", "fr"]
    rows = [(i, f"text {i}. " + "word " * (i % 37), langs[i % 2], f"src{i % 20}", 7 + len(str(i)) + 5 * (i % 37)) for i in range(1, 241)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    nations = [(f"nation {i}", i % 5) for i in range(25)]
    spark.createDataFrame(nations, "n_name string, n_regionkey int").write.parquet(f"{root}/nation.parquet")
    return str(root)


def test_pair_statistics_count_every_gap(spark, docs):
    got = QUERIES["pair_stats"](spark, docs).where("kind = 'margin'").groupBy("value").agg(F.sum("n_pairs")).collect()
    pairs = QUERIES["pairs_by_score_gap"](spark, docs).groupBy("margin").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in pairs} and {r["value"] for r in got} == {1, 2, 3, 4}


def test_pairs_in_lists_are_all_pairs(spark):
    """Repeated and null ids too; pairs are counted in their lists, so no task makes a row for each."""
    rows = [(None if i % 41 == 0 else i % 150, f"r{i % 2}", f"s{i % 3}", i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "passage_id long, rubric string, source_key string, score int")
    for gap, cell in ((1, 2000), (2, 7)):
        lists = J.pairs_by_score_gap(df, gap, cell_rows=cell, together=True)
        one_by_one = J.one_by_one(lists)
        pairs = J.pairs_by_score_gap(df, gap, cell_rows=cell)
        want = sorted(map(str, pairs.select(sorted(pairs.columns)).collect()))
        assert sorted(map(str, one_by_one.select(sorted(pairs.columns)).collect())) == want != []
        assert lists.agg(F.max(F.size("rejected_ids"))).first()[0] <= 2 * cell and lists.count() < len(want)
        counted = A.pair_levels(lists)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, A.pair_levels(pairs).collect()))
        assert counted.schema["n_pairs"].dataType == A.pair_levels(pairs).schema["n_pairs"].dataType
    with pytest.raises(ValueError):
        J.pairs_by_score_gap(df, carry=["score"], together=True)


def test_statistics_count_pairs_in_lists(spark, docs):
    plan = QUERIES["pair_stats"](spark, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(size(rejected_ids" in plan and plan.count("collect_list") == 2


def test_cells_are_dealt_over_all_tasks(spark):
    rows = [(i, "r", "s", i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "passage_id int, rubric string, source_key string, score int")
    tasks = J.pairs_by_score_gap(df, cell_rows=10).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 8 and max(r["count"] for r in tasks) < 16_000 // 3


def test_repeated_texts_take_little_room(spark, tmp_path):
    text = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(20)])
    texts = spark.range(50, numPartitions=1).select(text.alias("chosen"), F.lower(text).alias("rejected"))
    pairs = texts.select("*", F.lit("IMP").alias("dataset_type"), J.one_row_each(["a", "b"]).alias("rubric"))
    S.write_pairs(pairs, str(tmp_path / "pairs"))
    S.write_jsonl(texts, str(tmp_path / "lines"))

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*"))

    plain = texts.agg(F.sum(F.length("chosen") + F.length("rejected"))).first()[0]
    assert size("pairs") < plain and size("lines") < plain / 2
    back = S.read_pairs(spark, str(tmp_path / "pairs"), "chosen string, rejected string, dataset_type string, rubric string")
    assert sorted(map(tuple, back.select("chosen", "rejected", "rubric").collect())) == sorted(
        map(tuple, pairs.select("chosen", "rejected", "rubric").collect())
    )
    lines = S.read_jsonl(spark, str(tmp_path / "lines"), texts.schema)
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, texts.collect()))


def test_lines_are_compressed_at_the_fastest_level(spark, tmp_path):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows = [(" ".join(rng.choices(words, k=400)), "r", "IMP", "a") for _ in range(100)]
    df = spark.createDataFrame(rows, "chosen string, rejected string, dataset_type string, rubric string").coalesce(1)
    S.write_pairs(df, str(tmp_path / "pairs"))
    S.write_jsonl(df, str(tmp_path / "lines"))
    files = list(tmp_path.rglob("part-*.gz"))
    assert len(files) == 2
    for f in files:
        lines = gzip.decompress(f.read_bytes())
        assert len(zlib.compress(lines, 2)) < f.stat().st_size < len(lines) * 2 / 3


def test_arrays_are_compressed_at_a_fast_level(spark, tmp_path):
    """Larger than at the level that takes twice the time, smaller than at the fastest."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows = [(" ".join(rng.choices(words, k=400)), f"g{i % 2}") for i in range(200)]
    S.write_json_arrays(spark.createDataFrame(rows, "t string, g string").coalesce(1), str(tmp_path), ["g"])
    files = list(tmp_path.rglob("part-*.gz"))
    assert len(files) == 2
    for f in files:
        text = gzip.decompress(f.read_bytes())
        assert len(zlib.compress(text, 5)) < f.stat().st_size < len(zlib.compress(text, 1))
    assert sorted(r["t"] for r in S.read_json_array(spark, str(tmp_path), spark.createDataFrame(rows[:1], "t string, g string").select("t").schema).collect()) == sorted(t for t, _ in rows)


def test_records_of_several_rubrics_are_stored_close_together(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"p{i}", {"korean_topic": "t"}, rng.randbytes(30_000).hex(), rng.randbytes(30_000).hex(), "IMP", None) for i in range(40)]
    schema = "pair_id string, source_item struct<korean_topic: string>, chosen string, rejected string, dataset_type string, created_at timestamp"
    texts = spark.createDataFrame(rows, schema).coalesce(1)
    before = set(Path(shared_dir(spark).removeprefix("file:")).glob("train-records-*"))
    pairs = texts.select("*", J.one_row_each(RUBRICS).alias("rubric"))
    counts = D.convert_pairs(pairs, dict.fromkeys(RUBRICS, "Q"), str(tmp_path / "train"), str(tmp_path / "eval"))
    (stored,) = set(Path(shared_dir(spark).removeprefix("file:")).glob("train-records-*")) - before
    plain = 2 * 40 * 60_000  # every text once; hex digits take half of that at best
    assert sum(f.stat().st_size for f in stored.rglob("*.parquet")) < 0.8 * plain
    assert {r["split"]: r["n"] for r in counts.collect()} == {"train": 190, "eval": 50}


def test_lengths_meet_passages_not_pairs(spark, docs):
    found = QUERIES["build_score_gap_pairs"](spark, docs)
    pairs = found.agg(F.sum("n")).first()[0]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [rubric") == 4  # by passage before lengths are met, then without it, on either side
    rows = QUERIES["build_score_gap"](spark, docs).collect()
    assert {tuple(r[c] for c in found.columns) for r in rows} == {tuple(r) for r in found.collect()} and pairs > 0


def test_every_pair_is_written_by_its_ids(spark, docs, tmp_path):
    """Lists of rejected ids hold all pairs once, and take less than a byte for each where they recur."""
    stats = D.build_score_gap_pairs(spark, written_evaluations(spark, docs), str(tmp_path), min_gap=2, pattern="*")
    lists = spark.read.parquet(f"{tmp_path}/pairs")
    pairs = J.one_by_one(lists)
    assert sorted(pairs.columns) == sorted(["rubric", "source_key", "chosen_id", "rejected_id", "high_score", "low_score", "margin"])
    found = {(r["rubric"], r["margin"]): r["count"] for r in pairs.groupBy("rubric", "margin").count().collect()}
    assert found == {(r["rubric"], r["value"]): r["n_pairs"] for r in stats.where("kind = 'margin'").collect()} != {}
    assert pairs.distinct().count() == pairs.count() > lists.count()
    texts = spark.read.parquet(f"{tmp_path}/passages").select("passage_id")
    assert pairs.join(texts, F.col("rejected_id") == F.col("passage_id")).count() == pairs.count()
    rows = spark.range(1000).selectExpr("id * 8589934592 AS passage_id", "'r' AS rubric", "'s' AS source_key", "cast(id % 2 AS int) AS score")
    J.pairs_by_score_gap(rows, together=True).write.options(**D.ID_LISTS).parquet(f"{tmp_path}/large")
    assert sum(f.stat().st_size for f in (tmp_path / "large").rglob("part-*")) < 250_000


def test_margin_records_digest_passages_not_pairs(spark, docs):
    """Texts end below the pairing; the records say what those of whole texts say, and a missing text is empty."""
    found = QUERIES["to_rm_record_with_margin"](spark, docs)
    top = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[0]
    assert "md5" not in top and "generated_passage" not in top and "text#" in top
    texts = ["a", "b", None]
    rows = [(i, RUBRICS[i % 6], "s", 1 + i // 6 % 5, texts[i % 3], ("k", None, "f", None)) for i in range(90)]
    item = "struct<korean_topic:string,korean_context:string,foreign_topic:string,foreign_context:string>"
    df = spark.createDataFrame(rows, f"passage_id int, rubric string, source_key string, score int, text string, item {item}")

    def digests(records, of):
        turns = F.get("conversations", F.lit(0))["value"], F.col("chosen.value"), F.col("rejected.value")
        return sorted(records.select(*[of(t) for t in turns], "metadata.rubric", "metadata.margin").collect())

    whole = R.to_rm_record_with_margin(J.pairs_by_score_gap(df, 3, ["text", "item"]))
    short = J.pairs_by_score_gap(df.withColumn("text", F.md5(R.turn_text("text"))), 3, ["text", "item"])
    assert digests(R.to_rm_record_with_margin(short, of=F.md5), lambda t: t) == digests(whole, F.md5) != []


def test_arrays_are_cut_where_rows_are_made(spark, tmp_path):
    """Nothing is stored before, files are small, no array is too large, and no row is lost."""
    rows = spark.range(600, numPartitions=3).selectExpr(
        "id", "repeat(concat('é', id), 40) AS t", "if(id % 5 = 0, null, concat('g', id % 5)) AS g"
    )
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    S.write_json_arrays(rows, str(tmp_path / "a"), ["g"], rows_per_file=50, bytes_per_file=9_000)
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before
    arrays = {f: gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").rglob("part-*")}
    assert all(len(a) <= 9_001 and len(json.loads(a)) <= 50 for a in arrays.values())
    assert sum(f.stat().st_size for f in arrays) < sum(map(len, arrays.values())) / 2
    want = sorted((r["id"], r["t"]) for r in rows.collect())
    assert sorted((x["id"], x["t"]) for a in arrays.values() for x in json.loads(a)) == want
    assert {f.parent.name for f in arrays} == {"g=__HIVE_DEFAULT_PARTITION__", *[f"g=g{i}" for i in range(1, 5)]}
    back = S.read_json_array(spark, str(tmp_path / "a"), rows.select("id", "t").schema)
    assert sorted((r["id"], r["t"]) for r in back.collect()) == want
    S.write_json_arrays(rows.select("id"), str(tmp_path / "b"), rows_per_file=7)
    assert S.read_json_array(spark, str(tmp_path / "b"), rows.select("id").schema).count() == 600


def test_models_share_a_worker(spark, tmp_path):
    """Every model scores every text, in one process of a task; a score that is no number is null."""
    rows = spark.range(300, numPartitions=3).selectExpr("id", "if(id % 7 = 0, '', repeat(concat('é', id), cast(id % 50 as int) + 1)) AS passage")

    def process():
        return lambda s: s.str.len() * 0 + os.getpid()

    def length():
        return lambda s: (s.str.len() * 1.0).where(s.str.len() != 6)

    scorers = {"a": process, "b": process, "n": length}
    got = E.rank_candidates(rows, scorers, str(tmp_path / "ranked"), "id").collect()
    assert len(got) == 257 and all(r["a"] == r["b"] != os.getpid() for r in got)
    assert all(r["n"] == (len(r["passage"]) if len(r["passage"]) != 6 else None) for r in got)
    alone = score_with(rows, "passage", length, to="n").select("id", "n").collect()
    assert sorted(map(tuple, alone), key=str) == sorted(((r["id"], r["n"]) for r in got), key=str)
    small = score_with_each(rows, "passage", {"n": length}, padded=100).select("id", "n").collect()
    assert sorted(map(tuple, small), key=str) == sorted(map(tuple, alone), key=str)


def test_score_gap_records_move_texts_not_pairs(spark, docs, tmp_path):
    """Pairs are made where their texts lie; Parquet has the records of line JSON and keeps a text once for many."""
    tree = written_evaluations(spark, docs)
    records = D.score_gap_records(S.read_eval_tree(spark, tree, pattern="*").withColumn("passage_id", F.monotonically_increasing_id()))[1]
    plan = records._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = next(i for i, line in enumerate(plan) if "Join Inner" in line)
    assert any("RepartitionByExpression" in line for line in plan[last + 1 : last + 3])
    counts, rows, bytes_ = {}, {}, {}
    for kind in ("json", "parquet"):
        stats = D.build_score_gap(spark, tree, str(tmp_path / kind), min_gap=2, pattern="*", format=kind)
        counts[kind] = sorted(map(tuple, stats.collect()), key=str)
        rows[kind] = sorted(map(str, spark.read.schema(records.schema).format(kind).load(str(tmp_path / kind)).select(*records.columns).collect()))
        bytes_[kind] = sum(f.stat().st_size for f in (tmp_path / kind).rglob("part-*"))
    assert counts["json"] == counts["parquet"] and rows["json"] == rows["parquet"] != []
    assert bytes_["parquet"] < bytes_["json"] / 5
