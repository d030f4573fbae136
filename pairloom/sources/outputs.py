"""The tree of generated outputs: names, inventory, selection, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom import values as V

PARTITIONS = ["date", "output_type", "model", "template"]


def file_stem(path: Column) -> Column:
    """File name without folder and last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def with_path_metadata(df: DataFrame, path: str = "file_path") -> DataFrame:
    """Add benchmark id, version and template from the file name.

    Rows whose name has another form are dropped. The id is a number, so 10
    comes after 2.
    """
    stem = file_stem(F.col(path))
    pattern = f"^{V.FILE_NAME}"
    return (
        df.where(F.regexp_like(stem, F.lit(pattern)))
        .withColumn("benchmark_id", F.regexp_extract(stem, pattern, 1).cast("int"))
        .withColumn("version", F.regexp_extract(stem, pattern, 2))
        .withColumn("template_key", F.regexp_extract(stem, pattern, 3))
    )


def list_outputs(spark: SparkSession, root: str) -> DataFrame:
    """One row per file below ``root/<model>/<template>/``.

    Only names are read; of a partition folder ``name=value`` the value
    counts. The inventory stays a table: a model may own any number of files.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .load(root)
        .select(F.col("path").alias("file_path"), "length", F.col("modificationTime").alias("modified"))
    )
    parts = F.split("file_path", "/", -1)

    def folder(up: int) -> Column:
        return F.regexp_replace(F.try_element_at(parts, F.lit(-1 - up)), "^[^=]*=", "")

    def named(name: str, up: int) -> Column:
        found = F.nullif(F.regexp_extract("file_path", f"/{name}=([^/]*)/", 1), F.lit(""))
        return F.coalesce(found, folder(up))

    return files.select(
        named("model", 2).alias("model"),
        named("template", 1).alias("template"),
        "file_path",
        "length",
        "modified",
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths of the JSON files below ``root``, relative to it."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.json")
        .option("recursiveFileLookup", True)
        .load(root)
    )
    name = root.rstrip("/").rsplit("/", 1)[-1]
    return files.select(F.substring_index("path", f"/{name}/", -1).alias("file_path"))


def count_outputs(files: DataFrame) -> DataFrame:
    """Files and bytes per model and template."""
    return files.groupBy("model", "template").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes")
    )


def load_outputs(
    outputs: DataFrame,
    model: str | None = None,
    benchmark_id: int | None = None,
    version: str | None = None,
    template: str | None = None,
    date: str | None = None,
    output_type: str | None = None,
) -> DataFrame:
    """Rows that meet every given condition; ``None`` allows any value.

    On a table partitioned by :data:`PARTITIONS` these prune folders.
    """
    wanted = {
        "model": model,
        "benchmark_id": benchmark_id,
        "version": version,
        "template": template,
        "date": date,
        "output_type": output_type,
    }
    for name, value in wanted.items():
        if value is not None:
            outputs = outputs.where(F.col(name) == value)
    return outputs


def _one_file(outputs: DataFrame, highest: bool) -> DataFrame:
    """Rows of one (benchmark, template) only, picked by one small aggregate."""
    which = F.struct("benchmark_id", "template")
    pick = F.max(which) if highest else F.min(which)
    return outputs.where(which == outputs.agg(pick.alias("which")).scalar())


def _load_kind(outputs: DataFrame, kind: str, template: str | None, **wanted) -> DataFrame:
    found = load_outputs(outputs, template=template, **wanted)
    if template is not None:
        return _one_file(found, highest=False)
    return _one_file(found.where(infer_output_type(F.col("template")) == kind), highest=True)


def load_passages(
    outputs: DataFrame,
    model: str,
    benchmark_id: int | None = None,
    version: str = "v1.0.0",
    template: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """Passages a model wrote for one benchmark.

    Without a template, templates named like passages are looked through and
    the highest benchmark id is taken; with one, the lowest.
    """
    kind = {"output_type": "passage"} if date is not None else {}
    return _load_kind(
        outputs, "passage", template, model=model, benchmark_id=benchmark_id, version=version, date=date, **kind
    )


def load_stems(
    outputs: DataFrame,
    model: str,
    benchmark_id: int | None = None,
    version: str = "v1.0.0",
    template: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """Question stems a model wrote, chosen like :func:`load_passages`."""
    kind = {"output_type": "stem"} if date is not None else {}
    return _load_kind(
        outputs, "stem", template, model=model, benchmark_id=benchmark_id, version=version, date=date, **kind
    )


def load_options(
    outputs: DataFrame,
    model: str,
    benchmark_id: int | None = None,
    version: str = "v1.0.0",
    template: str = V.OPTIONS_TEMPLATE,
    date: str | None = None,
) -> DataFrame:
    """Answer options a model wrote with one template."""
    return _load_kind(
        outputs, "options", template, model=model, benchmark_id=benchmark_id, version=version, date=date
    )


def read_outputs(spark: SparkSession, root: str, schema, format: str = "json") -> DataFrame:
    """Outputs written by :func:`write_outputs`; partition values as columns."""
    return spark.read.schema(schema).format(format).load(root)


def output_type(template: Column) -> Column:
    """Folder a template's results belong to."""
    return (
        F.when(F.contains(template, F.lit("passage")), "passage")
        .when(F.contains(template, F.lit("stem")), "stem")
        .when(F.contains(template, F.lit("option")), "option")
        .otherwise("misc")
    )


def infer_output_type(template: Column) -> Column:
    """What a file holds when no template is asked for: passage, stem or null."""
    name = F.lower(template)

    def has(word: str) -> Column:
        return F.contains(name, F.lit(word))

    options = has("options") | has("eval")
    return F.when(has("passage") & ~has("stem") & ~options, "passage").when(has("stem") & ~options, "stem")


def highest_benchmark(files: DataFrame, wanted: str, by: list[str]) -> DataFrame:
    """Per group the file of the wanted kind with the highest benchmark id."""
    kept = files.where(infer_output_type(F.col("template_key")) == wanted)
    return latest_only(kept, by, [F.col("benchmark_id"), F.col("file_path")])


def latest_only(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Per key the row with the greatest order value; of rows that tie, one.

    Rows are ranked inside their key and cut to one before the shuffle
    (WindowGroupLimit), so a key with very many rows never gathers in one task
    and only one row per key and task moves.
    """
    last = Window.partitionBy(*keys).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("_at", F.row_number().over(last)).where(F.col("_at") == 1).drop("_at")


def checkpoint_number(path: Column) -> Column:
    """Number after the last ``-`` of a checkpoint folder name."""
    return F.substring_index(path, "-", -1).try_cast("bigint")


def select_rubric_files(files: DataFrame, prefix: str, valid: list[str] = V.RUBRICS) -> DataFrame:
    """The first file of each valid rubric named ``<prefix>_<rubric>_<date>``."""
    stem = file_stem(F.col("file_path"))
    rubric = F.regexp_extract(stem, rf"^{prefix}_(.+?)_\d{{8}}", 1)
    named = files.withColumn("rubric", rubric).where(F.col("rubric").isin(valid))
    return named.groupBy("rubric").agg(F.min("file_path").alias("file_path"))


def write_outputs(df: DataFrame, root: str, format: str = "json") -> None:
    """Write results below date, type, model, template, benchmark id and version.

    ``df`` needs the columns date, model and template; benchmark_id and
    version add folders where it has them. Writing the same folders again
    replaces them and leaves all others, so a rerun changes nothing. Line JSON
    by default, ``format="parquet"`` for data that is read often.
    """
    folders = PARTITIONS + [c for c in ("benchmark_id", "version") if c in df.columns]
    (
        df.withColumn("output_type", output_type(F.col("template")))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .format(format)
        .save(root)
    )


def output_path(date: Column, model: Column, benchmark_id: Column, version: Column, template: Column) -> Column:
    """Relative path a result file has in the output tree."""
    name = F.concat_ws("_", F.lit("benchmark"), benchmark_id.cast("string"), version, template)
    return F.concat_ws("/", date.cast("string"), output_type(template), model, template, F.concat(name, F.lit(".json")))


def benchmark_by_id(benchmarks: DataFrame, benchmark_id: int) -> DataFrame:
    """The benchmark with an id; no row if there is none."""
    return benchmarks.where(F.col("id") == benchmark_id)


def guidelines(benchmarks: DataFrame) -> DataFrame:
    """Problem types and goals of each benchmark, to be joined by its id."""
    return benchmarks.select(F.col("id").alias("benchmark_id"), "problem_types", "eval_goals")


def benchmark_items(benchmarks: DataFrame, item_index: int | None = None) -> DataFrame:
    """One row per benchmark item with its position from 0.

    An ``item_index`` outside the list gives no row.
    """
    items = benchmarks.select(
        F.col("id").alias("benchmark_id"),
        "problem_types",
        "eval_goals",
        F.posexplode("items").alias("pos", "item"),
    )
    return items if item_index is None else items.where(F.col("pos") == item_index)
