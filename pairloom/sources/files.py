"""Reading and writing JSON files of pairs, passages and evaluations."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom import values as V
from pairloom.schemas import EVALUATION
from pairloom.sources.arrays import array_elements

#: Bytes up to which a file is read as one row; larger ones are cut into elements by ranges.
WHOLE_FILE = 16 << 20
#: Line JSON is compressed by gzip at its fastest: a fifth of the time, for files a tenth larger.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Arrays at a level that takes a third of the usual time, for files a twenty-fifth larger.
GZIP_ARRAYS = {"compression": "gzip", "zlib.compress.level": "FOUR"}
#: Rows handled at once while arrays are written.
SLICE = 256

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _as_text(kind: T.DataType) -> T.DataType:
    """The type with every number and truth value read as text, so none can make its record unreadable."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _as_text(kind.valueType))
    return kind if isinstance(kind, T.TimestampType) else T.StringType()


def _typed(value: Column, kind: T.DataType) -> Column:
    """Values of :func:`_as_text` in their types; one that does not fit is null. ``4.0`` and ``"4"`` are the number 4."""
    if isinstance(kind, T.StructType):
        fields = F.struct(*[_typed(value[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), fields)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _typed(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, v: _typed(v, kind.valueType))
    if isinstance(kind, _NUMBERS):
        number = value.try_cast("decimal(38,10)")
        return F.coalesce(value.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))
    return value if isinstance(kind, (T.StringType, T.TimestampType)) else value.try_cast(kind)


def _records(texts: DataFrame, schema: T.StructType, keep: list[str], corrupt: str | None) -> DataFrame:
    """One row per JSON text in ``value``, whatever columns are read later.

    A text that is no JSON object gives no row, or with ``corrupt`` one row of
    nulls. That column holds the text of every record not read in full.
    """
    loose = _as_text(schema)
    marked = T.StructType([*loose.fields, T.StructField("_broken", T.StringType())])
    rows = texts.select(
        *keep,
        F.from_json("value", marked, {"columnNameOfCorruptRecord": "_broken"}).alias("_r"),
        F.json_object_keys("value").isNotNull().alias("_object"),
    )
    found = [_typed(F.col("_r")[f.name], f.dataType).alias(f.name) for f in schema]
    if corrupt is None:
        return rows.where("_object").select(*found, *keep)
    return rows.select(*found, *keep, F.col("_r._broken").alias(corrupt))


def _elements(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """The elements of files that hold a JSON array, as ``value`` with ``file_path``; any other file is one element.

    Both ways give the same elements; of a small file that is no JSON as a
    whole, the elements that are come through the second one too.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    place = F.col("_metadata.file_path").alias("file_path")
    small = files.where(F.col("_metadata.file_size") <= WHOLE_FILE).select("value", place)
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>"))
    out = small.select(F.explode(F.coalesce(listed, F.array("value"))).alias("value"), "file_path")
    large = files.where(F.col("_metadata.file_size") > WHOLE_FILE)
    if large.select(place).isEmpty():  # files are left out by their size before one is opened
        return out
    return out.unionByName(array_elements(spark, path, pattern, WHOLE_FILE))


def read_json_array(
    spark: SparkSession, path: str | list[str], schema: T.StructType, corrupt: str | None = None
) -> DataFrame:
    """Rows of files holding one JSON array each; an object is one row.

    A field of another type is null and leaves its record and its file as they
    are. Files that are no JSON add no rows, unless ``corrupt`` names a column
    for the text of what could not be read. Adds the column file_path.
    """
    return _records(_elements(spark, path), schema, ["file_path"], corrupt)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """Rows of line JSON; blank lines add no rows, nor do broken ones unless ``corrupt`` names a column for them."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return _records(lines, schema, [], corrupt)


def broken_records(rows: DataFrame, corrupt: str, by: list[str] = []) -> DataFrame:
    """How many records were read, and how many of them not in full."""
    broken = F.count_if(F.col(corrupt).isNotNull())
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), broken.alias("n_broken"))


def read_merged(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    pattern: str = V.RECORD_FILE,
    corrupt: str | None = None,
) -> DataFrame:
    """Record files below ``<model pair>/<rubric>/`` as one table, repeats kept.

    One recursive read; model pair and rubric come from the path, of a
    partition folder ``name=value`` the value. ``pattern`` is matched with
    file names; files Spark wrote need ``"*"``.
    """
    files = _elements(spark, root, pattern).withColumn("_parts", F.split("file_path", "/", -1))

    def folder(up: int) -> Column:
        return F.regexp_replace(F.try_element_at("_parts", F.lit(-1 - up)), "^[^=]*=", "")

    placed = files.select("value", folder(2).alias("model_pair"), folder(1).alias("rubric"))
    keep = ["model_pair", "rubric"]
    return _records(placed, schema, keep, corrupt)


def evaluation_model(path: Column) -> Column:
    """Model name from the first path part that holds ``_evaluation``.

    A partition folder ``name=value`` counts by its value.
    """
    part = F.regexp_extract(path, r"(?:^|/)(?:[^/=]*=)?([^/]*_evaluation[^/]*)", 1)
    return F.coalesce(F.nullif(F.replace(part, F.lit("_evaluation"), F.lit("")), F.lit("")), F.lit("unknown"))


def read_eval_tree(
    spark: SparkSession,
    root: str,
    keep_unknown: bool = True,
    pattern: str = V.EVALUATION_FILE,
    corrupt: str | None = None,
) -> DataFrame:
    """All evaluation files below ``root`` with the model that was evaluated.

    One scan serves every rubric. ``keep_unknown=False`` drops files that lie
    under no model folder. ``pattern`` is matched with file names; files Spark
    wrote need ``"*"``.
    """
    rows = _records(_elements(spark, root, pattern), EVALUATION, ["file_path"], corrupt)
    rows = rows.withColumn("model", evaluation_model(F.col("file_path")))
    return rows if keep_unknown else rows.where(F.col("model") != "unknown")


def flatten_entries(df: DataFrame, raw: str, entry: T.DataType) -> DataFrame:
    """Rows out of JSON texts that are a list, or an object of rows or lists.

    Values that are neither are dropped. ``raw`` is replaced by ``entry``.
    """
    as_map = F.from_json(raw, "map<string,string>")
    head = F.substring(F.ltrim(F.col(raw)), 1, 1)
    values = F.when(head == "[", F.array(F.col(raw))).when(head == "{", F.map_values(as_map))
    keep = [c for c in df.columns if c != raw]
    nodes = df.select(*keep, F.explode(values).alias("_v"))
    first = F.substring(F.ltrim(F.col("_v")), 1, 1)
    many = F.from_json("_v", T.ArrayType(entry))
    one = F.array(F.from_json("_v", entry))
    return nodes.select(
        *keep, F.explode(F.when(first == "[", many).when(first == "{", one)).alias("entry")
    ).where(F.col("entry").isNotNull())


def _in_arrays(rows_per_file: int, bytes_per_file: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Puts the last column's JSON texts into arrays, one open for each value of the others, together no larger than one may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[bytes]] = {}
        sizes: Counter[tuple] = Counter()
        total = 0

        def ended(key: tuple) -> pa.RecordBatch:
            nonlocal total
            total -= sizes.pop(key)
            value = b"[" + b",".join(held.pop(key)) + b"]"
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*key, value], schema)], schema=schema)

        for batch in batches:
            schema = batch.schema
            for i in range(0, batch.num_rows, SLICE):
                for *own, value in zip(*[c.to_pylist() for c in batch.slice(i, SLICE).columns], strict=True):
                    key, size = tuple(own), len(value) + 1
                    while held and total + size > bytes_per_file:
                        yield ended(max(sizes, key=sizes.get))
                    held.setdefault(key, []).append(value)
                    sizes[key] += size
                    total += size
                    if len(held[key]) >= rows_per_file:
                        yield ended(key)
        for key in list(held):
            yield ended(key)

    return run


def write_json_arrays(
    df: DataFrame, path: str, by: list[str] = [], rows_per_file: int = 10_000, bytes_per_file: int = 64 << 20
) -> None:
    """JSON files that hold one array each, for readers of whole files, compressed by gzip.

    An array ends after ``rows_per_file`` rows, or earlier where the arrays that
    a task has open, one below each of the ``by`` folders, reach
    ``bytes_per_file`` bytes: the largest ends then. A task cuts the rows that
    it makes and writes all of its files or none, so nothing is stored or moved
    before, and when a task runs again no row is lost or doubled.
    """
    row = F.to_json(F.struct(*[c for c in df.columns if c not in by]))
    rows = df.select(*by, row.cast("binary").alias("value"))
    arrays = rows.mapInArrow(_in_arrays(rows_per_file, bytes_per_file), rows.schema)
    out = arrays.select(*by, F.col("value").cast("string").alias("value")).write.mode("overwrite")
    out = out.option("maxRecordsPerFile", 1).options(**GZIP_ARRAYS)
    (out.partitionBy(*by) if by else out).text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Line JSON, text as it is, in files compressed by gzip, which Spark reads like plain ones."""
    df.write.mode("overwrite").options(**GZIP).json(path)


def write_pairs(pairs: DataFrame, root: str, format: str = "json") -> None:
    """Pairs below ``dataset_type=…/rubric=…``, as line JSON or Parquet.

    Every rubric has all texts again, so files of line JSON are compressed by
    gzip, which Spark reads like plain ones. Only the folders of types and rubrics in ``pairs`` are replaced. The
    complete set is the same table read without a filter.
    """
    writer = pairs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if format == "json":
        writer = writer.options(**GZIP)
    writer.partitionBy("dataset_type", "rubric").format(format).save(root)


def read_pairs(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    dataset_type: str | None = None,
    rubric: str | None = None,
    format: str = "json",
) -> DataFrame:
    """Pairs written by :func:`write_pairs`, all or one rubric."""
    df = spark.read.schema(schema).format(format).load(root)
    if dataset_type is not None:
        df = df.where(F.col("dataset_type") == dataset_type)
    return df if rubric is None else df.where(F.col("rubric") == rubric)
