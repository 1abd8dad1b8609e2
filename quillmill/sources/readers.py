"""Readers of artifacts (survey section A): JSON, JSONL, CSV, journals, wrapped and optional artifacts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

WRAPPERS = ("instances", "samples", "records", "data")
QUESTION_KEYS = ("question", "query", "source_question", "problem", "prompt")
ID_KEYS = ("instance_id", "id", "query_id")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_jsonish(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON or JSONL (A1): one document a file if its text up to the end is one, else one document a line.

    Decided by whether the first line is a whole document and a second line follows, so JSONL whose rows begin
    with a brace is read as JSONL. An empty file has no rows (given a schema).
    """
    first = spark.read.text(path).where(F.trim("value") != "").limit(2).collect()
    lines = len(first) == 2 and first[0]["value"].strip()[:1] == "{" and first[0]["value"].strip()[-1:] == "}"
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path, multiLine=not lines)


def unwrap(df: DataFrame, keys: tuple[str, ...] = WRAPPERS, required: bool = False) -> DataFrame:
    """The rows of the first array of structs among the wrapper's keys (A2, A3), else the rows themselves.

    With ``required`` a wrapper without rows is an error.
    """
    for k in keys:
        if k in df.columns and isinstance(df.schema[k].dataType, ArrayType) and isinstance(df.schema[k].dataType.elementType, StructType):
            return df.select(F.explode(k).alias("row")).select("row.*")
    if required:
        raise ValueError(f"no rows under {', '.join(keys)}")
    return df


def first_of(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of some columns that is there and not blank (A4)."""
    found = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(None).cast("string"))


def gold_of(df: DataFrame, names: tuple[str, ...] = ("gold_skill_ids", "skill_annotations", "skill_ids", "skill_id")) -> Column:
    """Gold ids from the first of some columns, each a list or a single id (A4)."""
    parts = []
    for n in names:
        if n in df.columns:
            c = F.col(n) if isinstance(df.schema[n].dataType, ArrayType) else F.when(F.trim(F.col(n)) != "", F.array(F.col(n)))
            parts.append(F.when(F.size(c) > 0, c))
    return F.coalesce(*parts, F.array().cast("array<string>"))


def benchmark(spark: SparkSession, paths: list[str], normalize) -> DataFrame:
    """(id, question, norm, source) of test files of any layout, blank questions dropped (A5)."""
    out = None
    for p in paths:
        rows = unwrap(read_jsonish(spark, p))
        one = rows.select(first_of(rows, ID_KEYS).alias("id"), first_of(rows, QUESTION_KEYS).alias("question")).where("question is not null").withColumn("source", F.lit(p))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "id string, question string, source string, norm string")
    return out.withColumn("norm", normalize(F.col("question")))


def last_of(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as a corpus read into a dictionary keeps it."""
    row = F.struct(*(c for c in df.columns if c != key))
    return df.groupBy(key).agg(F.max_by(row, order).alias("__row")).select(key, "__row.*").drop(order)


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, every cell as it stands, missing ones null."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_jsonl_strings(spark: SparkSession, path: str) -> DataFrame:
    """JSONL with every value as a string."""
    return spark.read.json(path, primitivesAsString=True)


def read_partitioned(spark: SparkSession, root: str, datasets: list[str] | None = None, pattern: str = r"(\w+)_(\d+)\.json$") -> DataFrame:
    """Artifacts below a folder with (dataset, number) from their file names, other files left out."""
    rows = spark.read.json(root, recursiveFileLookup=True, multiLine=True).withColumn("path", F.col("_metadata.file_path"))
    named = rows.withColumn("dataset", F.regexp_extract("path", pattern, 1)).withColumn("number", F.regexp_extract("path", pattern, 2).try_cast("int"))
    named = named.where((F.col("dataset") != "") & ~F.contains("path", F.lit("/tasks/")))
    return named if datasets is None else named.where(F.col("dataset").isin(datasets))


def read_journal(spark: SparkSession, path: str, schema: str, tag: str | None = None) -> DataFrame:
    """Lines of an append-only journal with their number.

    A last line that is no document is a write cut short and left out; one before it is an error, raised when the
    rows are used. With a ``tag`` rows of another schema tag are an error as well.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    marked = parsed.join(F.broadcast(last), "file")  # one row a file
    bad = F.col("row._bad").isNotNull()
    if tag is not None:
        bad = bad | (F.coalesce(F.col("row.schema"), F.lit("")) != tag)
    kept = marked.where(~(bad & (F.col("line") == F.col("last"))))
    checked = kept.withColumn("row", F.when(bad, F.raise_error(F.concat(F.lit("corrupt journal line: "), "value")).cast(kept.schema["row"].dataType)).otherwise(F.col("row")))
    return checked.select("line", "row.*").drop("_bad")


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL in which every line that isn't blank must be a document."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact, or no rows of its schema where the path doesn't exist."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        raise ValueError(f"{path} can't be read") from e


def read_checked(spark: SparkSession, path: str, schema: str, tag: str, key: str) -> DataFrame:
    """A canonical artifact: schema tag as expected, ids there and unique (A13, A14); raises otherwise."""
    df = spark.read.schema(schema).json(path, multiLine=True)
    if df.where(F.coalesce("schema", F.lit("")) != tag).limit(1).count():
        raise ValueError(f"{path} is no {tag}")
    rows = unwrap(df, tuple(c for c in df.columns if c != "schema"))
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).isEmpty():
        raise ValueError(f"{path} has missing or repeated ids")
    return rows
