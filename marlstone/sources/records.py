"""Sources and sinks of records: JSON arrays (text, bytes, files, gzip'd or not), JSON lines, Parquet."""

from __future__ import annotations

import base64
import gzip
import json
import re
from collections.abc import Iterable
from dataclasses import replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import ROW_ID, Dataset, json_rows

RECORD, RAW = "rec", "raw"


class SourceError(ValueError):
    """Input that isn't what it should be."""


def _allow_repeated_keys(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last one wins


def _dataset(df: DataFrame, **options) -> Dataset:
    return Dataset(df, RECORD, RAW, **options)


def from_json_array(spark: SparkSession, text: str, **options) -> Dataset:
    """Records of a JSON array held by the driver; each keeps its spelling and its place in the array."""
    return from_items(spark, _spellings(text), **options)


_BLANK = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()


def _spellings(text: str) -> list[str]:
    """Source text of each element of a JSON array, read once."""
    skip = lambda at: _BLANK.match(text, at).end()
    out: list[str] = []
    at = skip(0)
    if text[at : at + 1] != "[":
        try:
            _DECODER.raw_decode(text, at)
        except json.JSONDecodeError as e:
            raise SourceError(f"Invalid JSON: {e}") from None
        raise SourceError("Invalid JSON: an array is expected")
    at = skip(at + 1)
    if text[at : at + 1] == "]":
        at = skip(at + 1)
    else:
        mark = ","
        while mark == ",":
            try:
                _, end = _DECODER.raw_decode(text, at)
            except json.JSONDecodeError as e:
                raise SourceError(f"Invalid JSON: {e}") from None
            out.append(text[at:end])
            at = skip(end)
            mark = text[at : at + 1]
            at = skip(at + 1)
        if mark != "]":
            raise SourceError(f"Invalid JSON: a comma or the end of the array is expected at {end}")
    if at < len(text):
        raise SourceError(f"Invalid JSON: more after the array, at {at}")
    return out


def from_items(spark: SparkSession, texts: Iterable[str], **options) -> Dataset:
    """Records of JSON texts, one each."""
    _allow_repeated_keys(spark)
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"{ROW_ID} long, {RAW} string")
    return _dataset(rows.withColumn(RECORD, F.parse_json(RAW)), **options)


def from_objects(spark: SparkSession, items: Iterable, **options) -> Dataset:
    """Records of Python objects."""
    return from_items(spark, [json.dumps(x, ensure_ascii=False) for x in items], **options)


def from_bytes(spark: SparkSession, data: bytes, **options) -> Dataset:
    """Records of a JSON array in UTF-8."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError as e:
        raise SourceError(f"Invalid UTF-8: {e}") from None
    return from_json_array(spark, text, **options)


def from_gzip(spark: SparkSession, data: bytes, **options) -> Dataset:
    return from_bytes(spark, gzip_decompress_bytes(data), **options)


def read_json_array(spark: SparkSession, path: str, **options) -> Dataset:
    """Records of files that hold a JSON array each (``.json`` or ``.json.gz``). A file is one task's, so use JSON lines for large data."""
    _allow_repeated_keys(spark)
    items = spark.read.text(path, wholetext=True).mapInArrow(_elements, f"{ROW_ID} long, {RAW} string")
    return _dataset(items.withColumn(RECORD, F.parse_json(RAW)), **options)


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Elements of JSON arrays as they are spelled; numbered from 0 in the first task, the files of a task one after the other."""
    number = TaskContext.get().partitionId() << 40
    for batch in batches:
        for text in batch.column(0):
            parts = _spellings(text.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(parts)), pa.int64()), pa.array(parts, pa.string())], [ROW_ID, RAW])
            number += len(parts)


def read_json_lines(spark: SparkSession, path: str, **options) -> Dataset:
    """Records of JSON lines, which are split over tasks; numbered in the order of the scan."""
    _allow_repeated_keys(spark)
    lines = spark.read.text(path).where(F.trim("value") != "").withColumnRenamed("value", RAW)
    return _dataset(lines.withColumn(ROW_ID, F.monotonically_increasing_id()).withColumn(RECORD, F.parse_json(RAW)), **options)


def read_parquet(spark: SparkSession, path: str, json_columns: Iterable[str] = (), **options) -> Dataset:
    """Typed records; columns of JSON text may be read as VARIANT."""
    df = spark.read.parquet(path)
    for c in json_columns:
        df = df.withColumn(c, F.parse_json(c))
    return Dataset(df, **options)


def write_parquet(data: Dataset, path: str) -> Dataset:
    """Records as Parquet with their VARIANT columns, parsed once for all queries; returns the dataset that reads them."""
    data.df.write.parquet(path)
    return replace(data, df=data.df.sparkSession.read.schema(data.df.schema).parquet(path))


def to_json_array(data: Dataset, df: DataFrame) -> str:
    """All rows as one JSON array; for results that a driver holds."""
    rows = json_rows(data, df)
    return "[" + ",".join(r["json"] for r in rows.select("json").toLocalIterator()) + "]"


def write_json(data: Dataset, df: DataFrame, path: str, compression: str | None = None) -> None:
    """Rows as JSON lines, gzip'd if so wanted."""
    writer = json_rows(data, df).select(F.col("json").alias("value")).write
    (writer.option("compression", compression) if compression else writer).text(path)


# gzip codec


def gzip_compress(text: str) -> str:
    """gzip of UTF-8, as base64."""
    return base64.b64encode(gzip_compress_bytes(text.encode())).decode()


def gzip_decompress(text: str) -> str:
    try:
        packed = base64.b64decode(text, validate=True)
    except ValueError as e:
        raise SourceError(f"Invalid base64: {e}") from None
    try:
        return gzip_decompress_bytes(packed).decode("utf-8")
    except UnicodeDecodeError as e:
        raise SourceError(f"Invalid UTF-8: {e}") from None


def gzip_compress_bytes(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


def gzip_decompress_bytes(data: bytes) -> bytes:
    try:
        return gzip.decompress(data)
    except (OSError, EOFError) as e:
        raise SourceError(f"Invalid gzip: {e}") from None


def gzip_column(column: Column) -> Column:
    """Each text as base64 of its gzip."""

    @F.pandas_udf("string")
    def pack(texts):
        return texts.map(lambda s: None if s is None else gzip_compress(s))

    return pack(column)


def gunzip_column(column: Column) -> Column:
    @F.pandas_udf("string")
    def unpack(texts):
        return texts.map(lambda s: None if s is None else gzip_decompress(s))

    return unpack(column)
