"""Chunk files: back-to-back binary stream items, plain, ``.xz`` or ``.gz``.

The one Python step of the library.  It runs once per corpus, spread over the
files, and its result belongs in a columnar table.
"""

from __future__ import annotations

import gzip
import io
import lzma
import struct
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType,
    DataType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)

from chronorank.schema import DEFAULT, FIELD_ID, STREAM_ITEM

# Type codes of the binary protocol.
STOP, BOOL, BYTE, DOUBLE, I16, I32, I64, STRING, STRUCT, MAP, SET, LIST = (
    0, 2, 3, 4, 6, 8, 10, 11, 12, 13, 14, 15,
)
NUMBERS = {
    BOOL: struct.Struct(">?"),
    BYTE: struct.Struct(">b"),
    DOUBLE: struct.Struct(">d"),
    I16: struct.Struct(">h"),
    I32: struct.Struct(">i"),
    I64: struct.Struct(">q"),
}
SPARK_TO_WIRE = {
    "boolean": BOOL, "double": DOUBLE, "smallint": I16, "int": I32, "bigint": I64,
    "string": STRING, "binary": STRING, "struct": STRUCT, "map": MAP, "array": LIST,
}
BATCH_BYTES = 16 * 1024 * 1024
#: Bytes from which a file is read as a stream instead of as one row.
LARGE_FILE = 128 * 1024 * 1024
#: Bytes that a stream reads at a time.
READ_BYTES = 1024 * 1024


def _take(stream: BinaryIO, size: int) -> bytes:
    if size < 0:
        raise ValueError("negative size")
    data = stream.read(size)
    if len(data) != size:
        raise EOFError("truncated item")
    return data


def _number(stream: BinaryIO, wire: int) -> int | float | bool:
    kind = NUMBERS[wire]
    return kind.unpack(_take(stream, kind.size))[0]


def _wire(kind: DataType) -> int:
    return SPARK_TO_WIRE[kind.typeName() if isinstance(kind, (StructType, MapType, ArrayType)) else kind.simpleString()]


def _value(stream: BinaryIO, wire: int, kind: DataType | None) -> object:
    """Read one value; with ``kind`` None or another wire type it is skipped."""
    if kind is not None and _wire(kind) != wire:
        kind = None
    if wire == STRING:
        data = _take(stream, _number(stream, I32))
        return data.decode("utf-8", "replace") if isinstance(kind, StringType) else data
    if wire == STRUCT:
        return read_record(stream, kind)
    if wire == MAP:
        key_wire, value_wire = _number(stream, BYTE), _number(stream, BYTE)
        key_kind, value_kind = (kind.keyType, kind.valueType) if kind is not None else (None, None)
        size = _number(stream, I32)
        return [
            (_value(stream, key_wire, key_kind), _value(stream, value_wire, value_kind)) for _ in range(size)
        ]
    if wire in (LIST, SET):
        item_wire = _number(stream, BYTE)
        item_kind = kind.elementType if kind is not None else None
        return [_value(stream, item_wire, item_kind) for _ in range(_number(stream, I32))]
    if wire in NUMBERS:
        return _number(stream, wire)
    raise ValueError(f"unknown wire type {wire}")


def read_record(stream: BinaryIO, kind: StructType | None) -> dict | None:
    """Read a record into a fresh dict of the fields in ``kind``; others are skipped."""
    fields = {f.metadata[FIELD_ID]: f for f in kind.fields} if kind is not None else {}
    record = {f.name: f.metadata.get(DEFAULT) for f in fields.values()}
    while (wire := _number(stream, BYTE)) != STOP:
        field = fields.get(_number(stream, I16))
        value = _value(stream, wire, field.dataType if field else None)
        if field and _wire(field.dataType) == wire:
            record[field.name] = value
    return record if kind is not None else None


def _unpacked(path: str, raw: BinaryIO) -> BinaryIO:
    if path.endswith("xz"):
        return io.BufferedReader(lzma.LZMAFile(raw))
    if path.endswith(".gz"):
        return io.BufferedReader(gzip.GzipFile(fileobj=raw))
    return io.BufferedReader(raw)


def _stream(path: str) -> BinaryIO:
    """The bytes of a file, read in steps; the path is one that Spark lists."""
    if path.startswith("file:"):
        system, at = pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, at = pyarrow.fs.FileSystem.from_uri(quote(path, safe=":/@%"))
    return io.BufferedReader(system.open_input_file(at), READ_BYTES)


def decode(path: str, content: BinaryIO, kind: StructType) -> Iterator[tuple[dict, int]]:
    """Items of one file with their decoded size.

    The first unreadable item ends the file, because item borders are not marked;
    it is reported as a row of its own.
    """
    stream = _unpacked(path, content)
    index = 0
    try:
        while stream.peek(1):
            start = stream.tell()
            yield {**read_record(stream, kind), "_corrupt": None, "_index": index}, stream.tell() - start
            index += 1
    except (EOFError, ValueError, OSError, KeyError, RecursionError, lzma.LZMAError, struct.error) as err:
        empty = {f.name: None for f in kind.fields}
        yield {**empty, "_corrupt": f"{type(err).__name__}: {err}", "_index": index}, 0


def read_stream_items(
    spark: SparkSession, path: str, columns: StructType = STREAM_ITEM, large_file: int = LARGE_FILE
) -> DataFrame:
    """Stream items of all files below ``path``.

    ``columns`` is any subset of the item schema; the rest is skipped on the wire.
    Each row carries ``_path``, ``_index`` within the file, and ``_corrupt``,
    which is null for good items.

    Files are packed into tasks by their sizes.  Those below ``large_file`` bytes
    come as rows of Spark's reader.  Larger ones are opened by the task and read
    as a stream, from any store that Arrow's file systems reach, so their size has
    no limit.  Decoded rows leave in small batches: a worker holds one small file
    or a stream's buffer, and one batch.
    """
    schema = StructType(
        [
            *columns.fields,
            StructField("_path", StringType()),
            StructField("_index", IntegerType()),
            StructField("_corrupt", StringType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def items_of(name: str, content: BinaryIO) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for row, size in decode(name, content, columns):
            rows.append({**row, "_path": name})
            held += size
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                yield from items_of(name.as_py(), io.BytesIO(content.as_py()))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with _stream(name) as content:
                    yield from items_of(name, content)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # both filters reach the reader, which opens no file that they exclude
    small = files.where(F.col("length") < large_file).select("path", "content")
    large = files.where(F.col("length") >= large_file).select("path")
    return small.mapInArrow(held, schema).unionAll(large.mapInArrow(streamed, schema))


def good_items(items: DataFrame) -> DataFrame:
    return items.filter("_corrupt IS NULL").drop("_corrupt")


def corrupt_items(items: DataFrame) -> DataFrame:
    return items.filter("_corrupt IS NOT NULL").select("_path", "_index", "_corrupt")
