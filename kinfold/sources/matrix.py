"""Import of an embedding matrix file and its row index into an embedding table.

A file starts with the length of a JSON header (8 bytes, little-endian), then the
header with type, shape and byte range of each named matrix, then the raw rows.
Row positions are computable, so each partition reads just its byte range, and a
partition none of whose rows is wanted is not read at all. A folder of such files is
one matrix, its rows counted on in the order of the file names.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from kinfold.operators.ranking import rank_by_order
from kinfold.session import materialize

# The type names of the format and the numpy types they stand for.
_TYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2"}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    if path.startswith("file:"):
        path = urllib.parse.unquote(urllib.parse.urlparse(path).path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str):
    system, inner = file_system(path)
    return system.open_input_file(inner)


def _files(path: str) -> list[str]:
    """The files of a matrix in the order of their names; hidden ones are passed over."""
    system, inner = file_system(path)
    if system.get_file_info(inner).type != fs.FileType.Directory:
        return [path]
    found = system.get_file_info(fs.FileSelector(inner))
    names = sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{name}" for name in names]


def read_header(path: str, key: str) -> tuple[np.dtype, int, int, int]:
    """Element type, rows, columns and first byte of the matrix called ``key``."""
    with _open(path) as file:
        length = int.from_bytes(file.read(8), "little")
        entry = json.loads(file.read(length))[key]
    if entry["dtype"] not in _TYPES:
        raise ValueError(f"unsupported element type {entry['dtype']}")
    rows, columns = entry["shape"]
    return np.dtype(_TYPES[entry["dtype"]]), rows, columns, 8 + length + entry["data_offsets"][0]


class RowRange(InputPartition):
    """Rows ``start`` to ``stop`` of a file whose first row is row ``base`` of the matrix."""

    def __init__(self, path: str, layout: tuple, base: int, start: int, stop: int) -> None:
        self.path, self.layout, self.base, self.start, self.stop = path, layout, base, start, stop


class MatrixReader(DataSourceReader):
    """Takes comparisons of ``row`` with constants as filters, and the option ``wanted``: partitions by number."""

    def __init__(self, options: dict) -> None:
        self.path, self.key = options["path"], options.get("key", "embeddings")
        self.step = int(options.get("rowsPerPartition", 65536))
        self.low, self.high = 0, None
        wanted = options.get("wanted")
        self.wanted = None if wanted is None else {int(x) for x in wanted.split(",") if x}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the rows to read; every filter is still applied, as a partition may hold more rows."""
        for f in filters:
            if getattr(f, "attribute", None) == ("row",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, int(f.value) + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    stop = int(f.value) + (not isinstance(f, LessThan))
                    self.high = stop if self.high is None else min(self.high, stop)
                if isinstance(f, In) and f.value:
                    self.low = max(self.low, min(f.value))
                    self.high = max(f.value) + 1 if self.high is None else min(self.high, max(f.value) + 1)
            yield f

    def partitions(self) -> list[RowRange]:
        """Ranges of whole steps of the matrix, cut at file borders, that can hold a wanted row."""
        found, base = [], 0
        for path in _files(self.path):
            layout = read_header(path, self.key)
            rows, at = layout[1], 0
            while at < rows:
                number = (base + at) // self.step
                stop = min(rows, (number + 1) * self.step - base)
                inside = base + stop > self.low and (self.high is None or base + at < self.high)
                if inside and (self.wanted is None or number in self.wanted):
                    found.append(RowRange(path, layout, base, at, stop))
                at = stop
            base += rows
        return found or [RowRange(self.path, (np.dtype("<f4"), 0, 0, 0), 0, 0, 0)]  # one that reads nothing

    def read(self, part: RowRange) -> Iterator[pa.RecordBatch]:
        kind, _, columns, offset = part.layout
        width = columns * kind.itemsize
        if part.start == part.stop:
            return
        with _open(part.path) as file:
            for start in range(part.start, part.stop, 4096):
                n = min(4096, part.stop - start)
                file.seek(offset + start * width)
                values = np.frombuffer(file.read(n * width), dtype=kind).astype(np.float32)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * columns)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(part.base + start, part.base + start + n, dtype=np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(values)),
                    ],
                    names=["row", "embedding"],
                )


class MatrixSource(DataSource):
    """``spark.read.format("embedding_matrix").load(path)`` gives ``row, embedding``."""

    @classmethod
    def name(cls) -> str:
        return "embedding_matrix"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)


def read_matrix(
    spark: SparkSession, path: str, *, rows_per_partition: int = 65536, wanted: Iterable[int] | None = None
) -> DataFrame:
    """``row, embedding`` of a matrix file or folder.

    Filters on ``row`` skip the partitions they rule out; ``wanted`` names the
    partitions (``row div rows_per_partition``) that are read at all.
    """
    spark.dataSource.register(MatrixSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(MatrixSource.name()).option("rowsPerPartition", rows_per_partition)
    if wanted is not None:
        reader = reader.option("wanted", ",".join(str(int(x)) for x in wanted))
    return reader.load(path)


def write_matrix(rows: DataFrame, path: str, *, id_col: str = "posting_id", vec_col: str = "embedding") -> None:
    """Write vectors as a matrix folder ``path/matrix`` and its row index ``path/index``.

    Rows are put in order of the id by a range sort; each task writes one file and its
    part of the index. Vectors must be of one length and not null.
    """
    ordered = rows.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<float>").alias("vec"))
    placed = rank_by_order(ordered, F.col("id"), name="row").withColumn("row", F.col("row") - 1)
    placed = materialize(placed)
    system, inner = file_system(path)
    system.create_dir(f"{inner}/matrix", recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, first, width = [], None, 0
        for batch in batches:
            if batch.num_rows:
                first = batch["row"][0].as_py() if first is None else first
                flat = batch["vec"].flatten().to_numpy(zero_copy_only=False).astype("<f4")
                width = len(flat) // batch.num_rows
                if len(flat) != width * batch.num_rows:
                    raise ValueError("vectors of a matrix have one length")
                parts.append(flat)
        if first is None:
            return
        data = b"".join(p.tobytes() for p in parts)
        entry = {"dtype": "F32", "shape": [len(data) // (4 * width), width], "data_offsets": [0, len(data)]}
        header = json.dumps({"embeddings": entry}).encode()
        to, folder = file_system(path)
        # written whole under a name of its own, so a task that runs again replaces its file
        with to.open_output_stream(f"{folder}/matrix/rows-{first:015d}") as file:
            file.write(len(header).to_bytes(8, "little") + header + data)
        yield pa.RecordBatch.from_arrays([pa.array([first])], ["first"])

    placed.select("row", "vec").repartitionByRange("row").sortWithinPartitions("row").mapInArrow(save, "first long").count()
    entry = F.concat(F.lit('"'), F.col("row"), F.lit('": '), F.to_json(F.struct(F.col("id").cast("string").alias("i"))))
    # the id as JSON text, taken out of a one-field object
    entry = F.regexp_replace(entry, r'": \{"i":(.*)\}$', '": $1')
    placed.select(entry.alias("value")).write.text(f"{path}/index")


def read_row_index(spark: SparkSession, path: str) -> DataFrame:
    """``row, posting_id`` from a JSON map, with one entry per line or all on one line.

    A line that is no entry, brace or whole map is an error.
    """
    entry = r'^\s*"(\d+)"\s*:\s*("(?:[^"\\]|\\.)*"|[^,\s]+)\s*,?\s*$'
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[{}]?\s*$"))
    compact = F.from_json(F.when(F.col("value").rlike(r"^\s*\{.*\}\s*$"), F.col("value")), "map<string,string>")
    whole = text.select(F.explode(compact).alias("row", "posting_id")).withColumn("row", F.col("row").cast("long"))
    lines = text.where(compact.isNull()).withColumn(
        "value",
        F.when(F.col("value").rlike(entry), F.col("value")).otherwise(
            F.raise_error(F.concat(F.lit("not an entry of a row index: "), F.col("value")))
        ),
    )
    quoted = F.regexp_extract("value", entry, 2)
    # A one-element JSON list decodes the escapes of a quoted id.
    decoded = F.get(F.from_json(F.concat(F.lit("["), quoted, F.lit("]")), "array<string>"), F.lit(0))
    single = lines.select(
        F.regexp_extract("value", entry, 1).cast("long").alias("row"), decoded.alias("posting_id")
    )
    return single.unionByName(whole)


def import_embeddings(
    spark: SparkSession,
    matrix_path: str,
    index_path: str,
    *,
    rows_per_partition: int = 65536,
    ids: DataFrame | None = None,
    id_col: str = "posting_id",
) -> DataFrame:
    """``posting_id, embedding`` from a matrix and its row index.

    A vector without an id, or an id without a vector, is an error. With ``ids`` only
    their vectors are imported: partitions without any of their rows are not read, and
    an id that the index does not know is an error.
    """
    index = read_row_index(spark, index_path)
    wanted = None
    if ids is not None:
        asked = ids.select(F.col(id_col).cast("string").alias("posting_id")).distinct().withColumn("_a", F.lit(1))
        index = index.join(asked, "posting_id", "right")
        unknown = F.raise_error(F.concat(F.lit("no row for id "), F.col("posting_id")))
        index = materialize(index.select(F.coalesce("row", unknown.cast("long")).alias("row"), "posting_id"))
        parts = index.select(F.floor(F.col("row") / rows_per_partition).alias("part")).distinct()
        wanted = [r["part"] for r in parts.collect()]  # one number for each partition of the matrix
    vectors = read_matrix(spark, matrix_path, rows_per_partition=rows_per_partition, wanted=wanted)
    how = "full" if ids is None else "right"
    both = vectors.withColumn("_v", F.lit(1)).join(index.withColumn("_i", F.lit(1)), "row", how)
    complete = F.col("_v").isNotNull() & F.col("_i").isNotNull()
    problem = F.concat(F.lit("row without a vector or an id: "), F.col("row").cast("string"))
    checked = F.when(complete, F.col("posting_id")).otherwise(F.raise_error(problem))
    return both.select(checked.alias("posting_id"), "embedding")
