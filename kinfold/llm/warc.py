"""WARC archives of captures, and their index merged from sorted runs.

Every capture becomes a WARC 1.1 record. Of captures with equal payloads one is a
response and the others are revisits that refer to it. Reading an archive back
gives its part of the index sorted by URL key and time: a run. The runs are dealt
by ranges of that key, and every task merges its slices of all runs with a loser
tree, so the result is the whole capture history in one global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.blocks import bound_batches, to_bytes
from kinfold.session import ensure_checkpoint_dir

RECORDS_PER_FILE = 500
_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = (
    "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, record_offset long, record_length long"
)
_NAMES = [part.split()[0] for part in INDEX.split(", ")]
_KINDS = [{"string": pa.string(), "long": pa.int64()}[part.split()[1]] for part in INDEX.split(", ")]


def url_key(url: str | None) -> str:
    """Sortable form of a URL: host labels reversed, default port, www and fragment dropped, lower case."""
    text = (url or "").strip()
    try:
        parts = urlsplit(text)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return text.lower()
    if not host:
        return text.lower()
    name = ",".join(reversed(host.split(".")))
    where = "" if port in (None, 80, 443) else f":{port}"
    return f"{name}{where}){(parts.path or '/') + ('?' + parts.query if parts.query else '')}".lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, captured, payload: bytes, payload_digest: str, refers_to) -> str:
    """One record without its closing line ends; the payload is UTF-8, so the record is text."""
    revisit = refers_to is not None
    block = b"" if revisit else _HTTP + payload
    # a header value cannot hold line ends
    target = "".join(" " if c in "\r\n" else c for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {captured or ''}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + _END + block.decode()


def write_archives(captures: DataFrame, path: str, *, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for every row of ``page_id, url, html, captured`` to gzip archives.

    Of rows with equal payloads of at least ``min_bytes`` bytes, that with the
    largest ``page_id`` is the response, and rows that repeat its id are too; the
    others revisit it. A null payload is empty. Null ids, URLs and times are left
    blank; if all ids of a payload are null, all are responses. Further columns are
    dropped. An empty table writes no archive.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = captures.select("page_id", "url", "captured", payload.alias("html"), F.sha1(payload.cast("binary")).alias("_sha"))
    groups = rows.where(F.octet_length("html") >= min_bytes).groupBy("_sha").agg(F.count("*").alias("_n"), F.max("page_id").alias("_first"))
    repeated = groups.where("_n > 1").drop("_n")
    joined = rows.join(repeated, "_sha", "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")), F.col("_first"))
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch[c].to_pylist() for c in ("page_id", "url", "captured", "refers_to"))
            records = [
                _record(page, url, when, body, digest(body), refers)
                for page, url, when, refers, body in zip(*columns, to_bytes(batch["html"]))
            ]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.string())], ["value"])

    records = joined.select("page_id", "url", "captured", "refers_to", "html").mapInArrow(build, "value string")
    writer = records.write.option("lineSep", _END).option("maxRecordsPerFile", records_per_file).option("compression", "gzip")
    writer.text(path)


def parse_archive(data: bytes, name: str) -> list[tuple]:
    """Index entries of an archive in its own order; payload lengths and digests are checked against it."""
    entries, at = [], 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        body = head_end + 4
        end = body + int(head["Content-Length"])
        sha, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
        if head["WARC-Type"] == "response":
            payload = data[body + len(_HTTP) : end]
            if len(payload) != size or digest(payload) != sha:
                raise ValueError(f"{name}: payload at byte {at} does not match its digest")
        page = head["WARC-Record-ID"][len("<urn:page:") : -1]
        refers = head.get("WARC-Refers-To", "")[len("<urn:page:") : -1]
        entries.append((
            url_key(head["WARC-Target-URI"]), head["WARC-Date"], int(page) if page else None, head["WARC-Type"],
            int(refers) if refers else None, size, sha, name, at, end + 4 - at,
        ))
        at = end + 4
    return entries


def _order(entry: tuple) -> tuple:
    """URL key, time, page id (null first), then the place in the archives."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[7], entry[8]


class LoserTree:
    """K-way merge: each inner node keeps the loser of its match, the overall winner sits on top.

    After the winner is taken only the matches on its path are played again.
    """

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(run) for run in runs]
        self.size = max(1, len(runs))
        self.heads = [next(run, None) for run in self.runs] or [None]
        self.keys = [None if h is None else _order(h) for h in self.heads]
        self.losers = [-1] * self.size
        self.winner = -1
        for leaf in range(self.size):
            self._play(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int, building: bool = False) -> None:
        node = (leaf + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if building and other < 0:
                self.losers[node] = leaf
                return
            if self._before(other, leaf):
                self.losers[node], leaf = leaf, other
            node //= 2
        self.winner = leaf

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            head = next(self.runs[self.winner], None)
            self.heads[self.winner] = head
            self.keys[self.winner] = None if head is None else _order(head)
            self._play(self.winner)


def _batch(entries: list[tuple], *more: pa.Array, names: tuple[str, ...] = ()) -> pa.RecordBatch:
    columns = list(zip(*entries)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, _KINDS)), *more], [*_NAMES, *names])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under ``path``; the rows of an archive are a sorted run.

    Offsets and lengths count uncompressed bytes.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch["path"].to_pylist(), batch["content"]):
                content = gzip.decompress(data.as_py()) if name.endswith(".gz") else data.as_py()
                yield _batch(sorted(parse_archive(content, name), key=_order))

    return files.mapInArrow(parse, INDEX)


def merge_runs(index: DataFrame) -> DataFrame:
    """The runs merged in global order: ``part`` and ``place`` number the rows.

    Ranges of URL key, time and page id come from a sample; they only even out the
    tasks. A URL captured any number of times is cut by time and id like any other key.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for entry in zip(*(batch[c].to_pylist() for c in _NAMES)):
                runs.setdefault(entry[7], []).append(entry)
        # a shuffle may hand over a run's blocks in another order
        ordered = [run if all(_order(a) <= _order(b) for a, b in zip(run, run[1:])) else sorted(run, key=_order) for run in runs.values()]
        part = TaskContext.get().partitionId()
        merged = list(LoserTree(ordered))
        for start in range(0, len(merged), 5000):
            rows = merged[start : start + 5000]
            numbers = pa.array([part] * len(rows), pa.int32()), pa.array(range(start, start + len(rows)), pa.int64())
            yield _batch(rows, *numbers, names=("part", "place"))

    ranged = index.repartitionByRange("url_key", "captured", F.col("page_id").asc_nulls_first())
    return ranged.mapInArrow(merge, f"{INDEX}, part int, place long")


def capture_history(captures: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder, read them back, and merge their index."""
    spark = captures.sparkSession
    bound_batches(spark)
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(captures, path, min_bytes=min_bytes)
    return merge_runs(read_index(spark, path))
