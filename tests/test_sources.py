from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinfold.operators.encoding import ColorLayout
from kinfold.session import ensure_checkpoint_dir, materialize, spread
from kinfold.sources import images, matrix, tables


def test_csv_round_trip_keeps_quotes_breaks_and_order_of_columns(spark, tmp_path):
    rows = [("a", "1.jpg", 'tas "besar", merah', 7), ("b", "2.jpg", "satu\ndua", 8), ("c", "3.jpg", None, 9)]
    df = spark.createDataFrame(rows, tables.PRODUCT_SCHEMA)
    tables.write_csv(df.select("title", "posting_id", "label_group", "image"), str(tmp_path / "p"))
    back = tables.read_csv(spark, str(tmp_path / "p"), multi_line=True)
    assert back.schema == tables.PRODUCT_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_csv_with_extra_columns_and_without_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text('posting_id,image,image_phash,title,label_group\np,i.jpg,ff,"a ""b"" c",12\n')
    assert tuple(tables.read_csv(spark, str(tmp_path / "x.csv")).first()) == ("p", "i.jpg", 'a "b" c', 12)
    tables.write_csv(spark.createDataFrame([("f1", 0.5)], "k string, v double"), str(tmp_path / "s"), header=False)
    assert [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["f1,0.5"]


def test_embedding_and_assignment_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0], "x")], "posting_id string, embedding array<float>, extra string")
    tables.write_embeddings(df, str(tmp_path / "e"))
    assert tuple(tables.read_embeddings(spark, str(tmp_path / "e")).first()) == ("a", [1.0, 2.0])
    rows = spark.createDataFrame([("a", "train"), ("b", "val")], "posting_id string, split string")
    tables.write_assignments(rows, str(tmp_path / "a"))
    assert (tmp_path / "a" / "split=train").exists()
    grid = spark.createDataFrame([(0.1, "a"), (0.2, "a")], "threshold double, posting_id string")
    tables.write_by_threshold(grid, str(tmp_path / "g"))
    assert (tmp_path / "g" / "threshold=0.2").exists()
    tables.write_json(spark.createDataFrame([(["a b"], 3)], "ngrams array<string>, total_titles long"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"ngrams": ["a b"], "total_titles": 3}


def test_run_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    tables.append_run_log(tables.run_log(spark, "r1", "fit", {"lr": 0.1, "fusion": "none"}), path)
    tables.append_run_log(tables.run_log(spark, "r1", "fit", [(1, "f1", 0.5)]), path)
    summary = spark.createDataFrame([(0.1, 0.4, 0.6)], "threshold double, avg_f1 double, `avg_recall-5` double")
    tables.append_run_log(tables.grid_log(summary, "r2"), path)
    got = {(r["run_id"], r["run_name"], r["step"], r["key"]): r["value"] for r in spark.read.parquet(path).collect()}
    assert got == {
        ("r1", "fit", None, "lr"): "0.1",
        ("r1", "fit", None, "fusion"): "none",
        ("r1", "fit", 1, "f1"): "0.5",
        ("r2", "grid_search/threshold_0.1", None, "threshold"): "0.1",
        ("r2", "grid_search/threshold_0.1", None, "avg_f1"): "0.4",
        ("r2", "grid_search/threshold_0.1", None, "avg_recall-5"): "0.6",
    }


@pytest.mark.parametrize("kind,name", [("<f4", "F32"), ("<f2", "F16"), ("<f8", "F64")])
def test_matrix_import(spark, tmp_path, kind, name):
    values = np.random.default_rng(0).standard_normal((23, 5)).astype(kind)
    other = np.arange(4, dtype="<f4")
    header = json.dumps(
        {
            "__metadata__": {"format": "pt"},
            "other": {"dtype": "F32", "shape": [4], "data_offsets": [0, 16]},
            "embeddings": {"dtype": name, "shape": [23, 5], "data_offsets": [16, 16 + values.nbytes]},
        }
    ).encode()
    path = tmp_path / "m.bin"
    path.write_bytes(struct.pack("<Q", len(header)) + header + other.tobytes() + values.tobytes())
    ids = {str(i): f'id "{i}" \\ é' if i % 2 else f"train_{i}" for i in range(23)}
    (tmp_path / "index.json").write_text(json.dumps(ids, indent=2))
    df = matrix.import_embeddings(spark, str(path), str(tmp_path / "index.json"), rows_per_partition=4)
    got = {r["posting_id"]: r["embedding"] for r in df.collect()}
    assert set(got) == set(ids.values())
    for i in range(23):
        assert got[ids[str(i)]] == pytest.approx(values[i].astype(np.float32), abs=1e-6)
    assert matrix.read_matrix(spark, str(path), rows_per_partition=4).rdd.getNumPartitions() == 6


def png(pixels: np.ndarray) -> bytes:
    height, width, _ = pixels.shape
    raw = b"".join(b"\x00" + pixels[y].tobytes() for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    pictures = {f"{c} x.png": rng.integers(0, 256, (9 + i, 7, 3), dtype=np.uint8) for i, c in enumerate("abc")}
    for name, pixels in pictures.items():
        (tmp_path / name).write_bytes(png(pixels))
    products = spark.createDataFrame([("p1", "a x.png"), ("p2", "b x.png"), ("p3", "a x.png")], "posting_id string, image string")
    got = {r["posting_id"]: r["embedding"] for r in images.encode_image_folder(products, str(tmp_path)).collect()}
    for pid, name in (("p1", "a x.png"), ("p2", "b x.png"), ("p3", "a x.png")):
        want = ColorLayout()([pictures[name]])[0]
        assert got[pid] == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    missing = spark.createDataFrame([("p9", "no.png")], "posting_id string, image string")
    with pytest.raises(Exception, match="no image file no.png"):
        images.encode_image_folder(missing, str(tmp_path)).collect()
    assert images.encode_image_folder(missing, str(tmp_path), strict=False).count() == 0


def test_materialize_and_spread(spark):
    df = spark.range(10).select(F.col("id"), F.rand(3).alias("x"))
    held = materialize(df)
    assert held.schema["x"].dataType == df.schema["x"].dataType
    assert held.inputFiles()[0].replace("file://", "").startswith(ensure_checkpoint_dir(spark).replace("file:", ""))
    assert sorted(held.collect()) == sorted(held.collect())
    assert spread(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    big = spark.range(0, 10**10, 1, 3)
    assert spread(big) is big


def test_line_breaks_in_quotes_and_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('posting_id,image,title,label_group\n1,i,"two\nlines, ""quoted""",5\n2,j,plain,6\n')
    rows = sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "a.csv")).collect()))
    assert rows == [("1", "i", 'two\nlines, "quoted"', 5), ("2", "j", "plain", 6)]
    (tmp_path / "b.csv").write_text("posting_id,image,title,label_group\n1,i,t,not a number\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "b.csv")).collect()


def test_compact_index_and_unmatched_rows(spark, tmp_path):
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps({"0": "a", "1": 'b "q"', "2": "c"}))
    assert {(r["row"], r["posting_id"]) for r in matrix.read_row_index(spark, str(whole)).collect()} == {(0, "a"), (1, 'b "q"'), (2, "c")}
    values = np.ones((2, 3), "<f4")
    head = json.dumps({"embeddings": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, values.nbytes]}}).encode()
    (tmp_path / "m.bin").write_bytes(struct.pack("<Q", len(head)) + head + values.tobytes())
    with pytest.raises(Exception, match="without a vector or an id"):
        matrix.import_embeddings(spark, str(tmp_path / "m.bin"), str(whole)).collect()
    (tmp_path / "bad.json").write_text('{\n"0": "a",\nnonsense\n}')
    with pytest.raises(Exception, match="not an entry"):
        matrix.read_row_index(spark, str(tmp_path / "bad.json")).collect()


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    def session(master, folder=None):
        held = {}
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: held.get("d"), setCheckpointDir=lambda d: held.update(d=d))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("spark://host:7077"))
    assert ensure_checkpoint_dir(session("yarn", "/shared")) == "/shared"
    assert ensure_checkpoint_dir(session("local")) and ensure_checkpoint_dir(session("local[4]"))


def stored_matrix(spark, tmp_path, n=50):
    values = np.random.default_rng(2).standard_normal((n, 3)).astype(np.float32)
    rows = [(f'id "{i:03d}" \\ é', [float(x) for x in values[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "posting_id string, embedding array<float>").repartition(6)
    matrix.write_matrix(df, str(tmp_path / "m"))
    return {r[0]: r[1] for r in rows}


def test_a_written_matrix_comes_back(spark, tmp_path):
    want = stored_matrix(spark, tmp_path)
    for step in (7, 65536):
        df = matrix.import_embeddings(spark, str(tmp_path / "m" / "matrix"), str(tmp_path / "m" / "index"), rows_per_partition=step)
        assert {r["posting_id"]: r["embedding"] for r in df.collect()} == want


def test_only_wanted_ranges_of_a_matrix_are_read(spark, tmp_path):
    """Half of the file is cut off: what is not read cannot fail."""
    values = np.arange(80, dtype="<f4").reshape(40, 2)
    header = json.dumps({"embeddings": {"dtype": "F32", "shape": [40, 2], "data_offsets": [0, values.nbytes]}}).encode()
    path, index = tmp_path / "m.bin", tmp_path / "index.json"
    path.write_bytes(struct.pack("<Q", len(header)) + header + values.tobytes()[: values.nbytes // 2])
    index.write_text(json.dumps({str(i): f"p{i}" for i in range(40)}))
    ids = spark.createDataFrame([("p3",), ("p17",), ("p3",)], "posting_id string")
    df = matrix.import_embeddings(spark, str(path), str(index), rows_per_partition=4, ids=ids)
    assert {r["posting_id"]: r["embedding"] for r in df.collect()} == {"p3": [6.0, 7.0], "p17": [34.0, 35.0]}
    whole = matrix.read_matrix(spark, str(path), rows_per_partition=4)
    for condition, rows in (("row < 6", range(6)), ("row >= 4 and row <= 9", range(4, 10)), ("row = 19", [19]), ("row in (2, 5)", [2, 5]), ("row > 3 and row < 4", [])):
        assert sorted(r["row"] for r in whole.where(condition).collect()) == list(rows)
    reader = matrix.MatrixReader({"path": str(path), "rowsPerPartition": "4"})
    assert len(reader.partitions()) == 10
    list(reader.pushFilters([matrix.GreaterThan(("row",), 7), matrix.LessThanOrEqual(("row",), 12)]))
    assert [(p.start, p.stop) for p in reader.partitions()] == [(8, 12), (12, 16)]
    with pytest.raises(Exception, match="no row for id|unpack|buffer|size"):
        matrix.import_embeddings(spark, str(path), str(index), ids=spark.createDataFrame([("unknown",)], "posting_id string")).collect()


def test_committed_log_parts_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "log")
    settings = tables.run_log(spark, "007", "fit", {"lr": 0.1})
    tables.commit_run_log(settings, path, "settings")
    tables.commit_run_log(tables.run_log(spark, "007", "fit", [(1, "f1", 0.5), (2, "f1", 0.6)]), path, "metrics")
    tables.commit_run_log(tables.run_log(spark, "8", "fit", [(1, "f1", 0.1)]), path, "metrics")
    rows = lambda: sorted(tuple(r) for r in tables.read_run_log(spark, path).select("run_id", "part", "key", "value").collect())
    want = [("007", "metrics", "f1", "0.5"), ("007", "metrics", "f1", "0.6"), ("007", "settings", "lr", "0.1"), ("8", "metrics", "f1", "0.1")]
    assert rows() == want
    tables.commit_run_log(settings, path, "settings")  # the job is run again
    assert rows() == want

    def fails(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("lost")

    broken = tables.run_log(spark, "007", "fit", [(9, "f1", 0.9)]).repartition(2).mapInArrow(fails, tables.RUN_LOG_SCHEMA)
    with pytest.raises(Exception, match="lost"):
        tables.commit_run_log(broken, path, "metrics")
    assert rows() == want
    tables.commit_run_log(tables.run_log(spark, "007", "fit", [(1, "f1", 0.7)]), path, "metrics")
    assert rows() == [("007", "metrics", "f1", "0.7"), *want[2:]]


@pytest.mark.parametrize("size", [128 << 20, 40, 7])
def test_records_with_line_breaks_are_read_in_splits(spark, tmp_path, size):
    """Splits of a few bytes cut quoted fields anywhere; the rows are those Spark reads file by file."""
    texts = ["plain", 'say ""hi""', "two\nlines", "\n\nlead", 'odd ""\n"" pair', "a,b", "", "é\r\nmixed", "end\n"]
    for name in ("one.csv", "two.csv"):
        rows = [f'{name}-{i},{i}.png,"{t}",{i % 3}' for i, t in enumerate(texts * 3)]
        (tmp_path / name).write_bytes(("posting_id,image,title,label_group\n" + "\n".join(rows) + "\n").encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = tables.read_csv(spark, str(tmp_path))
        found = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted(map(tuple, tables.read_csv(spark, str(tmp_path), split=False).collect()), key=str)
    assert sorted(found, key=str) == want and len(want) == 54


def test_a_malformed_record_is_an_error_in_splits_too(spark, tmp_path):
    (tmp_path / "x.csv").write_text("posting_id,image,title,label_group\na,b,c,notanumber\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "x.csv")).collect()
