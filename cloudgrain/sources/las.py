"""Scan files (LAS 1.2, point formats 0-3) as a Spark source and sink.

Reading: Spark lists the files (its ``binaryFile`` source with the content
column pruned, so nothing is read yet), every file is cut into record ranges,
and the ranges are decoded in tasks, straight from bytes to Arrow. A huge file
is many ranges, so no file has to fit one task.

Writing: one file per tile, or a folder of files for a tile above
``points_per_file``; a task buffers at most one file. Files get their final
name only when the job commits.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, WriterCommitMessage,
)

from ..operators.ranking import join_on, with_range
from ..schemas import COORD_SCALE, POINT
from ..storage import settle

# LAS 1.2 header layout (byte offsets) and the 20 bytes all point formats share.
MAGIC = b"LASF"
HEADER_BYTES = 227
RECORD_BYTES = 20
RUN = 1000  # records that move together into a file: 20 kB
AT_HEADER_SIZE, AT_FIRST_POINT, AT_FORMAT, AT_RECORD_SIZE, AT_COUNT = 94, 96, 104, 105, 107
AT_SCALE, AT_OFFSET = 131, 155
RECORD = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("cls", "u1"),
          ("angle", "i1"), ("user", "u1"), ("source", "<u2")]
SHIFTS = (0, 2)  # some writers pad two text fields by one byte each; everything after them sits 2 bytes later

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
RANGE = "path string, length long, tile_name string, first long, n long"


@dataclass(frozen=True)
class Header:
    first_point: int
    record_bytes: int
    count: int
    scale: tuple
    offset: tuple


def parse_header(head: bytes, file_bytes: int) -> Header:
    """Header in the layout whose point records end exactly at the end of the file."""
    if head[:4] != MAGIC:
        raise ValueError("not a LAS file")
    for shift in SHIFTS:
        if len(head) < AT_OFFSET + shift + 24:
            continue
        first = struct.unpack_from("<I", head, AT_FIRST_POINT + shift)[0] + shift
        fmt, size = struct.unpack_from("<BH", head, AT_FORMAT + shift)
        count = struct.unpack_from("<I", head, AT_COUNT + shift)[0]
        if fmt <= 3 and size >= RECORD_BYTES and first + count * size == file_bytes:
            return Header(first, size, count, struct.unpack_from("<3d", head, AT_SCALE + shift),
                          struct.unpack_from("<3d", head, AT_OFFSET + shift))
    raise ValueError("header and file size disagree")


def _open(path: str):
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path) if url.scheme else path, "rb")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def _schema(mode: str, record_no: bool) -> T.StructType:
    fields = [T.StructField(f.name, f.dataType, True) for f in POINT.fields]
    if record_no:
        fields.append(T.StructField("record_no", T.LongType()))
    if mode == "PERMISSIVE":
        fields.append(T.StructField("_corrupt", T.StringType()))
    return T.StructType(fields)


_ARROW = {T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.LongType(): pa.int64()}


def _batch(schema: T.StructType, values: dict, n: int) -> pa.RecordBatch:
    kinds = [_ARROW[f.dataType] for f in schema.fields]
    cols = [pa.array(values[f.name], k) if f.name in values else pa.nulls(n, k) for f, k in zip(schema.fields, kinds)]
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema([pa.field(f.name, k) for f, k in zip(schema.fields, kinds)]))


def decode_range(
    path: str, length: int, tile: str, first: int, n: int, mode: str = "FAILFAST", record_no: bool = False, rows: int = 65_536,
) -> Iterator[pa.RecordBatch]:
    """Points ``first .. first+n`` of one file as Arrow batches."""
    schema = _schema(mode, record_no)
    with _open(path) as f:
        try:
            h = parse_header(f.read(HEADER_BYTES + max(SHIFTS)), length)
        except ValueError as bad:
            if mode == "FAILFAST":
                raise ValueError(f"{path}: {bad}") from None
            if mode == "PERMISSIVE" and first == 0:
                yield _batch(schema, {"tile_name": [tile], "_corrupt": [f"{path}: {bad}"]}, 1)
            return
        kind = np.dtype(RECORD + ([("rest", f"V{h.record_bytes - RECORD_BYTES}")] if h.record_bytes > RECORD_BYTES else []))
        at, end = first, min(first + n, h.count)
        if at < end:
            f.seek(h.first_point + at * h.record_bytes)
        while at < end:
            m = min(rows, end - at)
            r = np.frombuffer(f.read(m * h.record_bytes), kind)
            if len(r) < m:
                raise OSError(f"{path}: file ended early")
            values = {c: r[c] * h.scale[i] + h.offset[i] for i, c in enumerate("xyz")}
            values |= {"intensity": r["intensity"].astype("i4"), "classification": r["cls"].astype("i4"),
                       "tile_name": pa.array([tile]).take(pa.array(np.zeros(m, "i4")))}
            if record_no:
                values["record_no"] = np.arange(at, at + m, dtype="i8")
            yield _batch(schema, values, m)
            at += m


def tile_of(path):
    """Tile of a file: its name, or its folder's when the tile is a folder of files."""
    parent, name = F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1)
    return F.when(parent.endswith(".las"), parent).otherwise(name)


def with_ranges(files: DataFrame, records_per_range: int) -> DataFrame:
    """One row per (file, record range); the count comes from the file size, no file is opened."""
    most = F.greatest(F.floor((F.col("length") - HEADER_BYTES) / RECORD_BYTES), F.lit(1))
    starts = F.sequence(F.lit(0).cast("long"), most - 1, F.lit(records_per_range).cast("long"))
    return files.select("path", "length", tile_of(F.col("path")).alias("tile_name"), F.explode(starts).alias("first"),
                        F.lit(records_per_range).cast("long").alias("n"))


def decode_files(
    files: DataFrame, mode: str = "FAILFAST", records_per_range: int = 2_000_000, record_no: bool = False, partitions: int | None = None,
) -> DataFrame:
    """Decode listed files ``(path, length)``, batch or streaming."""
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = with_ranges(files, records_per_range).repartition(n, "path", "first")  # tiny rows: only names move

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from decode_range(r["path"], r["length"], r["tile_name"], r["first"], r["n"], mode, record_no)

    return spread.mapInArrow(decode, _schema(mode, record_no))


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "*.las").option("recursiveFileLookup", "true")
            .load(path).select("path", "length"))


def read_las(
    spark: SparkSession, path: str, mode: str = "FAILFAST", records_per_range: int = 2_000_000, record_no: bool = False,
    partitions: int | None = None, tiles: list[str] | None = None,
) -> DataFrame:
    """All points of all ``.las`` files below ``path``.

    ``mode``: FAILFAST fails on a bad file, DROPMALFORMED skips it, PERMISSIVE
    gives one row with its ``_corrupt`` text. Files of no bytes are passed over, as
    in every Spark file source. ``tiles`` drops other files before
    they are opened.
    """
    files = list_files(spark, path)
    if tiles is not None:
        files = files.where(tile_of(F.col("path")).isin(*tiles))
    return decode_files(files, mode, records_per_range, record_no, partitions)


_RUNS = pa.schema([
    ("tile_name", pa.string()), ("_p", pa.int32()), ("run", pa.int32()), ("n", pa.int64()),
    ("off_x", pa.float64()), ("off_y", pa.float64()), ("records", pa.binary()), ("box", pa.list_(pa.float64())),
])


def _runs(laid: DataFrame, order: list[str], scale: float) -> DataFrame:
    """The records of each (range ``_p``, tile) in order, in runs of at most ``RUN`` as they will lie in a file, with their bounding boxes."""
    by = [c for c in order if c != "tile_name"]

    def encode(table: pa.Table) -> pa.Table:
        if by:
            table = table.take(pa.array(np.lexsort([table.column(c).to_numpy() for c in reversed(by)])))
        off_x, off_y = (table.column(c)[0].as_py() for c in ("off_x", "off_y"))
        rows = []
        for k, at in enumerate(range(0, table.num_rows, RUN)):
            rec, box = _records(table.slice(at, RUN), scale, (off_x, off_y, 0.0))
            rows.append((k, len(rec), rec.tobytes(), box))
        run, n, records, boxes = zip(*rows)
        same = pa.array(np.zeros(len(rows), "i4"))
        columns = {"run": run, "n": n, "records": records, "box": boxes}
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else table.column(f.name).take(same) for f in _RUNS], schema=_RUNS)

    kinds = "tile_name string, _p int, run int, n long, off_x double, off_y double, records binary, box array<double>"
    return laid.groupBy("_p", "tile_name").applyInArrow(encode, kinds)


def save_las(
    df: DataFrame, path: str, points_per_file: int = 5_000_000, scale: float = COORD_SCALE, mode: str = "overwrite",
    order: tuple[str, ...] = ("x", "y", "z", "intensity", "classification"),
) -> None:
    """Write the six point columns as one folder of files per tile.

    Records follow ``order``; every file holds ``points_per_file`` of them (the last the
    rest) and is written by a task of its own, whatever the size of the tile. All files of a
    tile have one offset, a whole number of metres, so splitting a tile changes no
    coordinate. Values that the format cannot hold are an error.
    """
    df = df.select(*POINT.fieldNames())
    offsets = settle(df.groupBy("tile_name").agg(F.floor(F.avg("x")).cast("double").alias("off_x"), F.floor(F.avg("y")).cast("double").alias("off_y")))
    # Points move once, to their range of the order, and become runs of records there; only runs are written, ranked and moved again.
    runs = settle(_runs(join_on(with_range(df, ["tile_name"], list(order)), offsets, ["tile_name"]), list(order), scale))
    before = W.partitionBy("tile_name").orderBy("_p", "run").rowsBetween(W.unboundedPreceding, -1)
    placed = settle(runs.select("tile_name", "_p", "run", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    # A run over the end of a file is cut there.
    part = F.explode(F.sequence(F.floor(F.col("first") / points_per_file), F.floor((F.col("first") + F.col("n") - 1) / points_per_file))).alias("part")
    pieces = join_on(runs.drop("n"), placed, ["tile_name", "_p", "run"]).select("*", part)
    skip = F.greatest(F.col("part") * points_per_file - F.col("first"), F.lit(0))
    size = F.least((F.col("part") + 1) * points_per_file - F.col("first"), F.col("n")) - skip
    pieces = pieces.select(
        "tile_name", F.col("part").cast("int"), (F.col("first") + skip).alias("first"), "off_x", "off_y",
        F.substring("records", (skip * RECORD_BYTES + 1).cast("int"), (size * RECORD_BYTES).cast("int")).alias("records"), F.when(size == F.col("n"), F.col("box")).alias("box"))
    df = pieces.repartition("tile_name", "part").sortWithinPartitions("tile_name", "part", "first").drop("first")
    register(df.sparkSession)
    df.write.format("las").option("path", path).option("scale", str(scale)).mode(mode).save()


def register(spark: SparkSession) -> None:
    """Make ``format("las")`` known to a session and let it see filters on ``tile_name``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LasDataSource)


@dataclass
class _Range(InputPartition):
    path: str
    length: int
    tile: str
    first: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.mode = options.get("mode", "FAILFAST").upper()
        self.record_no = options.get("recordno", "false").lower() == "true"
        self.step = int(options.get("recordsperpartition", "2000000"))
        self.tile = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tile_name",):
                self.tile = f.value
            yield f  # rows are still checked by Spark

    def partitions(self) -> list[_Range]:
        return [r for info, tile in _scan_files(self.path) if self.tile in (None, tile) for r in _ranges(info, tile, self.step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from decode_range(partition.path, partition.length, partition.tile, partition.first, partition.n, self.mode, self.record_no)


def _scan_files(path: str) -> Iterator[tuple]:
    """(file, tile) of every scan file that has bytes; files still being written lie in folders of another name."""
    fs, root = _filesystem(path)
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.is_file and info.size and info.path.endswith(".las"):
            parent, name = info.path.split("/")[-2:]
            yield info, parent if parent.endswith(".las") else name


def _ranges(info, tile: str, step: int) -> list[_Range]:
    most = max((info.size - HEADER_BYTES) // RECORD_BYTES, 1)
    return [_Range(info.path, info.size, tile, a, step) for a in range(0, most, step)]


class _StreamReader(DataSourceStreamReader):
    """Scan files as a stream: an offset is the (modification time, path) up to which files were read.

    A file counts as new when it sorts after the offset; a file that shows up with an earlier modification time than
    one already read is passed over, so files should get their final names by a move or an upload, which set the time.
    """

    def __init__(self, options: dict):
        self.batch = _Reader(options)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def _new(self, after: dict) -> list:
        found = sorted(((int(info.mtime_ns or 0), info.path, info, tile) for info, tile in _scan_files(self.batch.path)), key=lambda f: f[:2])
        return [f for f in found if f[:2] > (after["time"], after["path"])]

    def latestOffset(self) -> dict:
        every = self._new(self.initialOffset())
        return {"time": every[-1][0], "path": every[-1][1]} if every else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return [r for at, path, info, tile in self._new(start) if (at, path) <= (end["time"], end["path"]) for r in _ranges(info, tile, self.batch.step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        yield from self.batch.read(partition)

    def commit(self, end: dict) -> None:
        pass  # the checkpoint holds the offset


def _filesystem(path: str):
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(url.path) if url.scheme else os.path.abspath(path)
    return pafs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.scale = float(options.get("scale", COORD_SCALE))
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/{self.job}", recursive=True)
        done, held, key, offset = [], [], None, None

        def flush():
            if not held:
                return
            name = key[0] if key[1] < 0 else f"{key[0]}/part-{key[1]:05d}.las"
            draft = f"{root}/{self.job}/{uuid.uuid4().hex}"
            with fs.open_output_stream(draft) as out:
                if isinstance(held[0], pa.RecordBatch):
                    out.write(encode_tile(pa.Table.from_batches(held), self.scale))
                else:
                    boxes = [box for _, box in held]
                    out.write(_head(sum(map(len, (rec for rec, _ in held))), self.scale, offset, [(max if i % 2 == 0 else min)(b[i] for b in boxes) for i in range(6)]))
                    for rec, _ in held:
                        out.write(rec.tobytes())
            done.append((draft, name))
            held.clear()

        for batch in iterator:
            tiles = batch.column("tile_name")
            given = {"off_x", "off_y"} <= set(batch.schema.names)
            parts = batch.column("part") if "part" in batch.schema.names else pa.array([-1] * batch.num_rows, pa.int32())
            codes = np.asarray(tiles.dictionary_encode().indices).astype("i8") * (1 << 32) + np.asarray(parts).astype("i8")
            edges = np.flatnonzero(np.diff(codes)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                here = (tiles[int(a)].as_py(), parts[int(a)].as_py())
                if here != key:
                    flush()
                    key = here
                    offset = (batch.column("off_x")[int(a)].as_py(), batch.column("off_y")[int(a)].as_py(), 0.0) if given else None
                part = batch.slice(int(a), int(b - a))
                if "records" in batch.schema.names:
                    held.extend(_held(*run, self.scale, offset) for run in zip(part.column("records").to_pylist(), part.column("box").to_pylist()))
                    continue
                # With a given offset, what is held of a file is its 20 bytes a record.
                held.append(_records(pa.Table.from_batches([part]), self.scale, offset) if given else part)
        flush()
        return _Written(done)

    def commit(self, messages: list[_Written]) -> None:
        fs, root = _filesystem(self.path)
        placed = set()
        for message in messages:
            for draft, name in (message.files if message else []):
                target = f"{root}/{name}"
                if target in placed:
                    raise ValueError(f"{name} came from two tasks: repartition by tile_name first")
                fs.create_dir(os.path.dirname(target), recursive=True)
                fs.move(draft, target)
                placed.add(target)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
                if info.is_file and info.path.endswith(".las") and info.path not in placed:
                    fs.delete_file(info.path)
            kept = {os.path.dirname(p) for p in placed}
            for info in fs.get_file_info(pafs.FileSelector(root)):
                if not info.is_file and info.path.endswith(".las") and info.path not in kept:
                    fs.delete_dir(info.path)
        self._drop_drafts(fs, root)

    def abort(self, messages: list[_Written]) -> None:
        self._drop_drafts(*_filesystem(self.path))

    def _drop_drafts(self, fs, root) -> None:
        if fs.get_file_info(f"{root}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.job}")


def spoil(path: str, name: str, n_bytes: int) -> None:
    """Put a damaged file beside the scan files: the first bytes of one of them, or of none, and then something else. For checks."""
    fs, root = _filesystem(path)
    info = next(i for i, _ in _scan_files(path))
    with fs.open_input_file(info.path) as f:
        head = f.read(n_bytes)
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(head + b"damaged")


def encode_tile(table: pa.Table, scale: float = COORD_SCALE, offset: tuple[float, float] | None = None) -> bytes:
    """One scan file in the standard layout: ``offset`` of x and y (else their means in whole metres), height offset 0."""
    xyz = {c: table.column(c).to_numpy() for c in "xy" if not table.column(c).null_count}
    if offset is None and len(xyz) == 2:
        offset = (float(np.floor(xyz["x"].mean())), float(np.floor(xyz["y"].mean())))
    rec, box = _records(table, scale, (*(offset or (0.0, 0.0)), 0.0))
    return _head(len(rec), scale, (*offset, 0.0), box) + rec.tobytes()


def _records(table: pa.Table, scale: float, offset: tuple) -> tuple[np.ndarray, list[float]]:
    """Records of points as they lie in a file, and the greatest and least x, y and z."""
    n = table.num_rows
    for c in ("x", "y", "z", "intensity", "classification"):
        if table.column(c).null_count:
            raise ValueError(f"{c} is null in {table.column(c).null_count} of {n} points; a scan file has no nulls")
    xyz = {c: table.column(c).to_numpy() for c in "xyz"}
    rec = np.zeros(n, np.dtype(RECORD))
    for c, o in zip("xyz", offset):
        rec[c] = _within(c, np.rint((xyz[c] - o) / scale), -(2**31), 2**31 - 1)
    rec["intensity"] = _within("intensity", table.column("intensity").to_numpy(), 0, 65535)
    rec["cls"] = _within("classification", table.column("classification").to_numpy(), 0, 255)
    rec["bits"], rec["source"] = 0x11, 1  # return 1 of 1
    return rec, [float(f(xyz[c])) for c in "xyz" for f in (np.max, np.min)]


def _held(records: bytes, box: list[float] | None, scale: float, offset: tuple) -> tuple[np.ndarray, list[float]]:
    """A run of records and its bounding box, for a cut one that of its stored coordinates."""
    rec = np.frombuffer(records, np.dtype(RECORD))
    return rec, box or [float(f(rec[c]) * scale + o) for c, o in zip("xyz", offset) for f in (np.max, np.min)]


def _head(n: int, scale: float, offset: tuple, box: list[float]) -> bytes:
    head = bytearray(HEADER_BYTES)
    head[:4] = MAGIC
    head[24:26] = bytes((1, 2))  # version
    head[58:68] = b"cloudgrain"
    struct.pack_into("<HI", head, AT_HEADER_SIZE, HEADER_BYTES, HEADER_BYTES)
    struct.pack_into("<BHI5I", head, AT_FORMAT, 0, RECORD_BYTES, n, n, 0, 0, 0, 0)
    struct.pack_into("<3d", head, AT_SCALE, scale, scale, scale)
    struct.pack_into("<9d", head, AT_OFFSET, *offset, *box)
    return bytes(head)


def _within(name: str, values: np.ndarray, lo: int, hi: int) -> np.ndarray:
    if not ((values >= lo) & (values <= hi)).all():  # NaN fails too
        raise ValueError(f"{name} does not fit the scan file: stored values must lie between {lo} and {hi}")
    return values


class LasDataSource(DataSource):
    """``spark.read.format("las")`` / ``spark.readStream.format("las")`` / ``df.write.format("las")``.

    Options: ``path``, ``mode``, ``recordsPerPartition``, ``recordNo``; when
    writing ``scale``. Rows to write must be grouped by ``tile_name`` (and
    ``part``) within tasks; :func:`save_las` sees to that.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        return _schema(self.options.get("mode", "FAILFAST").upper(), self.options.get("recordNo", "false").lower() == "true")

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer({k.lower(): v for k, v in self.options.items()}, overwrite)
