"""BigTIFF pictures of three 16-bit samples: a data source that reads one strip a partition, and the bytes of such a file.

The layout is the format's own: a header of 16 bytes, a directory of tagged entries, tables of strip offsets and sizes, and
strips of whole rows. Only the directory is read on the driver; strips are read as byte ranges by the tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: tags, types and their sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, SIZES, PLANAR, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
SHORT, LONG, LONG8 = 3, 4, 16
FORMATS = {SHORT: "H", LONG: "I", LONG8: "Q"}


def encode(pixels: np.ndarray, strip_rows: int = 256) -> bytes:
    """A little-endian file of height x width x 3 samples of 16 bits."""
    height, width, _ = pixels.shape
    n = max(1, -(-height // strip_rows))
    sizes = [min(strip_rows, height - k * strip_rows) * width * 6 for k in range(n)]
    tables = 16 + 8 + 11 * 20 + 8
    begin = tables + (16 * n if n > 1 else 0)
    offsets = [begin + sum(sizes[:k]) for k in range(n)]
    listed = lambda values, at: struct.pack("<Q", values[0] if n == 1 else at)  # noqa: E731  one value stands in the entry itself
    one = lambda v: struct.pack("<Q", v)
    entries = [
        (WIDTH, LONG, 1, one(width)), (HEIGHT, LONG, 1, one(height)), (BITS, SHORT, 3, struct.pack("<4H", 16, 16, 16, 0)), (COMPRESSION, SHORT, 1, one(1)), (PHOTOMETRIC, SHORT, 1, one(2)),
        (OFFSETS, LONG8, n, listed(offsets, tables)), (SAMPLES, SHORT, 1, one(3)), (ROWS, LONG, 1, one(strip_rows)), (SIZES, LONG8, n, listed(sizes, tables + 8 * n)), (PLANAR, SHORT, 1, one(1)),
        (SAMPLE_FORMAT, SHORT, 3, struct.pack("<4H", 1, 1, 1, 0)),
    ]
    directory = struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQ", tag, kind, count) + value for tag, kind, count, value in entries) + one(0)
    more = struct.pack(f"<{2 * n}Q", *offsets, *sizes) if n > 1 else b""
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + directory + more + pixels.astype("<u2").tobytes()


def strips(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Width, height and (first row, offset, bytes) of each strip, from the first directory; ValueError if the file is no such picture."""

    def take(at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > length:
            raise ValueError(f"{n} bytes at {at} of {length}")
        return read(at, n)

    head = take(0, 16)
    if head[:2] not in (b"II", b"MM"):
        raise ValueError("no byte order")
    order = "<" if head[:2] == b"II" else ">"
    magic, width8, zero, first = struct.unpack(order + "HHHQ", head[2:])
    if (magic, width8, zero) != (43, 8, 0):
        raise ValueError("no BigTIFF header")
    (count,) = struct.unpack(order + "Q", take(first, 8))
    if not 0 < count <= 4096:
        raise ValueError(f"{count} directory entries")
    raw, found = take(first + 8, 20 * count), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(order + "HHQ", raw, 20 * k)
        if kind in FORMATS and tag in (WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, SIZES, PLANAR):
            size = struct.calcsize("=" + FORMATS[kind]) * n
            body = raw[20 * k + 12 : 20 * k + 20] if size <= 8 else take(struct.unpack_from(order + "Q", raw, 20 * k + 12)[0], size)
            found[tag] = struct.unpack_from(f"{order}{n}{FORMATS[kind]}", body)
    one = lambda tag, default=None: found.get(tag, (default,))[0]
    width, height, rows = one(WIDTH, 0), one(HEIGHT, 0), one(ROWS, 1 << 32)
    if not (width and height and rows) or one(SAMPLES) != 3 or set(found.get(BITS, ())) != {16} or one(COMPRESSION, 1) != 1 or one(PLANAR, 1) != 1 or order != "<":
        raise ValueError("not a plain little-endian picture of three 16-bit samples")
    n = -(-height // rows)
    if len(found.get(OFFSETS, ())) != n:
        raise ValueError("strips are missing")
    out = [(k * rows, offset, min(rows, height - k * rows) * width * 6) for k, offset in enumerate(found[OFFSETS])]
    for _, offset, size in out:
        if offset + size > length:
            raise ValueError("a strip lies behind the end")
    return width, height, out


class _Strip(InputPartition):
    def __init__(self, path: str, width: int, row: int, offset: int, size: int) -> None:
        super().__init__(offset)
        self.path, self.width, self.row, self.offset, self.size = path, width, row, offset, size


class _Reader(DataSourceReader):
    def __init__(self, uri: str) -> None:
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        store, top = fs.FileSystem.from_uri(self.uri)
        info = store.get_file_info(top)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.path.lower().endswith((".tif", ".tiff"))]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            with store.open_input_file(f.path) as source:
                width, _, found = strips(lambda at, n, source=source: source.read_at(n, at), f.size)
            out += [_Strip(f.path, width, *s) for s in found]
        return out or [_Strip("", 0, 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        s = partition
        if not s.size:
            return
        store, _ = fs.FileSystem.from_uri(self.uri)
        with store.open_input_file(s.path) as source:
            px = np.frombuffer(source.read_at(s.size, s.offset), "<u2").reshape(-1, s.width, 3).astype(np.int32)
        y, x = np.divmod(np.arange(px.shape[0] * s.width, dtype=np.int32), s.width)
        yield pa.record_batch([pa.array([s.path] * len(x), pa.string()), pa.array(x), pa.array(y + np.int32(s.row)), *(pa.array(np.ascontiguousarray(px[:, :, k].ravel())) for k in range(3))], ["path", "x", "y", "r", "g", "b"])


class BigTiff(DataSource):
    """``spark.dataSource.register(BigTiff)``, then ``spark.read.format("bigtiff").load(uri)``: a file, or a folder of .tif files, in a store that all executors reach."""

    @classmethod
    def name(cls) -> str:
        return "bigtiff"

    def schema(self) -> str:
        return "path string, x int, y int, r int, g int, b int"

    def reader(self, schema: object) -> DataSourceReader:
        path = self.options["path"]
        return _Reader(path if ":" in path.split("/")[0] else f"file://{path}")
