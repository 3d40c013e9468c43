"""Raster files as tables of pixels, and back.

Raw rasters are read row by row as records of fixed length, so a large file is
split between tasks on any file system. GeoTIFFs are decoded from their bytes,
a file to a row; `geotiff` is also a data source for spark.read, whose
partitions are blocks of rows, for file systems that all nodes mount.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIXELS = "path string, row int, col int, value double"


def check_size(spark: SparkSession, path: str, expected: int) -> None:
    """A file of another size than its header says is an error; only its
    length is read."""
    size = spark.read.format("binaryFile").load(path).select("length").first()["length"]
    if size != expected:
        raise ValueError(f"{path} has {size} bytes; its header says {expected}")


def read_raw(spark: SparkSession, path: str, nrows: int, ncols: int, *, kind: str = ">f4", bands: int = 1, band: int = 0) -> DataFrame:
    """(row, col, value) of one band of a raw raster, bands interleaved by
    line. kind: NumPy's name of the cell type."""
    width = int(kind[2:]) * ncols * bands
    check_size(spark, path, width * nrows)
    records = spark.sparkContext.binaryRecords(path, width).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    rows = spark.createDataFrame(records, "row long, raw binary")

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at = b.column(0).to_numpy()
            cells = np.concatenate([np.frombuffer(x.as_py(), kind)[band * ncols : (band + 1) * ncols] for x in b.column(1)]) if len(at) else np.empty(0)
            yield pa.RecordBatch.from_pydict({"row": np.repeat(at, ncols).astype(np.int32), "col": np.tile(np.arange(ncols, dtype=np.int32), len(at)), "value": cells.astype(float)})

    return rows.mapInArrow(decode, "row int, col int, value double")


def read_gamma(spark: SparkSession, path: str, header: dict) -> DataFrame:
    """A GAMMA raster: big-endian float32."""
    return read_raw(spark, path, header["NROWS"], header["NCOLS"])


def read_roipac(spark: SparkSession, path: str, header: dict) -> DataFrame:
    """A ROI_PAC raster, little-endian: of an interferogram the second of two
    float32 bands, of a DEM int16."""
    if "DATUM" in header:
        return read_raw(spark, path, header["NROWS"], header["NCOLS"], kind="<i2")
    return read_raw(spark, path, header["NROWS"], header["NCOLS"], kind="<f4", bands=2, band=1)


def read_lookup(spark: SparkSession, path: str, nrows: int, ncols: int) -> DataFrame:
    """(row, col, range_px, azimuth_px) of a GAMMA lookup table: big-endian
    float32 pairs. A file of the wrong size is an error."""
    both = read_raw(spark, path, nrows, 2 * ncols)
    cell = both.select("row", F.floor(F.col("col") / 2).cast("int").alias("col"), (F.col("col") % 2).alias("which"), "value")
    return cell.groupBy("row", "col").agg(F.max(F.when(F.col("which") == 0, F.col("value"))).alias("range_px"), F.max(F.when(F.col("which") == 1, F.col("value"))).alias("azimuth_px"))


# TIFF: fixed values of the format.
SHORT, LONG, ASCII, DOUBLE = 3, 4, 2, 12
SIZES = {1: 1, ASCII: 1, SHORT: 2, LONG: 4, 6: 1, 8: 2, 11: 4, DOUBLE: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
SCALE, TIEPOINT, METADATA, NODATA = 33550, 33922, 42112, 42113
PACKBITS = 32773


@dataclass
class Tiff:
    """What a TIFF of one band holds besides its cells."""

    nrows: int
    ncols: int
    kind: str
    strip_rows: int
    strips: list[tuple[int, int]]
    packed: bool
    x_first: float = 0.0
    y_first: float = 0.0
    x_step: float = 1.0
    y_step: float = -1.0
    nodata: float | None = None
    metadata: dict[str, str] = field(default_factory=dict)


def parse_tiff(raw: bytes) -> Tiff:
    """The directory of a classic TIFF."""
    import xml.etree.ElementTree as xml

    end = {b"II": "<", b"MM": ">"}[raw[:2]]
    magic, at = struct.unpack(end + "HI", raw[2:8])
    if magic != 42:
        raise ValueError("not a classic TIFF")
    tags = {}
    (n,) = struct.unpack_from(end + "H", raw, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(end + "HHI", raw, at + 2 + 12 * i)
        size, here = SIZES.get(kind, 1) * count, at + 2 + 12 * i + 8
        if size > 4:
            (here,) = struct.unpack_from(end + "I", raw, here)
        if kind == ASCII:
            tags[tag] = raw[here : here + count].split(b"\0")[0].decode()
        else:
            tags[tag] = struct.unpack_from(end + str(count) + {1: "B", SHORT: "H", LONG: "I", 6: "b", 8: "h", 11: "f", DOUBLE: "d"}[kind], raw, here)
    if tags.get(COMPRESSION, (1,))[0] not in (1, PACKBITS) or tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("only one band, plain or packed, can be read")
    kind = end + {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]] + str(tags[BITS][0] // 8)
    out = Tiff(tags[HEIGHT][0], tags[WIDTH][0], kind, tags.get(STRIP_ROWS, tags[HEIGHT])[0], list(zip(tags[OFFSETS], tags[COUNTS])), tags.get(COMPRESSION, (1,))[0] == PACKBITS)
    if SCALE in tags and TIEPOINT in tags:
        out.x_step, out.y_step = tags[SCALE][0], -tags[SCALE][1]
        out.x_first = tags[TIEPOINT][3] - tags[TIEPOINT][0] * out.x_step
        out.y_first = tags[TIEPOINT][4] - tags[TIEPOINT][1] * out.y_step
    if NODATA in tags:
        out.nodata = float(tags[NODATA])
    if METADATA in tags:
        out.metadata = {x.get("name"): x.text or "" for x in xml.fromstring(tags[METADATA])}
    return out


def unpack(raw: bytes) -> bytes:
    """Decode PackBits."""
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack(raw: bytes) -> bytes:
    """Encode PackBits: runs of three and more as runs, all else as it is."""
    import re

    out, at = bytearray(), 0

    def plain(a, b):
        for i in range(a, b, 128):
            part = raw[i : min(i + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in re.finditer(rb"(.)\1{2,127}", raw, re.S):
        plain(at, m.start())
        out.append(257 - len(m[0]))
        out.extend(m[1])
        at = m.end()
    plain(at, len(raw))
    return bytes(out)


def strip(tiff: Tiff, read, i: int):
    """Cells of a strip as an array of rows. read(offset, size) gives bytes."""
    import numpy as np

    raw = read(*tiff.strips[i])
    if tiff.packed:
        raw = unpack(raw)
    return np.frombuffer(raw, tiff.kind).reshape(-1, tiff.ncols)


def encode_tiff(image, x_first: float, y_first: float, x_step: float, y_step: float, *, nodata: float | None = None, metadata: dict | None = None, packed: bool = True) -> bytes:
    """A GeoTIFF of one float32 (or int16) band with metadata items."""
    import numpy as np
    from xml.sax.saxutils import escape

    image = np.asarray(image)
    kind = "<i2" if image.dtype.kind == "i" else "<f4"
    image = image.astype(kind)
    nrows, ncols = image.shape
    rows = max(1, 65536 // (ncols * image.itemsize))
    strips = [image[r : r + rows].tobytes() for r in range(0, nrows, rows)]
    strips = [pack(s) for s in strips] if packed else strips
    items = "".join(f'<Item name="{escape(str(k))}">{escape(str(v))}</Item>' for k, v in (metadata or {}).items())
    entries = [
        (WIDTH, LONG, [ncols]), (HEIGHT, LONG, [nrows]), (BITS, SHORT, [image.itemsize * 8]), (COMPRESSION, SHORT, [PACKBITS if packed else 1]), (PHOTOMETRIC, SHORT, [1]),
        (OFFSETS, LONG, [0] * len(strips)), (SAMPLES, SHORT, [1]), (STRIP_ROWS, LONG, [rows]), (COUNTS, LONG, [len(s) for s in strips]), (FORMAT, SHORT, [3 if kind == "<f4" else 2]),
        (SCALE, DOUBLE, [x_step, -y_step, 0.0]), (TIEPOINT, DOUBLE, [0.0, 0.0, 0.0, x_first, y_first, 0.0]),
    ]
    if items:
        entries.append((METADATA, ASCII, f"<GDALMetadata>{items}</GDALMetadata>\0".encode()))
    if nodata is not None:
        entries.append((NODATA, ASCII, f"{nodata}\0".encode()))
    body = lambda kind, v: v if kind == ASCII else struct.pack("<" + str(len(v)) + {SHORT: "H", LONG: "I", DOUBLE: "d"}[kind], *v)
    extra = 8 + 2 + 12 * len(entries) + 4
    data = extra + sum(len(body(k, v)) + len(body(k, v)) % 2 for _, k, v in entries if len(body(k, v)) > 4)
    offsets = [data + sum(map(len, strips[:i])) for i in range(len(strips))]
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(entries)), b""
    for tag, k, v in entries:
        raw = body(k, offsets if tag == OFFSETS else v)
        head += struct.pack("<HHI", tag, k, len(raw) if k == ASCII else len(v))
        if len(raw) <= 4:
            head += raw.ljust(4, b"\0")
        else:
            head += struct.pack("<I", extra + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return head + b"\0" * 4 + tail + b"".join(strips)


def read_geotiffs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, row, col, value) of GeoTIFFs; nodata as null."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for name, raw in zip(b.column(0), b.column(1)):
                raw = raw.as_py()
                tiff = parse_tiff(raw)
                for i in range(len(tiff.strips)):
                    cells = strip(tiff, lambda a, n, raw=raw: raw[a : a + n], i)
                    yield _batch(pa, np, name.as_py(), tiff, i, cells)

    return files.mapInArrow(decode, PIXELS)


def _batch(pa, np, name, tiff, i, cells):
    row, col = np.mgrid[: cells.shape[0], : tiff.ncols]
    value = cells.astype(float).ravel()
    bad = np.isnan(value) if tiff.nodata is None else np.isnan(value) | (np.abs(value - tiff.nodata) <= 1e-6)
    return pa.RecordBatch.from_arrays([pa.array([name] * len(value)), pa.array((row.ravel() + i * tiff.strip_rows).astype(np.int32)), pa.array(col.ravel().astype(np.int32)), pa.array(value, mask=bad)], ["path", "row", "col", "value"])


def geotiff_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, nrows, ncols, x_first, x_last, y_first, y_last, x_step, y_step,
    nodata, metadata) of GeoTIFFs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = "path string, nrows int, ncols int, x_first double, x_last double, y_first double, y_last double, x_step double, y_step double, nodata double, metadata map<string,string>"

    def heads(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for name, raw in zip(pdf["path"], pdf["content"]):
                t = parse_tiff(raw)
                out.append((name, t.nrows, t.ncols, t.x_first, t.x_first + t.ncols * t.x_step, t.y_first, t.y_first + t.nrows * t.y_step, t.x_step, t.y_step, t.nodata, t.metadata))
            yield pd.DataFrame(out, columns=["path", "nrows", "ncols", "x_first", "x_last", "y_first", "y_last", "x_step", "y_step", "nodata", "metadata"])

    return files.mapInPandas(heads, kind)


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").load(path): pixels of one GeoTIFF, `rows`
    strips to a partition (option; 16)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> "GeoTiffReader":
        return GeoTiffReader(self.options)


class GeoTiffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"].removeprefix("file://"), int(options.get("rows", 16))

    def partitions(self):
        with open(self.path, "rb") as file:
            n = len(parse_tiff(file.read()).strips)
        return [_Rows(self.path, i, min(i + self.step, n)) for i in range(0, n, self.step)]

    def read(self, partition) -> Iterator:
        import numpy as np
        import pyarrow as pa

        path, first, last = partition.value
        with open(path, "rb") as file:
            tiff = parse_tiff(file.read())

            def take(at, n):
                file.seek(at)
                return file.read(n)

            for i in range(first, last):
                yield _batch(pa, np, path, tiff, i, strip(tiff, take, i))


def images(pixels: DataFrame, nrows: int, ncols: int, encode, *, by: str = "name", value: str = "value") -> DataFrame:
    """(name, content): a file for each image, encode(name, array) its bytes.
    An image is one task."""

    def one(key, pdf):
        import numpy as np
        import pandas as pd

        image = np.full((nrows, ncols), np.nan)
        image[pdf["row"], pdf["col"]] = pdf["value_"]
        return pd.DataFrame({"name": [str(key[0])], "content": [encode(str(key[0]), image)]})

    rows = pixels.select(F.col(by).cast("string").alias("name"), "row", "col", F.col(value).alias("value_"))
    return rows.groupBy("name").applyInPandas(one, "name string, content binary")


def geotiffs(pixels: DataFrame, nrows: int, ncols: int, x_first: float, y_first: float, x_step: float, y_step: float, *, metadata: dict | None = None, **names) -> DataFrame:
    return images(pixels, nrows, ncols, lambda name, image: encode_tiff(image, x_first, y_first, x_step, y_step, metadata=metadata), **names)


def gamma_bytes(image) -> bytes:
    """An image as a GAMMA raster, NaN as 0."""
    import numpy as np

    return np.nan_to_num(np.asarray(image, float)).astype(">f4").tobytes()


def roipac_bytes(image) -> bytes:
    """An image as a ROI_PAC interferogram: a band of ones, then the phase."""
    import numpy as np

    phase = np.nan_to_num(np.asarray(image, float)).astype("<f4")
    return np.stack([np.ones_like(phase), phase], 1).tobytes()


def save(files: DataFrame, folder: str) -> int:
    """Write (name, content) rows as files of a folder on any file system, one
    at a time; returns how many. Only for products a person looks at."""
    spark = files.sparkSession
    jvm, n = spark._jvm, 0
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in files.toLocalIterator():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(base, r["name"]), True)
        out.write(bytes(r["content"]))
        out.close()
        n += 1
    return n


def png(image, low: float, high: float, diverging: bool = True) -> bytes:
    """A quick look: blue, white and red about the middle, or white to red;
    missing cells are transparent."""
    import zlib

    import numpy as np

    t = np.clip((np.nan_to_num(image, nan=low) - low) / ((high - low) or 1), 0, 1)
    t = 2 * t - 1 if diverging else t
    fade = 1 - np.abs(t)
    rgb = [np.where(t >= 0, 1, fade), fade, np.where(t <= 0, 1, fade) if diverging else fade]
    rgba = np.stack([*(np.round(c * 255) for c in rgb), np.where(np.isnan(image), 0, 255)], 2).astype(np.uint8)
    lines = b"".join(b"\0" + row.tobytes() for row in rgba)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def kml(name: str, north: float, south: float, east: float, west: float) -> bytes:
    """A ground overlay for name.png."""
    box = f"<north>{north}</north><south>{south}</south><east>{east}</east><west>{west}</west>"
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><GroundOverlay><name>{name}</name><Icon><href>{name}.png</href></Icon><LatLonBox>{box}</LatLonBox></GroundOverlay></kml>\n'.encode()
