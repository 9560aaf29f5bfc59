"""NIfTI-1 volumes: a parser, a writer, readers by folder and by manifest.

``read_volumes`` gives one row for each .nii or .nii.gz file: name, shape, spacing, affine (rows of four) and data in C order;
``case_files`` gives one row for each case of a manifest with the files that its path columns name; ``read_headers`` reads no
voxels, ``read_slabs`` gives a row for each slab.  For these two tasks open files themselves; else files reach Python as bytes that Spark has read, so any store that Spark reads will do; Spark cuts the batches by their bytes, and volumes are
unpacked one by one.
"""

from __future__ import annotations

import contextlib
import gzip
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldcohort.operators.cohort import small
from fieldcohort.sources import files
from fieldcohort.sources.tables import localized_column

#: Type codes of the format. Fixed values.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {v: k for k, v in TYPES.items()}
SCHEMA = "name string, shape array<int>, spacing array<double>, affine array<array<double>>, data array<double>"


@dataclass(frozen=True)
class Header:
    """What a file's first bytes say of its data."""

    shape: tuple[int, ...]
    spacing: tuple[float, ...]
    affine: np.ndarray
    kind: np.dtype
    offset: int
    slope: float
    inter: float

    def scaled(self, data: np.ndarray) -> np.ndarray:
        if self.slope != 0.0 and np.isfinite(self.slope) and (self.slope, self.inter) != (1.0, 0.0):
            return data * self.slope + self.inter
        return data


#: Bytes of a header.
HEAD = 348


def header(raw: bytes) -> Header:
    """The header in the first HEAD bytes of an unpacked file."""
    order = next((o for o in "<>" if len(raw) >= HEAD and struct.unpack(o + "i", raw[:4])[0] == HEAD), None)
    if order is None or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dims = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    if code not in TYPES:
        raise ValueError(f"type code {code} is not supported")
    zooms = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    qform, sform = struct.unpack(order + "2h", raw[252:256])
    if sform > 0:
        affine = np.vstack([np.array(struct.unpack(order + "12f", raw[280:328])).reshape(3, 4), [0, 0, 0, 1]])
    elif qform > 0:
        affine = _quaternion(struct.unpack(order + "6f", raw[256:280]), zooms)
    else:
        affine = np.diag([*zooms[1:4], 1.0])
    return Header(tuple(dims[1 : dims[0] + 1]), tuple(float(z) for z in zooms[1:4]), affine.astype(float), np.dtype(order + TYPES[code]), int(offset), slope, inter)


def parse(raw: bytes) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """Data (scaled where the header says so), affine and spacing of a file's bytes."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    head = header(raw)
    data = np.frombuffer(raw, dtype=head.kind, count=int(np.prod(head.shape)), offset=head.offset).reshape(head.shape, order="F")
    return head.scaled(data), head.affine, head.spacing


def _quaternion(q: tuple[float, ...], zooms: tuple[float, ...]) -> np.ndarray:
    b, c, d, *shift = q
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    v = np.array([[0, -d, c], [d, 0, -b], [-c, b, 0]])
    rotation = np.eye(3) + 2 * a * v + 2 * v @ v
    sides = np.array(zooms[1:4]) * np.array([1, 1, -1.0 if zooms[0] < 0 else 1.0])
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = rotation * sides, shift
    return out


def render(data: np.ndarray, affine: np.ndarray, description: str = "", compress: bool = True) -> bytes:
    """The bytes of a NIfTI-1 file; booleans are stored as bytes; the description has 79 characters at most."""
    data = data.astype(np.uint8) if data.dtype == bool else data
    code = CODES[data.dtype.str[1:]]
    zooms = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    head = bytearray(352)
    head[0:4] = struct.pack("<i", 348)
    head[40:56] = struct.pack("<8h", data.ndim, *data.shape, *[1] * (7 - data.ndim))
    head[70:74] = struct.pack("<2h", code, data.dtype.itemsize * 8)
    head[76:108] = struct.pack("<8f", 1.0, *zooms, *[1.0] * 4)
    head[108:120] = struct.pack("<3f", 352.0, 1.0, 0.0)
    text = description.encode("ascii", "replace")[:79]
    head[148 : 148 + len(text)] = text
    head[123] = 2  # millimetres
    head[252:256] = struct.pack("<2h", 0, 2)
    head[280:328] = struct.pack("<12f", *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + data.astype(data.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(raw, mtime=0) if compress else raw


def read_volumes(spark: SparkSession, path: str, as_bytes: bool = False) -> DataFrame:
    """One row for each volume below ``path``; with ``as_bytes`` the data are little-endian single precision in a binary
    column, half the size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                data, affine, spacing = parse(bytes(content))
                flat = np.ascontiguousarray(data, dtype="<f4" if as_bytes else float)
                yield pd.DataFrame([(name.rsplit("/", 1)[-1], list(data.shape), list(spacing), affine.tolist(), flat.tobytes() if as_bytes else flat.ravel())], columns=["name", "shape", "spacing", "affine", "data"])

    return _files(spark, path).select("path", "content").mapInPandas(run, SCHEMA.replace("data array<double>", "data binary") if as_bytes else SCHEMA)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nii*").load(path)


@contextlib.contextmanager
def _unpacked(uri: str) -> Iterator[BinaryIO]:
    """A file's unpacked bytes, from the first on."""
    with files.open_file(uri) as raw:
        packed = raw.read(2) == b"\x1f\x8b"
        raw.seek(0)
        if packed:
            with gzip.GzipFile(fileobj=raw) as inner:
                yield inner
        else:
            yield raw


def _by_file(spark: SparkSession, path: str, read: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """What ``read`` makes of each volume file below ``path``, a task for each; Spark lists the files, tasks open them."""
    found = _files(spark, path).select("path")
    kinds = found.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = to_arrow_schema(kinds)
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                for row in read(uri):
                    yield pa.RecordBatch.from_pylist([row], schema=fields)

    return found.repartitionByRange(max(1, found.count()), "path").mapInArrow(run, schema)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """name, shape, spacing, affine and type of each volume below ``path``, from its first bytes: no voxel is read."""

    def read(uri: str) -> Iterator[dict]:
        with _unpacked(uri) as raw:
            head = header(raw.read(HEAD))
        yield {"name": uri.rsplit("/", 1)[-1], "shape": list(head.shape), "spacing": list(head.spacing), "affine": head.affine.tolist(), "type": head.kind.str[1:]}

    return _by_file(spark, path, read, "name string, shape array<int>, spacing array<double>, affine array<array<double>>, type string")


def read_slabs(spark: SparkSession, path: str, thickness: int = 16) -> DataFrame:
    """The volumes below ``path`` in slabs of up to ``thickness`` places of the last axis: name, shape (of the volume), spacing,
    affine, first (place on the last axis), thick and data (little-endian single precision, C order, of the slab).

    Files hold the last axis outermost, so a slab is a stretch of the file; a task holds one slab, packed files too."""
    if thickness < 1:
        raise ValueError("a slab has at least one place")

    def read(uri: str) -> Iterator[dict]:
        with _unpacked(uri) as raw:
            head = header(raw.read(HEAD))
            _take(raw, head.offset - HEAD)
            across = int(np.prod(head.shape[:-1]))
            for first in range(0, head.shape[-1], thickness):
                thick = min(thickness, head.shape[-1] - first)
                data = np.frombuffer(_take(raw, across * thick * head.kind.itemsize), dtype=head.kind).reshape((*head.shape[:-1], thick), order="F")
                flat = np.ascontiguousarray(head.scaled(data), dtype="<f4").tobytes()
                yield {"name": uri.rsplit("/", 1)[-1], "shape": list(head.shape), "spacing": list(head.spacing), "affine": head.affine.tolist(), "first": first, "thick": thick, "data": flat}

    return _by_file(spark, path, read, "name string, shape array<int>, spacing array<double>, affine array<array<double>>, first int, thick int, data binary")


def _take(raw: BinaryIO, size: int) -> bytes:
    """The next ``size`` bytes; a file that ends before raises."""
    got = raw.read(size)
    while len(got) < size:
        more = raw.read(size - len(got))
        if not more:
            raise ValueError("a volume file ends before its data do")
        got += more
    return bytes(got)


def plain_path(c: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?(?=/)", "")


def case_files(spark: SparkSession, manifest: DataFrame, columns: dict[str, str], root: str, anchor: str = "ARC", optional: tuple[str, ...] = (), keep: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """``keep`` and, for each name in ``columns``, the bytes of the file that the manifest's column of that value names.

    Relative paths lie below ``root``, absolute ones that have a component ``anchor`` are moved there (``localized_column``).
    A path that is NULL or has no file below ``root`` raises, but for NULLs of ``optional`` names.  The files stay packed and
    are shuffled once, to their case; a case is a task of its own as long as there are at most 10,000."""
    base = plain_path(F.lit(root.rstrip("/")))
    at = lambda c: F.when(c.startswith("/") | c.contains(":/"), plain_path(localized_column(c, root, anchor))).otherwise(F.concat(base, F.lit("/"), c))
    cells = F.array(*[F.struct(F.lit(n).alias("name"), at(F.col(c)).alias("path")) for n, c in columns.items()])
    wanted = manifest.select(keep[0], F.explode(cells).alias("r")).select(keep[0], "r.name", "r.path")
    stored = _files(spark, root).withColumn("path", plain_path(F.col("path")))
    needed = wanted.where(F.col("path").isNotNull() | ~F.col("name").isin(*optional)) if optional else wanted
    missing = [f"{r['name']} of {r[0]}: {r['path']}" for r in needed.join(stored.select("path"), "path", "left_anti").select(keep[0], "name", "path").limit(5).collect()]
    if missing:
        raise FileNotFoundError(f"missing volumes: {missing}")
    cases = max(1, min(manifest.count(), 10_000))
    joined = stored.select("path", "content").join(small(wanted), "path").repartition(cases, keep[0])
    each = joined.groupBy(keep[0]).agg(*[F.max(F.when(F.col("name") == n, F.col("content"))).alias(n) for n in columns])
    return each.join(small(manifest.select(*keep)), keep[0]) if len(keep) > 1 else each


def vector_and_mask(row: dict) -> tuple[np.ndarray, np.ndarray, tuple[float, ...]]:
    """Field, mask and spacing of a case row with the packed files ``field`` and ``valid``, which must share their geometry."""
    (u, at, spacing), (valid, mask_at, _) = parse(bytes(row["field"])), parse(bytes(row["valid"]))
    if not same_geometry((u.shape[:3], at), (valid.shape[:3], mask_at)):
        raise ValueError(f"field and mask of {row['case_id']} differ in geometry")
    return np.ascontiguousarray(u, dtype=np.float32), valid > 0, spacing


def write_volumes(df: DataFrame, path: str) -> None:
    """Store (name, shape, affine, data) rows as rendered files in a Parquet table of (name, content), by Spark's committer;
    ``report.write_files`` puts them into a folder."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.rename(columns={"name": "name_", "shape": "shape_"}).itertuples():
                data = np.frombuffer(r.data, dtype="<f4") if isinstance(r.data, bytes | bytearray) else np.asarray(r.data, dtype=np.float32)
                yield pd.DataFrame([(r.name_, render(data.reshape([int(n) for n in r.shape_]), np.array([list(a) for a in r.affine])))], columns=["name", "content"])

    df.select("name", "shape", "affine", "data").mapInPandas(run, "name string, content binary").write.mode("overwrite").parquet(path)


def check_geometry(shape: tuple[int, ...], affine: np.ndarray, spacing: tuple[float, float, float] | None = None, atol: float = 1e-4) -> tuple[float, float, float]:
    """Spacing of an atlas grid that has orthogonal axes in RAS order, an odd first axis and its midpoint at world x = 0."""
    m = np.asarray(affine, dtype=float)[:3, :3]
    lengths = np.sqrt((m**2).sum(axis=0))
    if not np.isfinite(m).all() or (lengths <= 0).any():
        raise ValueError("the affine has no valid spacing")
    if not np.allclose(m / lengths, np.eye(3), atol=atol):
        raise ValueError("the axes are not orthogonal in RAS order")
    if spacing is not None and not np.allclose(lengths, spacing, atol=atol):
        raise ValueError(f"spacing {lengths.tolist()} is not {spacing}")
    if shape[0] % 2 == 0:
        raise ValueError("the first axis has an even size")
    middle = affine[0][0] * (shape[0] - 1) / 2 + affine[0][3]
    if abs(middle) > atol:
        raise ValueError(f"the midpoint lies at x = {middle:.4g}")
    return tuple(float(v) for v in lengths)


def check_template(shape: tuple[int, ...], affine: np.ndarray, mask: np.ndarray, spacing: tuple[float, float, float] | None = None, least: float = 0.999) -> float:
    """``check_geometry`` and a mask that is its own mirror image to a Dice of ``least``; returns that Dice."""
    check_geometry(shape, affine, spacing)
    ends = [affine[0][3], affine[0][0] * (shape[0] - 1) + affine[0][3]]
    if abs(sum(ends)) > 1e-3:
        raise ValueError("the end points of the first axis are not symmetric")
    mask = mask.astype(bool)
    total = 2 * mask.sum()
    overlap = 1.0 if total == 0 else float(2 * (mask & mask[::-1]).sum() / total)
    if overlap < least:
        raise ValueError(f"the mask is not symmetric: Dice {overlap:.4f}")
    return overlap


def same_geometry(a: tuple[tuple[int, ...], np.ndarray], b: tuple[tuple[int, ...], np.ndarray]) -> bool:
    """Shapes equal, affines within 1e-4 absolutely and 1e-5 relatively."""
    return tuple(a[0]) == tuple(b[0]) and np.allclose(a[1], b[1], atol=1e-4, rtol=1e-5)


def same_geometry_column(shape_a, shape_b, affine_a, affine_b):
    """The same for columns of volume rows."""
    close = F.forall(F.zip_with(F.flatten(affine_a), F.flatten(affine_b), lambda x, y: F.abs(x - y) <= 1e-4 + 1e-5 * F.abs(y)), lambda x: x)
    return (shape_a == shape_b) & close


def index_to_point(index: np.ndarray, origin: np.ndarray, spacing: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Physical point (LPS) of voxel indices (rows)."""
    return np.asarray(index, dtype=float) * spacing @ np.asarray(direction).T + origin


def point_to_index(point: np.ndarray, origin: np.ndarray, spacing: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Voxel indices of physical points (LPS)."""
    return (np.asarray(point, dtype=float) - origin) @ np.linalg.inv(np.asarray(direction)).T / spacing


def lps_affine(origin: np.ndarray, spacing: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """The RAS affine of a grid that is described in LPS."""
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = np.asarray(direction) * spacing, origin
    return np.diag([-1.0, -1.0, 1.0, 1.0]) @ out


def voxel_map(a: np.ndarray, b: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Voxel indices (rows) of the grid with affine ``a`` as indices of the grid with affine ``b``."""
    world = np.asarray(index, dtype=float) @ np.asarray(a)[:3, :3].T + np.asarray(a)[:3, 3]
    return (world - np.asarray(b)[:3, 3]) @ np.linalg.inv(np.asarray(b)[:3, :3]).T
