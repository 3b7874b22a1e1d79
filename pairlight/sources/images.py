"""PNG files as a Spark data source: listing, header and digest without decoding pixels.

The driver lists the files and cuts the list into partitions; a task opens each of its
files and reads up to the first chunk of pixels, a few hundred bytes, and the whole
file only where its digest is asked for. Pictures never pass through the JVM. Paths
are those that Arrow's file systems open: a local or mounted folder, hdfs:, s3:.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
INCHES_PER_METRE = 0.0254
#: Files of a partition, bytes of a first look at a file, and bytes read at once for a digest.
FILES, LOOK, READ = 256, 512, 1 << 20
SCHEMA = "set string, name string, sha256 string, width int, height int, bit_depth int, color_type int, ppi_x double, ppi_y double, bytes_read long"


def png_header(data: bytes, more=lambda have: b"") -> tuple[int, int, int, int, float | None, float | None]:
    """Width, height, bit depth, colour type and resolution from the chunks before the pixels.

    ``more(have)`` gives further bytes of the file after the first ``have``, or none.
    """
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    size, ppi, at = None, (None, None), 8
    while True:
        while len(data) < at + 8 and (part := more(len(data))):
            data += part
        if len(data) < at + 8:
            break
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind in (b"IDAT", b"IEND"):
            break
        while len(data) < at + 12 + n and (part := more(len(data))):
            data += part
        if kind == b"IHDR":
            size = struct.unpack_from(">IIBB", data, at + 8)
        elif kind == b"pHYs":
            x, y, unit = struct.unpack_from(">IIB", data, at + 8)
            if unit == 1:
                ppi = round(x * INCHES_PER_METRE, 2), round(y * INCHES_PER_METRE, 2)
        at += 12 + n
    if size is None:
        raise ValueError("PNG without a header")
    return (*size, *ppi)


@dataclass
class Files(InputPartition):
    """Some files: set code and path of each."""

    files: list[tuple[str, str]]


class PngReader(DataSourceReader):
    def __init__(self, folders: dict[str, str], digest: bool):
        self.folders, self.digest = folders, digest

    def partitions(self) -> list[Files]:
        found = []
        for code, folder in self.folders.items():
            system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            listed = system.get_file_info(fs.FileSelector(path))
            found += sorted((code, f"{folder.rstrip('/')}/{f.base_name}") for f in listed if f.is_file and f.extension == "png")
        return [Files(found[k : k + FILES]) for k in range(0, len(found), FILES)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for code, path in partition.files:
            system, inside = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
            with system.open_input_file(inside) as file:
                counted = [0]

                def look(have: int, size: int = LOOK, file=file, counted=counted) -> bytes:
                    part = file.read_at(min(size, max(0, file.size() - have)), have)
                    counted[0] += len(part)
                    return part

                header = png_header(look(0), look)
                digest = None
                if self.digest:
                    sha = hashlib.sha256()
                    for at in range(0, file.size(), READ):
                        sha.update(look(at, READ))
                    digest = sha.hexdigest()
            rows.append((code, path.rsplit("/", 1)[1], digest, *header, counted[0]))
        kinds = [pa.string()] * 3 + [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.int64()]
        cells = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], [f.split(" ")[0] for f in SCHEMA.split(", ")])


class PngFiles(DataSource):
    """Options: folders (JSON: a folder for each set code), digest (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "png_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PngReader:
        return PngReader(json.loads(self.options["folders"]), self.options.get("digest", "true") == "true")


def read_images(spark: SparkSession, paths: dict[str, str], digest: bool = True) -> DataFrame:
    """set, name, sha256 (null without ``digest``), header fields and bytes_read of the PNG files in a folder for each set."""
    spark.dataSource.register(PngFiles)
    return spark.read.format("png_files").option("folders", json.dumps(paths)).option("digest", str(digest).lower()).load()
