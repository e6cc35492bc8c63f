"""Files in the shared folder, written and read by range inside tasks, on any store that pyarrow reaches."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs

#: Open files that a reader keeps.
OPEN = 8


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop path and the path inside it. Paths without a scheme are local ones."""
    scheme, _, rest = path.partition(":") if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", path) else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def create(path: str):
    """A new file, open for writing; its folder is made."""
    system, inside = located(path)
    system.create_dir(inside.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inside, compression=None)  # as it is, whatever its name


def reader() -> Callable[[str, int, int], bytes]:
    """A function (path, offset, length) that reads these bytes and nothing else; fewer bytes raise OSError."""
    opened: dict = {}

    def read(path: str, offset: int, length: int) -> bytes:
        if path not in opened:
            if len(opened) >= OPEN:
                opened.pop(next(iter(opened))).close()
            system, inside = located(path)
            opened[path] = system.open_input_file(inside)
        data = opened[path].read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{path} ends before {offset + length}")
        return data

    return read


def read_table(path: str) -> pa.Table:
    """A folder of Parquet files."""
    system, inside = located(path)
    return pq.read_table(inside, filesystem=system, partitioning=None)
