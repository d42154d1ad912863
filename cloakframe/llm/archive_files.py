"""Files in the shared folder by URI, from any executor: a local path, file:, hdfs:, s3: and what else pyarrow opens."""

from __future__ import annotations

from functools import lru_cache

from pyarrow import fs


@lru_cache(maxsize=8)
def _system(base: str) -> tuple[fs.FileSystem, str]:
    if base.startswith("file:"):
        return fs.LocalFileSystem(), "/" + base.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(base)


class Folder:
    def __init__(self, base: str):
        self.fs, self.base = _system(base.rstrip("/"))

    def write(self, name: str, data: bytes) -> None:
        """The whole file or none: it is written aside and moved."""
        self.fs.create_dir(self.base, recursive=True)
        with self.fs.open_output_stream(f"{self.base}/.{name}.part") as f:
            f.write(data)
        self.fs.move(f"{self.base}/.{name}.part", f"{self.base}/{name}")

    def read_at(self, name: str, offset: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.base}/{name}") as f:
            f.seek(offset)
            return f.read(length)
