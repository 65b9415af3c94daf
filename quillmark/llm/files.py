"""Files that executors write and read in the shared folder, by whatever scheme it has."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> str:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def open_input(uri: str):
    """Memory-mapped where the file system is a local mount, else a random-access file."""
    import pyarrow as pa

    fs, path = open_fs(uri)
    return pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
