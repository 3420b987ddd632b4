"""Random access to files for data sources: plain paths, and addresses of the file systems that Arrow opens (file, s3, gs, hdfs, ...)."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path within it."""
    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place on."""
    system, at = located(path)
    return system.open_input_file(at)


def exists(path: str) -> bool:
    system, at = located(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def size(path: str) -> int:
    system, at = located(path)
    return system.get_file_info(at).size


def first_with(folders: list[str], sentinel: str) -> str:
    """The first of the folders in which a file of that name lies."""
    for folder in folders:
        if exists(f"{folder.rstrip('/')}/{sentinel}"):
            return folder
    raise FileNotFoundError(f"{sentinel} in none of {', '.join(folders)}")
