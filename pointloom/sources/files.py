"""Files by path or URI, through the filesystem that the scheme names: whole, by range, or copied piece by piece."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyarrow import fs

PIECE = 1 << 20


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a path and the path within it; plain paths are local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def file_size(path: str) -> int | None:
    """Bytes of a file; None where it does not exist."""
    where, at = locate(path)
    info = where.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def exists(path: str) -> bool:
    return file_size(path) is not None


def read_raw(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """The bytes of a file, or `length` of them from `offset`."""
    where, at = locate(path)
    with where.open_input_file(at) as f:
        f.seek(offset)
        return f.read(length) if length is not None else f.read()


def write_raw(path: str, data: bytes) -> None:
    where, at = locate(path)
    with where.open_output_stream(at) as f:
        f.write(data)


def lines(path: str, offset: int = 0) -> Iterator[bytes]:
    """Lines from an offset on, read piece by piece."""
    where, at = locate(path)
    with where.open_input_file(at) as f:
        f.seek(offset)
        left = b""
        while piece := f.read(PIECE):
            *full, left = (left + piece).split(b"\n")
            yield from full
        if left:
            yield left


def join_files(path: str, head: bytes, parts: list[str]) -> None:
    """A file of `head` and the parts, in order; the parts go."""
    where, at = locate(path)
    with where.open_output_stream(at) as out:
        out.write(head)
        for p in parts:
            _, name = locate(p)
            with where.open_input_stream(name) as f:
                while piece := f.read(PIECE):
                    out.write(piece)
            where.delete_file(name)
