"""Bytes of files in any store that Arrow's file systems open, read in ranges by tasks."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str):
    """(file system, path in it); plain paths are local ones."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def size(path: str) -> int:
    system, at = opened(path)
    return system.get_file_info(at).size


def read(path: str, start: int = 0, length: int | None = None) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        f.seek(start)
        return f.read(length) if length is not None else f.read()


def names(folder: str, suffix: str = "") -> list[str]:
    """Full paths of a folder's files, by name."""
    system, at = opened(folder)
    found = system.get_file_info(fs.FileSelector(at, recursive=False))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(suffix))


def exists(path: str) -> bool:
    system, at = opened(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def write(path: str, data: bytes) -> None:
    """A whole file; folders above it are made."""
    system, at = opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(data)
