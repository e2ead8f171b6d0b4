"""Files by path or address for Python data sources, which run without the JVM's file systems."""

from __future__ import annotations

from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; plain paths and ``file:`` are local."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def data_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder whose names do not start with ``_`` or ``.``."""
    system, own = place(path)
    info = system.get_file_info(own)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    prefix = path[: len(path) - len(own)] if path.endswith(own) else "file:"
    found = system.get_file_info(fs.FileSelector(own, recursive=True))
    return sorted(
        (prefix + i.path, i.size) for i in found
        if i.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in i.path[len(own) :].strip("/").split("/"))
    )
