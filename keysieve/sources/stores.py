"""Where trees are: mounted file systems, and stores that Arrow can address.

Both are used from tasks, so what a task needs is found again from the address of
the tree's root. Spark's own readers are not used here: they leave out names that
start with a dot or an underscore, and empty files.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

from pyarrow import fs

#: File systems by scheme, for addresses that Arrow does not know or that need credentials:
#: a function from the address to a file system and the path in it.
FILE_SYSTEMS: dict[str, Callable[[str], tuple[fs.FileSystem, str]]] = {
    "s3a": lambda address: fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", address)),
}


@dataclass(frozen=True)
class Entry:
    """A file or a folder; the size of a file is null until somebody asks for it."""

    name: str
    path: str
    folder: bool
    size: int | None = None


class Mounted:
    """The operating system's calls; links are left alone."""

    def root(self, path: str) -> Entry | None:
        """The entry behind a root; None if it is neither a file nor a folder. A missing one is an error."""
        info = os.lstat(path)
        kind = info.st_mode
        known = stat.S_ISDIR(kind) or stat.S_ISREG(kind)
        size = info.st_size if stat.S_ISREG(kind) else None
        return Entry(os.path.basename(path), path, stat.S_ISDIR(kind), size) if known else None

    def entries(self, folder: str) -> Iterator[Entry]:
        with os.scandir(folder) as found:
            for entry in found:
                is_folder = entry.is_dir(follow_symlinks=False)
                if is_folder or entry.is_file(follow_symlinks=False):
                    yield Entry(entry.name, entry.path, is_folder)

    def size(self, path: str) -> int:
        return os.lstat(path).st_size

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")


class Addressed:
    """A file system of Arrow; listing a folder gives the sizes as well."""

    def __init__(self, system: fs.FileSystem):
        self.system = system

    def _entry(self, info: fs.FileInfo) -> Entry | None:
        if info.type not in (fs.FileType.File, fs.FileType.Directory):
            return None
        folder = info.type == fs.FileType.Directory
        return Entry(info.base_name, info.path, folder, None if folder else info.size)

    def root(self, path: str) -> Entry | None:
        info = self.system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no file or folder {path}")
        return self._entry(info)

    def entries(self, folder: str) -> Iterator[Entry]:
        for info in self.system.get_file_info(fs.FileSelector(folder)):
            if entry := self._entry(info):
                yield entry

    def size(self, path: str) -> int:
        return self.system.get_file_info(path).size

    def open(self, path: str) -> BinaryIO:
        return self.system.open_input_file(path)


def scheme_of(address: str) -> str:
    """The scheme of an address in lower case; a plain path has ``file``."""
    scheme = re.match("([A-Za-z][A-Za-z0-9+.-]+):", address)
    return scheme.group(1).lower() if scheme else "file"


def local_path(address: str) -> str:
    """The path behind a ``file:`` address or a plain path; any other scheme is refused."""
    if scheme_of(address) != "file":
        raise ValueError(f"{address}: not on a mounted file system")
    return re.sub("^file:/*", "/", address)


def store_of(address: str) -> tuple[Mounted | Addressed, str]:
    """The store of an address, and the path in it."""
    scheme = scheme_of(address)
    if scheme == "file":
        return Mounted(), os.path.abspath(local_path(address))
    find = FILE_SYSTEMS.get(scheme, fs.FileSystem.from_uri)
    try:
        system, path = find(address)
    except ValueError as problem:  # Arrow's own error for an unknown scheme is one
        raise ValueError(f"{address}: neither on a mounted file system nor in a store that Arrow knows") from problem
    return Addressed(system), path.rstrip("/")


class Stores(dict):
    """Stores by the address of a root, each opened once per task."""

    def __missing__(self, address: str) -> Mounted | Addressed:
        self[address], _ = store_of(address)
        return self[address]


def reason(problem: OSError) -> str:
    return problem.strerror or str(problem) or "unreadable"


def after_newline(handle: BinaryIO, place: int, step: int = 1 << 16) -> int:
    """Where the line that holds the byte at ``place`` ends, its newline included."""
    handle.seek(place)
    while part := handle.read(step):
        found = part.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(part)
    return place


def read_lines_of(handle: BinaryIO, start: int, end: int | None) -> bytes:
    """The whole lines that begin at or after ``start`` and before ``end``; to the end of the file without one."""
    first = after_newline(handle, start - 1) if start else 0
    last = None if end is None else after_newline(handle, end - 1)
    if last is not None and last <= first:
        return b""
    handle.seek(first)
    return handle.read() if last is None else handle.read(last - first)
