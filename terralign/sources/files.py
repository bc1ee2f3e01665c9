"""Random access to files on any store that Arrow reads, for the binary sources."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str):
    """A seekable Arrow file of a path or URI."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def ranges(n: int, size: int) -> list[tuple[int, int]]:
    return [(a, min(a + size, n)) for a in range(0, n, size)]
