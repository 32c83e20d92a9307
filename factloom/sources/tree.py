"""A Spark data source that walks folders and yields whole text files.

Built on the public Python data source API. The driver lists only enough folders to cut the tree
into pieces; the executors walk and read their own pieces, in Arrow batches. A folder that the driver
listed is cut into ranges of file names by bytes, small ones share a piece; a folder that it did not
list any more is walked by one task, which may walk others too. Ignored folders are not entered, and files whose text nobody asked
for are listed without being opened.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Pieces wanted per scan; folders are opened breadth first until there are that many.
_PIECES = 512
_BATCH_BYTES = 16 * 1024 * 1024
_SPLIT_BYTES = 64 * 1024 * 1024
# What opening a file costs, in bytes.
_OPEN_BYTES = 4096


@dataclass(frozen=True)
class _Part:
    """Files of a folder from ``first`` up to, not including, ``end`` (None: no bound), and all below if ``deep``."""

    folder: str
    deep: bool = False
    first: str | None = None
    end: str | None = None


@dataclass
class _Piece(InputPartition):
    parts: list[_Part]


def open_folder(path: str):
    """(file system, path in it) of a folder; without a scheme it is a local one."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("path", ...)`` -> (file, content, size, mtime)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file string, content string, size bigint, mtime timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    """Options: ``path``; ``glob`` of names; ``ignore``, a JSON list of patterns on paths below the root;
    ``texts``, a JSON list of endings whose text is read (``.env`` files always); ``splitBytes`` of a piece."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.glob = options.get("glob")
        self.ignore = [re.compile(p) for p in json.loads(options.get("ignore") or "[]")]
        texts = json.loads(options.get("texts") or "null")
        self.texts = None if texts is None else tuple(t.lower() for t in texts)
        self.split_bytes = int(options.get("splitBytes") or _SPLIT_BYTES)

    def _opened(self, path: str) -> bool:
        name = posixpath.basename(path).lower()
        return self.texts is None or name.endswith(self.texts) or name == ".env" or name.startswith(".env.")

    def _list(self, filesystem, root: str, folder: str):
        """(folders, files) below one folder that are wanted, by name; without hidden ones and links."""
        import os

        from pyarrow import fs

        folders, files = [], []
        local = isinstance(filesystem, fs.LocalFileSystem)
        for info in filesystem.get_file_info(fs.FileSelector(folder)):
            name = posixpath.basename(info.path)
            if local and os.path.islink(info.path):
                continue
            if self.ignore:
                below = posixpath.relpath(info.path, root)
                if any(p.search(below) for p in self.ignore):
                    continue
            if info.type == fs.FileType.Directory:
                if not name.startswith("."):
                    folders.append(info.path)
            elif not name.startswith(".") or name.lower() == ".env" or name.lower().startswith(".env."):
                if not self.glob or fnmatch.fnmatch(name, self.glob):
                    files.append(info)
        return sorted(folders), sorted(files, key=lambda f: f.path)

    def _cost(self, info) -> int:
        return _OPEN_BYTES + (info.size or 0 if self._opened(info.path) else 0)

    def partitions(self):
        filesystem, root = open_folder(self.path)
        parts, costs, queue = [], [], [root]
        while queue and len(queue) + sum(costs) // self.split_bytes < _PIECES:
            folder = queue.pop(0)
            folders, files = self._list(filesystem, root, folder)
            queue.extend(folders)
            # The outer ranges of a folder are open, so that no file falls between listing and reading.
            first, cost = None, 0
            for info in files:
                if cost and cost + self._cost(info) > self.split_bytes:
                    parts.append(_Part(folder, False, first, posixpath.basename(info.path)))
                    costs.append(cost)
                    first, cost = posixpath.basename(info.path), 0
                cost += self._cost(info)
            parts.append(_Part(folder, False, first, None))
            costs.append(cost)
        pieces, held, size = [], [], 0
        for part, cost in zip(parts, costs):
            if held and size + cost > self.split_bytes:
                pieces.append(_Piece(held))
                held, size = [], 0
            held.append(part)
            size += cost
        if held:
            pieces.append(_Piece(held))
        # However many folders are left, they are dealt over a bounded number of pieces.
        deals = min(len(queue), _PIECES)
        return pieces + [_Piece([_Part(folder, True) for folder in queue[i::deals]]) for i in range(deals)]

    def _walk(self, filesystem, root: str, part: _Part) -> Iterator:
        folders, files = self._list(filesystem, root, part.folder)
        for info in files:
            name = posixpath.basename(info.path)
            if (part.first is None or name >= part.first) and (part.end is None or name < part.end):
                yield info
        stack = folders if part.deep else []
        while stack:
            more, files = self._list(filesystem, root, stack.pop())
            stack.extend(more)
            yield from files

    def read(self, piece: _Piece):
        import pyarrow as pa

        filesystem, root = open_folder(self.path)
        schema = pa.schema(
            [("file", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]
        )
        rows, held = [], 0
        for info in (i for part in piece.parts for i in self._walk(filesystem, root, part)):
            content = None
            if self._opened(info.path):
                try:
                    with filesystem.open_input_stream(info.path) as stream:
                        content = stream.read().decode("utf-8", errors="replace")
                except OSError:
                    pass
            rows.append((posixpath.relpath(info.path, root), content, info.size, info.mtime))
            held += self._cost(info)
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
