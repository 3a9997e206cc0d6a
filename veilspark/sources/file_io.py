"""The functions that run in Python workers: list one directory, read some files, write some."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# Workers receive these functions by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_BATCH_BYTES = 32 << 20


def open_fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _place(inner: str, path: str, root: str) -> str:
    """Where a listed path is inside the store. Only the root is parsed as a URI: names may hold any character."""
    return inner.rstrip("/") + path[len(root.rstrip("/")) :] or "/"


def list_children(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """One directory level; names leave the task in small batches. Links to directories are not followed."""
    from pyarrow import fs

    store, inner = open_fs(root)
    local = isinstance(store, fs.LocalFileSystem)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            infos = store.get_file_info(fs.FileSelector(_place(inner, path, root), recursive=False))
            infos = [i for i in infos if i.type in (fs.FileType.File, fs.FileType.Directory)]
            infos = [i for i in infos if not (local and i.type == fs.FileType.Directory and os.path.islink(i.path))]
            for start in range(0, len(infos), 10_000):
                part = infos[start : start + 10_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [f"{path.rstrip('/')}/{i.base_name}" for i in part],
                        "is_dir": [i.type == fs.FileType.Directory for i in part],
                        "length": pa.array([i.size for i in part], pa.int64()),
                    }
                )


def read_bytes(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """File contents; a batch is handed over when it holds enough bytes."""

    def flush(paths, contents, lengths):
        return pa.RecordBatch.from_pydict(
            {"path": paths, "content": pa.array(contents, pa.binary()), "length": pa.array(lengths, pa.int64())}
        )

    paths, contents, lengths, held = [], [], [], 0
    store, inner = open_fs(root)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                with store.open_input_stream(_place(inner, path, root)) as f:
                    data = f.read()
            except OSError:
                data = None  # unreadable: kept as a row without content
            paths.append(path)
            contents.append(data)
            lengths.append(None if data is None else len(data))
            held += len(data or b"")
            if held >= _BATCH_BYTES:
                yield flush(paths, contents, lengths)
                paths, contents, lengths, held = [], [], [], 0
    if paths:
        yield flush(paths, contents, lengths)


# What Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""")


def write_folders(batches: Iterator[pa.RecordBatch], root: str, by: str) -> Iterator[pa.RecordBatch]:
    """Rows ``(name, bytes)`` in order of their names: the texts of a name as the lines of one file in its folder ``by=name``.

    A task that runs again writes the same files. Each batch gives the number of files that it begins.
    """
    from pyspark import TaskContext

    store, inner = open_fs(root)
    part = f"part-{TaskContext.get().partitionId():05d}-0.txt"
    last, file = None, None
    try:
        for batch in batches:
            begun = 0
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file is None or name != last:
                    if file is not None:
                        file.close()
                    value = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", name) or "__HIVE_DEFAULT_PARTITION__"
                    folder = f"{inner.rstrip('/')}/{by}={value}"
                    store.create_dir(folder)
                    last, file, begun = name, store.open_output_stream(f"{folder}/{part}"), begun + 1
                file.write((text or b"") + b"\n")
            yield pa.RecordBatch.from_pydict({"files": pa.array([begun], pa.int64())})
    finally:
        if file is not None:
            file.close()


def _line_start(f, at: int, stop: int) -> int:
    """The first line start at or behind ``at``, a newline's place and one; ``stop`` if there is none before it."""
    if at <= 0:
        return 0
    f.seek(at - 1)
    place = at - 1
    while place < stop:
        data = f.read(min(_PEEK, stop - place))
        if not data:
            return stop
        found = data.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(data)
    return stop


_PEEK = 1 << 16


def read_ranges(batches: Iterator[pa.RecordBatch], root: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Of files the lines that start in ``[start, start + max_bytes)``: ``(path, start, content, length)``.

    A line belongs to the range that it starts in, however long it is; a range in which none starts has no row.
    """
    store, inner = open_fs(root)
    for batch in batches:
        for path, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                with store.open_input_file(_place(inner, path, root)) as f:
                    stop = start + max_bytes
                    begin = _line_start(f, start, min(stop, length))
                    if begin >= min(stop, length) and start:
                        continue
                    end = _line_start(f, stop, length) if stop < length else length
                    f.seek(begin)
                    data = f.read(end - begin)
            except OSError:
                data = None
            yield pa.RecordBatch.from_pydict({
                "path": [path], "start": pa.array([start], pa.int64()), "content": pa.array([data], pa.binary()),
                "length": pa.array([None if data is None else len(data)], pa.int64()),
            })
