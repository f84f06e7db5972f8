"""Files that tasks write and read themselves, in the folder that all executors share, and objects that workers keep.

A task writes under names that no other attempt uses and returns the names as rows; Spark's own commit of those rows decides which
attempt counts, so files of a lost or repeated attempt are never listed and never read.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; plain absolute paths are local. Any scheme that pyarrow knows will do."""
    return fs.FileSystem.from_uri(uri)


def create(folder: str, suffix: str) -> tuple[str, pa.NativeFile]:
    """A new file in the folder: its address and a stream to write it."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}")


def open_file(uri: str) -> pa.NativeFile:
    """A file to read at any place."""
    system, path = located(uri)
    return system.open_input_file(path)


def worker_object(name: str, make: Callable):
    """An object that is made once a worker process and stays for the tasks that it runs later."""
    kept = sys.modules.setdefault("quotelark_worker_objects", types.ModuleType("quotelark_worker_objects")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
