"""Small helpers for tasks that write or read files of the shared folder, whatever file system it is on."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def part_name(folder: str, suffix: str) -> tuple[int, str]:
    """This task's partition number and a file name that no other attempt of the task has."""
    part = TaskContext.get().partitionId()
    return part, f"{folder}/part-{part:06d}-{uuid.uuid4().hex[:12]}.{suffix}"
