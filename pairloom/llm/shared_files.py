"""Array files in the shared folder, written by tasks and memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np


def _local(uri: str) -> str | None:
    return uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:") if uri.startswith("file:") else uri if "://" not in uri else None


class Appender:
    """A file of arrays one after another, in its place only once it is whole, so that a repeated attempt does no harm."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name
        if (path := _local(folder)) is not None:
            os.makedirs(path, exist_ok=True)
            self.part = f"{path}/.{name}.{uuid.uuid4().hex}"
            self.file = open(self.part, "wb")
            return
        from pyarrow import fs

        self.store, path = fs.FileSystem.from_uri(folder)
        self.store.create_dir(path, recursive=True)
        self.path, self.part = f"{path}/{name}", f"{path}/.{name}.{uuid.uuid4().hex}"
        self.file = self.store.open_output_stream(self.part)

    def add(self, array: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(array).tobytes())

    def close(self) -> None:
        self.file.close()
        if (path := _local(self.folder)) is not None:
            os.replace(self.part, f"{path}/{self.name}")
        else:
            self.store.move(self.part, self.path)


def save(folder: str, name: str, array: np.ndarray) -> None:
    file = Appender(folder, name)
    file.add(array)
    file.close()


@lru_cache(1)
def _copies() -> tempfile.TemporaryDirectory:
    """A folder of this worker alone, removed when it ends."""
    return tempfile.TemporaryDirectory(prefix="pairloom-")


@lru_cache(maxsize=20_000)
def load(folder: str, name: str, kind: str) -> np.ndarray:
    """The array, mapped read-only; a file of a remote folder is copied to the worker first. Empty files give no items."""
    path = _local(folder)
    if path is None:
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(folder)
        path = f"{_copies().name}/{uuid.uuid5(uuid.NAMESPACE_URL, folder)}"
        os.makedirs(path, exist_ok=True)
        if not os.path.exists(f"{path}/{name}"):
            part = f"{path}/.{uuid.uuid4().hex}"
            with store.open_input_stream(f"{remote}/{name}") as f, open(part, "wb") as g:
                while chunk := f.read(1 << 22):
                    g.write(chunk)
            os.replace(part, f"{path}/{name}")
    if not os.path.getsize(f"{path}/{name}"):
        return np.zeros(0, kind)
    return np.memmap(f"{path}/{name}", kind, "r")
