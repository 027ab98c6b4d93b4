"""Binary files in the shared folder, written and read by tasks.

`file:` paths are opened where they are. Other stores go through Arrow's file systems; arrays of
theirs are fetched to a temporary file that is unlinked as soon as it is mapped.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs


def local_path(path: str) -> str | None:
    """The path on a mounted file system, or None for another store."""
    if path.startswith("file:"):
        return re.sub(r"^file:/*", "/", path)
    return path if path.startswith("/") else None


def put(path: str, content: bytes) -> None:
    """Write whole or not at all: a file is renamed to its name when it is complete. A task that
    runs twice writes the same name again or another one; readers go by the manifest."""
    here = local_path(path)
    if here is None:
        store, name = pafs.FileSystem.from_uri(path)
        store.create_dir(os.path.dirname(name), recursive=True)
        with store.open_output_stream(name) as out:
            out.write(content)
        return
    os.makedirs(os.path.dirname(here), exist_ok=True)
    part = f"{here}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(content)
    os.replace(part, here)


def mapped(path: str, dtype: str) -> np.ndarray:
    """The file as a read-only array, memory-mapped."""
    here = local_path(path)
    if here is not None:
        return np.memmap(here, dtype, "r") if os.path.getsize(here) else np.zeros(0, dtype)
    store, name = pafs.FileSystem.from_uri(path)
    fd, copy = tempfile.mkstemp()
    try:
        with os.fdopen(fd, "wb") as out, store.open_input_stream(name) as source:
            while chunk := source.read(1 << 22):
                out.write(chunk)
        return np.memmap(copy, dtype, "r") if os.path.getsize(copy) else np.zeros(0, dtype)
    finally:
        os.unlink(copy)


def give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task that hands memory which its Python worker keeps for later back to the system: workers
    are used again, and what one stage has freed would count beside what the next one takes."""
    for _ in batches:
        pass
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)
    return
    yield
