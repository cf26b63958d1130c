"""Arrays in files of the shared folder: written by one task, mapped or read by many."""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

#: Arrays that a worker keeps open; where the folder is no file system of this machine they are in memory, so they are few.
KEPT_MAPS, KEPT_BYTES = 4096, 256 << 20
_open: OrderedDict[str, np.ndarray] = OrderedDict()


def save(folder: str, *arrays: np.ndarray) -> str:
    """Write arrays to a new file each; their common name.  A task that is run again writes another name."""
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    name = uuid.uuid4().hex
    for i, array in enumerate(arrays):
        out = io.BytesIO()
        np.save(out, array)
        with store.open_output_stream(f"{base}/{name}.{i}.npy") as stream:
            stream.write(out.getbuffer())
    return name


def load(folder: str, name: str, i: int) -> np.ndarray:
    """An array as a memory map, or read into memory where the folder isn't a file system of this machine."""
    key = f"{folder}/{name}.{i}"
    if key in _open:
        _open.move_to_end(key)
        return _open[key]
    store, base = fs.FileSystem.from_uri(folder)
    path = f"{base}/{name}.{i}.npy"
    if isinstance(store, fs.LocalFileSystem):
        found = np.load(path, mmap_mode="r")
    else:
        with store.open_input_file(path) as file:
            found = np.load(io.BytesIO(file.read()))
    _open[key] = found
    while len(_open) > KEPT_MAPS or sum(x.nbytes for x in _open.values() if not isinstance(x, np.memmap)) > KEPT_BYTES and len(_open) > 1:
        _open.popitem(last=False)
    return found
