"""Files in the folder that driver and executors share, written whole and read memory-mapped."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import pyarrow.fs


class SharedFolder:
    """A folder given as a path or a URI. Made anew from its URI in each process."""

    def __init__(self, uri: str):
        self.uri = uri
        if "://" in uri or uri.startswith("file:"):
            self.store, self.path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[len("file:") :])
        else:
            self.store, self.path = pyarrow.fs.LocalFileSystem(), os.path.abspath(uri)

    def write(self, name: str, data: bytes) -> None:
        """The file appears whole or not at all; a repeated task writes the same again."""
        self.store.create_dir(self.path, recursive=True)
        draft = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        with self.store.open_output_stream(draft) as out:
            out.write(data)
        if isinstance(self.store, pyarrow.fs.LocalFileSystem):
            os.replace(draft, f"{self.path}/{name}")
        else:
            self.store.move(draft, f"{self.path}/{name}")

    def map(self, name: str) -> mmap.mmap:
        """The file's bytes, mapped. From a store without local files it is copied to a file without a name first."""
        if isinstance(self.store, pyarrow.fs.LocalFileSystem):
            with open(f"{self.path}/{name}", "rb") as file:
                return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        with tempfile.TemporaryFile() as copy, self.store.open_input_stream(f"{self.path}/{name}") as source:
            while chunk := source.read(1 << 20):
                copy.write(chunk)
            copy.flush()
            return mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ)
