"""Numbers that tasks of one job leave for those of the next: a file a block in a folder below the shared checkpoint folder.

Tasks read and write through pyarrow (local or mounted paths, ``file:``, ``hdfs:``, ``s3:``, ``gs:``, ``abfs:``). A file is there as a whole or
not at all, and a task that runs again writes the same bytes. The folder belongs to its job, which deletes what it no longer needs.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and ":/" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":/", ":///", 1))


class Folder:
    """Files of bytes by name below ``uri``."""

    def __init__(self, uri: str):
        self.uri = uri

    def create(self) -> Folder:
        system, root = _opened(self.uri)
        system.create_dir(root, recursive=True)
        return self

    def write(self, name: str, *parts: np.ndarray | bytes) -> None:
        system, root = _opened(self.uri)
        new = f"{root}/{name}.{uuid.uuid4().hex}"
        with system.open_output_stream(new) as f:
            for p in parts:
                f.write(p if isinstance(p, bytes) else np.ascontiguousarray(p).data)
        try:
            system.move(new, f"{root}/{name}")
        except OSError:  # where a move does not replace: an earlier attempt has left the same bytes
            if system.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                raise
            system.delete_file(new)

    def read(self, name: str):
        """The file as a buffer."""
        system, root = _opened(self.uri)
        with system.open_input_file(f"{root}/{name}") as f:
            return f.read_buffer()

    def delete(self, names: list[str] | None = None) -> None:
        """The named files that are there, or the folder."""
        system, root = _opened(self.uri)
        if names is None:
            system.delete_dir(root)
            return
        for info in system.get_file_info([f"{root}/{x}" for x in names]):
            if info.type == fs.FileType.File:
                system.delete_file(info.path)
