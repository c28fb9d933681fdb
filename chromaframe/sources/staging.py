"""Files that tasks of a data source writer put aside, and that its commit alone brings to their place."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


#: How often the removal of a folder is tried again.
ATTEMPTS = 20


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written, as (place in the staging folder, name)."""

    files: list[tuple[str, str]]


class Staging:
    """A folder beside the files to come, of one job. Every attempt of a task has its own place in it, so one that is lost leaves nothing behind.

    The driver makes the folder, and no task does: what still runs when a write has been aborted fails at its next file.
    """

    def __init__(self, path: str):
        self.path = path
        self.folder = f"_temporary-{uuid.uuid4().hex}"
        system, root = filesystem(path)
        system.create_dir(f"{root}/{self.folder}", recursive=True)

    def attempt(self) -> StagedFiles:
        return StagedFiles(self, f"{self.folder}/{uuid.uuid4().hex}")

    def commit(self, messages: list[Staged | None], overwrite: bool) -> None:
        system, root = filesystem(self.path)
        names = [name for m in messages if m for _, name in m.files]
        if len(set(names)) < len(names):
            self.abort()
            raise ValueError("two rows have one file name")
        if overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.is_file:
                    system.delete_file(old.path)
        for m in messages:
            for place, name in m.files if m else []:
                system.move(f"{root}/{place}", f"{root}/{name}")
        self.abort()

    def abort(self) -> None:
        """Removes the folder. It is renamed first, so that tasks that still run cannot add files while it is emptied."""
        system, root = filesystem(self.path)
        gone = f"{root}/{self.folder}-gone"
        if system.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            system.move(f"{root}/{self.folder}", gone)
        for left in range(ATTEMPTS, -1, -1):  # a file whose making had begun may appear in between
            if system.get_file_info(gone).type == fs.FileType.NotFound:
                return
            try:
                system.delete_dir(gone)
            except OSError:
                if not left:
                    raise
                time.sleep(0.1)


class StagedFiles:
    """Files of one attempt."""

    def __init__(self, staging: Staging, place: str):
        self.system, self.root = filesystem(staging.path)
        self.place, self.files = place, []
        self.system.create_dir(f"{self.root}/{place}", recursive=False)

    def add(self, name: str, content: bytes) -> None:
        if not name or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"not a file name: {name!r}")
        with self.system.open_output_stream(f"{self.root}/{self.place}/{len(self.files)}") as out:
            out.write(content)
        self.files.append((f"{self.place}/{len(self.files)}", name))

    def message(self) -> Staged:
        return Staged(self.files)
