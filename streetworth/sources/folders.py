"""Folders of files that tasks write by themselves, in any store that Arrow opens."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def listed(path: str, *endings: str) -> list[str]:
    """The file, or all committed files of the folder with one of the endings."""
    store, at = opened(path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [at]
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(at)) if i.path.endswith(endings) and not i.base_name.startswith("_"))


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class FolderWriter(DataSourceArrowWriter):
    """Files under names of their own, which begin with _ and are passed over by readers until the job is committed; so a task that is repeated leaves no rows twice."""

    def __init__(self, path: str, overwrite: bool):
        self.path = path
        store, folder = opened(path)
        if overwrite or store.get_file_info(folder).type != fs.FileType.NotFound:
            raise ValueError(f"{path} exists or should be overwritten; files are written to new folders")

    def file(self, ending: str) -> tuple[str, fs.FileSystem, str]:
        """(name, store, path to write to) of a new file."""
        store, folder = opened(self.path)
        store.create_dir(folder)
        name = f"part-{uuid.uuid4().hex}{ending}"
        return name, store, f"{folder}/_{name}"

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        store.create_dir(folder)
        for name in (n for m in messages if m is not None for n in m.names):
            store.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = opened(self.path)
        for name in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{folder}/_{name}")
