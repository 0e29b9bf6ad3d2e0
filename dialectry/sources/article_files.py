"""A sink of one file a row, committed as a whole: tasks write into a staging folder, and the driver renames that folder."""

from __future__ import annotations

import os
import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class FileWriter(DataSourceWriter):
    """Each attempt of a task writes a file aside and renames it to its name in the staging folder.

    A repeated attempt has the same rows and replaces whole files by equal ones; nobody sees the staging folder before the commit.
    """

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def _open(self, path: str):
        uri = path if "://" in path else f"file://{os.path.abspath(path.removeprefix('file:'))}"
        return pafs.FileSystem.from_uri(uri)

    def write(self, iterator):
        system, base = self._open(self.staging)
        attempt = str(TaskContext.get().taskAttemptId())
        folders, files, out, name = set(), 0, None, None
        aside = posixpath.join(base, f".attempt-{attempt}")

        def close():
            nonlocal out
            if out is not None:
                out.close()
                system.move(aside, name)
                out = None

        system.create_dir(base, recursive=True)
        for folder, file, text in iterator:
            if any(x in (None, "", ".", "..") or "/" in x for x in (folder, file)):
                raise ValueError(f"not a file name: {folder!r}, {file!r}")
            new = posixpath.join(base, folder, file + self.suffix)
            if new != name:
                close()
                if folder not in folders:
                    system.create_dir(posixpath.join(base, folder), recursive=True)
                    folders.add(folder)
                name, out, files = new, system.open_output_stream(aside), files + 1
            out.write(text.encode() + b"\n")
        close()
        return Written(attempt, files)

    def commit(self, messages):
        system, base = self._open(self.staging)
        target = self._open(self.path)[1]
        old = system.get_file_info(target).type != pafs.FileType.NotFound
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} exists")
        system.create_dir(base, recursive=True)
        if old:
            system.move(target, f"{base}-old")
        system.move(base, target)
        if old:
            system.delete_dir(f"{base}-old")

    def abort(self, messages):
        system, base = self._open(self.staging)
        if system.get_file_info(base).type != pafs.FileType.NotFound:
            system.delete_dir(base)


class ArticleFiles(DataSource):
    """``format("article_files")``: rows (folder, file, text), sorted by folder and file within a partition, as ``folder/file.txt`` under ``path``."""

    @classmethod
    def name(cls):
        return "article_files"

    def writer(self, schema, overwrite):
        if [f.name for f in schema.fields] != ["folder", "file", "text"]:
            raise ValueError("the columns must be folder, file and text")
        return FileWriter(self.options["path"], self.options.get("suffix", ".txt"), overwrite)
