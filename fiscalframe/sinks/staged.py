"""Replacing several outputs together: new ones are written aside and take their places once all are there."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import SparkSession


class _Folder:
    """The file system of a path, whichever Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def move(self, source: str, target: str) -> None:
        # Some file systems tell a failure, others raise it.
        if not self._system.rename(self._path(source), self._path(target)):
            raise OSError(f"Impossibile spostare '{source}' in '{target}'.")

    def delete(self, path: str) -> None:
        self._system.delete(self._path(path), True)


@contextmanager
def replacing(spark: SparkSession, targets: Sequence[str]) -> Iterator[list[str]]:
    """Gives a place beside each target to write it to; at the end they replace the targets, all or none.

    If anything fails, while writing or while replacing, the old outputs are where they were, and
    what was written is deleted.  The places have hidden names, so a reader of the folder does not see them.
    Only the moves themselves, a moment each, can be seen one after the other.
    """
    mark = uuid4().hex
    aside = [posixpath.join(posixpath.dirname(t), f"_{posixpath.basename(t)}.{mark}.new") for t in targets]
    old = [posixpath.join(posixpath.dirname(t), f"_{posixpath.basename(t)}.{mark}.old") for t in targets]
    systems = [_Folder(spark, t) for t in targets]
    undo = []
    try:
        yield aside
        for system, target, new, kept in zip(systems, targets, aside, old, strict=True):
            if system.exists(target):
                system.move(target, kept)
                undo.append((system, kept, target))
            system.move(new, target)
            undo.append((system, target, new))
    except BaseException:
        for system, now, before in reversed(undo):
            system.move(now, before)
        raise
    else:
        for system, kept in zip(systems, old, strict=True):
            system.delete(kept)
        for target in targets:
            spark.catalog.refreshByPath(target)
    finally:
        for system, new in zip(systems, aside, strict=True):
            system.delete(new)
