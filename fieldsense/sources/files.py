"""Small file operations through Hadoop, on whatever file system a path lies."""

from __future__ import annotations

import os
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, asked of the file system it lies on."""
    fs, p = _at(spark, path)
    return fs.exists(p)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` (none when it is missing)."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    """Remove ``path`` with all below it; nothing happens where it is missing."""
    fs, p = _at(spark, path)
    fs.delete(p, True)


SHELL_SPECIAL = frozenset("*?[]{}^\\\n\r")     # a name with one of these would be a pattern to the shell


def _shell(spark: SparkSession, args: list[str], paths: list[str], *last: str) -> list[str]:
    """One call of Hadoop's file shell for many paths; returns those it did not
    take away (names that are patterns to it are not tried)."""
    plain = [p for p in paths if not SHELL_SPECIAL.intersection(p)]
    if len(paths) < 2 or not plain or any(SHELL_SPECIAL.intersection(x) for x in last):
        return paths
    shell = spark._jvm.org.apache.hadoop.fs.FsShell(spark._jsparkSession.sessionState().newHadoopConf())
    words = spark._jvm.org.apache.commons.lang3.StringUtils.split("\n".join([*args, *plain, *last]), "\n")
    if shell.run(words) != 0:
        return paths                # some stayed: each is looked at, those that are gone are done
    return [p for p in paths if SHELL_SPECIAL.intersection(p)]


def delete_in_bulk(spark: SparkSession, paths: list[str]) -> list[str]:
    """Remove many files at once; returns those that are still there."""
    return _shell(spark, ["-rm", "-f", "-skipTrash"], paths)


def move_in_bulk(spark: SparkSession, paths: list[str], folder: str) -> list[str]:
    """Move many files into ``folder`` at once, each whose name is free there (no
    file is ever replaced); returns those that are still where they were."""
    fs, target = _at(spark, folder)
    fs.mkdirs(target)
    return _shell(spark, ["-mv"], paths, folder)


def local_disposal(folder: str | None):
    """A function that deletes one local file or, with ``folder``, moves it there as
    ``move_aside`` does. Tasks call it: it needs no Spark and nothing of this package.

    A file gets its new name as a link before it loses the old one, so none is ever
    replaced, and a move that was cut short in between is finished by the next."""
    def checksum(path):                     # where Hadoop's local file system keeps it, if it wrote the file
        at, _, name = path.rpartition("/")
        return f"{at}/.{name}.crc"

    def delete_local(path):
        for p in (path, checksum(path)):
            with suppress(FileNotFoundError):
                os.unlink(p)

    def move_local(path):
        name, n = path.rpartition("/")[2], 0
        stem, dot, suffix = name.rpartition(".")
        if not dot:
            stem, suffix = name, ""
        while True:
            goal = f"{folder}/{stem}_{n}{dot}{suffix}" if n else f"{folder}/{name}"
            try:
                os.link(path, goal, follow_symlinks=False)
                break
            except FileExistsError:
                with suppress(FileNotFoundError):
                    if os.path.samestat(os.lstat(path), os.lstat(goal)):
                        break
                n += 1
            except FileNotFoundError:
                if os.path.lexists(path):
                    raise                   # the folder is missing
                return                      # gone already
        try:
            os.replace(checksum(path), checksum(goal))
        except FileNotFoundError:
            with suppress(FileNotFoundError):
                os.unlink(checksum(goal))   # of a file that lay there before
        with suppress(FileNotFoundError):
            os.unlink(path)

    return delete_local if folder is None else move_local


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None where it is missing."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that readers see the old or the new text, never a
    part: written aside, then renamed over the old one."""
    fs, p = _at(spark, path)
    jvm = spark._jvm
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark._jsparkSession.sessionState().newHadoopConf())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(aside), fs.makeQualified(p), options)


def move_aside(spark: SparkSession, path: str, folder: str) -> str | None:
    """Move a file into ``folder`` under its own name, or with ``_1``, ``_2`` ...
    before the suffix where that name is taken. Returns the new path, or None
    when the file is gone already."""
    fs, p = _at(spark, path)
    target_fs, target = _at(spark, folder)
    if not fs.exists(p):
        return None
    target_fs.mkdirs(target)
    stem, dot, suffix = p.getName().rpartition(".")
    if not dot:
        stem, suffix = p.getName(), ""
    n = 0
    while True:
        name = p.getName() if not n else f"{stem}_{n}{dot}{suffix}"
        goal = spark._jvm.org.apache.hadoop.fs.Path(target, name)
        if not target_fs.exists(goal) and fs.rename(p, goal):
            return goal.toString()
        if not fs.exists(p):
            return None
        if not target_fs.exists(goal):
            raise OSError(f"could not move {path} to {goal.toString()}")
        n += 1
