"""A file system tree as a DataFrame: one row a path, with lstat's columns and extended attributes.

The listing is read level by level: the directories of a level are dealt to tasks, which apply the
ignore rules of their ancestors and read nothing of an ignored directory."""

from __future__ import annotations

import errno
import os
import stat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.scratch import Scratch

from treeloom.sources.ignore import FILE_NAME, Matcher

SCHEMA = "path string, parent string, name binary, is_dir boolean, mode long, uid long, gid long, mtime_ns long, size long, link_target binary, rdev struct<major:long,minor:long>, xattrs map<binary,binary>"


def read_xattrs(path: str) -> dict[bytes, bytes]:
    """Extended attributes; a file system without them has none, other errors are raised."""
    try:
        return {n.encode("utf-8", "surrogateescape"): os.getxattr(path, n, follow_symlinks=False) for n in os.listxattr(path, follow_symlinks=False)}
    except OSError as e:
        if e.errno in (errno.ENOTSUP, errno.ENOSYS):
            return {}
        raise


def row(root: str, path: str, name: bytes) -> dict:
    """lstat's columns; path is relative to root."""
    full = os.path.join(root, path) if path else root
    st = os.lstat(full) if path else os.stat(full)
    kind = stat.S_IFMT(st.st_mode)
    device = kind in (stat.S_IFCHR, stat.S_IFBLK)
    return {
        "path": path,
        "parent": None if not path else os.path.dirname(path),
        "name": name,
        "is_dir": kind == stat.S_IFDIR,
        "mode": st.st_mode,
        "uid": st.st_uid,
        "gid": st.st_gid,
        "mtime_ns": st.st_mtime_ns,
        "size": st.st_size,
        "link_target": os.readlink(os.fsencode(full)) if kind == stat.S_IFLNK else None,
        "rdev": {"major": os.major(st.st_rdev), "minor": os.minor(st.st_rdev)} if device else None,
        "xattrs": {} if kind == stat.S_IFLNK else read_xattrs(full),
    }


def matcher_of(root: str, path: str, use: bool) -> Matcher:
    """The ignore rules in force in a directory."""

    def text(p: str) -> str | None:
        try:
            with open(os.path.join(root, p, FILE_NAME), encoding="utf-8", errors="surrogateescape", newline="") as f:
                return f.read()
        except (FileNotFoundError, NotADirectoryError):
            return None
        except IsADirectoryError:
            return None

    m = Matcher()
    if not use:
        return m
    m = m.descend(None, text(""))
    parts = path.split("/") if path else []
    for i, part in enumerate(parts):
        m = m.descend(part, text("/".join(parts[: i + 1])))
    return m


def list_dir(root: str, path: str, use_ignore: bool = True) -> list[dict]:
    """A directory's rows in bytewise order of their names."""
    m = matcher_of(root, path, use_ignore)
    out = []
    for name in sorted(os.listdir(os.fsencode(os.path.join(root, path)))):
        shown = os.fsdecode(name)
        child = f"{path}/{shown}" if path else shown
        is_dir = stat.S_ISDIR(os.lstat(os.path.join(root, child)).st_mode)
        if not m.ignored(shown, is_dir):
            out.append(row(root, child, name))
    return out


def admit(path: str) -> bool:
    """Whether a source is a directory; a regular file is none, anything else is refused. A link is followed."""
    mode = os.stat(path).st_mode
    if not (stat.S_ISDIR(mode) or stat.S_ISREG(mode)):
        raise ValueError(f"{path}: neither a directory nor a regular file")
    return stat.S_ISDIR(mode)


def tree(spark: SparkSession, root: str, use_ignore: bool = True) -> DataFrame:
    """All paths below root and root itself (the empty path)."""
    is_dir = admit(root)
    level, scratch = spark.createDataFrame([row(root, "", b"")], SCHEMA), Scratch(spark, "tree")
    found = level
    while is_dir:
        dirs = level.where("is_dir").select("path")

        def read(batches, root=root):
            import pandas as pd

            for b in batches:
                rows = [r for p in b["path"] for r in list_dir(root, p, use_ignore)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

        tasks = spark.sparkContext.defaultParallelism
        level = scratch.save(dirs.repartition(tasks).mapInPandas(lambda it, f=read: f(it), SCHEMA), "level")
        found = found.unionByName(level)
        is_dir = not level.where("is_dir").isEmpty()
    return found


def totals(files: DataFrame) -> DataFrame:
    """Count and size of the regular files of a tree."""
    regular = F.col("mode").bitwiseAND(F.lit(stat.S_IFMT(0xFFFF))) == stat.S_IFREG
    return files.where(regular).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
