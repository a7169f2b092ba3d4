"""Ignore files: patterns by directory that exclude entries of a tree.

The rules are git's: the last matching pattern decides, `!` includes again, a slash at the end asks
for a directory, one elsewhere ties the pattern to its directory, `**` spans directories. An ignored
directory is never read. The ignore file itself is never ignored; a directory of its name can be."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: The ignore file's name: a parameter.
FILE_NAME = ".treeignore"


def glob_regex(glob: str) -> str:
    """One path part's glob as a regex."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(glob):
            out += re.escape(glob[i])
            i += 1
        elif c == "[" and (end := glob.find("]", i + (glob[i : i + 1] in ("!", "^", "]")))) > 0:
            inner = glob[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[:1] in ("!", "^") else inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(regex over the path from the pattern's directory, directories only, includes again); None for no pattern."""
    line = line.removesuffix("\r")
    if line.startswith("#") or not line.strip():
        return None
    again = line.startswith("!")
    line = line[again:].lstrip("\\") if line[again:].startswith("\\!") or line[again:].startswith("\\#") else line[again:]
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    only_dirs = line.endswith("/")
    line = line.rstrip("/") if only_dirs else line
    tied = "/" in line
    parts = line.lstrip("/").split("/")
    regex = "" if tied else "(?:.*/)?"
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**":
            regex += ".*" if last else "(?:.*/)?"
        else:
            regex += glob_regex(part) + ("" if last else "/")
    return re.compile(regex + r"\Z", re.DOTALL), only_dirs, again


class Matcher:
    """The patterns in force in a directory: those of its parents and its own."""

    def __init__(self, path: tuple[str, ...] = (), patterns: tuple = ()):
        self.path, self.patterns = path, patterns

    def descend(self, name: str | None, text: str | None) -> Matcher:
        """For the directory `name` below (None: this one), whose ignore file holds `text`."""
        path = self.path if name is None else (*self.path, name)
        found = [p for p in map(pattern, (text or "").split("\n")) if p]
        return Matcher(path, (*self.patterns, *((len(path), p) for p in found)))

    def ignored(self, name: str, is_dir: bool) -> bool:
        if name == FILE_NAME and not is_dir:
            return False
        whole = (*self.path, name)
        for depth, (regex, only_dirs, again) in reversed(self.patterns):
            if only_dirs and not is_dir:
                continue
            if regex.match("/".join(whole[depth:])):
                return not again
        return False


def kept(files: DataFrame, path: str, rules: dict[tuple[str, ...], str]) -> DataFrame:
    """The rows whose path, of parts joined by slashes, no ignore file excludes, nor any directory above it.

    rules: the text of the ignore file of each directory that has one, by its path's parts."""
    at = files.columns.index(path)

    def read(batches):
        known: dict[tuple[str, ...], Matcher | None] = {}

        def below(parts: tuple[str, ...]) -> Matcher | None:
            """The patterns in force in a directory; None if it is ignored itself."""
            if parts not in known:
                if len(known) > 100_000:
                    known.clear()
                above = below(parts[:-1]) if parts else Matcher()
                if parts and (above is None or above.ignored(parts[-1], True)):
                    known[parts] = None
                else:
                    known[parts] = above.descend(parts[-1] if parts else None, rules.get(parts))
            return known[parts]

        for b in batches:
            keep = []
            for x in b.column(at).to_pylist():
                *folder, name = x.split("/")
                m = below(tuple(folder))
                keep.append(m is not None and not m.ignored(name, False))
            yield b.filter(pa.array(keep, pa.bool_()))

    return files.mapInArrow(read, files.schema)
