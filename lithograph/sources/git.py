"""Change history of files in a git work tree: blamed lines and commits, a file at a time on the executors.

The work tree must be at the same path on every executor, on a shared file system.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_BLAME = "file string, line int, commit string, author string, email string, commit_time long, author_time long, message string"


def repository_root(path: str) -> str | None:
    """The nearest folder, path or above, with a .git folder; None without one.  A .git file, as worktrees have, doesn't count."""
    at = os.path.abspath(path)
    while not os.path.isdir(os.path.join(at, ".git")):
        if at == os.path.dirname(at):
            return None
        at = os.path.dirname(at)
    return at


def _git(root: str, *args: str) -> str:
    """What git prints; empty where it fails."""
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True)
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def _blamed(file: str, porcelain: str) -> Iterator[tuple]:
    head: dict[str, str] = {}
    commit, line = "", 0
    for text in porcelain.split("\n"):
        if text.startswith("\t"):  # the line itself ends its entry
            mail = head.get("author-mail", "").strip("<>")
            yield file, line, commit, head.get("author"), mail, int(head.get("committer-time", 0)), int(head.get("author-time", 0)), head.get("summary")
            head = {}
        elif not head:
            parts = text.split(" ")
            if len(parts) >= 3:
                commit, line = parts[0], int(parts[2])
                head = {"": ""}
        else:
            name, _, value = text.partition(" ")
            head[name] = value


def blame_lines(files: DataFrame, root: str, column: str = "file") -> DataFrame:
    """(file, line, commit, author, email, commit_time, author_time, message) of each distinct path in files.

    Renames are followed.  A path that git can't blame, or a null one, gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in _BLAME.split(", ")]
        for pdf in batches:
            for file in pdf["file"]:
                yield pd.DataFrame(list(_blamed(file, _git(root, "blame", "--line-porcelain", "--", file))), columns=names)

    return files.select(files[column].alias("file")).where("file is not null").distinct().mapInPandas(run, _BLAME)


def file_commits(files: DataFrame, root: str, column: str = "file") -> DataFrame:
    """(file, commit) of each commit that touched a distinct path of files, renames not followed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file in pdf["file"]:
                found = _git(root, "log", "--format=%H", "--", file).split()
                yield pd.DataFrame({"file": [file] * len(found), "commit": found}, dtype=object)

    return files.select(files[column].alias("file")).where("file is not null").distinct().mapInPandas(run, "file string, commit string")
