"""The change feed of a git repository as Python data sources, batch and streaming.

``spark.dataSource.register(GitPages)`` then ``spark.read.format("git_pages")``
with options ``root`` (a path every executor reaches), ``since`` (a commit, or none
for all pages) gives (page_ref, date, content, deleted) as of HEAD.  As a stream,
the offset is the commit last seen.  Only names and dates are listed where the plan
is made; contents are read by the tasks, each a share of the paths.

``git_raw`` gives (raw_rel, date, dirty) rows of the raw files: one for each commit of
each file, and one for each file that differs from HEAD.  A task has a folder of
``raw``; where the plan is made only these folders are named.
"""

from __future__ import annotations

import os
import re
import subprocess
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

_PAGE = re.compile(r"^wiki/[^/]*/[^/]*\.md$")


def _git(root: str, *args: str, asked: bytes | None = None) -> bytes:
    run = ["git", "-c", "core.quotePath=false", "-C", root, *args]
    return subprocess.run(run, input=asked, capture_output=True, check=True, env={**os.environ, "TZ": "UTC"}).stdout


def head(root: str) -> str:
    """The commit at HEAD, "" where there is none."""
    try:
        return _git(root, "rev-parse", "HEAD").decode().strip()
    except subprocess.CalledProcessError:
        return ""


def is_work_tree(root: str) -> bool:
    """R-10."""
    try:
        return _git(root, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except (subprocess.CalledProcessError, OSError):
        return False


def known(root: str, sha: str) -> bool:
    """Whether a commit is there to walk from."""
    return bool(sha) and subprocess.run(["git", "-C", root, "cat-file", "-e", f"{sha}^{{commit}}"], capture_output=True).returncode == 0


def dates(root: str, span: str) -> dict[str, str]:
    """A-08, R-07: by page the greatest author date of its non-merge commits in a span."""
    latest: dict[str, int] = {}
    at = 0
    for line in _git(root, "log", "--no-merges", "--format=%x01%at", "--name-only", "--no-renames", span).decode().splitlines():
        if line.startswith("\x01"):
            at = int(line[1:])
        elif _PAGE.match(line):
            latest[line] = max(at, latest.get(line, 0))
    return {p: datetime.fromtimestamp(t, UTC).strftime("%Y-%m-%d") for p, t in latest.items()}


class Share(InputPartition):
    def __init__(self, root: str, commit: str, paths: list[tuple[str, str]]):
        super().__init__(0)
        self.root, self.commit, self.paths = root, commit, paths


def shares(root: str, commit: str, since: str, size: int = 500) -> list[Share]:
    """R-05, R-06: all pages, or those touched by what HEAD has and ``since`` lacks."""
    if not commit:
        return []
    if known(root, since):
        dated = dates(root, f"{since}..{commit}")
        touched = {p for p in _git(root, "diff", "--name-only", "--no-renames", since, commit).decode().splitlines() if _PAGE.match(p)}
        paths = sorted({p: dated.get(p, "") for p in touched | dated.keys()}.items())
    else:
        dated = dates(root, commit)
        paths = [(p, dated.get(p, "")) for p in sorted(_git(root, "ls-tree", "-r", "--name-only", commit).decode().splitlines()) if _PAGE.match(p)]
    return [Share(root, commit, paths[k : k + size]) for k in range(0, len(paths), size)]


def rows(share: Share):
    """A share's pages, by one git process: what is asked for is told in that order."""
    told = _git(share.root, "cat-file", "--batch", asked="".join(f"{share.commit}:{p}\n" for p, _ in share.paths).encode())
    at = 0
    for path, date in share.paths:
        end = told.index(b"\n", at)
        line, at = told[at:end], end + 1
        if line.endswith(b" missing"):
            yield path, date, None, True
        else:
            size = int(line.rsplit(b" ", 1)[1])
            yield path, date, told[at : at + size].decode("utf-8", "replace"), False
            at += size + 1


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.root, self.since = options["root"], options.get("since", "")

    def partitions(self):
        return shares(self.root, head(self.root), self.since)

    def read(self, partition):
        return rows(partition) if isinstance(partition, Share) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.since = options["root"], options.get("since", "")

    def initialOffset(self):
        return {"head": self.since}

    def latestOffset(self):
        return {"head": head(self.root)}

    def partitions(self, start, end):
        return shares(self.root, end["head"], start["head"]) if start != end else []

    def read(self, partition):
        return rows(partition) if isinstance(partition, Share) else iter(())


class GitPages(DataSource):
    @classmethod
    def name(cls):
        return "git_pages"

    def schema(self):
        return "page_ref string, date string, content string, deleted boolean"

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


class Folder(InputPartition):
    def __init__(self, spec: str):
        super().__init__(0)
        self.spec = spec


class _Raw(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]

    def partitions(self):
        raw = os.path.join(self.root, "raw")
        below = sorted(d.name for d in os.scandir(raw) if d.is_dir()) if os.path.isdir(raw) else []
        # Of folders that are gone only the history knows; their files are no candidates.
        return [Folder(":(glob)raw/*"), *(Folder(f":(literal)raw/{name}") for name in below)]

    def read(self, partition):
        if not isinstance(partition, Folder) or not head(self.root):
            return
        # R-08: merges count too, each against every parent.
        at = ""
        for entry in _git(self.root, "log", "-z", "-m", "--format=%x01%ad", "--date=format-local:%Y-%m-%d", "--name-only", "--", partition.spec).decode("utf-8", "replace").split("\0"):
            for line in entry.lstrip("\n").split("\n\n") if entry.startswith("\x01") else [entry.lstrip("\n")]:
                if line.startswith("\x01"):
                    at = line[1:].strip()
                elif line:
                    yield line, at, False
        # R-09: a line is two letters, a space and the path; of a rename the old path follows.
        told = iter(_git(self.root, "status", "--porcelain", "-z", "-uall", "--", partition.spec).decode("utf-8", "replace").split("\0"))
        for entry in told:
            if entry:
                yield entry[3:], None, True
                if entry[0] in "RC":
                    yield next(told), None, True


class GitRaw(DataSource):
    @classmethod
    def name(cls):
        return "git_raw"

    def schema(self):
        return "raw_rel string, date string, dirty boolean"

    def reader(self, schema):
        return _Raw(self.options)
