"""Git repositories as tables: spark.read.format("git").option("repository", ...).option("relation", ...).load().

Relations: files (tracked *.py and their working-tree content), commits, changes (numstat), name_status, patches, blame.
Each partition runs git where its task runs, so the repository's path must be one that every executor sees. files (by
number and bytes), name_status, patches and blame are cut into one partition per chunk of paths, commits or lines; commits
and changes are one walk of git's own, bounded by since, until a tip, and limit.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Paths, commits or lines that one partition handles, and bytes of files from which on it takes no further one.
CHUNK, CHUNK_BYTES = 256, 1 << 16

SCHEMAS = {
    "files": "path string, content binary, error string",
    "commits": "seq long, commit string, parents array<string>, committed long, author_name string, author_email string, subject string",
    "changes": "seq long, commit_seq long, commit string, committed long, path string, additions long, deletions long, previous_path string",
    "name_status": "commit string, seq long, status string, path string, previous_path string",
    "patches": "commit string, parent string, patch binary",
    "blame": "revision string, path string, line long, commit string, source_path string, source_line long, text string, status string",
}


class GitError(RuntimeError):
    """git ended with a status other than 0, or could not be started."""

    def __init__(self, command: tuple[str, ...], returncode: int | None, stderr: str):
        super().__init__(stderr or "git failed")
        self.command, self.returncode, self.stderr = command, returncode, stderr

    def __reduce__(self):
        return GitError, (self.command, self.returncode, self.stderr)


def git(repository: str, *arguments: str) -> bytes:
    command = ("git", "-C", repository, *arguments)
    try:
        done = subprocess.run(command, capture_output=True)
    except OSError as e:
        raise GitError(command, None, str(e)) from e
    if done.returncode:
        raise GitError(command, done.returncode, done.stderr.decode(errors="replace").strip())
    return done.stdout


def fields(raw: bytes) -> list[str]:
    """The NUL-ended fields of git's -z output."""
    return raw.decode("utf-8", "replace").split("\0")[:-1]


def root_of(path: str) -> str:
    """The working tree's root; GitError where there is none."""
    return git(path, "rev-parse", "--show-toplevel").decode().removesuffix("\n")


def safe_path(path: str) -> str:
    """A relative POSIX path without steps upward; ValueError for any other."""
    pure = PurePosixPath(path)
    if not path or "\\" in path or pure.is_absolute() or ".." in pure.parts:
        raise ValueError(f"not a relative path inside the repository: {path!r}")
    return str(pure)


def walk_arguments(options: dict[str, str]) -> list[str]:
    """Bounds of a walk: newest first, one commit more than the limit, so that the caller sees whether there are more."""
    bounds = [f"--max-count={int(options['limit']) + 1}"] if options.get("limit") else []
    bounds += [f"--since=@{int(options['since'])} +0000"] if options.get("since") else []
    paths = [p for p in options.get("paths", "").split(",") if p]
    return ["--date-order", *bounds, options.get("tip") or "HEAD", *(["--", *paths] if paths else [])]


def log(repository: str, options: dict[str, str], *how: str) -> bytes:
    """git log under the options' bounds; nothing for a repository without commits."""
    try:
        return git(repository, "log", *how, *walk_arguments(options))
    except GitError as e:
        if "HEAD" in e.stderr and not options.get("tip") and ("bad revision" in e.stderr or "does not have any commits" in e.stderr or "unknown revision" in e.stderr):
            return b""
        raise


def read_commits(repository: str, options: dict[str, str], _: list) -> Iterator[tuple]:
    found = fields(log(repository, options, "-z", "--format=%H%x00%P%x00%ct%x00%an%x00%ae%x00%s"))
    if len(found) % 6:
        raise GitError(("git", "log"), 0, "a commit's record is not whole")
    for seq in range(len(found) // 6):
        sha, parents, committed, name, email, subject = found[6 * seq : 6 * seq + 6]
        yield seq, sha, parents.split(), int(committed), name, email, subject


def read_changes(repository: str, options: dict[str, str], _: list) -> Iterator[tuple]:
    """Changed paths with line counts, newest first. Binary files have no counts and are left out; merges have no rows.

    path is the newest name of the file: a rename gives its old name, from there backward, the name that the new one has.
    commit_seq numbers the commits that have rows.
    """
    commit = committed = counted = None
    commit_seq, seq = -1, 0
    newest: dict[str, str] = {}
    found = iter(fields(log(repository, options, "-z", "--numstat", "--find-renames", "--format=%x01%H%x02%ct")))
    for item in found:
        item = item.lstrip("\n")
        while item.startswith("\x01"):
            head, _, item = item[1:].partition("\n")
            commit, _, committed = head.partition("\x02")
        if not item:
            continue
        added, deleted, path = item.split("\t", 2)
        previous = None
        if not path:
            previous, path = next(found), next(found)
        if added == "-":
            continue
        path = newest.get(path, path)
        if previous is not None:
            newest[previous] = path
        if commit != counted:
            commit_seq, counted = commit_seq + 1, commit
        yield seq, commit_seq, commit, int(committed), path, int(added), int(deleted), previous
        seq += 1


def read_name_status(repository: str, options: dict[str, str], commits: list[str]) -> Iterator[tuple]:
    for commit in commits:
        found = iter(fields(git(repository, "diff-tree", "--root", "--no-commit-id", "--name-status", "-z", "-r", "-M", commit)))
        for seq, status in enumerate(found):
            previous = next(found) if status[0] in "RC" else None
            yield commit, seq, status[0], next(found), previous


def read_patches(repository: str, options: dict[str, str], commits: list[str]) -> Iterator[tuple]:
    """Patch of each commit against its only parent; null for a merge or a first commit."""
    most = int(options.get("max_bytes") or 0)
    for commit in commits:
        parents = git(repository, "rev-list", "--parents", "-n", "1", commit).decode().split()[1:]
        if len(parents) != 1:
            yield commit, None, None
            continue
        command = ("diff", "--no-color", "--no-ext-diff", "--binary", parents[0], commit)
        patch = git(repository, *command)
        if most and len(patch) > most:
            raise GitError(("git", *command), 0, f"the patch has {len(patch)} bytes, more than {most}")
        yield commit, parents[0], patch


def blamed(repository: str, revision: str, path: str, lines: list[int]) -> dict[int, tuple]:
    """commit, source_path, source_line, text of each line, by one call for all of them."""
    spans = [x for line in sorted(set(lines)) for x in ("-L", f"{line},{line}")]
    out: dict[int, tuple] = {}
    head, source_path = [], ""
    for x in git(repository, "blame", "--line-porcelain", *spans, revision, "--", path).decode("utf-8", "replace").split("\n"):
        if not head:
            head = x.split()
        elif x.startswith("filename "):
            source_path = x.removeprefix("filename ")
        elif x.startswith("\t"):
            out[int(head[2])] = head[0], source_path, int(head[1]), x[1:]
            head = []
    return out


def read_blame(repository: str, options: dict[str, str], lines: list[int]) -> Iterator[tuple]:
    """Where each line comes from; status is unavailable where git does not tell. Lines that the file lacks make git refuse the
    whole call, so that they are then asked for one by one."""
    revision, path = options.get("tip") or "HEAD", safe_path(options["path"])
    found: dict[int, tuple] = {}
    for calls in ([lines], [[x] for x in sorted(set(lines))]):  # all at once, or else each alone
        for some in calls if lines and not found else []:
            try:
                found |= blamed(repository, revision, path, some)
            except GitError:
                pass
    for line in lines:
        if line in found:
            yield revision, path, line, *found[line], "available"
        else:
            yield revision, path, line, None, None, None, None, "unavailable"


def file_chunks(repository: str, paths: list[str]) -> list[list[str]]:
    """Paths in their order, cut into chunks of at most CHUNK paths that end where they hold CHUNK_BYTES."""
    out: list[list[str]] = []
    held = CHUNK_BYTES
    for path in paths:
        if held >= CHUNK_BYTES or len(out[-1]) == CHUNK:
            out.append([])
            held = 0
        out[-1].append(path)
        try:
            held += (Path(repository) / path).stat().st_size
        except OSError:
            pass  # read_files tells it
    return out


def read_files(repository: str, options: dict[str, str], paths: list[str]) -> Iterator[tuple]:
    """Content of tracked files as the working tree has them; a file that cannot be read has an error instead."""
    for path in paths:
        try:
            yield path, (Path(repository) / path).read_bytes(), None
        except OSError as e:
            yield path, None, e.strerror or str(e)


READERS = {"files": read_files, "commits": read_commits, "changes": read_changes, "name_status": read_name_status, "patches": read_patches, "blame": read_blame}


class Chunk(InputPartition):
    def __init__(self, items: list):
        self.items = items


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.relation = options.get("relation", "")
        if self.relation not in READERS:
            raise ValueError(f"relation must be one of {', '.join(READERS)}")
        self.repository = options["repository"]

    def partitions(self) -> list[InputPartition]:
        if self.relation in ("commits", "changes"):
            return [Chunk([])]
        if self.relation == "files":
            items = sorted(fields(git(self.repository, "ls-files", "-z", "--", "*.py")))
            return [Chunk(x) for x in file_chunks(self.repository, items)] or [Chunk([])]
        elif self.relation == "blame":
            items = [int(x) for x in self.options.get("lines", "").split(",") if x]
        else:
            items = [x for x in self.options.get("commits", "").split(",") if x]
        return [Chunk(items[i : i + CHUNK]) for i in range(0, len(items), CHUNK)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        return READERS[self.relation](self.repository, self.options, partition.items)


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("relation", "")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def read(spark: SparkSession, repository: str, relation: str, **options) -> DataFrame:
    """One relation of a repository; options that are None stay unset, lists are joined by commas."""
    spark.dataSource.register(GitSource)
    reader = spark.read.format("git").option("repository", repository).option("relation", relation)
    for key, value in options.items():
        if value is not None:
            reader = reader.option(key, ",".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value))
    return reader.load()
