"""The Git source on small repositories made here."""

import os
import subprocess

import pytest

from strataquery.sources import git

WHEN = {"GIT_AUTHOR_DATE": "2024-01-01T00:00:00Z", "GIT_COMMITTER_DATE": "2024-01-01T00:00:00Z"}
WHO = {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x.org", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x.org"}


def run(at, *arguments):
    return subprocess.run(["git", "-C", str(at), *arguments], check=True, capture_output=True, env=os.environ | WHEN | WHO).stdout.decode().strip()


def commit(at, files, message="work"):
    for name, content in files.items():
        path = at / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
    run(at, "add", "-A")
    run(at, "commit", "-q", "--allow-empty", "-m", message)
    return run(at, "rev-parse", "HEAD")


@pytest.fixture
def repository(tmp_path):
    run(tmp_path, "init", "-q")
    return tmp_path


def test_files_commits_changes(spark, repository):
    first = commit(repository, {"a.py": "x = 1\n" * 9, "b.txt": "no", "c.bin": b"\0\1"}, "feat: one")
    run(repository, "mv", "a.py", "d.py")
    second = commit(repository, {"e.py": "y = 2\n"}, "fix: two")
    at = str(repository)
    assert [(r.path, bytes(r.content)) for r in git.read(spark, at, "files").orderBy("path").collect()] == [("d.py", b"x = 1\n" * 9), ("e.py", b"y = 2\n")]
    commits = git.read(spark, at, "commits", since=1).orderBy("seq").collect()
    assert [(r.commit, r.parents, r.author_email, r.subject) for r in commits] == [(second, [first], "a@x.org", "fix: two"), (first, [], "a@x.org", "feat: one")]
    assert git.read(spark, at, "commits", limit=1).count() == 2
    changes = git.read(spark, at, "changes").orderBy("seq").collect()
    assert [(r.commit_seq, r.commit, r.path, r.additions, r.deletions, r.previous_path) for r in changes] == [
        (0, second, "d.py", 0, 0, "a.py"), (0, second, "e.py", 1, 0, None), (1, first, "d.py", 9, 0, None), (1, first, "b.txt", 1, 0, None),
    ]
    status = git.read(spark, at, "name_status", commits=[second]).orderBy("seq").collect()
    assert [(r.status, r.path, r.previous_path) for r in status] == [("R", "d.py", "a.py"), ("A", "e.py", None)]
    patches = {r.commit: r.patch for r in git.read(spark, at, "patches", commits=[first, second]).collect()}
    assert patches[first] is None and b"+y = 2" in patches[second]
    blame = git.read(spark, at, "blame", path="d.py", lines=[1, 99]).orderBy("line").collect()
    assert [(r.line, r.commit, r.source_path, r.text, r.status) for r in blame] == [(1, first, "a.py", "x = 1", "available"), (99, None, None, None, "unavailable")]


def test_empty_repository(spark, repository):
    for relation in ("files", "commits", "changes"):
        assert git.read(spark, str(repository), relation).collect() == []


def test_merge_has_no_change_rows(spark, repository):
    commit(repository, {"a.py": "1\n"})
    run(repository, "checkout", "-q", "-b", "side")
    commit(repository, {"b.py": "2\n"})
    run(repository, "checkout", "-q", "-")
    commit(repository, {"c.py": "3\n"})
    run(repository, "merge", "-q", "--no-ff", "-m", "merge", "side")
    assert sorted(r.path for r in git.read(spark, str(repository), "changes").collect()) == ["a.py", "b.py", "c.py"]


@pytest.mark.parametrize("path", ["/x", "../x", "a/../b", "a\\b", ""])
def test_unsafe_paths(path):
    with pytest.raises(ValueError):
        git.safe_path(path)


def test_files_are_cut_by_their_bytes(spark, repository):
    names = [f"m{i}.py" for i in range(7)]
    commit(repository, {n: "x = 1\n" * (git.CHUNK_BYTES // 6 if n in ("m1.py", "m4.py") else 1) + "y = 2\n" for n in names})
    (repository / "m6.py").unlink()
    assert git.file_chunks(str(repository), names) == [["m0.py", "m1.py"], ["m2.py", "m3.py", "m4.py"], ["m5.py", "m6.py"]]
    found = git.read(spark, str(repository), "files")
    assert found.rdd.getNumPartitions() == 3
    assert sorted((r.path, r.error) for r in found.select("path", "error").collect()) == [(n, "No such file or directory" if n == "m6.py" else None) for n in names]
    assert [len(x) for x in git.file_chunks(str(repository), ["gone.py"] * 600)] == [256, 256, 88] and git.file_chunks(str(repository), []) == []
