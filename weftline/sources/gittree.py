"""A Spark data source over a git repository's tree at a pinned revision: (path, content).

spark.dataSource.register(GitTree); spark.read.format("gittree").option("repository", folder).option("revision", sha).load().
Paths are listed once on the driver; tasks read `paths_per_task` blobs each. The folder must be one that executors see."""

from __future__ import annotations

import subprocess

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _git(folder: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, timeout=600, check=False)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip())
    return done.stdout


class Blobs(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.size = options["repository"], int(options.get("paths_per_task", "200"))
        self.revision = _git(self.folder, "rev-parse", "--verify", options.get("revision", "HEAD") + "^{commit}").decode().strip()

    def partitions(self):
        names = _git(self.folder, "ls-tree", "-r", "-z", "--name-only", self.revision).decode(errors="surrogateescape").split("\0")
        paths = [n for n in names if n]
        return [Blobs(paths[i : i + self.size]) for i in range(0, len(paths), self.size)] or [Blobs([])]

    def read(self, partition):
        """One git process a task: it answers names with a line that ends in the blob's size, then the blob and a line feed."""
        if not partition.paths:
            return
        with subprocess.Popen(["git", "-C", self.folder, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:
            for path in partition.paths:
                if "\n" in path:  # can't be asked for by line
                    yield path, _git(self.folder, "show", f"{self.revision}:{path}")
                    continue
                git.stdin.write(f"{self.revision}:{path}\n".encode(errors="surrogateescape"))
                git.stdin.flush()
                head = git.stdout.readline().decode(errors="replace").split()
                if len(head) < 3 or head[-2] != "blob":  # a submodule's commit has no content here
                    if len(head) >= 3 and head[-1].isdigit():
                        git.stdout.read(int(head[-1]) + 1)
                    continue
                yield path, git.stdout.read(int(head[-1]) + 1)[:-1]
            git.stdin.close()


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gittree"

    def schema(self) -> str:
        return "path string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)
