"""Small files and renames on any file system that Spark reaches, by way of the driver's Hadoop client."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._path(path)
        return p.getFileSystem(self._conf), p

    def join(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        fs.mkdirs(self._path(new).getParent())
        if not fs.rename(p, self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def files(self, path: str) -> list[tuple[str, int, int]]:
        """(name below the path, size, time of change in ms) of a file, or of every file of a folder."""
        fs, p = self._at(path)
        found, out = fs.listFiles(p, True), []
        root = fs.makeQualified(p).toString()
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString().removeprefix(root), s.getLen(), s.getModificationTime()))
        return sorted(out)

    def stat(self, path: str) -> tuple[int, str]:
        """(size, digest of all files' names, sizes and times) of a file or folder."""
        files = self.files(path)
        return sum(n for _, n, _ in files), hashlib.sha256(repr(files).encode()).hexdigest()

    def _versions(self, path: str) -> list[int]:
        fs, p = self._at(path)
        if not fs.exists(p.getParent()):
            return []
        names = [s.getPath().getName().removeprefix(p.getName() + ".") for s in fs.listStatus(p.getParent())]
        return sorted(int(n) for n in names if n.isdigit())

    def read_text(self, path: str) -> str | None:
        """The newest version."""
        versions = self._versions(path)
        if not versions:
            return None
        return "\n".join(r[0] for r in self.spark.read.text(f"{path}.{versions[-1]}", wholetext=True).collect())

    def write_text(self, path: str, text: str) -> None:
        """A whole file that is renamed to the next version, so that at any time the newest version is whole; the one before it stays."""
        versions = self._versions(path)
        fs, p = self._at(f"{path}.{uuid.uuid4().hex}.new")
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        number = versions[-1] + 1 if versions else 1
        if not fs.rename(p, self._path(f"{path}.{number}")):
            fs.delete(p, False)
            raise OSError(f"version {number} of {path} was written by another")
        for old in versions[:-1]:
            fs.delete(self._path(f"{path}.{old}"), False)
