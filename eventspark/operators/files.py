"""Small files beside a table, written by the driver: markers, lists, logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

#: Folders that one call into the JVM lists.
LISTED_AT_ONCE = 500


def in_threads(step: Callable[[int], None], hours: Iterable[int]) -> None:
    """``step`` for each hour, for some at a time: calls of a file system wait
    more than they work. The first failure is raised, when all have ended."""
    with ThreadPoolExecutor(8) as pool:
        for _ in pool.map(step, hours):
            pass


class Folder:
    """A folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self._conf)

    def at(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """The entries of a folder below this one (none if it isn't there)."""
        there = self.at(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(there)) if self.fs.exists(there) else []

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def glob(self, pattern: str) -> list[str]:
        """Paths relative to this folder."""
        return self.paths(self.fs.globStatus(self.at(pattern)))

    def paths(self, statuses) -> list[str]:
        """Paths, relative to this folder, of what a listing found: one call for
        all of them."""
        if not statuses:
            return []
        base = f"{self.fs.makeQualified(self.at()).toString().rstrip('/')}/"
        text = self._jvm.org.apache.commons.lang3.ArrayUtils.toString(self._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(statuses))
        return sorted(x.removesuffix(",") for x in text[1:-1].split(base)[1:])  # {path,path}

    def names_in(self, folders: list[str]) -> dict[str, list[str]]:
        """The entries of many folders below this one, those that aren't there
        left out: some hundred folders with a call."""
        found: dict[str, list[str]] = {}
        for i in range(0, len(folders), LISTED_AT_ONCE):
            wanted = ",".join(f"{f}/*" for f in folders[i:i + LISTED_AT_ONCE])
            for path in self.paths(self.fs.globStatus(self.at(f"{{{wanted}}}"))):
                folder, name = path.rsplit("/", 1)
                found.setdefault(folder, []).append(name)
        return found

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def move(self, name: str, to: str) -> bool:
        """Rename below this folder; False if ``to`` is there already."""
        target = self.at(to)
        self.fs.mkdirs(target.getParent())
        return not self.fs.exists(target) and self.fs.rename(self.at(name), target)

    def create(self, name: str, text: str = "") -> bool:
        """A new file, visible only when it is whole; False if there is one of
        that name. Where the file system renames atomically without replacing
        (HDFS and others with a name node), only one of several writers wins."""
        made = self.at(f".{uuid.uuid4().hex}.tmp")
        out = self.fs.create(made, False)
        try:
            if text:
                out.write(bytearray(text, "utf-8"))
        finally:
            out.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self._conf)
        try:
            context.rename(self.fs.makeQualified(made), self.fs.makeQualified(self.at(name)), how)
        except Exception as e:  # noqa: BLE001 - the JVM's exception, by its name
            self.fs.delete(made, False)
            if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
                return False
            raise
        return True
