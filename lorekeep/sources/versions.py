"""Folders whose state is a manifest: what is written becomes visible when the next manifest is put in place, all at once."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession


class Folder:
    """``state()`` is the newest complete manifest. A writer that dies before ``publish`` leaves the state as it was; of two
    writers that began at the same state one gets an error. Works on any Hadoop file system with an atomic rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(""))) if self._fs.exists(self._at("")) else []

    def version(self) -> int:
        return max((int(m[1]) for n in self.names() if (m := re.fullmatch(r"manifest-(\d+)\.json", n))), default=0)

    def state(self) -> dict:
        """Empty where nothing has been published. ``version`` is the manifest's number."""
        n = self.version()
        if not n:
            return {"version": 0}
        stream = self._fs.open(self._at(f"manifest-{n:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": n}
        finally:
            stream.close()

    def publish(self, state: dict, after: int) -> dict:
        """Puts ``state`` in place as the version behind ``after``."""
        to, by = self._at(f"manifest-{after + 1:08d}.json"), self._at(f".manifest-{uuid.uuid4().hex}")
        stream = self._fs.create(by, False)
        stream.write(bytearray(json.dumps({k: v for k, v in state.items() if k != "version"}).encode()))
        stream.close()
        if self._fs.exists(to) or not self._fs.rename(by, to):
            self._fs.delete(by, False)
            raise RuntimeError(f"another writer has published version {after + 1} of {self.path}")
        return state | {"version": after + 1}

    def fresh(self, kind: str) -> str:
        """Name of a folder that nobody has written yet."""
        return f"{kind}-{uuid.uuid4().hex[:12]}"

    def remove(self) -> None:
        self._fs.delete(self._at(""), True)

    def move(self, to: str, ending: str, by: str, name: str | None = None) -> None:
        """Files of this ending to another folder, with another ending and, for a single file, another name."""
        goal = Folder(self.spark, to)
        goal._fs.mkdirs(goal._at(""))
        for n in self.names():
            if n.endswith(ending) and not n.startswith((".", "_")):
                self._fs.rename(self._at(n), goal._at((name or n.removesuffix(ending)) + by))

    def keep_only(self, live: set[str]) -> None:
        """Removes what no manifest from the newest on names: older manifests and other folders. For times without readers of
        older versions."""
        newest = f"manifest-{self.version():08d}.json"
        for n in self.names():
            if n != newest and n not in live:
                self._fs.delete(self._at(n), True)
