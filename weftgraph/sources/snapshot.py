"""Versioned snapshots: a folder per writer and a marker per version that is created last."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from weftgraph.plans.adapter import Graph


class SnapshotStore:
    """Readers resolve the pointer once and keep that version; writers publish a version by creating one marker."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, *parts: str):
        p = self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return p.getFileSystem(self._conf), p

    def version(self) -> int:
        """The newest published version, 0 without one."""
        fs, p = self._at("published")
        if not fs.exists(p):
            return 0
        return max([int(s.getPath().getName()) for s in fs.listStatus(p)], default=0)

    def publish(self, graph: Graph, expect: int | None = None) -> int:
        """Write a snapshot into a folder of its own and make it the current one by creating its marker, which names the
        folder; raises where another version than expected is current, or another writer was first. A loser's folder is
        read by nobody and goes."""
        now = self.version()
        if expect is not None and now != expect:
            raise RuntimeError(f"version {now} is current, not {expect}")
        v, folder = now + 1, f"data-{uuid.uuid4().hex}"
        graph.nodes.write.parquet(f"{self.path}/{folder}/nodes")
        graph.edges.write.parquet(f"{self.path}/{folder}/edges")
        fs, p = self._at("published", str(v))
        fs.mkdirs(p.getParent())
        try:
            marker = fs.create(p, False)  # fails where there is one
        except Exception as e:
            where, own = self._at(folder)
            where.delete(own, True)
            raise RuntimeError(f"version {v} was published by another writer") from e
        marker.write(folder.encode())
        marker.close()
        return v

    def _folder(self, v: int) -> str:
        fs, p = self._at("published", str(v))
        stream = fs.open(p)
        try:
            return bytes(b & 255 for b in stream.readNBytes(100)).decode()
        finally:
            stream.close()

    def read(self, v: int | None = None) -> Graph:
        v = v or self.version()
        if not v:
            raise RuntimeError("nothing is published")
        folder = self._folder(v)
        return Graph(self.spark.read.parquet(f"{self.path}/{folder}/nodes"), self.spark.read.parquet(f"{self.path}/{folder}/edges"), v)

    def clear(self) -> None:
        """Nothing is published from here on; snapshots that readers hold stay until their folders are removed."""
        fs, p = self._at("published")
        fs.delete(p, True)
