"""Chunk store: generations as Parquet partitions, and a pointer to the live one.

A collection is a folder: ``chunks/generation=...`` and ``_live.json``.  Readers go
through ``live``, which reads the pointer and prunes to its partition, so they
never see a mixture.  The pointer is replaced by one rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = "_live.json"


class Store:
    mode = "pointer"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.chunks_path = f"{self.folder}/chunks"

    # ---- pointer -----------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def metadata(self) -> dict:
        """The pointer file; empty before the first switch."""
        fs, at = self._fs(f"{self.folder}/{POINTER}")
        if not fs.exists(at):
            return {}
        stream = fs.open(at)
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_metadata(self, values: dict) -> None:
        fs, at = self._fs(f"{self.folder}/{POINTER}")
        _, new = self._fs(f"{self.folder}/{POINTER}.{uuid.uuid4().hex}.partial")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(values, sort_keys=True).encode()))
        stream.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context.rename(new, at, overwrite)

    @property
    def live_generation(self) -> str | None:
        return self.metadata().get("visible_generation")

    def switch(self, generation: str | None, **more) -> None:
        """Make a generation the live one, or none; other keys of the pointer stay."""
        self.write_metadata(self.metadata() | {"visible_generation": generation} | more)

    # ---- reading -----------------------------------------------------------

    def generations(self) -> list[str]:
        fs, at = self._fs(self.chunks_path)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(at) if s.isDirectory() and "=" in s.getPath().getName())

    def generation(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.chunks_path}/generation={name}").withColumn("generation", F.lit(name))

    def live(self) -> DataFrame | None:
        name = self.live_generation
        return self.generation(name) if name and name in self.generations() else None

    def count(self) -> int:
        live = self.live()
        return live.count() if live is not None else 0

    # ---- writing -----------------------------------------------------------

    def stage(self, rows: DataFrame, generation: str) -> None:
        """Write a whole candidate as a generation that nobody reads yet."""
        rows.drop("generation").write.mode("overwrite").parquet(f"{self.chunks_path}/generation={generation}")

    def upsert(self, rows: DataFrame, generation: str | None = None, **more) -> str:
        """Rows by ``chunk_id``: of one id the last by ``ingest_seq`` holds; others stay.

        ``more`` goes into the pointer together with the switch.
        """
        generation = generation or f"RUN-{uuid.uuid4().hex}"
        live = self.live()
        self.stage(merged(live, rows) if live is not None else last_of_each(rows), generation)
        self.switch(generation, **more)
        return generation

    def append(self, rows: DataFrame) -> str:
        """Rows as they come, without regard to ids."""
        live, generation = self.live(), f"RUN-{uuid.uuid4().hex}"
        self.stage(live.drop("generation").unionByName(rows, allowMissingColumns=True) if live is not None else rows, generation)
        self.switch(generation)
        return generation

    def delete(self, ids: DataFrame | None = None) -> None:
        """Delete by ``chunk_id``, or everything."""
        live = self.live()
        if live is None:
            return
        generation = f"RUN-{uuid.uuid4().hex}"
        self.stage(live.join(ids.select("chunk_id"), "chunk_id", "left_anti") if ids is not None else live.limit(0), generation)
        self.switch(generation)

    def discard(self, generation: str) -> bool:
        """Delete a generation that is not live; whether there was one."""
        if generation == self.live_generation:
            raise ValueError("the generation is live")
        fs, at = self._fs(f"{self.chunks_path}/generation={generation}")
        return fs.exists(at) and fs.delete(at, True)

    def rename(self, generation: str, to: str) -> None:
        """Put a staged generation in the place of another that is not live."""
        self.discard(to)
        fs, at = self._fs(f"{self.chunks_path}/generation={generation}")
        _, new = self._fs(f"{self.chunks_path}/generation={to}")
        fs.rename(at, new)

    def remove_obsolete(self, only: list[str] | None = None) -> int:
        """Delete generations that are not live, all or those named; how many there were.

        A replacement names the generation that it took the place of, so what other runs
        have staged stays.
        """
        live = self.live_generation
        return sum(self.discard(name) for name in self.generations() if name != live and (only is None or name in only))


def last_of_each(rows: DataFrame, key: str = "chunk_id", order: str = "ingest_seq") -> DataFrame:
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def merged(old: DataFrame, new: DataFrame, key: str = "chunk_id", order: str = "ingest_seq") -> DataFrame:
    """Old rows that have no new one, and the last of each new."""
    latest = last_of_each(new, key, order)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest, allowMissingColumns=True)
