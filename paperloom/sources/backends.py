"""What a vector store, a replacement store, a verifiable store and a legacy store have to offer."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..operators import retrieval
from .store import Store


@runtime_checkable
class VectorBackend(Protocol):
    def add(self, rows: DataFrame) -> None: ...

    def query(self, vector: list[float], k: int, where: dict | None = None) -> DataFrame: ...

    def delete(self, ids: DataFrame | None = None) -> None: ...

    def count(self) -> int: ...


@runtime_checkable
class ReplacementBackend(Protocol):
    mode: str

    def stage(self, rows: DataFrame, generation: str) -> None: ...

    def generation(self, name: str) -> DataFrame: ...

    def generations(self) -> list[str]: ...

    def switch(self, generation: str | None, **more) -> None: ...

    def remove_obsolete(self, only: list[str] | None = None) -> int: ...

    def discard(self, generation: str) -> bool: ...

    def live(self) -> DataFrame | None: ...


@runtime_checkable
class VerifiableBackend(Protocol):
    """Reads only: whoever verifies cannot write."""

    def live(self) -> DataFrame | None: ...

    def generations(self) -> list[str]: ...

    def metadata(self) -> dict: ...

    def count(self) -> int: ...


@runtime_checkable
class LegacyStoreReader(Protocol):
    def rows(self) -> DataFrame: ...

    def metadata(self) -> dict: ...


class StoreBackend:
    """A ``Store`` as a vector backend."""

    def __init__(self, store: Store):
        self.store = store

    def add(self, rows: DataFrame) -> None:
        self.store.append(rows)

    def query(self, vector: list[float], k: int, where: dict | None = None) -> DataFrame:
        live = self.store.live()
        if live is None:
            raise LookupError("the store is empty")
        return retrieval.nearest(retrieval.where(live, where), vector, k)

    def delete(self, ids: DataFrame | None = None) -> None:
        self.store.delete(ids)

    def count(self) -> int:
        return self.store.count()


class ParquetLegacyReader:
    """A legacy store as Parquet rows with a JSON of metadata beside them; nothing is written."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def metadata(self) -> dict:
        import json

        found = self.spark.read.text(f"{self.folder}/metadata.json", wholetext=True).head()
        return json.loads(found[0]) if found else {}
