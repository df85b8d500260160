"""The token store is read only if its manifest holds."""

from __future__ import annotations

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from paperloom.llm import token_store  # noqa: E402
from test_corpus_operators import by_id, frame, prose  # noqa: E402


def test_altered_recipes_are_not_read(spark, monkeypatch):
    rng = random.Random(14)
    docs = frame(spark, [None, ""] + [prose(rng, 50) for _ in range(6)])
    assert set(by_id(token_store.store_and_read(docs))) == set(range(8))
    real = token_store.write
    for change in ("doc_id <> 3 as keep, start", "true as keep, start + cast(doc_id = 3 as bigint) as start"):

        def altered(docs, folder, change=change):
            real(docs, folder)
            recipes = spark.read.parquet(f"{folder}/recipes")
            rows = recipes.selectExpr("part", "place", "doc_id", *change.split(", "), "n_tokens", "chunks").where("keep").drop("keep")
            schema, kept = recipes.schema, rows.select(recipes.columns).collect()
            spark.createDataFrame(kept, schema).write.mode("overwrite").parquet(f"{folder}/recipes")
            return folder

        monkeypatch.setattr(token_store, "write", altered)
        with pytest.raises(ValueError, match="manifest"):
            token_store.store_and_read(docs)


def test_tasks_of_a_worker_share_what_is_remembered(spark):
    rng = random.Random(15)
    texts = [prose(rng, 40) for _ in range(8)]
    docs = frame(spark, texts).select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            encoder = token_store.encoder_of()
            before = len(encoder.of_piece)
            for text in batch.column(1).to_pylist():
                encoder.encode(text)
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()], pa.int64()), pa.array([len(encoder.of_piece) - before], pa.int64())], ["worker", "new"])

    seen, again = set(), []
    for _ in range(12):  # idle workers take turns
        for worker, new in docs.coalesce(1).mapInArrow(run, "worker bigint, new bigint").collect():
            again += [new] * (worker in seen)
        seen.add(worker)
    assert again and not any(again)
    whole = token_store.LibraryEncoder(token_store.public_tokenizers.path(token_store.VOCABULARY))
    assert [token_store.encoder_of().encode(t) for t in texts + texts] == [whole.encode(t) for t in texts + texts]
