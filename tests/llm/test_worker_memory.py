"""What the stages of the pipeline leave in a worker, and the batches it gets."""

import gc
import weakref

import corpus_pipeline
import pyarrow as pa
import pytest

from fringelake.llm import bpe, shared
from fringelake.llm.queries import vocabulary


def test_another_function_drops_the_vocabulary():
    """Workers live on between stages, so that a vocabulary kept for ever is held beside all that follows."""
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words"]})
    encode = shared.returning_memory(bpe._encoded(vocabulary(), False), f"bpe {vocabulary()}")
    first = list(encode(iter([rows])))
    held = weakref.ref(bpe.load(vocabulary()))
    assert list(encode(iter([rows]))) == first and held() is bpe.load(vocabulary())  # its own next task finds it
    assert not list(shared.returning_memory(lambda batches: batches)(iter([])))
    gc.collect()
    assert held() is None
    assert list(encode(iter([rows]))) == first


@pytest.mark.parametrize("stage", ["language_id", "simhash", "bpe"])
def test_stages_send_small_batches(spark, stage):
    keys = list(shared.BATCH)
    before = {k: spark.conf.get(k, None) for k in keys}
    docs = spark.range(2000).selectExpr("id doc_id", "concat_ws(' ', 'the text of', id, repeat('word ', 40)) text", "'en' lang", "'web' source", "240L n_chars").coalesce(1)
    try:
        for k in keys:
            spark.conf.unset(k)
        dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) == 2000 and max(r.n for r in sizes) <= 512
        spark.conf.set(keys[0], "7")
        shared.small_batches(spark)
        assert spark.conf.get(keys[0]) == "7"  # lower limits stay
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
