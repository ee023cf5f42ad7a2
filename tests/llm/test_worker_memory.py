"""What a Python worker keeps beside later stages, and what waits in the executor for its answers."""

from pathlib import Path

import pyarrow as pa
import pytest
from quillworks.llm import common, simhash


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096 / 2**20


def test_fingerprints_drop_what_earlier_stages_keep():
    words = common.worker_cache("another stage", lambda: {k: f"{k:01000d}" for k in range(100_000)})
    last = f"{1:01000d}"  # lies above the words: the C library gives back by itself only what is on top
    held = resident_mb()
    del words
    batch = pa.RecordBatch.from_arrays([pa.array([1, None]), pa.array([5, 6]), pa.array(["One two THREE", None])], ["doc", "row_hash", "text"])
    out = list(simhash.with_fingerprints(iter([batch])))
    assert common.worker_state()["cache"][0] != "another stage" and last
    assert held - resident_mb() > 80
    assert out[0].to_pydict() == {"doc": [1, None], "row_hash": [5, 6], "fp": [simhash.fingerprint("one two three") - (simhash.fingerprint("one two three") >> 63 << 64), 0]}


def test_no_text_waits_for_its_fingerprint(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    text = simhash.fingerprint_rows(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "ArrowEvalPython" not in text


@pytest.mark.parametrize("kind", ["string", "decimal(20,3)", "timestamp", "date", "binary"])
def test_kinds_of_ids(spark, kind):
    made = {"timestamp": "timestamp_seconds(id)", "date": "date_add(date'2020-01-01', int(id))", "binary": "cast(string(id) as binary)"}.get(kind, f"cast(id as {kind})")
    docs = spark.range(6).selectExpr(f"if(id = 5, null, {made}) as doc_id", "if(id % 2 = 0, 'a few plain words', 'others') as text").coalesce(1)
    rows = simhash.fingerprint_rows(docs, "doc_id", "text")
    assert rows.schema["doc"].dataType == docs.schema["doc_id"].dataType
    assert [r.doc for r in rows.collect()] == [r.doc_id for r in docs.collect()]
    assert len(simhash.keep_documents(docs).collect()) == 2
