"""What tasks hold beside the JVM's heap: bounded Arrow batches, texts sent once, one Python worker a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

import sievefold.llm.quality as quality
import sievefold.llm.secrets as secrets
import sievefold.llm.shared as shared
import sievefold.llm.simhash as simhash


def test_batches_are_bounded_by_bytes(spark):
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word here ', 2000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    found = shared.keep_columns(docs, {"id": "doc_id", "text": "text"}).mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 2000
    assert max(r["size"] for r in found) < 1.1 * shared.ARROW_BYTES


def test_texts_are_sent_once_wherever_their_column_stands(spark):
    text = "the password: hunter2hunter2 " + " ".join(f"w{k}" for k in range(40))
    rows = [(k, text if k % 3 else None, "x", k) for k in range(30)]
    docs = spark.createDataFrame(rows, "n_chars long, text string, `a.b` string, doc_id long")
    for out in (quality.keep_good(docs), secrets.redact_secrets(docs)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        step = next(line for line in plan.splitlines() if "MapInArrow" in line)
        assert out.columns == docs.columns and "run(row#" in step and "text#" not in step
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == {k for k in range(30) if k % 3}
    got = {r["doc_id"]: r for r in secrets.redact_secrets(docs).collect()}
    for k in range(30):
        want = text.replace("password: hunter2hunter2", "<SECRET>") if k % 3 else None
        assert got[k]["text"] == want and got[k]["n_chars"] == (len(want) if want else None) and got[k]["a.b"] == "x"


def test_links_leave_no_python_to_what_reads_them(spark):
    prints = spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long")
    found = simhash.links(prints, simhash.SimhashRules(), shared.Scratch(spark))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
    assert [{r["a"], r["b"]} for r in found.filter("a < 4 AND b < 4").collect()] == [{1, 3}]


def test_places_of_suffixes_take_four_bytes():
    sa, _ = quality.suffix_array(np.array([0, 1, 0, 1, 2]), np.zeros(5, np.int64))
    assert sa.dtype == np.int32 and sa.tolist() == [0, 2, 1, 3, 4]
