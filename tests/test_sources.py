"""Files, manifests, streams and the driver's contract."""

import os
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import __spark_entry__
from strandlake.sources import files
from strandlake.streaming import events as S

REPO = os.path.dirname(os.path.abspath(__spark_entry__.__file__))


def test_multi_object_lines(spark):
    lines = spark.createDataFrame([('{"a":1}{"b":2}',), ("{} [1]",), ("{",), (None,)], "line string")
    got = sorted((r["line"] or "", r["position"], r["object"], r["error"]) for r in files.decode_lines(lines, "line").collect())
    assert got == [("{", 0, None, "no JSON at offset 0"), ('{"a":1}{"b":2}', 0, '{"a":1}', None), ('{"a":1}{"b":2}', 1, '{"b":2}', None), ("{} [1]", 0, "{}", None), ("{} [1]", 1, None, "no object at offset 3")]


def test_jsonl(spark, tmp_path):
    path = f"file://{tmp_path}/x"
    assert files.count_lines(spark, path) == 0
    files.write_jsonl(spark.createDataFrame([(1, None)], "id long, t string"), path)
    files.write_jsonl(spark.createDataFrame([(2, "é")], "id long, t string"), path)
    assert files.count_lines(spark, path) == 2
    rows = files.read_jsonl(spark, path, "id long").select("id", F.variant_get("_extra", "$.t", "string").alias("t")).collect()
    assert sorted((r["id"], r["t"]) for r in rows) == [(1, None), (2, "é")]


def test_manifest_chain(spark, tmp_path):
    out = f"{tmp_path}/out"
    spark.range(1).write.parquet(out)
    m = files.Manifest(spark, f"file://{tmp_path}/m")
    chain = [{"stage": "sample", "n": 5}, {"stage": "filter"}]
    assert not m.finished("filter", chain, out)
    m.finish("filter", chain)
    again = files.Manifest(spark, f"file://{tmp_path}/m")
    assert again.finished("filter", chain, out)
    assert not again.finished("filter", [{"stage": "sample", "n": 6}, {"stage": "filter"}], out)


def test_repeat_detector_with_cut_tags(spark, tmp_path):
    rows = [("s", i, c) for i, c in enumerate(["<steer>x</steer><ex", "ec>same words he", "re</exec><exec>same words here</e", "xec><exec>other thing</exec>"])]
    path = f"{tmp_path}/in"
    for r in rows:
        spark.createDataFrame([r], "stream_id string, event_index long, chunk string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("stream_id string, event_index long, chunk string").parquet(path)
    q = S.repeat_detector(stream).writeStream.outputMode("update").format("memory").queryName("cut_tags").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["blocks"], r["run"]) for r in spark.table("cut_tags").collect()] == [(3, 1)]


def test_fan_out_writes_a_batch_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, "r", 1, k, 0.0) for i, k in enumerate(["doc_started", "leaf_scored", "doc_finished"])], "event_index long, run_id string, doc_id long, event_type string, value double")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        S.fan_out(S.read_events(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/event_log").count() == 3
    assert spark.read.parquet(f"{tmp_path}/out/lifecycle").count() == 2


def test_entry(spark, sf):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_corpus_operators(tmp_path):
    for name in ("strandlake", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{REPO}/{name}") else shutil.copy)(f"{REPO}/{name}", f"{tmp_path}/{name}")
    shutil.rmtree(f"{tmp_path}/strandlake/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
