"""The plans on streams."""

import time

import pytest

from maskwell.streaming.sessions import deidentify_stream, vault_stream


def test_notes_stream(spark, tmp_path):
    spark.createDataFrame([(1, "SSN: 219-44-8812"), (2, None)], "id long, text string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    q = deidentify_stream(source).select("id", "masked_text").writeStream.format("memory").queryName("masked_notes").start()
    try:
        q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("masked_notes").collect()) == [(1, "SSN: [SSN_1]"), (2, "")]
    finally:
        q.stop()


def wait_for(condition, seconds=60):
    until = time.time() + seconds
    while time.time() < until and not condition():
        time.sleep(0.5)


def test_vault_stream(spark, tmp_path):
    """A query in processing time never settles, so the test waits for rows and stops it."""
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, folder = "session_id string, op string, ciphertext binary", str(tmp_path / "ops")
    put = lambda *ops: spark.createDataFrame(ops, schema).coalesce(1).write.mode("append").parquet(folder)
    put(("a", "put", b"xyz"))
    q = vault_stream(spark.readStream.schema(schema).parquet(folder), 3600).writeStream.format("memory").queryName("vault_ops").outputMode("append").trigger(processingTime="1 second").start()
    try:
        wait_for(lambda: q.exception() or spark.table("vault_ops").count() >= 1)
        put(("a", "get", None), ("b", "get", None))
        wait_for(lambda: q.exception() or spark.table("vault_ops").count() >= 3)
        got = {(r["session_id"], r["op"]): (r["status"], bytes(r["ciphertext"]) if r["ciphertext"] else None) for r in spark.table("vault_ops").collect()}
        assert got == {("a", "put"): ("ok", None), ("a", "get"): ("ok", b"xyz"), ("b", "get"): ("expired", None)}
    finally:
        q.stop()
