from gleaner.operators.schema import CHUNK_SCHEMA
from gleaner.operators.store import Store
from gleaner.streaming.incremental import take_in


def test_only_new_files_are_taken_in(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/db", 1)
    row = lambda i, t: (f"p::{i}", "p", "h", i, 0, 1, "", t, [1.0], None, None, [], "text")
    drop = lambda *rows: spark.createDataFrame(list(rows), CHUNK_SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drop(row(0, "a"), row(1, "b"))
    assert take_in(store, "s", f"{tmp_path}/in", f"{tmp_path}/seen") == 1
    assert take_in(store, "s", f"{tmp_path}/in", f"{tmp_path}/seen") == 0
    drop(row(1, "z"), row(1, "zz"))
    drop(row(1, "c"), row(2, "d"))
    assert take_in(store, "s", f"{tmp_path}/in", f"{tmp_path}/seen") == 1
    assert sorted((r["id"], r["text"]) for r in store.table("s").collect()) == [("p::0", "a"), ("p::1", "c"), ("p::2", "d")]
