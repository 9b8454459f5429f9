import threading

import pytest

from qualitylens.sources import generations as G


def test_two_writers_and_a_repeated_batch(spark, tmp_path):
    root = str(tmp_path / "state")
    one, two = spark.range(3), spark.range(5)
    assert G.current(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        G.read(spark, root)
    assert G.commit(one, root, 0, "b0") == 1 and G.read(spark, root).count() == 3
    # both start from the first generation; one of them wins, whole
    done: list = []

    def write(df):
        try:
            done.append(G.commit(df, root, 1))
        except G.Lost:
            done.append(None)

    writers = [threading.Thread(target=write, args=(df,)) for df in (one, two)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done, key=str) == [2, None]
    assert G.current(spark, root) == 2 and G.read(spark, root).count() in (3, 5)
    assert len(list((tmp_path / "state").glob("data-*"))) == 2
    assert G.commit(two, root, 2, "b0") == 1 and G.current(spark, root) == 2
    with pytest.raises(G.Lost):
        G.commit(two, root, 1)
    assert G.read(spark, root, 1).count() == 3


def test_rows_written_aside_are_not_seen(spark, tmp_path):
    root = str(tmp_path / "state")
    G.commit(spark.range(2), root, 0)
    spark.range(9).write.parquet(f"{root}/data-of-a-writer-that-died")
    (tmp_path / "state" / "_commits" / ".half").write_text("{")
    assert G.read(spark, root).count() == 2 and G.current(spark, root) == 1


def test_stream_into_generations(spark, tmp_path):
    for k in range(3):
        spark.range(k * 10, k * 10 + 4).coalesce(1).write.parquet(str(tmp_path / f"in/p{k}"))
    root = str(tmp_path / "out")
    src = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    put = G.batches_into(root)
    q = src.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    n = G.current(spark, root)
    assert n == 3 and sum(G.read(spark, root, k + 1).count() for k in range(n)) == 12
    put(spark.range(100), 1)  # delivered again
    assert G.current(spark, root) == n
