from datetime import datetime, timedelta
from pathlib import Path

from siftline.operators import frecency
from siftline.streaming import opens

DAY = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(p, None if d is None else DAY + timedelta(days=d), c) for p, d, c in rows], opens.EVENTS)


def shown(rows):
    return {r.path: (r.opened, (r["last"] - DAY).days) for r in rows.collect()}


def test_batch_and_stream_agree_after_clears(spark, tmp_path):
    source, kept, state = (str(tmp_path / x) for x in ("in", "counts", "state"))
    run = lambda: opens.into_table(spark, source, kept, state).awaitTermination()
    first = [("a", 0, False), ("a", 1, None), ("b", 1, False), ("c", 2, False), (None, 1, False), ("d", None, False)]
    events(spark, first).write.parquet(source)
    run()
    assert shown(opens.current(spark, kept)) == shown(opens.counted(events(spark, first))) == {"a": (2, 1), "b": (1, 1), "c": (1, 2)}
    second = [("a", 3, True), ("b", 4, False), ("a", 2, False), ("b", 3, True), ("c", 3, False)]
    events(spark, second).write.mode("append").parquet(source)
    run()
    assert shown(opens.current(spark, kept)) == shown(opens.counted(events(spark, first + second))) == {"b": (1, 4), "c": (2, 3)}
    third = [("a", 2, False), ("a", 5, False), ("c", 6, True)]
    events(spark, third).write.mode("append").parquet(source)
    run()
    want = {"a": (1, 5), "b": (1, 4)}
    assert shown(opens.current(spark, kept)) == shown(opens.counted(events(spark, first + second + third))) == want

    opens.compact(spark, kept)
    assert shown(opens.current(spark, kept)) == want
    assert sorted(p.name for p in Path(kept).iterdir()) == ["snapshot=2"]
    opens.clear(spark, kept, DAY + timedelta(days=5))
    assert shown(opens.current(spark, kept)) == {"a": (1, 5)}
    events(spark, [("b", 7, False), ("c", 7, False), ("c", 4, False)]).write.mode("append").parquet(source)
    run()
    now = {"a": (1, 5), "b": (1, 7), "c": (1, 7)}
    assert shown(opens.current(spark, kept)) == now
    opens.compact(spark, kept)
    opens.compact(spark, kept)
    assert shown(opens.current(spark, kept)) == now and sorted(p.name.split("=")[0] for p in Path(kept).iterdir()) == ["emptied", "snapshot"]


def test_empty(spark, tmp_path):
    assert opens.current(spark, str(tmp_path / "none")).collect() == []
    opens.compact(spark, str(tmp_path / "none"))
    assert shown(frecency.summed(opens.counted(events(spark, [])).select("path", "last").withColumnRenamed("last", "ts"))) == {}
