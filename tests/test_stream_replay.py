"""A stream over a table larger than the heap arrives in event-time order, in batches; its state stays as large as a batch."""

import datetime as dt
import glob
import random

import pytest

from pickwise.streaming import replay as R


def _table(spark, tmp_path, day_of):
    pick = random.Random(7)
    rows = []
    for i in range(1_500):
        at = day_of(i)
        at = None if at is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=at, hours=pick.randrange(24))
        rows.append((i // 6, i % 6, pick.choice("RAN"), pick.randrange(11) / 100, at))
    pick.shuffle(rows)
    schema = "l_orderkey long, l_linenumber int, l_returnflag string, l_discount double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    best, count = {}, {}
    for order, line, flag, discount, at in rows:
        if at is not None:
            key = (int((dt.datetime(at.year, at.month, at.day) - dt.datetime(1970, 1, 1)).total_seconds()), order)
            best[key] = max(best.get(key, (-1.0, 0, 0)), (discount, -line, int(flag == "R")))
            count[key] = count.get(key, 0) + 1
    return {(*key, -line, y, count[key]) for key, (_, line, y) in best.items()}


@pytest.mark.parametrize("days,on_disk", [(40, False), (1, True)])
def test_larger_table_arrives_in_batches_and_gives_the_same_windows(spark, tmp_path, monkeypatch, days, on_disk):
    from pickwise.plans.catalog.streaming import stream_windowed_selection
    from pickwise.session import ensure_checkpoint_dir

    want = _table(spark, tmp_path, lambda i: None if i % 97 == 0 else (i * 31) % days)
    monkeypatch.setattr(R, "BATCH_ROWS", 200 // spark.sparkContext.defaultParallelism)
    place = f"{ensure_checkpoint_dir(spark).removeprefix('file:')}/pickwise-stream/*/checkpoint"
    before = set(glob.glob(place))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    got = stream_windowed_selection(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    (made,) = set(glob.glob(place)) - before
    logs = sorted(glob.glob(f"{made}/offsets/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1]))
    assert int(logs[-1].rsplit("/", 1)[1]) >= 6               # 1,500 rows, some 200 a batch
    assert ("RocksDB" in open(logs[0]).read()) == on_disk     # one day's rows cannot leave the state before the end
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions and "RocksDB" not in (spark.conf.get(f"{R.STATE}.providerClass", "") or "")


def test_most_rows_that_a_window_and_its_delay_keep():
    assert R.held_rows({}) == 0
    assert R.held_rows({1: 5, 2: 1, 3: 1, 10: 6}) == 7
