import collections

import pytest

from playlytics.llm import sharding


def brute(shards, slots):
    """Shards take turns, each walking its whole order of preference from the start."""
    orders = []
    for s in shards:
        start, step = sharding.preference(s, slots)
        orders.append([(start + k * step) % slots for k in range(slots)])
    table = {}
    while len(table) < slots:
        for shard, order in enumerate(orders):
            free = next((x for x in order if x not in table), None)
            if free is not None:
                table[free] = shard
    return [table[k] for k in range(slots)]


def test_table_against_brute_force():
    shards = [f"s{i}" for i in range(7)]
    assert sharding.fill(shards, 101) == brute(shards, 101)
    counts = collections.Counter(sharding.fill(shards, 101))
    assert max(counts.values()) - min(counts.values()) <= 1


def test_few_slots_move_when_a_shard_leaves():
    shards = [f"s{i}" for i in range(10)]
    before, after = sharding.fill(shards, 1009), sharding.fill(shards[:-1], 1009)
    kept = sum(a == b for a, b in zip(before, after, strict=True) if a != 9)
    assert kept > 0.8 * sum(a != 9 for a in before)


def test_turns_weigh_shards():
    counts = collections.Counter(sharding.fill(["a", "b"], 1009, [3, 1]))
    assert counts[0] == pytest.approx(3 * counts[1], abs=4)


@pytest.mark.parametrize("shards, slots, turns", [(["a"], 100, None), (["a", "a"], 101, None), ([], 101, None), (["a", "b"], 101, [0, 0])])
def test_wrong_tables(shards, slots, turns):
    with pytest.raises(ValueError):
        sharding.fill(shards, slots, turns)


def test_placement(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2**62, None)], "doc_id bigint, slot string")
    got = sharding.place(docs)
    assert got.columns == ["doc_id", "slot", "_slot", "shard"]
    rows = got.collect()
    assert len(rows) == 4
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    table = sharding.fill()
    assert all(r["shard"] == sharding.SHARDS[table[r["_slot"]]] for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "hashpartitioning" not in plan
    assert sharding.place(spark.createDataFrame([], "doc_id bigint")).count() == 0


def test_shards_are_even(spark):
    counts = [r["count"] for r in sharding.place(spark.range(64_000).withColumnRenamed("id", "doc_id")).groupBy("shard").count().collect()]
    assert len(counts) == 128 and max(counts) < 1.3 * 500 and min(counts) > 0.7 * 500
