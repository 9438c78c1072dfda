"""Behaviour of the store: snapshots, transactions, scans, recovery, flush and compaction."""

import random

import pytest

from palimpsest import Engine, KeyNotFound, Options
from palimpsest.functions import prefix_range, successor, text_successor
from palimpsest.operators import compact as C
from palimpsest.plans import live, resolve


def put(engine, **kv):
    with engine.update() as t:
        for k, v in kv.items():
            t.put(k, v)


def keys(df):
    return [bytes(r.key).decode() for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    with Engine(spark, f"file://{tmp_path}/db", Options(cooldown_s=1e-9)) as e:
        yield e


def test_prefix_bounds():
    assert successor(b"a\xff\xff") == b"b" and successor(b"\xff") is None
    assert text_successor("a퟿") == "a"
    with pytest.raises(ValueError):
        prefix_range(b"")


def test_tombstone_hides_after_resolving(spark):
    log = spark.createDataFrame([(b"a", b"1", 1, 1, 0), (b"a", None, 2, 2, 1), (b"b", b"2", 1, 3, 0), (b"b", b"3", 1, 4, 0)], "key binary, value binary, ts long, seq long, op int")
    assert [(bytes(r.key), bytes(r.value)) for r in live(log).collect()] == [(b"b", b"3")]
    assert live(log, 1).count() == 2 and live(log, 0).count() == 0 and resolve(log).count() == 2


def test_scans_and_cursor(store):
    with store.update() as t:
        for c in "abcdefghij":
            t.put(c, f"val_{c}")
    with store.view() as t:
        assert keys(t.range("c", "g")) == list("cdef")
        assert keys(t.range("c", "g", ascending=False)) == list("fedc")
        assert keys(t.range(None, "c")) == ["a", "b"] and keys(t.range("i")) == ["i", "j"] and keys(t.range("c", "c")) == []
        assert [k.decode() for k, _ in t.iterator(False)] == list("jihgfedcba")
        it = t.iterator()
        assert [it.next()[0], it.next()[0], it.next()[0]] == [b"a", b"b", b"c"]
        assert it.prev()[0] == b"b" and not it.is_ascending
        it.set_direction(True)
        assert it.next()[0] == b"c" and it.has_next() and it.has_prev()
        it.close()
        assert it.next() is None
        for bad in (lambda: t.range(), lambda: t.range("g", "c"), lambda: t.prefix("")):
            with pytest.raises(ValueError):
                bad()


def test_prefixes(store):
    put(store, **{f"user:{i:03}": "u" for i in range(1, 5)}, **{f"post:{i:03}": "p" for i in range(1, 5)}, **{"config:001": "c"})
    with store.view() as t:
        assert keys(t.prefix("user:")) == [f"user:{i:03}" for i in range(1, 5)]
        assert [k.decode() for k, _ in t.prefix_iterator("user:", False)] == [f"user:{i:03}" for i in range(4, 0, -1)]
        assert keys(t.prefix("nobody")) == []


def test_overwrites_over_runs(store):
    for v, r in (("v1", range(30)), ("v2", range(10, 40)), ("v3", range(20, 50))):
        put(store, **{f"key{i:02}": v for i in r})
        store.force_flush()
    with store.view() as t:
        got = {bytes(r.key).decode(): bytes(r.value).decode() for r in t.range("key15", "key35").collect()}
    assert got == {f"key{i:02}": "v2" if i < 20 else "v3" for i in range(15, 35)}


def test_time_travel_over_flush_and_compaction(store):
    seen = []
    for i in range(1, 6):
        put(store, mvcc=f"value{i}")
        seen.append(store._last_ts)
        store.force_flush()

    def values():
        out = []
        for ts in seen:
            with store.view() as t:
                t.timestamp = ts
                out.append(t.get("mvcc"))
        return out

    want = [f"value{i}".encode() for i in range(1, 6)]
    assert values() == want
    store.compact([r["run_id"] for r in store.manifest.runs], 2)
    assert values() == want and len(store.manifest.runs) == 1


def test_isolation_and_last_operation_wins(store):
    put(store, k="initial")
    a = store.begin()
    put(store, k="updated")
    b = store.begin()
    assert (a.get("k"), a.get("k"), b.get("k")) == (b"initial", b"initial", b"updated")
    b.put("x", "1")
    b.delete("x")
    b.delete("k")
    b.put("k", "mine")
    with pytest.raises(KeyNotFound):
        b.get("x")
    assert b.get("k") == b"mine" and keys(b.scan()) == ["k"]
    b.commit()
    b.commit()
    with pytest.raises(RuntimeError):
        b.put("late", "1")
    with store.view() as t:
        assert t.get("k") == b"mine"


def test_bad_arguments(store):
    t = store.begin()
    for bad in (lambda: t.put("", "v"), lambda: t.put("k", ""), lambda: t.put(None, "v"), lambda: t.delete(""), lambda: t.get("")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyNotFound):
        t.get("absent")
    t.rollback()
    t.rollback()


def test_update_rolls_back_on_errors(store):
    with pytest.raises(ZeroDivisionError):
        store.run_update(lambda t: (t.put("k", "v"), 1 / 0))
    with store.view() as t, pytest.raises(KeyNotFound):
        t.get("k")


def test_recovery(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    one = Engine(spark, root)
    put(one, committed="yes")
    one.begin().put("lost", "1")
    back = one.begin()
    back.put("rolled", "1")
    back.rollback()
    left = one.begin()
    left.put("left", "1")
    left.save()
    two = Engine(spark, root, Options(recover_uncommitted=True))  # the first was never closed
    with two.view() as t:
        assert keys(t.scan()) == ["committed"]
    assert two.get_txn(left.id).write_set == {b"left": b"1"}
    two.force_flush()
    assert Engine(spark, root).snapshot().count() == 1


def test_deleted_keys_stay_deleted(store):
    put(store, zombie="alive")
    store.force_flush()
    with store.update() as t:
        t.delete("zombie")
        for i in range(20):
            t.put(f"pad{i}", "x")
    store.force_flush()
    for r in list(store.manifest.runs):
        store.compact([r["run_id"]], 2)
    store.options.retain_after = store._last_ts
    store.compact([max(r["run_id"] for r in store.manifest.runs)], 3)
    with store.view() as t, pytest.raises(KeyNotFound):
        t.get("zombie")
    store.compact([r["run_id"] for r in store.manifest.runs], 3)
    assert store.log().where("op = 1").count() == 0 and store.snapshot().count() == 20
    assert store.vacuum() and store.snapshot().count() == 20


def test_picks():
    assert C.pick_size_tiered(list(enumerate([100, 120, 149, 151, 200], 1)), threshold=5) == [1, 2, 3]
    assert C.pick_size_tiered([(1, 5)]) == []
    runs = [dict(run_id=i, min_key=a, max_key=b) for i, (a, b) in enumerate([("apple", "banana"), ("cat", "zebra"), ("dog", "elephant"), ("apple", "apple")], 1)]
    assert C.pick_leveled(runs, [])[0] == 4
    assert C.distribute_groups([1000, 2000, 3000, 4000]) == ([0, 1, 2], [3])


def test_groups_of_touching_ranges(spark):
    runs = spark.createDataFrame([(1, "apple", "banana"), (2, "banana", "cherry"), (3, "dog", "elephant"), (4, "elephant", "fox"), (5, "zebra", "zulu")], "run_id int, min_key string, max_key string")
    assert [r.group_id for r in C.key_range_groups(runs).orderBy("run_id").collect()] == [0, 0, 1, 1, 2]


def test_compaction_keeps_answers(store):
    for i in range(9):
        put(store, **{f"k{j}": f"{i}-{j}" for j in range(i, i + 5)})
        store.force_flush()
    before = {bytes(r.key): bytes(r.value) for r in store.snapshot().collect()}
    assert store.compact_if_needed() is not None
    assert {bytes(r.key): bytes(r.value) for r in store.snapshot().collect()} == before
    assert "option level_count" in store.stats()
    assert store.level_scores().count() >= 1


def test_against_a_dict_of_versions(spark, tmp_path):
    rng, model = random.Random(7), []
    e = Engine(spark, f"file://{tmp_path}/db", Options(cooldown_s=1e-9))
    names = [f"k{i}" for i in range(12)]
    for step in range(12):
        with e.update() as t:
            ops = {}
            for _ in range(rng.randrange(1, 5)):
                k = rng.choice(names)
                if rng.random() < 0.3:
                    t.delete(k)
                    ops[k] = None
                else:
                    t.put(k, f"{step}-{k}")
                    ops[k] = f"{step}-{k}"
        model.append((e._last_ts, ops))
        if step % 4 == 3:
            e.force_flush()
    e.compact([r["run_id"] for r in e.manifest.runs], 2)
    for ts in (model[3][0], model[7][0], model[-1][0]):
        want = {}
        for at, ops in model:
            if at <= ts:
                want |= ops
        got = {bytes(r.key).decode(): bytes(r.value).decode() for r in e.snapshot(ts).collect()}
        assert got == {k: v for k, v in want.items() if v}


def test_streamed_batches(spark, tmp_path, store):
    from palimpsest.streaming import ingest

    spark.createDataFrame([("a", "1", 0), ("b", "2", 0)], "key string, value string, op int").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("key string, value string, op int").parquet(f"{tmp_path}/in")
    ingest(s, store, f"{tmp_path}/cp").awaitTermination()
    assert store.snapshot().count() == 2
    spark.createDataFrame([("a", None, 1)], "key string, value string, op int").write.mode("append").parquet(f"{tmp_path}/in")
    ingest(s, store, f"{tmp_path}/cp").awaitTermination()
    with store.view() as t:
        assert keys(t.scan()) == ["b"]


def test_bulk_load_and_multi_get(spark, store):
    store.append(spark.range(100).selectExpr("cast(id as string) as key", "concat('v', id) as value"))
    with store.view() as t:
        t.put("5", "mine")
        t.delete("6")
        asked = spark.createDataFrame([(b"5",), (b"6",), (b"7",), (b"x",)], "key binary")
        got = {bytes(r.key): (r.value and bytes(r.value), r.found) for r in t.multi_get(asked).collect()}
    assert got == {b"5": (b"mine", True), b"6": (None, False), b"7": (b"v7", True), b"x": (None, False)}


def test_rolled_back_recovered_transaction_stays_away(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    with Engine(spark, root) as e:
        t = e.begin()
        t.put("a", "1")
        t.save()
    with Engine(spark, root, Options(recover_uncommitted=True)) as e:
        (t,) = e._txns.values()
        assert t.get("a") == b"1"
        t.rollback()
    with Engine(spark, root, Options(recover_uncommitted=True)) as e:
        assert not e._txns and e.snapshot().count() == 0


def test_commits_after_an_append_of_later_times(spark, store):
    store.append(spark.createDataFrame([("a", "old", 0, 1 << 62)], "key string, value string, op int, ts long"))
    put(store, a="new")
    assert bytes(store.snapshot().first().value) == b"new"


def test_later_rows_of_an_append_win(spark, store):
    store.append(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), ("a", "4")], "key string, value string").coalesce(1))
    assert {bytes(r.key): bytes(r.value) for r in store.snapshot().collect()} == {b"a": b"4", b"b": b"3"}


def test_a_batch_and_its_number_are_published_together(spark, tmp_path):
    root, rows = f"file://{tmp_path}/db", spark.createDataFrame([("a", "1")], "key string, value string")
    with Engine(spark, root) as e:
        e.append(rows, batch=("s", 3))
        put(e, a="2")
    with Engine(spark, root) as e:  # as after a crash right after the append
        assert e.manifest.batches == {"s": 3} and len(e.manifest.runs) == 1
        assert bytes(e.snapshot().first().value) == b"2"


def test_ranges_leave_out_runs_by_their_bounds(spark, store):
    for k in "am":
        store.append(spark.createDataFrame([(f"{k}{i}", "v") for i in range(5)], "key string, value string"))
    with store.view() as t:
        assert keys(t.range("m1", "m3")) == ["m1", "m2"] and keys(t.prefix("a")) == [f"a{i}" for i in range(5)]
        assert len(store.snapshot(start=b"m1", end=b"m3").inputFiles()) < len(store.snapshot().inputFiles())
    assert store.snapshot(start=b"x", end=b"y").count() == 0


def test_size_tiered_needs_the_full_threshold(spark, store):
    store.options.write_buffer_size = 1  # any level scores above 1
    put(store, a="1")
    store.force_flush()
    assert store.pick() is None


def test_last_level_is_dealt_upwards(spark, tmp_path):
    with Engine(spark, f"file://{tmp_path}/db", Options(write_buffer_size=1, level_count=3, level_multiplier=1, partition_ratio=0.9)) as e:
        for k in "abc":
            e.append(spark.createDataFrame([(f"{k}{i}", "v" * 10) for i in range(3)], "key string, value string"))
        for r in e.manifest.runs:
            r["level"] = 3
        before = keys(e.snapshot().orderBy("key"))
        assert e.partition_last_level() is not None
        assert keys(e.snapshot().orderBy("key")) == before and {r["level"] for r in e.manifest.runs} <= {1, 2, 3} and any(r["level"] < 3 for r in e.manifest.runs)


def test_scans_come_in_order(spark):
    from palimpsest import queries as Q

    for name, down in (("q06_range", False), ("q07_open_start", False), ("q08_open_end", True), ("q09_prefix", False)):
        got = [r.c_name for r in Q.queries()[name](spark, "/root/testdata/sf0.01").collect()]
        assert got and got == sorted(got, reverse=down)
