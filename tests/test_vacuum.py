"""Vacuum beside open writers, history over reopening, keys and ranges out of change files, folds that come by themselves."""

import random

import pytest

from snaptable import table as module
from snaptable.database import Database
from snaptable.sql.ast import Condition
from snaptable.streaming.changes import changes_since

COLUMNS = (("id", "int"), ("name", "string"))


def rows(spark, keys, tag="x"):
    return spark.createDataFrame([(k, f"{tag}{k}") for k in keys], "id int, name string")


def test_an_open_load_outlives_a_vacuum(spark, db):
    a, b = db.create_table("a", COLUMNS), db.create_table("b", COLUMNS)
    b.load(rows(spark, range(50)))
    t = db.begin()
    a.load(rows(spark, range(100)), t)
    b.update_where({"name": "y"}, Condition("id", ">=", "0"), t)
    b.load(rows(spark, [7, 1000], "z"), t)
    dropped = db.begin()
    a_gone = db.create_table("c", COLUMNS)
    a_gone.load(rows(spark, range(9)), dropped)
    assert db.vacuum() == 0
    db.abort(dropped)
    assert db.vacuum() == 1
    db.commit(t)
    assert a.frame().count() == 100 and b.get_by_key("7") == ["7", "z7"] and b.get_by_key("8") == ["8", "y"] and b.frame().count() == 51


def test_a_fold_that_is_being_written_outlives_a_vacuum(spark, db, monkeypatch):
    t = db.create_table("t", COLUMNS)
    t.load(rows(spark, range(50)))
    t.load(rows(spark, range(25, 75), "y"))
    whole = module.Table.write_base

    def write_base(self, *how):
        found = whole(self, *how)
        assert db.vacuum() == 0  # neither the old base, nor its changes, nor the new base
        return found

    monkeypatch.setattr(module.Table, "write_base", write_base)
    assert db.fold(t) and t.frame().count() == 75 and t.get_by_key("30") == ["30", "y30"]
    assert db.vacuum() == 2 and t.frame().filter("name like 'y%'").count() == 50


def test_history_after_a_vacuum_and_reopening(spark, tmp_path):
    with Database(spark, str(tmp_path)) as db:
        t = db.create_table("t", COLUMNS)
        t.load(rows(spark, range(20)))
        t.update_where({"name": "one"}, Condition("id", "<", "5"))
        t.load(rows(spark, [3, 99], "late"))
        before = t.versions().count()
        assert before == 27 and db.fold(t) and db.vacuum() == 2
        t.insert(["500", "after"])
        want = sorted(map(tuple, t.versions().collect()), key=repr)
    with Database(spark, str(tmp_path)) as db:
        t = db.table("t")
        assert sorted(map(tuple, t.versions().collect()), key=repr) == want and len(want) == 22
        assert len(t.dump()) == 22 and t.dump()[-1].endswith("99|late99")
        assert changes_since(t, db.log.last - 1).count() == 1 and t.get_by_key("2") == ["2", "one"]
        assert db.vacuum() == 0


def test_one_rule_for_rows_of_one_key(spark, db):
    """The greatest by columns, numbers as numbers, whether the table is empty or not."""
    same = spark.createDataFrame([(1, 9), (1, 10), (2, None), (2, -3), (3, None)], "id int, v int")
    for k, first in enumerate((False, True)):
        t = db.create_table(f"t{k}", (("id", "int"), ("v", "int")))
        if first:
            t.load(spark.createDataFrame([(8, 8)], "id int, v int"))
        t.load(same)
        assert [t.get_by_key(i) for i in "123"] == [["1", "10"], ["2", "-3"], ["3", ""]]


def test_keys_and_ranges_without_a_job(spark, db, monkeypatch):
    t = db.create_table("t", COLUMNS)
    t.load(rows(spark, range(0, 3000, 2)))
    old = db.begin()
    assert t.update_where({"name": "even"}, Condition("id", ">=", "1000")) == 1000
    t.load(rows(spark, range(2001, 2400, 2), "odd"))
    assert t.delete_where(Condition("id", ">", "2390")) == 309
    t.update_by_key("1000", ["1000", "single"])
    t.delete_by_key("1002")
    own = db.begin()
    t.insert(["1003", "own"], own)
    t.delete_by_key("1004", own)
    seen = {}
    for name, txn in (("now", None), ("old", old), ("own", own)):
        seen[name] = sorted((r["__key"], [r["f0"], r["f1"]]) for r in t.raw(txn).collect())
    monkeypatch.setattr(module.Table, "raw", None)
    monkeypatch.setattr(module.snapshot, "visible", None)
    rng = random.Random(1)
    for name, txn in (("now", None), ("old", old), ("own", own)):
        whole = dict(seen[name])
        for low, high in [("", "\U0010ffff"), ("1000", "1004"), ("5", "4")] + [tuple(sorted(str(rng.randrange(3000)) for _ in "ab")) for _ in range(30)]:
            assert t.range_by_key(low, high, txn) == [(k, f) for k, f in seen[name] if low <= k <= high]
        for k in map(str, rng.sample(range(3100), 200)):
            assert t.get_by_key(k, txn) == whole.get(k)


def test_folds_come_by_themselves(spark, db, monkeypatch):
    monkeypatch.setattr(module, "FOLD_FILES", 3)
    t = db.create_table("t", COLUMNS)
    for k in range(12):
        t.load(rows(spark, range(10 * k, 10 * k + 10)))
        assert len(db.txns.chains[t.number].files) <= 3
    monkeypatch.setattr(module, "FOLD_ROWS", 5)
    t.load(rows(spark, range(300)))
    assert not db.txns.chains[t.number].files and t.frame().count() == 300 and len(db.txns.chains[t.number].base["files"]) >= 1


@pytest.mark.parametrize("batches", [3])
def test_a_batch_already_in_the_log_is_not_loaded_again(spark, db, batches):
    t = db.create_table("t", COLUMNS)
    for k in range(batches):
        t.load(rows(spark, [k]), stream=["s", k])
    assert db.log.marks == {"s": 2}
