"""Tables, visibility, crashes and sessions."""

import random
import threading
import time

import pytest

from snaptable.database import Database, DatabaseError
from snaptable.executor import Session
from snaptable.sources.catalog import CatalogError
from snaptable.table import TableError
from snaptable.txn.locks import DeadlockError
from snaptable.txn.manager import UnknownTransaction

USERS = (("id", "int"), ("name", "string"))


@pytest.fixture
def users(db):
    return db.create_table("users", USERS)


def test_rows_come_and_go(users):
    assert users.scan_all() == [] and users.get_by_key("40") is None
    for key, name in (("40", "oar"), ("7", "mast"), ("", "")):
        users.insert([key, name])
    assert users.delete_by_key("7") and not users.delete_by_key("7") and not users.update_by_key("7", ["7", "x"])
    assert users.update_by_key("40", ["40", "keel"])
    assert users.scan_all() == [("", ["", ""]), ("40", ["40", "keel"])]
    assert users.get_by_key("40") == ["40", "keel"] and users.get_by_key("") == ["", ""]


def test_wrong_numbers_of_values(users):
    with pytest.raises(TableError, match="^No values provided for insert.$"):
        users.insert([])
    with pytest.raises(TableError, match="^Mismatched column count in insert.$"):
        users.insert(["1"])
    with pytest.raises(TableError, match="^Mismatched column count in update.$"):
        users.update_by_key("1", ["1", "2", "3"])


def test_keys_come_in_byte_order(users):
    for k in ("2", "10", "1", "9", "é", "z"):
        users.insert([k, "x"])
    assert [k for k, _ in users.scan_all()] == ["1", "10", "2", "9", "z", "é"]


def test_an_insert_shows_to_itself_and_after_commit_to_all(db, users):
    t = db.begin()
    users.insert(["1", "a"], t)
    assert users.get_by_key("1", t) and users.get_by_key("1") is None
    db.commit(t)
    assert users.get_by_key("1") == ["1", "a"]
    with pytest.raises(UnknownTransaction):
        users.insert(["2", "b"], t)


def test_a_commit_after_the_snapshot_does_not_show(db, users):
    reader = db.begin()
    users.insert(["2", "b"])
    assert users.get_by_key("2", reader) is None and users.scan_all(reader) == []
    assert users.get_by_key("2", db.begin()) == ["2", "b"]


def test_what_is_dropped_never_was(db, users):
    t = db.begin()
    users.insert(["3", "c"], t)
    db.abort(t)
    assert users.get_by_key("3") is None
    users.insert(["4", "d"])
    t = db.begin()
    assert users.delete_by_key("4", t) and users.get_by_key("4", t) is None
    db.abort(t)
    assert users.get_by_key("4") == ["4", "d"]
    assert users.update_by_key("4", ["4", "e"]) and users.delete_by_key("4")  # a dropped delete leaves no trace


def test_readers_of_four_moments(db, users):
    moments = [db.begin()]
    for change in (lambda: users.insert(["a", "v1"]), lambda: users.update_by_key("a", ["a", "v2"]), lambda: users.delete_by_key("a"), lambda: users.insert(["a", "v4"])):
        change()
        moments.append(db.begin())
    assert [users.get_by_key("a", t) for t in moments] == [None, ["a", "v1"], ["a", "v2"], None, ["a", "v4"]]
    assert [len(users.scan_all(t)) for t in moments] == [0, 1, 1, 0, 1]


def test_a_key_changed_many_times_in_one_transaction(db, users):
    users.insert(["k", "before"])
    t = db.begin()
    users.update_by_key("k", ["k", "once"], t)
    users.delete_by_key("k", t)
    assert users.scan_all(t) == [] and not users.update_by_key("k", ["k", "no"], t)
    users.insert(["k", "again"], t)
    assert users.scan_all(t) == [("k", ["k", "again"])] and users.scan_all() == [("k", ["k", "before"])]
    db.commit(t)
    assert users.scan_all() == [("k", ["k", "again"])]


def test_both_tables_or_none(db):
    a, b = db.create_table("a", (("id", "int"),)), db.create_table("b", (("id", "int"),))
    t = db.begin()
    a.insert(["1"], t)
    b.insert(["1"], t)
    assert a.scan_all() == b.scan_all() == []
    db.commit(t)
    assert len(a.scan_all()) == len(b.scan_all()) == 1
    with pytest.raises(CatalogError, match="^Database::getTable: no such table: c$"):
        db.table("c")


def test_committed_work_survives_and_open_work_does_not(spark, tmp_path):
    with Database(spark, str(tmp_path)) as db:
        t = db.create_table("users", USERS)
        for i in "123":
            t.insert([i, i])
        open_one = db.begin()
        t.insert(["4", "x"], open_one)
        t.update_by_key("1", ["1", "x"], open_one)
        t.delete_by_key("2", open_one)
        with pytest.raises(DatabaseError):
            Database(spark, str(tmp_path))
        number = open_one.id
    with Database(spark, str(tmp_path)) as db:
        t = db.table("users")
        assert t.scan_all() == [(i, [i, i]) for i in "123"]
        again = db.begin()
        t.insert(["4", "y"], again)
        t.update_by_key("1", ["1", "y"], again)
        t.delete_by_key("2", again)
        assert again.id >= number
        db.commit(again)
    with Database(spark, str(tmp_path)) as db:
        assert dict(db.table("users").scan_all()) == {"1": ["1", "y"], "3": ["3", "3"], "4": ["4", "y"]}


def test_a_second_writer_waits_and_builds_on_what_it_finds(db):
    t = db.create_table("t", (("id", "string"), ("a", "string"), ("b", "string")))
    t.insert(["1", "a0", "b0"])
    first, second = db.begin(), db.begin()
    t.update_where({"a": "a1"}, None, first)
    threading.Timer(0.1, db.commit, [first]).start()
    began = time.monotonic()
    assert t.update_where({"b": "b2"}, None, second) == 1 and time.monotonic() - began >= 0.08
    db.commit(second)
    assert t.get_by_key("1") == ["1", "a1", "b2"]


def test_a_row_deleted_while_waiting_is_not_written(db, users):
    users.insert(["1", "a"])
    first, second = db.begin(), db.begin()
    users.delete_by_key("1", first)
    threading.Timer(0.1, db.commit, [first]).start()
    assert not users.update_by_key("1", ["1", "b"], second)
    db.commit(second)
    assert users.scan_all() == []


def test_a_deadlock_over_tables_ends(db, users):
    users.insert(["1", "a"])
    users.insert(["2", "b"])
    one, two = db.begin(), db.begin()
    users.update_by_key("1", ["1", "x"], one)
    users.update_by_key("2", ["2", "x"], two)
    failed = []

    def other():
        try:
            users.update_by_key("1", ["1", "y"], two)
        except DeadlockError as e:
            failed.append(e)
            db.abort(two)

    thread = threading.Thread(target=other)
    thread.start()
    time.sleep(0.1)
    assert users.update_by_key("2", ["2", "z"], one)
    thread.join(5)
    db.commit(one)
    assert failed and dict(users.scan_all()) == {"1": ["1", "x"], "2": ["2", "z"]}


# Sessions ---------------------------------------------------------------------------------------


def run(session, *statements):
    return [session.execute(s).formatted() for s in statements]


def test_sql_over_a_small_table(db):
    s = Session(db)
    assert run(s, "CREATE TABLE users (id string PRIMARY KEY, name string, age int);") == ["OK\n"]
    run(s, "INSERT INTO users VALUES ('1','Alice',30);", "INSERT INTO users VALUES ('2','Bob',25);", "INSERT INTO users VALUES ('3','Carol',40);")
    assert run(s, "SELECT name FROM users WHERE age > 26;") == ["name\nAlice\nCarol\nOK 2 rows\n"]
    assert run(s, "UPDATE users SET name = 'B', age = 26 WHERE id = '2';", "DELETE FROM users WHERE name = 'Alice';") == ["OK 1 rows affected\n"] * 2
    assert run(s, "SELECT * FROM users;") == ["id|name|age\n2|B|26\n3|Carol|40\nOK 2 rows\n"]
    assert run(s, "SELECT age, age FROM users WHERE age != 40;") == ["age|age\n26|26\nOK 1 rows\n"]


def test_ints_compare_as_numbers_and_keys_as_text(db):
    s = Session(db)
    run(s, "CREATE TABLE t (id int PRIMARY KEY, age int);", "INSERT INTO t VALUES (7, 9);", "INSERT INTO t VALUES (10, 10);")
    assert run(s, "SELECT id FROM t WHERE age > 9;") == ["id\n10\nOK 1 rows\n"]
    assert run(s, "SELECT id FROM t WHERE id = 007;", "SELECT id FROM t WHERE id >= 7;") == ["id\nOK 0 rows\n", "id\n10\n7\nOK 2 rows\n"]
    run(s, "UPDATE t SET id = 8 WHERE id = 7;")
    assert run(s, "SELECT id FROM t WHERE id = 7;", "SELECT id FROM t WHERE id = 8;") == ["id\n8\nOK 1 rows\n", "id\nOK 0 rows\n"]
    run(s, "INSERT INTO t VALUES ('a', 'x');")
    assert run(s, "SELECT * FROM t WHERE age > 1;") == ["ERROR: stoll\n"]
    assert run(s, "SELECT age FROM t WHERE id = 'a';") == ["age\nx\nOK 1 rows\n"]


@pytest.mark.parametrize(
    ("sql", "reply"),
    [
        ("SELECT x FROM users;", "ERROR: no such column: x\n"),
        ("SELECT * FROM users WHERE ID = 1;", "ERROR: no such column: ID\n"),
        ("UPDATE users SET x = 1;", "ERROR: no such column: x\n"),
        ("SELECT * FROM Users;", "ERROR: Database::getTable: no such table: Users\n"),
        ("CREATE TABLE users (a int);", "ERROR: Table already exists: users\n"),
        ("CREATE TABLE u (a real);", "ERROR: unknown column type 'real' (expected int or string)\n"),
        ("INSERT INTO users VALUES (1);", "ERROR: Mismatched column count in insert.\n"),
        ("COMMIT;", "ERROR: no transaction is in progress on this connection\n"),
        ("ROLLBACK;", "ERROR: no transaction is in progress on this connection\n"),
        ("SELECT 'x;", "ERROR: unterminated string literal (at position 7)\n"),
    ],
)
def test_errors_are_replies(db, users, sql, reply):
    assert run(Session(db), sql) == [reply]


def test_transactions_in_sql(db):
    s, other = Session(db), Session(db)
    run(s, "CREATE TABLE t (id string PRIMARY KEY);")
    assert run(s, "BEGIN;", "BEGIN;") == ["OK\n", "ERROR: a transaction is already in progress on this connection\n"]
    run(s, "INSERT INTO t VALUES ('1');", "SELECT nothing;", "CREATE TABLE made (a int);")
    assert run(other, "SELECT * FROM t;") == ["id\nOK 0 rows\n"] and run(s, "COMMIT;") == ["OK\n"]
    run(s, "BEGIN;", "INSERT INTO t VALUES ('2');", "CREATE TABLE stays (a int);", "ROLLBACK;")
    assert run(other, "SELECT * FROM t;") == ["id\n1\nOK 1 rows\n"] and db.has_table("stays")


def test_random_work_against_a_plain_map(spark, tmp_path):
    seed = random.randrange(1 << 30)
    print("seed", seed)
    rng, model = random.Random(seed), {}
    db = Database(spark, str(tmp_path))
    table = db.create_table("fuzz", (("id", "string"), ("value", "string")))
    for step in range(3000):
        key, value = str(rng.randrange(50)), f"v{step}"
        what = rng.random()
        if what < 0.4 and key not in model:
            table.insert([key, value])
            model[key] = value
        elif what < 0.6:
            assert table.update_by_key(key, [key, value]) == (key in model)
            if key in model:
                model[key] = value
        elif what < 0.75:
            assert table.delete_by_key(key) == (model.pop(key, None) is not None)
        elif what < 0.9:
            assert table.get_by_key(key) == ([key, model[key]] if key in model else None)
        elif what < 0.97:
            t, shadow = db.begin(), dict(model)
            for k in rng.sample(range(50), 3):
                if table.delete_by_key(str(k), t):
                    del shadow[str(k)]
                else:
                    table.insert([str(k), value], t)
                    shadow[str(k)] = value
            if rng.random() < 0.5:
                db.commit(t)
                model = shadow
            else:
                db.abort(t)
        elif what < 0.99:
            assert dict(table.scan_all()) == {k: [k, v] for k, v in model.items()}
        elif what < 0.9925:
            db.close()
            db = Database(spark, str(tmp_path))
            table = db.table("fuzz")
        elif what < 0.994 and model:
            assert db.fold(table)
    assert dict(table.scan_all()) == {k: [k, v] for k, v in model.items()}
    assert {r.id: r.value for r in table.frame().collect()} == model
    db.close()


def test_many_writers_and_a_steady_reader(db):
    table = db.create_table("stress", (("id", "string"), ("value", "string")))
    for i in range(60):
        table.insert([f"k{i}", "v0"])
    reader = db.begin()
    before = table.scan_all(reader)

    def work(w):
        own = [f"k{i}" for i in range(w * 15, w * 15 + 15)]
        for turn in (1, 2):
            for k in own:
                assert table.update_by_key(k, [k, f"v{turn}"])
        for k in own[:5]:
            assert table.delete_by_key(k)
        for i in range(10):
            table.insert([f"n{w}-{i}", "new"])

    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    while any(t.is_alive() for t in threads):
        assert table.scan_all(reader) == before
    [t.join() for t in threads]
    rows = {k: f[1] for k, f in table.scan_all()}
    assert len(rows) == 60 - 20 + 40 and all(v in ("v2", "new") for v in rows.values())
    assert table.scan_all(reader) == before
