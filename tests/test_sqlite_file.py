import os
import random
import sqlite3
from contextlib import closing

import pytest

from tarn.errors import FileFormatError
from tarn.session import Engine
from tarn.plans.parser import parse
from tarn.sources.file_format import FileWriter, Pages, encode_record, encode_varint, record, signed, varint
from tarn.sources.sqlite_file import SqliteFileSource, master, parse_ddl


def database(path, *statements, page_size=4096, many=()):
    with sqlite3.connect(path) as db:
        db.execute(f"PRAGMA page_size = {page_size}")
        for s in statements:
            db.execute(s)
        for s, rows in many:
            db.executemany(s, rows)
    db.close()
    return str(path)


@pytest.mark.parametrize("page_size", [512, 4096, 65536])
def test_values_and_overflow(spark, tmp_path, page_size):
    rows = [(i, n, f, t, b) for i, (n, f, t, b) in enumerate([
        (None, None, None, None), (0, 0.0, "", b""), (1, 1.0, "é", b"\x00"), (-1, -2.5, "x" * 100_000, b"y" * 5000), (127, 1e300, "z", b"z"), (-129, 3.0, "a", b"b"),
        (2**15, 0.5, "t", b"u"), (-(2**23), 0.5, "t", b"u"), (2**31, 0.5, "t", b"u"), (-(2**47), 0.5, "t", b"u"), (2**63 - 1, 0.5, "t" * 480, b"u"), (-(2**63), 0.5, "t" * 4061, b"u"),
    ])]
    path = database(tmp_path / "v.db", "CREATE TABLE v (id INT, n INT, f REAL, t TEXT, b BLOB)", page_size=page_size, many=[("INSERT INTO v VALUES (?,?,?,?,?)", rows)])
    got = Engine(spark).open_file(path).execute("SELECT * FROM v").collect()
    assert [(r.id, r.n, r.f, r.t, None if r.b is None else bytes(r.b)) for r in got] == rows


def test_tree_partitions_and_rowid(spark, tmp_path):
    rows = [(7 * i, f"name {i}") for i in range(1, 5001)]
    path = database(tmp_path / "t.db", "CREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT, name TEXT)", page_size=512, many=[("INSERT INTO t VALUES (?,?)", rows)])
    engine = Engine(spark).open_file(path, rowid="true")
    df = engine.catalog.table("t")
    assert df.rdd.getNumPartitions() > 1
    assert sorted((r.id, r.name) for r in df.collect()) == rows and all(r.id == r._rowid for r in df.take(9))
    assert engine.execute("SELECT name FROM t WHERE id = 70").collect()[0].name == "name 10"


def test_rowid_ranges(spark, tmp_path):
    rows = [(3 * i - 6000, "x" * 50) for i in range(4000)]
    path = database(tmp_path / "p.db", "CREATE TABLE p (id INTEGER PRIMARY KEY, t TEXT)", page_size=512, many=[("INSERT INTO p VALUES (?,?)", rows)])
    with Pages(path) as pages:
        splits = pages.splits(2)
        assert len(splits) >= 64 and splits[0].low == -(2**63) and splits[-1].high == 2**63 - 1
        for s in splits[::7]:
            assert all(s.low <= rowid <= s.high for rowid, _ in pages.rows(s.page))
        assert all(a.high + 1 == b.low for a, b in zip(splits, splits[1:]))
    whole = Engine(spark).open_file(path).catalog.table("p").rdd.getNumPartitions()
    for low, high in ((300, 300), (-(10**9), -5900), (5000, 5010), (100_000, 200_000)):
        df = Engine(spark).open_file(path, rowid_from=low, rowid_to=high).catalog.table("p")
        assert sorted(r.id for r in df.collect()) == [i for i, _ in rows if low <= i <= high]
        assert df.rdd.getNumPartitions() < whole / 4


def test_foreign_schemas(spark, tmp_path):
    path = database(
        tmp_path / "f.db", "CREATE TABLE \"odd name\" (\"a b\" INTEGER, [c] VARCHAR(9) DEFAULT 'x, y', d, e INT CHECK (e > 0), UNIQUE (c), CONSTRAINT k PRIMARY KEY (\"a b\"))",
        "INSERT INTO \"odd name\" VALUES (5, 'q', NULL, 1)", "ALTER TABLE \"odd name\" ADD COLUMN late TEXT", "CREATE TABLE empty (a INT)", "CREATE INDEX i ON empty (a)",
    )
    engine = Engine(spark).open_file(path)
    assert engine.catalog.tables()[:2] == ["empty", "odd name"] or {"empty", "odd name"} <= set(engine.catalog.tables())
    row = engine.catalog.table("odd name").collect()[0]
    assert tuple(row) == (5, "q", None, 1, None)
    assert engine.execute("SELECT * FROM empty").count() == 0


def test_mixed_classes(spark, tmp_path):
    path = database(tmp_path / "m.db", "CREATE TABLE m (a)", many=[("INSERT INTO m VALUES (?)", [(1,), (2.5,), ("x",), (b"y",), (None,)])])
    with pytest.raises(Exception, match="dynamic"):
        Engine(spark).open_file(path).execute("SELECT a FROM m").collect()
    tags = [r.a.tag if r.a else None for r in Engine(spark).open_file(path, mode="dynamic").execute("SELECT a FROM m").collect()]
    assert tags == [1, 1, 2, 3, None]


def test_bad_files(tmp_path):
    good = bytearray(open(database(tmp_path / "g.db", "CREATE TABLE g (a INT)"), "rb").read())
    for at, value in ((0, 0), (16, 3), (18, 9), (21, 1), (47, 9), (59, 2), (59, 7), (72, 1), (100, 2)):
        bad = bytearray(good)
        bad[at] = value
        path = tmp_path / f"bad{at}-{value}.db"
        path.write_bytes(bad)
        with pytest.raises(FileFormatError), Pages(str(path)) as pages:
            list(pages.rows(1))
    (tmp_path / "short.db").write_bytes(good[:50])
    with pytest.raises(FileFormatError):
        Pages(str(tmp_path / "short.db"))


def test_varint_and_record():
    for n in [*range(300), 2**14 - 1, 2**14, 2**32 - 1, 2**56 - 1, 2**56, 2**63, 2**64 - 1]:
        data = encode_varint(n)
        assert varint(data, 0) == (n, len(data)) and len(data) == min(9, max(1, -(-n.bit_length() // 7)))
    assert signed(varint(encode_varint(-5), 0)[0]) == -5
    with pytest.raises(FileFormatError):
        varint(b"\x80", 0)
    assert record(bytes([4, 8, 9, 1, 0xFF])) == [0, 1, -1]
    for bad in ([2, 10], [2, 20, 1], [9, 1]):
        with pytest.raises(FileFormatError):
            record(bytes(bad))
    for width in (1, 2, 3, 4, 6, 8):
        for n in (-(1 << 8 * width - 1), (1 << 8 * width - 1) - 1):
            assert record(encode_record([n])) == [n]
    row = [None, 0, 1, -1, 2**40, 1.5, "é" * 200, b"\x00" * 9, "", b""] + [None] * 200
    assert record(encode_record(row)) == row
    assert record(encode_record(row), [6, 0, 300]) == ["é" * 200, None, None]
    with pytest.raises(FileFormatError):
        encode_record([2**63])


def test_ddl():
    got = parse_ddl('CREATE TABLE x (id INTEGER PRIMARY KEY, "t""q" DOUBLE PRECISION NOT NULL, n DECIMAL(10, 2) DEFAULT (1 + 2), FOREIGN KEY (n) REFERENCES y(z))')
    assert [(c.name, c.type_name, c.is_rowid) for c in got] == [("id", "INTEGER", True), ('t"q', "DOUBLE PRECISION", False), ("n", "DECIMAL", False)]
    with pytest.raises(FileFormatError):
        parse_ddl("CREATE TABLE x (a INT PRIMARY KEY) WITHOUT ROWID")


def tall(path, n=3000):
    rows = [(7 * i, "x" * (i % 60), i % 11) for i in range(-n // 2, n // 2)]
    draw = random.Random(1)
    return rows, database(path, "CREATE TABLE t (id INTEGER PRIMARY KEY, name TEXT, k INT)", "CREATE INDEX i ON t (k, name)", page_size=512, many=[("INSERT INTO t VALUES (?,?,?)", draw.sample(rows, len(rows)))])


def test_cursors(tmp_path):
    rows, path = tall(tmp_path / "c.db")
    with Pages(path) as pages:
        root = next(r for n, r, *_ in master(pages) if n == "t")
        assert [r for r, _ in pages.rows(root, reverse=True)] == [i for i, *_ in reversed(rows)]
        for probe in (rows[0][0], rows[-1][0], 0, 7 * 1234):
            assert pages.seek(root, probe) == [None, *next(r[1:] for r in rows if r[0] == probe)]
            assert pages.seek(root, probe + 1) is None
        assert [r for r, _ in pages.rows(root, -50, 50, reverse=True)] == [i for i, *_ in reversed(rows) if -50 <= i <= 50]
        assert pages.count * 512 == os.path.getsize(path) and len(pages.page(2)) == 512 and pages.header.page_count == pages.count
        leaf = pages.splits(root, 10**6)[0].page
        assert [r for r, _ in pages.page_rows(pages.parse(leaf))] == [i for i, *_ in rows[: len(pages.parse(leaf).places)]]
    seen = []
    with Pages(open(path, "rb").read()) as pages:  # in memory, and only the pages of a path are read
        pages.page = lambda n, own=pages.page: seen.append(n) or own(n)
        pages.seek(root, 700)
    assert 2 <= len(seen) <= 5


def test_index(spark, tmp_path):
    rows, path = tall(tmp_path / "i.db")
    with Pages(path) as pages:
        root = next(r for n, r, *_ in master(pages, "index") if n == "i")
        want = sorted([k, name, i] for i, name, k in rows)
        assert list(pages.entries(root)) == want
        for key in ((3,), (3, "xx"), (10, "x" * 59), (11,), (None,), (-1, "")):
            assert pages.find(root, key) == [e[2] for e in want if tuple(e[: len(key)]) == key]
        assert list(pages.entries(root, (2, "xxx"), (4,))) == [e for e in want if e[:2] >= [2, "xxx"] and e[0] <= 4]
        with pytest.raises(FileFormatError):
            list(pages.raw_rows(root))
    spark.dataSource.register(SqliteFileSource)
    got = spark.read.format("sqlite_file").options(path=path, index="i").load().collect()
    assert [list(r) for r in got] == want


def test_overflow_chains_end_with_their_row(tmp_path):
    path = database(tmp_path / "o.db", "CREATE TABLE o (t TEXT)", page_size=512, many=[("INSERT INTO o VALUES (?)", [("y" * 3000,)])])
    data = bytearray(open(path, "rb").read())
    with Pages(path) as pages:
        root = next(r for n, r, *_ in master(pages) if n == "o")
        last = max(n for n in range(2, pages.count + 1) if n != root and data[(n - 1) * 512 : (n - 1) * 512 + 4] == bytes(4))
    data[(last - 1) * 512 + 3] = 2
    with Pages(bytes(data)) as pages, pytest.raises(FileFormatError, match="chain"):
        list(pages.rows(root))


def test_written_files_are_databases(spark, tmp_path):
    draw = random.Random(2)
    for page_size in (512, 4096, 65536):
        for n in (0, 1, 40, 6000):
            rows = [(k * 3 - 100, draw.choice([None, -5, 2**50, 1.25, "é" * draw.randint(0, 9), b"z" * draw.choice([3, 700, 70_000 if n < 100 else 5])])) for k in range(n)]
            file = FileWriter(page_size)
            file.table("t", "CREATE TABLE t (v)", ((i, [v]) for i, v in rows))
            for extra in range(30):
                file.table(f"e{extra}", f"CREATE TABLE e{extra} (a, b)", [])
            (tmp_path / "w.db").write_bytes(file.finish())
            with closing(sqlite3.connect(tmp_path / "w.db")) as db:
                assert db.execute("PRAGMA integrity_check").fetchall() == [("ok",)]
                assert db.execute("SELECT rowid, v FROM t").fetchall() == rows and db.execute("SELECT count(*) FROM sqlite_master").fetchone() == (31,)
            with Pages(str(tmp_path / "w.db")) as pages:
                assert [(i, v[0]) for i, v in pages.rows(dict((n, r) for n, r, *_ in master(pages))["t"])] == rows
    with pytest.raises(FileFormatError):
        FileWriter().table("t", "CREATE TABLE t (v)", [(2, [1]), (1, [1])])


def test_sink_and_pushdown(spark, tmp_path):
    spark.dataSource.register(SqliteFileSource)
    path = str(tmp_path / "out")
    rows = spark.range(0, 5000, 1, 4).selectExpr("id * 2 AS id", "concat('name ', id) AS name", "id / 4 AS score", "cast(NULL AS int) AS none")
    for mode in ("append", "overwrite"):
        rows.write.format("sqlite_file").mode(mode).options(path=path, table="t", rowid="id", page_size=512).save()
    engine = Engine(spark).open_file(path)
    whole = engine.catalog.table("t").rdd.getNumPartitions()
    assert engine.execute("SELECT * FROM t").count() == 5000
    for where, want in (("id = 70", {70}), ("id > 99.5 AND 104 >= id", {100, 102, 104}), ("id = 3.5", set()), ("id < 3 AND name != 'name 1'", {0}), ("id <= 2 OR id = 9000", {0, 2, 9000})):
        df = engine.execute(f"SELECT id FROM t WHERE {where}")
        assert {r.id for r in df.collect()} == want
        assert " OR " in where or df.rdd.getNumPartitions() < whole / 4
    assert engine.catalog.registered["t"].frame(parse("SELECT score FROM t WHERE none = 1")).columns == ["score", "none"]
    pushed = engine.catalog.table("t").where("id = 8000")
    assert pushed.count() == 1 and pushed.rdd.getNumPartitions() < whole / 4
    down = spark.read.format("sqlite_file").options(path=path, table="t", order="desc").load()
    assert [r.id for r in down.select("id").collect()] == list(range(9998, -1, -2))
    with pytest.raises(Exception, match="binary"):
        spark.range(1).selectExpr("array(id) AS a").write.format("sqlite_file").mode("append").options(path=path, table="u").save()
