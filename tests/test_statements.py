"""Writing statements end to end."""

import pytest

from tablelog.operators.integrity import ConstraintError
from tablelog.plans.connection import Connection
from tablelog.plans.dialect import UnsupportedSql


@pytest.fixture
def db(spark, tmp_path):
    return Connection(spark, f"file://{tmp_path}/db")


def rows(db, sql):
    return [tuple(r) for r in db.query(sql).collect()]


def test_modification(db):
    """A harbour's berths: every statement kind that changes rows, on one table."""
    db.execute("CREATE TABLE berths (pier INTEGER PRIMARY KEY, ship TEXT NOT NULL DEFAULT 'free' CHECK (length(ship) >= 3), draught REAL)")
    db.execute("INSERT INTO berths (pier, ship, draught) VALUES (10, 'tern', 4.25), (20, 'gull', NULL), (30, 'heron', 7.0)")
    db.execute("INSERT INTO berths (pier) VALUES (?)", [40])
    assert rows(db, "SELECT * FROM berths ORDER BY pier") == [(10, "tern", 4.25), (20, "gull", None), (30, "heron", 7.0), (40, "free", None)]
    got = db.execute("UPDATE berths AS x SET ship = ship || '-' || x.pier, draught = coalesce(draught, 2) * 2 WHERE pier IN (SELECT pier FROM berths WHERE length(ship) = 4 AND ship <> 'free') RETURNING pier + 1 AS next, ship")
    assert sorted(map(tuple, got.collect())) == [(11, "tern-10"), (21, "gull-20")]
    assert [tuple(r) for r in db.execute("DELETE FROM berths RETURNING ship ORDER BY pier DESC LIMIT 1").collect()] == [("free",)]
    db.execute("UPDATE berths SET (ship, draught) = ('egret', draught - 1) WHERE pier = 30")
    db.execute("WITH low AS (SELECT 20 AS p) DELETE FROM berths WHERE pier IN (SELECT p FROM low)")
    assert rows(db, "SELECT * FROM berths ORDER BY pier") == [(10, "tern-10", 8.5), (30, "egret", 6.0)]
    for bad in ("INSERT INTO berths (pier, ship) VALUES (50, 'xy')", "INSERT INTO berths (pier, ship) VALUES (30, 'petrel')"):
        with pytest.raises(ConstraintError):
            db.execute(bad)
    db.execute("INSERT OR IGNORE INTO berths (pier, ship) VALUES (30, 'petrel'), (60, 'crane'), (60, 'stork')")
    db.execute("REPLACE INTO berths (pier, ship) VALUES (10, 'swan')")
    assert rows(db, "SELECT pier, ship FROM berths ORDER BY pier") == [(10, "swan"), (30, "egret"), (60, "crane")]


def test_upserts_and_policies(db):
    """Measured heights by station: a chain of upserts takes each row in turn."""
    db.execute("CREATE TABLE heights (station INTEGER PRIMARY KEY, metres INTEGER UNIQUE, total INTEGER NOT NULL DEFAULT 100)")
    db.execute("INSERT INTO heights (station, metres) VALUES (3, 12), (4, 15)")
    db.execute("INSERT INTO heights (station, metres) VALUES (3, 20), (3, 21), (3, 22), (6, 40) ON CONFLICT (station) DO UPDATE SET total = total + excluded.metres, metres = excluded.metres")
    assert rows(db, "SELECT * FROM heights ORDER BY station") == [(3, 22, 163), (4, 15, 100), (6, 40, 100)]
    db.execute("INSERT INTO heights (station, metres) VALUES (7, 40), (8, 41) ON CONFLICT (metres) DO NOTHING")
    assert [r[0] for r in rows(db, "SELECT station FROM heights ORDER BY station")] == [3, 4, 6, 8]
    with pytest.raises(ConstraintError):
        db.execute("UPDATE heights SET metres = 41 WHERE station = 4")
    db.execute("UPDATE OR IGNORE heights SET metres = 41 WHERE station = 4")
    db.execute("UPDATE OR REPLACE heights SET metres = 22 WHERE station = 8")
    assert rows(db, "SELECT station, metres FROM heights ORDER BY station") == [(4, 15), (6, 40), (8, 22)]


def test_references(db):
    db.execute("CREATE TABLE parents (id INTEGER PRIMARY KEY, code TEXT UNIQUE)")
    db.execute("CREATE TABLE children (id INTEGER PRIMARY KEY, code TEXT REFERENCES parents (code) ON DELETE SET NULL ON UPDATE CASCADE)")
    db.execute("CREATE TABLE toys (id INTEGER PRIMARY KEY, child INTEGER REFERENCES children ON DELETE CASCADE)")
    db.execute("INSERT INTO parents VALUES (1, 'x'), (2, 'y')")
    db.execute("INSERT INTO children VALUES (10, 'x'), (11, 'y'), (12, NULL)")
    db.execute("INSERT INTO toys VALUES (100, 10), (101, 11)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO children VALUES (13, 'z')")
    db.execute("UPDATE parents SET code = 'xx' WHERE id = 1")
    db.execute("DELETE FROM parents WHERE id = 2")
    assert rows(db, "SELECT * FROM children ORDER BY id") == [(10, "xx"), (11, None), (12, None)]
    db.execute("DELETE FROM children WHERE id = 10")
    assert rows(db, "SELECT id FROM toys") == [(101,)]
    with pytest.raises(UnsupportedSql):
        db.execute("DROP TABLE parents")


def test_definitions(db):
    db.execute("CREATE TABLE IF NOT EXISTS t (a INTEGER, b TEXT, c REAL, CONSTRAINT pk PRIMARY KEY (a), CONSTRAINT positive CHECK (c > 0)) WITHOUT ROWID")
    db.execute("INSERT INTO t VALUES (1, 'x', 2.0)")
    db.execute("ALTER TABLE t RENAME COLUMN b TO body")
    db.execute("ALTER TABLE t ADD COLUMN d TEXT NOT NULL DEFAULT 'new'")
    db.execute("ALTER TABLE t DROP CONSTRAINT positive")
    db.execute("ALTER TABLE t DROP COLUMN c")
    db.execute("ALTER TABLE t RENAME TO u")
    db.execute("CREATE UNIQUE INDEX bodies ON u (body)")
    db.execute("CREATE VIEW v AS SELECT body FROM u WHERE a > 0")
    db.execute("PRAGMA user_version = 7")
    assert rows(db, "SELECT * FROM u") == [(1, "x", "new")] and rows(db, "SELECT * FROM v") == [("x",)]
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO u VALUES (2, 'x', 'y')")
    assert [r.name for r in db.pragma("table_info", "u").collect()] == ["a", "body", "d"] and db.pragma("user_version").first()[0] == 7
    with pytest.raises(UnsupportedSql):
        db.execute("ALTER TABLE u DROP COLUMN a")
    with pytest.raises(UnsupportedSql):
        db.execute("CREATE TABLE w (a, PRIMARY KEY (a))")
    db.execute("DROP VIEW v")
    db.execute("DROP TABLE u")
    db.execute("DROP TABLE IF EXISTS u")
    assert db.store.tables() == []


def test_a_failing_transaction_leaves_nothing(db):
    db.execute("CREATE TABLE t (a INTEGER PRIMARY KEY)")

    def work(t):
        t.execute("INSERT INTO t VALUES (1)")
        t.execute("INSERT INTO t VALUES (1)")

    with pytest.raises(ConstraintError):
        db.update(work)
    assert rows(db, "SELECT count(*) FROM t") == [(0,)]
    db.update(lambda t: [t.execute("INSERT INTO t VALUES (1)"), t.execute("UPDATE t SET a = a + 1")])
    assert rows(db, "SELECT a FROM t") == [(2,)]


def test_conflict_policies_of_the_schema(db):
    """Each constraint has a policy of its own: a seat is kept, a ticket replaces, a missing grade is filled in."""
    db.execute("CREATE TABLE seats (seat INTEGER PRIMARY KEY ON CONFLICT IGNORE, ticket INTEGER UNIQUE ON CONFLICT REPLACE, grade REAL NOT NULL ON CONFLICT REPLACE DEFAULT 2.5)")
    db.execute("INSERT INTO seats VALUES (7, 700, 1.0), (8, 800, NULL), (9, 900, 3.0)")
    db.execute("INSERT INTO seats VALUES (7, 701, 4.0), (5, 900, NULL)")
    assert rows(db, "SELECT * FROM seats ORDER BY seat") == [(5, 900, 2.5), (7, 700, 1.0), (8, 800, 2.5)]


def test_one_of_many_writers_wins_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tablelog.sources.tables import TableStore, VersionConflict

    store = TableStore(spark, f"file://{tmp_path}/race")
    for base in range(12):
        with ThreadPoolExecutor(6) as pool:
            def write(k):
                try:
                    return store.commit(base, {}, {f"{base}-{k}": k})
                except VersionConflict:
                    return None

            won = [v for v in pool.map(write, range(6)) if v is not None]
        assert won == [base + 1]
        assert len(store.manifest(base + 1)["catalog"]) == base + 1


def test_ids_for_rows_without_one(db):
    """Rows that give no number get one each, in order, and no later statement gives it again."""
    db.execute("CREATE TABLE tides (no INTEGER PRIMARY KEY, at TEXT, depth REAL)")
    db.execute("INSERT INTO tides (at, depth) VALUES ('low', 0.5), ('high', 6.5)")
    db.execute("INSERT INTO tides VALUES (NULL, 'slack', 3.0), (77, 'spring', 7.5)")
    got = rows(db, "SELECT no, at FROM tides ORDER BY no")
    assert [at for _, at in got] == ["spring", "low", "high", "slack"] and len({no for no, _ in got}) == 4 and got[1][0] + 1 == got[2][0]
    db.execute("CREATE TABLE marks (no INTEGER PRIMARY KEY, at TEXT) WITHOUT ROWID")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO marks (at) VALUES ('low')")


def test_views_in_writing_statements(db):
    db.execute("CREATE TABLE wells (well INTEGER PRIMARY KEY, depth INTEGER, owner TEXT)")
    db.execute("INSERT INTO wells VALUES (1, 30, 'ann'), (2, 80, 'bo'), (3, 95, 'cy')")
    db.execute("CREATE VIEW deep AS SELECT well, depth FROM wells WHERE depth > 50")
    db.execute("CREATE VIEW deepest AS SELECT well FROM deep WHERE depth > 90")
    db.execute("CREATE TABLE visits (well INTEGER PRIMARY KEY, depth INTEGER)")
    db.execute("INSERT INTO visits SELECT well, depth + 1 FROM deep")
    db.execute("DELETE FROM visits WHERE well IN (SELECT well FROM deepest)")
    assert rows(db, "SELECT * FROM visits") == [(2, 81)] and rows(db, "SELECT * FROM deepest") == [(3,)]

    def work(t):
        for change in ("DROP COLUMN depth", "RENAME COLUMN depth TO metres", "RENAME TO pits"):
            with pytest.raises(UnsupportedSql):
                t.execute(f"ALTER TABLE wells {change}")
        t.execute("ALTER TABLE wells DROP COLUMN owner")

    db.update(work)
    assert rows(db, "SELECT * FROM wells ORDER BY well") == [(1, 30), (2, 80), (3, 95)]


def test_parameters(db):
    db.execute("CREATE TABLE p (k INTEGER PRIMARY KEY, v TEXT, w REAL)")
    db.execute("INSERT INTO p VALUES (?2, ?1, ?), (:n, 'what?' /* ? */, NULL)", ["it's a \\ back", 4, 0.25, 9])
    assert rows(db, "SELECT * FROM p ORDER BY k") == [(4, "it's a \\ back", 0.25), (9, "what?", None)]
    db.execute("UPDATE p SET v = @v WHERE k = $k", {"v": "new", "$k": 9})
    assert [tuple(r) for r in db.query("SELECT v FROM p WHERE k IN (?, ?1 + 5) AND w IS NULL", [4]).collect()] == [("new",)]
    with pytest.raises(UnsupportedSql):
        db.execute("DELETE FROM p WHERE k = ?3", [1])


def test_scripts_write_and_pragmas_give_rows(db):
    got = [r for _, r in db.script("CREATE TABLE q (a INTEGER PRIMARY KEY, b TEXT NOT NULL); CREATE UNIQUE INDEX only ON q (b, a); INSERT INTO q VALUES (1, 'x') RETURNING b; SELECT nope; PRAGMA index_info(only); PRAGMA user_version = 3; PRAGMA user_version")]
    assert got[0] is None and got[1] is None and got[2].first().b == "x" and isinstance(got[3], Exception) and got[5] is None
    assert [tuple(r) for r in got[4].collect()] == [(0, 1, "b"), (1, 0, "a")] and got[6].first()[0] == 3
    assert [(r.name, r.notnull, r.hidden) for r in db.query("PRAGMA table_xinfo('q')").collect()] == [("a", 0, 0), ("b", 1, 0)]
    assert db.query("PRAGMA table_info(nothing)").collect() == [] and [r.coll for r in db.query("PRAGMA index_xinfo(only)").collect()] == ["BINARY", "BINARY"]


def test_upsert_names_its_row(db):
    """The current row's columns under the statement's alias or the table's name, beside the candidate's."""
    db.execute("CREATE TABLE stock (part INTEGER PRIMARY KEY, held INTEGER, note TEXT)")
    db.execute("INSERT INTO stock VALUES (1, 10, 'a.b'), (2, 20, NULL)")
    db.execute("INSERT INTO stock AS s (part, held) VALUES (1, 5), (2, 50), (3, 7) ON CONFLICT (part) DO UPDATE SET held = s.held - excluded.held, note = 's.held' WHERE \"s\".held >= excluded.held")
    db.execute("INSERT INTO stock (part, held) VALUES (3, 1) ON CONFLICT (part) DO UPDATE SET held = stock.held + excluded.held")
    assert rows(db, "SELECT * FROM stock ORDER BY part") == [(1, 5, "s.held"), (2, 20, None), (3, 8, None)]
    with pytest.raises(UnsupportedSql):
        db.execute("CREATE TABLE names (n TEXT COLLATE NOCASE PRIMARY KEY)")
