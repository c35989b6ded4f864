"""The engine against small eager models."""

import random

import pytest
from pyspark.sql import functions as F

from tablelog.functions import keys, scalar, values
from tablelog.functions.integrity import hmac_sha256
from tablelog.operators import changes, coordination, dml, integrity, log, recursion, replicate, windows
from tablelog.plans import catalog, dialect
from tablelog.plans.connection import Connection, ModeError, format_table
from tablelog.sources.ordered import OrderedStore
from tablelog.sources.tables import TableStore, VersionConflict

LOG = "admission_seq long, op_index int, device long, ver long, op string, key array<string>, range array<string>, value double"


def random_log(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for k in range(1, n + 1):
        for j in range(rng.randint(1, 2)):
            key = [rng.choice("ab"), *([rng.choice("xyz")] if rng.random() < 0.8 else [])]
            kind = rng.choice(["set", "set", "set", "delete", "range_delete"])
            wide = rng.choice([[], ["a"], ["b"], ["b", "x"]])
            rows.append((k, j, rng.randint(0, 1), k * 2 + j, kind, None if kind == "range_delete" else key, wide if kind == "range_delete" else None, float(rng.randint(0, 9)) if kind == "set" else None))
    return rows


def model(rows, cut):
    live = {}
    for seq, _, _, _, op, key, wide, value in sorted(rows):
        if seq > cut:
            continue
        if op == "set":
            live[tuple(key)] = value
        elif op == "delete":
            live.pop(tuple(key), None)
        else:
            live = {k: v for k, v in live.items() if list(k[: len(wide)]) != wide}
    return live


@pytest.mark.parametrize("seed", range(3))
def test_log_reads_follow_the_model(spark, seed):
    rows = random_log(seed)
    df = spark.createDataFrame(rows, LOG)
    for cut in (20, 60):
        want = model(rows, cut)
        assert {tuple(r.key): r.value for r in log.visible(df, cut).collect()} == want
        counts = {tuple(r.prefix): r.live for r in log.live_counts(df, cut).collect()}
        for prefix in {k[:n] for k in want for n in range(len(k) + 1)}:
            assert counts[prefix] == sum(k[: len(prefix)] == prefix for k in want)
    want = sorted(k for k in model(rows, 60) if k[0] == "b")
    page = log.list_page(df, ["b"], None, 2).collect()
    assert [tuple(r.key) for r in page] == want[:2] and all(r.truncated == (len(want) > 2) for r in page)
    early = log.visible(df, 30)
    again = {tuple(r.key): r.value for r in log.materialized(df.where("admission_seq > 30"), early).collect()}
    assert again == model(rows, 60)
    floors = {tuple(r.key): r.floor for r in log.version_floors(df).collect()}
    for key in {tuple(r[5]) for r in rows if r[5]}:
        assert floors[key] == max(r[3] for r in rows if (r[5] and tuple(r[5]) == key) or (r[6] is not None and list(key[: len(r[6])]) == r[6]))
    assert log.gaps(df).count() == 0


def test_range_asserts(spark):
    rows = random_log(9)
    asserts = [(k, d, p, 40) for k, (d, p) in enumerate([(0, []), (1, ["a"]), (0, ["b", "x"]), (1, ["c"])])]
    got = {r.assert_id: r.foreign_seq for r in log.foreign_max(spark.createDataFrame(rows, LOG), spark.createDataFrame(asserts, "assert_id long, device long, prefix array<string>, upto long")).collect()}
    want = {}
    for k, d, p, upto in asserts:
        hits = [r[0] for r in rows if r[2] != d and ((r[5] and r[5][: len(p)] == p) or (r[6] is not None and (r[6][: len(p)] == p or p[: len(r[6])] == r[6])))]
        if hits and max(hits) > upto:
            want[k] = max(hits)
    assert got == want


def test_key_codec_keeps_order_and_prefixes(spark):
    rng = random.Random(1)
    tuples = [[bytes(rng.choice([0, 0, 1, 255, 97]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))] for _ in range(80)]
    rows = spark.createDataFrame([(t,) for t in tuples], "key array<binary>").select("key", keys.encode(F.col("key")).alias("flat"))
    got = [([bytes(c) for c in r.key], bytes(r.flat)) for r in rows.select("key", "flat", keys.decode(F.col("flat")).alias("back")).collect() if [bytes(c) for c in r.back] == [bytes(c) for c in r.key]]
    assert len(got) == len(tuples)
    assert [t for t, _ in sorted(got, key=lambda x: x[1])] == sorted(tuples)
    for a, fa in got[:20]:
        for b, fb in got[:20]:
            assert fb.startswith(fa) == (b[: len(a)] == a)


def test_values(spark):
    one = spark.range(1)
    v, image = values.value, lambda x: F.hex(values.key_image(x))
    r = one.select(image(v("integer", F.lit(1))).alias("a"), image(v("real", F.lit(1.0))).alias("b"), image(v("text", F.lit("1"))).alias("c"), image(values.with_affinity(v("text", F.lit("1")), "integer")).alias("d"), image(v("integer", F.lit(-1))).alias("e"), values.quote(v("text", F.lit("it's"))).alias("q"), values.typeof(values.with_affinity(v("integer", F.lit(3)), "text")).alias("t"), image(v("null")).alias("n")).first()
    assert r.a == r.b == r.d != r.c and r.e < r.a and r.q == "'it''s'" and r.t == "text" and r.n == "00"
    assert [values.affinity_of(x) for x in ("FLOATING POINT", "VARCHAR(9)", "BLOB", "DOUBLE PRECISION", "DECIMAL(3)", "CHARINT")] == ["integer", "text", "blob", "real", "numeric", "integer"]


def test_scalars(spark):
    one = spark.range(1)
    r = one.select(scalar.unicode_of(F.lit("é")).alias("u"), F.hex(scalar.zeroblob(F.lit(2))).alias("z"), scalar.scalar_max(F.lit(1), F.lit(None).cast("int")).alias("m"), scalar.glob(F.lit("aXc"), "a[^b]?").alias("g"), scalar.glob(F.lit("a.c"), "a.?").alias("h"), scalar.like(F.lit("ABC"), "a%").alias("l")).first()
    assert (r.u, r.z, r.m, r.g, r.h, r.l) == (233, "0000", None, True, True, True)
    import hashlib
    import hmac

    got = one.select(hmac_sha256(F.unhex(F.lit("AB" * 32)), F.lit(b"msg")).alias("h")).first().h
    assert got == hmac.new(bytes.fromhex("AB" * 32), b"msg", hashlib.sha256).hexdigest()


TABLE = "id long, email string, body string"


def test_insert_policies(spark):
    table = spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (3, None, "three")], TABLE)
    rows = spark.createDataFrame([(1, "c", "x", 1), (4, "b", "y", 2), (5, "e", "z", 3), (5, "f", "w", 4), (6, "e", "v", 5), (7, None, "n", 6)], TABLE + ", ordinal long")
    uniques = [["id"], ["email"]]
    after = lambda c: sorted(map(tuple, changes.apply(table, c, ["id"]).collect()))
    assert after(dml.insert(table, rows, uniques, "ignore")) == [(1, "a", "one"), (2, "b", "two"), (3, None, "three"), (5, "e", "z"), (7, None, "n")]
    assert after(dml.insert(table, rows, uniques, "replace")) == [(1, "c", "x"), (3, None, "three"), (4, "b", "y"), (5, "f", "w"), (6, "e", "v"), (7, None, "n")]
    with pytest.raises(integrity.ConstraintError):
        dml.insert(table, rows, uniques)
    fresh = rows.where("ordinal = 6")
    assert after(dml.insert(table, fresh, uniques))[-1] == (7, None, "n")


def test_upsert_folds_in_order(spark):
    table = spark.createDataFrame([(1, "start", 0), (5, "keep", 0)], "id long, body string, revisions long")
    rows = spark.createDataFrame([(1, "a", 0, 1), (1, "b", 0, 2), (2, "new", 0, 3), (2, "again", 0, 4), (5, "skip", 0, 5)], "id long, body string, revisions long, ordinal long")
    done = dml.upsert(table, rows, ["id"], {"body": "body || '/' || excluded.body", "revisions": "revisions + 1"}, "excluded.body <> 'skip'")
    assert sorted(map(tuple, changes.apply(table, done, ["id"]).collect())) == [(1, "start/a/b", 2), (2, "new/again", 1), (5, "keep", 0)]
    nothing = dml.upsert(table, rows, ["id"])
    assert [tuple(r) for r in dml.returning(nothing, "id", "body").collect()] == [(2, "new")]


def test_update_delete_and_undo(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "c", "z")], TABLE)
    done = dml.update(table, {"email": "body", "body": "email"}, "id <> 2")
    new = changes.apply(table, done, ["id"])
    assert sorted(map(tuple, new.collect())) == [(1, "x", "a"), (2, "b", None), (3, "z", "c")]
    assert sorted(map(tuple, changes.apply(new, changes.inverse(done), ["id"]).collect())) == sorted(map(tuple, table.collect()))
    assert changes.verify(table, done, ["id"]).count() == 0 and changes.verify(new, done, ["id"]).count() == 2
    assert sorted(r.id for r in changes.apply(table, dml.delete(table, "body <> 'x'"), ["id"]).collect()) == [1, 2]
    assert dml.selected(table, None, ["id"], -1).count() == 3 and dml.selected(table, None, ["id"], 0).count() == 0
    ids = dml.allocate_rowids(spark.createDataFrame([(None, "p", "q"), (9, "r", "s"), (None, "t", "u")], TABLE), "id", 3, 5, "email").collect()
    base = (3 << 47) | (5 << 20)
    assert sorted(r.id for r in ids) == [9, base, base + 1]


def test_references(spark):
    tables = {"p": spark.createDataFrame([(1,), (2,)], "id long"), "c": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "cid long, pid long"), "g": spark.createDataFrame([(100, 10), (101, 11)], "gid long, cid long")}
    chain = [integrity.Reference("c", ["pid"], "p", ["id"], "cascade"), integrity.Reference("g", ["cid"], "c", ["cid"], "cascade")]
    out = integrity.delete_cascade(tables, chain, "p", tables["p"].where("id = 1"))
    assert sorted(r.cid for r in out["c"].collect()) == [11, 12] and [r.gid for r in out["g"].collect()] == [101]
    default = [integrity.Reference("c", ["pid"], "p", ["id"], "set_default", defaults={"pid": 2})]
    assert sorted(map(tuple, integrity.delete_cascade(tables, default, "p", tables["p"].where("id = 1"))["c"].collect()), key=str) == [(10, 2), (11, 2), (12, None)]
    with pytest.raises(integrity.ConstraintError):
        integrity.delete_cascade(tables, [integrity.Reference("c", ["pid"], "p", ["id"], "restrict")], "p", tables["p"].where("id = 1"))
    assert integrity.orphans(tables["c"], ["pid"], tables["p"].where("id = 2"), ["id"]).count() == 1


def test_leases_and_conflicts(spark):
    leases = spark.createDataFrame([(1, 0, "write", ["a"], 50), (2, 1, "read", ["b", "x"], 90), (3, 1, "write", ["c"], 5)], "lease_id long, holder long, lease_mode string, lease_prefix array<string>, deadline long")
    asked = spark.createDataFrame([(1, 0, "write", ["a", "q"]), (2, 1, "read", ["a", "q"]), (3, 0, "read", ["b"]), (4, 2, "write", []), (5, 3, "write", ["c"])], "request_id long, device long, mode string, prefix array<string>")
    assert {r.request_id: r.retry_after for r in coordination.lease_conflicts(asked, leases, 10).collect()} == {2: 50, 4: 90}
    assert sorted(r.lease_id for r in coordination.acquire(asked, leases, 10, 5).collect()) == [1, 3, 5]
    renewed = coordination.renew(leases, spark.createDataFrame([(1, 0), (2, 0), (3, 1), (9, 1)], "lease_id long, device long"), 10, 7)
    assert {r.lease_id: (r.deadline, r.valid) for r in renewed.collect()} == {1: (17, True), 2: (None, False), 3: (None, False), 9: (None, False)}
    assert [r.lease_id for r in coordination.release(leases, spark.createDataFrame([(1, 0), (2, 0)], "lease_id long, device long"), 10).collect()] == [2]


def test_schemas():
    t = catalog.Table("notes", (catalog.Column("id", "INTEGER"), catalog.Column("body", "TEXT")), ("id",), checks=("length(body) > 0 AND body <> 'body'",))
    later = t.rename_column("body", "text")
    assert later.checks == ("length(text) > 0 AND text <> 'body'",) and later.revision() != t.revision()
    for bad in (lambda: t.drop_column("id"), lambda: t.drop_column("body"), lambda: t.rename("NOTES"), lambda: t.rename_column("body", "ID"), lambda: t.add_column(catalog.Column("n", "TEXT", True))):
        with pytest.raises(catalog.SchemaError):
            bad()
    assert catalog.column_order({"b": None, "a": None, "c": "b", "d": "a"}) == ["a", "d", "b", "c"]


def test_dialect():
    assert dialect.split_statements("SELECT ';' ; -- x;\nSELECT 2;") == ["SELECT ';'", "SELECT 2"]
    assert [dialect.classify(s) for s in ("SELECT 1", "WITH a AS (SELECT 1) DELETE FROM t", "CREATE TABLE t(a)", "PRAGMA user_version", "VALUES (1)")] == ["read", "write", "ddl", "pragma", "read"]
    for s in ("ATTACH 'x' AS y", "BEGIN", "SELECT 1; SELECT 2", "INSERT OR FAIL INTO t VALUES (1)", "CREATE TRIGGER x", "CREATE TEMP TABLE t(a)"):
        with pytest.raises(dialect.UnsupportedSql):
            dialect.classify(s)
    assert dialect.to_spark('SELECT "a b", [c] FROM t WHERE x == 1 LIMIT -1').strip() == "SELECT `a b`, `c` FROM t WHERE x = 1"


def test_dialect_runs(spark):
    got = spark.sql(dialect.to_spark("SELECT total(a) AS t, count(*) AS n FROM (VALUES (1), (2)) v(a) WHERE a IN () OR a > 0")).first()
    assert (got.t, got.n) == (3.0, 2)
    got = spark.sql(dialect.to_spark("SELECT max(1, NULL) AS m, min(3, 2) AS k, iif(1 > 0, 'y', 'n') AS i, 'Abc' GLOB 'A*' AS g, 'ABC' LIKE 'a_c' AS l")).first()
    assert (got.m, got.k, got.i, got.g, got.l) == (None, 2, "y", True, True)


def test_dialect_tables_and_hints(spark):
    session = spark.newSession()
    session.sql("SELECT 1 AS a UNION ALL SELECT 2").createOrReplaceTempView("one_two")
    sql = "SELECT typeof(a) AS t, typeof('x') AS s, typeof(NULL) AS n FROM one_two INDEXED BY some_index WHERE a IN one_two AND 'abc' REGEXP '^a' LIMIT 1"
    assert tuple(session.sql(dialect.to_spark(sql)).first()) == ("integer", "text", "null")
    assert session.sql(dialect.to_spark("EXPLAIN QUERY PLAN SELECT a FROM one_two")).count() == 1


def test_ordered_store(spark, tmp_path):
    kv = OrderedStore(spark, f"file://{tmp_path}/kv")
    cells = [([b"a"], b"1"), ([b"a", b"x"], b"2"), ([b"a\x00"], b"3"), ([b"b", b"\x00\x01"], b"4"), ([b"b"], b"5")]
    kv.apply(spark.createDataFrame([(k, v, n) for n, (k, v) in enumerate(cells)], "key array<binary>, value binary, ordinal int"))
    kv.apply(spark.createDataFrame([([b"b"], b"6", 0), ([b"b"], None, 1), ([b"c"], b"7", 2)], "key array<binary>, value binary, ordinal int"))
    read = lambda df: [([bytes(c) for c in r.key], bytes(r.value)) for r in df.collect()]
    assert read(kv.scan(None, None)) == [([b"a"], b"1"), ([b"a", b"x"], b"2"), ([b"a\x00"], b"3"), ([b"b", b"\x00\x01"], b"4"), ([b"c"], b"7")]
    assert read(kv.scan_prefix([b"a"])) == [([b"a"], b"1"), ([b"a", b"x"], b"2")]
    assert read(kv.get([b"c"])) == [([b"c"], b"7")] and read(kv.scan([b"a", b"x"], [b"b"])) == [([b"a", b"x"], b"2"), ([b"a\x00"], b"3")]


def test_replicas(spark):
    c = replicate.Cursors().append(5).applied(3).trim(2)
    assert (c.head, c.neck, c.tail) == (2, 3, 5)
    with pytest.raises(replicate.CursorError):
        c.trim(4)
    image = "struct<id:bigint,v:string>"
    table = spark.createDataFrame([(1, "a"), (2, "mine")], "id long, v string")
    foreign = spark.createDataFrame([(1, 7, None, (3, "c")), (2, 7, (3, "c"), (3, "d")), (3, 0, (2, "b"), (2, "mine")), (4, 8, (1, "a"), None)], f"admission_seq long, device long, before {image}, after {image}")
    assert sorted(map(tuple, replicate.rebase(table, foreign, 0, ["id"]).collect())) == [(2, "mine"), (3, "d")]
    pending = spark.createDataFrame([("t1", 1, (2, "b"), (2, "x")), ("t1", 2, (2, "x"), (2, "mine")), ("t2", 3, (1, "z"), (1, "a"))], f"txn string, ordinal long, before {image}, after {image}")
    assert sorted(map(tuple, replicate.roll_back(table, pending, ["id"]).collect())) == [(1, "z"), (2, "b")]
    assert [r.txn for r in replicate.overlapping(pending, foreign, 0, ["id"]).collect()] == ["t2"]
    log_rows = spark.createDataFrame([(6,), (7,)], "admission_seq long")
    assert replicate.append_admissions(log_rows.limit(0), log_rows, c)[1].tail == 7
    with pytest.raises(replicate.CursorError):
        replicate.append_admissions(log_rows.limit(0), log_rows.where("admission_seq = 7"), c)


def test_fixpoint(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    reach = recursion.fixpoint(spark.createDataFrame([(1,)], "a long"), lambda new: new.join(edges, "a").select(F.col("b").alias("a")))
    assert sorted(r.a for r in reach.collect()) == [1, 2, 3]


def test_group_commit_in_order(spark):
    """Against a loop that keeps every accepted write, in and across groups."""
    import random

    rng = random.Random(5)
    fp, proposals, wrote = [], [], []
    for t in range(120):
        front = rng.choice([3, 4, 5, 7])
        for _ in range(rng.randrange(1, 3)):
            fp.append((t, rng.choice(["read", "write", "constraint"]), [rng.choice("abcdef"), str(rng.randrange(6))][: rng.choice([1, 2, 2])], front))
        for f in fp:
            if f[0] == t and f[1] == "write":
                wrote.append((t, f[2], rng.random() < 0.3))
        proposals.append((t, t % 2, 1000 - t))
    proposals.append((0, 0, 5000))
    past = [(2, -1, ["a", "1"], False), (4, -1, ["b"], True)]
    frames = [spark.createDataFrame(r, s) for r, s in ((proposals, "txn long, space long, arrival long"), (fp, "txn long, kind string, prefix array<string>, frontier long"), (past, "commit_seq long, writer long, region array<string>, wide boolean"), (wrote, "txn long, region array<string>, wide boolean"))]

    def meets(region, wide, prefix):
        return region[: len(prefix)] == prefix or wide and prefix[: len(region)] == region

    for given in (wrote, None):
        writes = given if given is not None else [(f[0], f[2], False) for f in fp if f[1] == "write"]
        want = {}
        for space in (0, 1):
            order = sorted((p for p in proposals if p[1] == space), key=lambda p: p[2])
            done, seq, ok = [], 4, set()
            for g in range(0, len(order), 8):
                seq += g == 0 or took
                took = False
                for place, (t, _, _) in enumerate(order[g : g + 8], g + 1):
                    bad = t not in ok and any(any(c > f[3] and meets(r, w, f[2]) for c, _, r, w in past) or any((s == seq or s > f[3]) and meets(r, w, f[2]) for s, r, w in done) for f in fp if f[0] == t)
                    if not bad and t not in ok:
                        took = True
                        ok.add(t)
                        done += [(seq, r, w) for x, r, w in writes if x == t]
                    want[space, place] = (t, g // 8, bad)
        got = recursion.group_commit(*frames[:3], 8, frames[3] if given is not None else None)
        assert sorted(map(tuple, got.collect())) == sorted((t, place, g, bad) for (_, place), (t, g, bad) in want.items())
        assert 0 < sum(bad for _, _, bad in want.values()) < len(want)


def test_store_versions(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/s")
    a = store.commit(0, {"t": spark.range(3)})
    store.commit(a, {"t": spark.range(5)})
    assert store.read("t").count() == 5 and store.read("t", a).count() == 3
    with pytest.raises(VersionConflict):
        store.commit(a, {"t": spark.range(9)})
    store.prune(2)
    assert store.versions() == [2] and store.read("t").count() == 5


def test_connection(spark, tmp_path):
    c = Connection(spark, f"file://{tmp_path}/c")
    c.update(lambda t: t.put("notes", spark.createDataFrame([(1, "one"), (2, None)], "id long, body string")))
    c.create_view("named", "SELECT id FROM notes WHERE body IS NOT NULL")
    assert [r.id for r in c.query("SELECT * FROM named").collect()] == [1]
    assert c.query("SELECT id FROM notes WHERE id = ?", [2]).first().id == 2
    with pytest.raises(ModeError):
        c.query("DELETE FROM notes")

    def fails(t):
        t.drop("notes")
        raise RuntimeError

    with pytest.raises(RuntimeError):
        c.update(fails)
    with c.view() as read:
        c.update(lambda t: t.drop("notes"))
        assert read("SELECT count(*) AS n FROM notes").first().n == 2
    assert [isinstance(r, Exception) for _, r in c.script("SELECT 1 AS a; SELECT nope; SELECT 2 AS b")] == [False, True, False]
    assert format_table(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, X'0A' AS c")).splitlines()[-2:] == ["1 | NULL | X'0A'", "1 row"]


def test_excluded_frames(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "id long, v long")
    frame = Window.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    peers = Window.partitionBy("v")
    got = {r.id: (r.a, r.b, r.c) for r in df.select("id", windows.sum_excluding_current(F.col("v"), frame).alias("a"), windows.sum_excluding_group(F.col("v"), frame, peers).alias("b"), windows.sum_excluding_ties(F.col("v"), frame, peers).alias("c")).collect()}
    assert got == {1: (3, 2, 3), 2: (3, 2, 3), 3: (2, 2, 4), 4: (4, 4, 4)}


def test_first_conflicts_against_all_pairs(spark):
    """Random prefixes, regions and frontiers, own commits and ties among them, against a loop over all pairs."""
    import random

    draw = random.Random(5)
    prefix = lambda: [draw.choice("ab") for _ in range(draw.randrange(4))]
    asked = [(draw.randrange(12), draw.choice(["read", "write"]), prefix(), draw.randrange(25)) for _ in range(150)]
    done = [(draw.randrange(25), draw.randrange(12), prefix(), draw.random() < 0.4) for _ in range(60)]
    f = spark.createDataFrame(asked, "txn long, kind string, prefix array<string>, frontier long")
    h = spark.createDataFrame(done, "commit_seq long, writer long, region array<string>, wide boolean")
    for serializable in (True, False):
        want: dict = {}
        for txn, kind, p, frontier in asked:
            for seq, writer, region, wide in done:
                if (serializable or kind == "write") and seq > frontier and writer != txn and (region[: len(p)] == p or (wide and p[: len(region)] == region)):
                    want[txn] = min(seq, want.get(txn, seq))
        assert {r.txn: r.first_conflict for r in coordination.conflicts(f, h, serializable).collect()} == want


def test_lease_bars_against_all_pairs(spark):
    import random

    draw = random.Random(6)
    prefix = lambda: [draw.choice("abc") for _ in range(draw.randrange(3))]
    leases = [(k, draw.randrange(4), draw.choice(["read", "write"]), prefix(), draw.randrange(40)) for k in range(12)]
    asked = [(k, draw.randrange(4), draw.choice(["read", "write"]), prefix()) for k in range(80)]
    held = spark.createDataFrame(leases, "lease_id long, holder long, lease_mode string, lease_prefix array<string>, deadline long")
    r = spark.createDataFrame(asked, "request_id long, device long, mode string, prefix array<string>")
    near = lambda a, b: a[: len(b)] == b or b[: len(a)] == a
    want = {}
    for k, device, mode, p in asked:
        until = [d for _, holder, m, q, d in leases if d > 10 and holder != device and near(p, q) and "write" in (m, mode)]
        if until:
            want[k] = max(until)
    assert {x.request_id: x.retry_after for x in coordination.lease_conflicts(r, held, 10).collect()} == want
    writes = r.selectExpr("request_id AS write_id", "device", "prefix", "mode = 'read' AS wide")
    barred = {k for k, device, mode, p in asked if any(d > 10 and holder != device and (p[: len(q)] == q or (mode == "read" and near(p, q))) for _, holder, _, q, d in leases)}
    assert {x.write_id for x in coordination.barred_writes(writes, held, 10).collect()} == barred
