"""Upsert algebra (K1/K2/W3/W4/K15), device registry (K4, J7, J10, W1), J5 prefix join."""

import datetime as dt
import random

from pyspark.sql import functions as F

from mediashelf.operators import registry as R
from mediashelf.operators import upsert as U
from mediashelf.operators.prefix_join import longest_prefix_mount

from .conftest import rows

FILES = "id long, device_uuid string, path string, hash string, size long, system_id string, last_sync timestamp_ntz"
BATCH = "device_uuid string, path string, hash string, size long, system_id string, ord long"
T0 = dt.datetime(2020, 1, 1)


def files_df(spark):
    return spark.createDataFrame([
        (1, "d1", "a.jpg", "h1", 10, "s1", T0), (2, "d1", "b.jpg", "h2", 20, "s1", T0),
        (5, "d2", "a.jpg", "h3", 30, "s2", None)], FILES)


def apply(t, b, as_of="2021-01-01 00:00:00"):
    return U.upsert(t, b, ["device_uuid", "path", "system_id"], ["hash", "size"], as_of=as_of, order_col="ord").table


def test_upsert_basic(spark):
    b = spark.createDataFrame([("d1", "a.jpg", "x", 11, "s1", 1), ("d1", "a.jpg", "y", 12, "s1", 2),
                               ("d3", "n.jpg", "z", 1, "s1", 1), ("d3", "m.jpg", "w", 2, "s1", 1)], BATCH)
    out = rows(apply(files_df(spark), b), "id", "device_uuid", "path", "hash", "size", "last_sync")
    assert out == [
        (1, "d1", "a.jpg", "y", 12, dt.datetime(2021, 1, 1)),     # later write wins, stamped (K15)
        (2, "d1", "b.jpg", "h2", 20, T0),                         # untouched
        (5, "d2", "a.jpg", "h3", 30, None),
        (6, "d3", "m.jpg", "w", 2, None),                          # new ids in key order, not stamped
        (7, "d3", "n.jpg", "z", 1, None)]


def test_upsert_idempotent_and_composes(spark):
    random.seed(3)
    t = files_df(spark)
    b1 = spark.createDataFrame([("d%d" % random.randint(1, 3), "p%d" % random.randint(1, 6), "h", random.randint(1, 99),
                                 "s1", i) for i in range(30)], BATCH)
    b2 = spark.createDataFrame([("d%d" % random.randint(1, 3), "p%d" % random.randint(1, 6), "g", random.randint(1, 99),
                                 "s1", 100 + i) for i in range(30)], BATCH)
    once = apply(t, b1)
    twice = apply(once, b1)
    cols = ("device_uuid", "path", "system_id", "hash", "size")
    assert rows(once, *cols) == rows(twice, *cols)
    seq = apply(apply(t, b1), b2)
    together = apply(t, b1.unionByName(b2))
    assert rows(seq, *cols) == rows(together, *cols)
    keys = seq.groupBy("device_uuid", "path", "system_id").count().where("count > 1").count()
    assert keys == 0
    assert seq.select("id").distinct().count() == seq.count()


def test_replace_mode(spark):
    b = spark.createDataFrame([("d1", "a.jpg", "x", 11, "s1", 1)], BATCH)
    res = U.upsert(files_df(spark), b, ["device_uuid", "path", "system_id"], mode="replace", order_col="ord")
    out = rows(res.table, "id", "path", "hash", "last_sync")
    assert (6, "a.jpg", "x", None) in out and all(r[0] != 1 for r in out)
    assert rows(res.counts(), "action", "rows") == [("delete", 1), ("insert", 1)]


def test_serial_ids_dense(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 5000).cast("string")).alias("k"))
    out = U.assign_serial_ids(df, ["k"], 100, partitions=7)
    got = sorted((r["k"], r["id"]) for r in out.collect())
    assert [i for _, i in sorted(got, key=lambda x: x[1])] == list(range(101, 5101))
    assert [k for k, _ in sorted(got, key=lambda x: x[1])] == sorted(k for k, _ in got)


DEV = "id long, uuid string, mount_path string, label string, first_seen timestamp_ntz, last_seen timestamp_ntz, " \
      "system_id string, last_sync timestamp_ntz, is_active boolean"


def devices(spark):
    return spark.createDataFrame([
        (1, "u1", "/V/a", "a", T0, T0, "me", T0, True), (2, "u2", "/V/b", "b", T0, T0, "me", T0, True),
        (3, "u1", "/V/a", "a", T0, T0, "other", T0, True)], DEV)


def test_register_devices(spark):
    seen = spark.createDataFrame([("u1", "/V/new", "N"), ("u9", "/V/x", None), (None, "/V/z", "z")],
                                 "uuid string, mount_path string, label string")
    out = {(r["uuid"], r["system_id"]): r for r in
           R.register_devices(devices(spark), seen, "me", "2022-02-02 00:00:00").table.collect()}
    now = dt.datetime(2022, 2, 2)
    assert out[("u1", "me")]["first_seen"] == T0 and out[("u1", "me")]["last_seen"] == now
    assert out[("u1", "me")]["mount_path"] == "/V/new"
    assert out[("u9", "me")]["first_seen"] == now == out[("u9", "me")]["last_seen"]
    assert out[("u9", "me")]["label"] is None  # a NULL label stays NULL
    # a NULL uuid in the seen list disables the deactivation (NOT IN with NULL)
    assert out[("u2", "me")]["is_active"] is True


def test_register_devices_missing_fields(spark):
    seen = spark.createDataFrame([("u7",)], "uuid string")
    out = {(r["uuid"], r["system_id"]): r for r in
           R.register_devices(devices(spark), seen, "me", "2022-02-02 00:00:00").table.collect()}
    assert out[("u7", "me")]["mount_path"] == "" and out[("u7", "me")]["label"] == ""


def test_mark_inactive_rules(spark):
    d = devices(spark)
    empty = spark.createDataFrame([], "uuid string")
    assert rows(R.mark_inactive(d, empty, "me", T0)) == rows(d)
    with_null = spark.createDataFrame([("u1",), (None,)], "uuid string")
    assert rows(R.mark_inactive(d, with_null, "me", T0)) == rows(d)
    only_u1 = spark.createDataFrame([("u1",)], "uuid string")
    got = {(r["uuid"], r["system_id"]): r["is_active"] for r in R.mark_inactive(d, only_u1, "me", T0).collect()}
    assert got == {("u1", "me"): True, ("u2", "me"): False, ("u1", "other"): True}


def test_mount_lookup_chain(spark):
    mp = spark.createDataFrame([(1, "u1", "me", "/old", dt.datetime(2020, 1, 1)),
                                (2, "u1", "me", "/mount/path", dt.datetime(2021, 1, 1))],
                               "id long, device_uuid string, system_id string, mount_path string, last_updated timestamp_ntz")
    d = spark.createDataFrame([(7, "u2", "/devices/path", "me")], "id long, uuid string, mount_path string, system_id string")
    req = spark.createDataFrame([("u1", "me"), ("u2", "me"), ("u3", "me")], "device_uuid string, system_id string")
    got = {r["device_uuid"]: r["mount_path"] for r in R.device_mount_point(req, mp, d).collect()}
    assert got == {"u1": "/mount/path", "u2": "/devices/path", "u3": None}


def test_longest_prefix_cases(spark):
    mounts = spark.createDataFrame([("/V/Ext", "a"), ("/V/External", "b"), ("/V", "c"), ("", "e")],
                                   "mount_path string, uuid string")
    paths = spark.createDataFrame([(1, "/V/External/b"), (2, "/V/Extra"), (3, "/q"), (4, "/V//Ext/")],
                                  "id long, path string")
    got = {r["id"]: (r["mount_path"], r["device_label"]) for r in longest_prefix_mount(paths, mounts).collect()}
    assert got == {1: ("/V/External", "External"), 2: ("/V/Ext", "Ext"), 3: (None, None), 4: ("/V/Ext", "Ext")}


def test_longest_prefix_brute_force(spark):
    random.seed(7)
    alphabet = "ab/"
    mounts = sorted({"/" + "".join(random.choice(alphabet) for _ in range(random.randint(0, 5))) for _ in range(25)})
    paths = ["/" + "".join(random.choice(alphabet) for _ in range(random.randint(0, 9))) for _ in range(300)]
    mdf = spark.createDataFrame([(m, f"u{i}") for i, m in enumerate(mounts)], "mount_path string, uuid string")
    pdf = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    got = {r["id"]: r["mount_path"] for r in longest_prefix_mount(pdf, mdf).collect()}

    def norm(p):
        import re
        p = re.sub("/+", "/", p)
        return p if p == "/" else p.rstrip("/")
    for i, p in enumerate(paths):
        cands = [m for m in mounts if m and norm(p).startswith(m)]
        assert got[i] == (max(cands, key=len) if cands else None), p


def test_restore_paths(spark):
    files = spark.createDataFrame([(1, "u1", "Photos/a.jpg"), (2, "u2", "b.jpg"), (3, "u9", "c.jpg"), (4, "u1", "/abs.jpg")],
                                  "id long, device_uuid string, path string")
    devs = spark.createDataFrame([(1, "u1", "/Volumes/X/", "me"), (2, "u2", "", "me")],
                                 "id long, uuid string, mount_path string, system_id string")
    mps = spark.createDataFrame([], "id long, device_uuid string, system_id string, mount_path string, "
                                    "last_updated timestamp_ntz")
    req = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "file_id long")
    got = {r["file_id"]: r["full_path"] for r in R.restore_paths(req, files, devs, mps, "me").collect()}
    assert got == {1: "/Volumes/X/Photos/a.jpg", 2: None, 3: None, 4: "/abs.jpg", 5: None}
    live = spark.createDataFrame([("/abs.jpg",)], "path string")
    got = {r["file_id"]: r["full_path"] for r in R.restore_paths(req, files, devs, mps, "me", live).collect()}
    assert got[4] == "/abs.jpg" and got[1] is None


def test_init_catalogue_idempotent(spark, tmpdir_path):
    from mediashelf.schemas import SCHEMAS, init_catalogue
    paths = init_catalogue(spark, tmpdir_path)
    assert set(paths) == set(SCHEMAS)
    spark.createDataFrame([(1, "u", "/m", "l", None, None, "s", None, True)], SCHEMAS["devices"]) \
        .write.mode("overwrite").parquet(paths["devices"])
    init_catalogue(spark, tmpdir_path)
    assert spark.read.parquet(paths["devices"]).count() == 1
    assert spark.read.parquet(paths["files"]).count() == 0


def test_longest_prefix_shuffle_path_with_hot_mount(spark):
    random.seed(11)
    mounts = ["/"] + sorted({"/" + "".join(random.choice("ab") for _ in range(random.randint(1, 4))) for _ in range(20)})
    paths = ["/" + "".join(random.choice("ab/") for _ in range(random.randint(0, 8))) for _ in range(400)]
    mdf = spark.createDataFrame([(m, f"u{i}") for i, m in enumerate(mounts)], "mount_path string, uuid string")
    pdf = spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # mount side "too big": shuffle joins
    try:
        got = {r["id"]: r["mount_path"] for r in longest_prefix_mount(pdf, mdf).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    import re

    def norm(p):
        p = re.sub("/+", "/", p)
        return p if p == "/" else p.rstrip("/")
    for i, p in enumerate(paths):
        cands = [m for m in mounts if norm(p).startswith(m)]
        assert got[i] == (max(cands, key=len) if cands else None), p


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_key = st.tuples(st.sampled_from(["d1", "d2"]), st.sampled_from(["a", "b", "c", "d"]), st.sampled_from(["s1", "s2"]))


def py_upsert(current, batch, as_of):
    last = {}
    for dev, path, h, size, sysid, ord_ in batch:
        k = (dev, path, sysid)
        if k not in last or ord_ > last[k][2]:
            last[k] = (h, size, ord_)
    out = []
    keys = set()
    for id_, dev, path, h, size, sysid, ls in current:
        k = (dev, path, sysid)
        keys.add(k)
        if k in last:
            out.append((id_, dev, path, last[k][0], last[k][1], sysid, as_of))
        else:
            out.append((id_, dev, path, h, size, sysid, ls))
    nxt = max([r[0] for r in current], default=0)
    for k in sorted(k for k in last if k not in keys):
        nxt += 1
        out.append((nxt, k[0], k[1], last[k][0], last[k][1], k[2], None))
    return sorted(out)


@settings(max_examples=15, deadline=None)
@given(st.lists(_key, unique=True, max_size=8), st.lists(st.tuples(_key, st.integers(0, 99)), max_size=15))
def test_upsert_matches_python_model(spark, cur_keys, batch_rows):
    current = [(i * 10 + 1, d, p, f"h{i}", i, s, T0) for i, (d, p, s) in enumerate(cur_keys)]
    batch = [(d, p, f"n{j}", v, s, j) for j, ((d, p, s), v) in enumerate(batch_rows)]
    cdf = spark.createDataFrame(current, FILES)
    bdf = spark.createDataFrame(batch, BATCH)
    got = U.upsert(cdf, bdf, ["device_uuid", "path", "system_id"], ["hash", "size"],
                   as_of="2021-01-01 00:00:00", order_col="ord").table
    rows = sorted(tuple(r[c] for c in ("id", "device_uuid", "path", "hash", "size", "system_id", "last_sync"))
                  for r in got.collect())
    assert rows == py_upsert(current, batch, dt.datetime(2021, 1, 1))


def py_register(devs, seen, me, now):
    """Plain statement: per seen device with a uuid, update (mount, label, last_seen,
    active, last_sync) or insert (first_seen = last_seen = now); then mark inactive the
    active devices of ``me`` not in the seen uuids (no change if the list is empty or has
    a NULL)."""
    table = [dict(r) for r in devs]
    nxt = max([r["id"] for r in table], default=0)
    new = []
    for s in seen:
        if not s["uuid"]:
            continue
        hit = [r for r in table if r["uuid"] == s["uuid"] and r["system_id"] == me]
        if hit:
            for r in hit:
                r.update(mount_path=s["mount_path"], label=s["label"], last_seen=now, is_active=True, last_sync=now)
        elif not any(n["uuid"] == s["uuid"] for n in new):
            new.append(dict(uuid=s["uuid"], mount_path=s["mount_path"], label=s["label"], first_seen=now,
                            last_seen=now, system_id=me, last_sync=None, is_active=True))
    for n in sorted(new, key=lambda n: n["uuid"]):
        nxt += 1
        n["id"] = nxt
        table.append(n)
    active = [s["uuid"] for s in seen]
    if active and None not in active:
        for r in table:
            if r["system_id"] == me and r["is_active"] and r["uuid"] is not None and r["uuid"] not in active:
                r.update(is_active=False, last_sync=now)
    cols = ("id", "uuid", "mount_path", "label", "first_seen", "last_seen", "system_id", "last_sync", "is_active")
    return sorted(tuple(r[c] for c in cols) for r in table)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3"]), st.sampled_from(["me", "other"]), st.booleans()),
                unique_by=lambda t: (t[0], t[1]), max_size=5),
       st.lists(st.tuples(st.sampled_from(["u1", "u3", "u4", "", None]), st.sampled_from(["/V/a", "/V/b"])),
                unique_by=lambda t: t[0], max_size=4))
def test_register_devices_matches_plain_statement(spark, devspec, seenspec):
    now = dt.datetime(2022, 2, 2)
    devs = [dict(id=i + 1, uuid=u, mount_path="/old", label="L", first_seen=T0, last_seen=T0, system_id=s,
                 last_sync=T0, is_active=a) for i, (u, s, a) in enumerate(devspec)]
    seen = [dict(uuid=u, mount_path=m, label=(m or "").split("/")[-1]) for u, m in seenspec]
    cols = ("id", "uuid", "mount_path", "label", "first_seen", "last_seen", "system_id", "last_sync", "is_active")
    ddf = spark.createDataFrame([tuple(d[c] for c in cols) for d in devs], DEV)
    sdf = spark.createDataFrame([(s["uuid"], s["mount_path"], s["label"]) for s in seen],
                                "uuid string, mount_path string, label string")
    got = sorted(tuple(r[c] for c in cols) for r in R.register_devices(ddf, sdf, "me", now).table.collect())
    assert got == py_register(devs, seen, "me", now)
