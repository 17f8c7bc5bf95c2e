"""Sync (F11, F12, T1, T2, T4) and inventory parsers."""

import datetime as dt

from pyspark.sql import functions as F

from mediashelf.operators import sync as S
from mediashelf.sources import inventory as inv

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)
OLD = NOW - dt.timedelta(minutes=10)

DEV = "id long, uuid string, mount_path string, label string, first_seen timestamp_ntz, last_seen timestamp_ntz, " \
      "system_id string, last_sync timestamp_ntz, is_active boolean"
FILES = "id long, device_uuid string, path string, hash string, size long, modified_time timestamp_ntz, " \
        "scanned_time timestamp_ntz, system_id string, last_sync timestamp_ntz"


def test_dirty_three_valued(spark):
    df = spark.createDataFrame([(1, None, "me"), (2, None, "other"), (3, OLD, None), (4, None, None), (5, NOW, "me")],
                               "id long, last_sync timestamp_ntz, system_id string")
    sel = sorted(r["id"] for r in df.where(S.dirty(df, "me", S.cutoff_of(NOW))).collect())
    assert sel == [2, 3]
    acted = sorted(r["id"] for r in S.acted(df, "me", S.cutoff_of(NOW)).collect())
    assert acted == [2, 3]


def test_foreign_device_becomes_mine(spark):
    d = spark.createDataFrame([(1, "test-uuid", "/test/mount/path", "Test Device", OLD, OLD, "other-system", OLD, True)], DEV)
    r = S.sync_devices(d, "me", NOW).first()
    assert r["system_id"] == "me" and r["last_sync"] == NOW and r["is_active"] is True and r["last_seen"] == NOW


def test_device_conflict_pair(spark):
    d = spark.createDataFrame([(1, "u", "/m", "L", OLD, OLD, "system1", NOW - dt.timedelta(minutes=10), True),
                               (2, "u", "/m", "L", OLD, OLD, "system2", NOW - dt.timedelta(minutes=5), True)], DEV)
    out = S.sync_devices(d, "me", NOW).collect()
    assert len(out) == 1 and out[0]["system_id"] == "me" and out[0]["id"] == 2


def test_files_sync_and_orphans(spark):
    f = spark.createDataFrame([(1, "u", "/test/file/path", "test-hash", 1024, OLD, OLD, "other-system", OLD),
                               (2, "u", "gone", "h", 1, OLD, OLD, "other-system", OLD)], FILES)
    present = spark.createDataFrame([("u", "/test/file/path")], "device_uuid string, path string")
    out = S.sync_files(f, "me", NOW, present).collect()
    assert [(r["id"], r["system_id"], r["last_sync"], r["hash"]) for r in out] == [(1, "me", NOW, "test-hash")]
    ia = spark.createDataFrame([(10, 1, "cam", "other", OLD), (11, 2, "cam", "other", OLD)],
                               "id long, file_id long, camera_model string, system_id string, last_sync timestamp_ntz")
    got = sorted((r["file_id"], r["system_id"]) for r in S.sync_image_analysis(ia, S.sync_files(f, "me", NOW, present),
                                                                                "me", NOW).collect())
    assert got == [(1, "me")]


def lines_df(spark, host, os_, lines):
    return spark.createDataFrame([(host, os_, NOW, i, l) for i, l in enumerate(lines)],
                                 "host string, os string, captured_at timestamp_ntz, seq long, line string")


def test_linux_lines(spark):
    df = lines_df(spark, "h", "Linux", ["/dev/sda1 U1 /media/a b", "/dev/sda2 U2 /boot", "/dev/sda3 U3",
                                        "/dev/sda4 U4 /", "  /dev/sdb1   U5   /mnt/x  ", "/dev/sdb2 U6 /mnt/x"])
    got = sorted((r["mount_path"], r["uuid"]) for r in inv.linux_devices(df).collect())
    assert got == [("/media/a b", "U1"), ("/mnt/x", "U6")]


def test_macos_fold(spark):
    df = lines_df(spark, "h", "Darwin", [
        "Volume UUID: BEFORE", "Device Identifier: disk1", "   Volume UUID: A1", "   Mount Point: /Volumes/Data",
        "   Mount Point: (not mounted)", "Device Identifier: disk2", "Volume UUID: A2", "Mount Point: (not mounted)",
        "Device Identifier: disk3", "Volume UUID: A3", "Mount Point: /Volumes/VM", "Device Identifier: disk4",
        "Volume UUID: A4", "Mount Point: /", "Device Identifier: disk5", "Mount Point: /Volumes/NoUuid"])
    got = sorted((r["mount_path"], r["uuid"]) for r in inv.macos_devices(df).collect())
    assert got == [("/", "A4"), ("/Volumes/Data", "A1")]


def test_windows_and_home(spark):
    df = lines_df(spark, "h", "Windows", ["DeviceID DriveLetter", "C: \\\\?\\Volume{1}\\", "D: \\\\?\\Volume{2}\\", "E:"])
    homes = spark.createDataFrame([("h", NOW, "my.host.lan", "/home/me")],
                                  "host string, captured_at timestamp_ntz, node string, home_dir string")
    got = sorted((r["mount_path"], r["uuid"]) for r in inv.all_devices(df, homes).collect())
    assert got == [("/home/me", "HOME-my-host-lan-me"), ("D:", "\\\\?\\Volume{2}\\")]
    first = {r["uuid"]: r["mount_path"] for r in inv.first_mount_of_uuid(inv.all_devices(df, homes)).collect()}
    assert first["HOME-my-host-lan-me"] == "/home/me"


def test_migration_rewrite_dry_run_and_key_widening(spark):
    from mediashelf.operators import migrate as M
    files = spark.createDataFrame([(1, "u", "/Volumes/X/a/b.jpg", None, None), (2, "u", "c.jpg", "migration", None),
                                   (3, "u", "/Volumes/X/d.jpg", "other", None), (4, "v", "/Volumes/Y/e.jpg", "", None)],
                                  "id long, device_uuid string, path string, system_id string, last_sync timestamp_ntz")
    devs = spark.createDataFrame([(10, "u", "/Volumes/X", "me")], "id long, uuid string, mount_path string, system_id string")
    dry = M.apply_rewrite(files, devs, "me", NOW, dry_run=True)
    assert sorted(map(tuple, dry.collect())) == sorted(map(tuple, files.collect()))
    out = {r["id"]: (r["path"], r["system_id"]) for r in M.apply_rewrite(files, devs, "me", NOW).collect()}
    assert out == {1: ("a/b.jpg", "me"), 2: ("c.jpg", "me"), 3: ("/Volumes/X/d.jpg", "other"),
                   4: ("/Volumes/Y/e.jpg", "")}
    stats = {r["device_uuid"]: (r["total"], r["updated"]) for r in
             M.rewrite_stats(M.rewrite_plan(files, devs, "me")).collect()}
    assert stats == {"u": (2, 2), None: (2, 2)}
    assert M.can_widen_key(files, ["device_uuid", "path"])
    assert not M.can_widen_key(files, ["device_uuid"])


from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_sys = st.sampled_from(["me", "other", "third", None])
_ls = st.sampled_from([None, OLD, NOW])


def py_sync_files(rows, me, now, cutoff):
    """The reference loop: dirty rows (SQL NULL rules) owned by another system (Python !=),
    each acted row in id order updating every row of its (device, path); then one row per
    full key: newest last_sync (NULLs last), then largest id."""
    def dirty(r):
        a = None if r["last_sync"] is None else r["last_sync"] < cutoff
        b = None if r["system_id"] is None else r["system_id"] != me
        return (a is True) or (b is True)
    table = [dict(r) for r in rows]
    acted = sorted((dict(r) for r in rows if dirty(r) and r["system_id"] != me), key=lambda r: r["id"])
    for a in acted:
        for r in table:
            if r["device_uuid"] == a["device_uuid"] and r["path"] == a["path"]:
                r.update(hash=a["hash"], size=a["size"], system_id=me, last_sync=now)
    best = {}
    for r in table:
        k = (r["device_uuid"], r["path"], r["system_id"])
        rank = (r["last_sync"] is not None, r["last_sync"] or dt.datetime.min, r["id"])
        if k not in best or rank > best[k][0]:
            best[k] = (rank, r)
    return sorted((r["id"], r["device_uuid"], r["path"], r["hash"], r["size"], r["system_id"], r["last_sync"])
                  for _, r in best.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u", "v"]), st.sampled_from(["a", "b", "c"]), _sys, _ls),
                min_size=1, max_size=10, unique_by=lambda t: (t[0], t[1], t[2])))  # a valid table: unique full key
def test_sync_files_matches_reference_loop(spark, specs):
    rows = [dict(id=i + 1, device_uuid=d, path=p, hash=f"h{i}", size=i, modified_time=None, scanned_time=None,
                 system_id=s, last_sync=ls) for i, (d, p, s, ls) in enumerate(specs)]
    df = spark.createDataFrame([tuple(r[c] for c in ("id", "device_uuid", "path", "hash", "size", "modified_time",
                                                      "scanned_time", "system_id", "last_sync")) for r in rows], FILES)
    got = sorted((r["id"], r["device_uuid"], r["path"], r["hash"], r["size"], r["system_id"], r["last_sync"])
                 for r in S.sync_files(df, "me", NOW).collect())
    assert got == py_sync_files(rows, "me", NOW, S.cutoff_of(NOW))


def py_macos(lines):
    """Plain statement of the fold: volumes start at 'Device Identifier:'; keep the last
    UUID value and the last valid mount; save volumes with identifier, UUID and mount;
    later volumes overwrite a mount; keep /Volumes/* (not Recovery/VM) and '/'."""
    devices, vol, data = {}, None, {}

    def save():
        if vol and "UUID" in data and "Mount Point" in data:
            devices[data["Mount Point"]] = data["UUID"]
    for raw in lines:
        line = raw.strip()
        if line.startswith("Device Identifier:"):
            save()
            vol = line.split(":")[1].strip()
            data = {}
        elif "Volume UUID:" in line:
            data["UUID"] = line.split(":", 1)[1].strip()
        elif "Mount Point:" in line:
            mp = line.split(":", 1)[1].strip()
            if mp and mp != "(not mounted)":
                data["Mount Point"] = mp
    save()
    return sorted((m, u) for m, u in devices.items()
                  if (m.startswith("/Volumes/") and not m.startswith("/Volumes/Recovery")
                      and not m.startswith("/Volumes/VM")) or m == "/")


_mac_line = st.one_of(
    st.sampled_from(["Device Identifier: disk1", "Device Identifier:", "  Device Identifier: disk2s1 "]),
    st.sampled_from(["Volume UUID: A", "   Volume UUID: B-1", "Volume UUID:", "Volume UUID: C:D"]),
    st.sampled_from(["Mount Point: /Volumes/Data", "Mount Point: (not mounted)", "Mount Point: /",
                     "Mount Point: /Volumes/Recovery", "Mount Point: /Volumes/VMx", "Mount Point:",
                     "  Mount Point:   /Volumes/Other  ", "Mount Point: /private/var"]),
    st.sampled_from(["Bus Protocol: USB", "", "   Volume Name: X"]))


@settings(max_examples=25, deadline=None)
@given(st.lists(_mac_line, max_size=14))
def test_macos_fold_matches_plain_statement(spark, lines):
    from mediashelf.sources import inventory as inv
    df = spark.createDataFrame([("h", "Darwin", NOW, i, l) for i, l in enumerate(lines)],
                               "host string, os string, captured_at timestamp_ntz, seq long, line string")
    got = sorted((r["mount_path"], r["uuid"]) for r in inv.macos_devices(df).collect())
    assert got == py_macos(lines)


def py_linux(lines):
    out = {}
    for line in lines:
        parts = line.strip().split()
        if len(parts) >= 3:
            uuid, mount = parts[1], " ".join(parts[2:])
            if uuid and mount and mount not in ["/boot", "/"]:
                out[mount] = uuid
    return sorted(out.items())


def py_windows(lines):
    out = {}
    for line in lines[1:]:
        parts = line.strip().split()
        if len(parts) >= 2 and parts[0] and parts[1] and parts[0] != "C:":
            out[parts[0]] = parts[1]
    return sorted(out.items())


_tok = st.sampled_from(["/dev/sda1", "U1", "U2", "/boot", "/", "/media/a", "b", "C:", "D:", "\\\\?\\Vol{1}\\"])
_ws = st.sampled_from([" ", "  ", "\t", " \t "])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.tuples(_tok, _ws), max_size=5), min_size=1, max_size=8))
def test_linux_windows_match_plain_statement(spark, raw):
    from mediashelf.sources import inventory as inv
    lines = ["".join(t + w for t, w in parts) for parts in raw]
    for os_name, parse, model in (("Linux", inv.linux_devices, py_linux), ("Windows", inv.windows_devices, py_windows)):
        df = spark.createDataFrame([("h", os_name, NOW, i, l) for i, l in enumerate(lines)],
                                   "host string, os string, captured_at timestamp_ntz, seq long, line string")
        got = sorted((r["mount_path"], r["uuid"]) for r in parse(df).collect())
        assert got == model(lines), os_name


def py_sync_devices(rows, me, now, cutoff, present=None):
    """Reference loop for devices: dirty rows owned by another system; per such row, if its
    uuid is present every row of the uuid takes ownership (last_seen, owner, last_sync,
    active), else every row of the uuid is marked inactive (and stamped); then one row per
    (uuid, owner): newest last_sync (NULLs last), then largest id."""
    def dirty(r):
        a = None if r["last_sync"] is None else r["last_sync"] < cutoff
        b = None if r["system_id"] is None else r["system_id"] != me
        return (a is True) or (b is True)
    table = [dict(r) for r in rows]
    for a in sorted((dict(r) for r in rows if dirty(r) and r["system_id"] != me), key=lambda r: r["id"]):
        ok = present is None or a["uuid"] in present
        for r in table:
            if r["uuid"] == a["uuid"]:
                if ok:
                    r.update(last_seen=now, system_id=me, last_sync=now, is_active=True)
                else:
                    r.update(is_active=False, last_sync=now)
    best = {}
    for r in table:
        k = (r["uuid"], r["system_id"])
        rank = (r["last_sync"] is not None, r["last_sync"] or dt.datetime.min, r["id"])
        if k not in best or rank > best[k][0]:
            best[k] = (rank, r)
    cols = ("id", "uuid", "last_seen", "system_id", "last_sync", "is_active")
    return sorted(tuple(r[c] for c in cols) for _, r in best.values())


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["u1", "u2", "u3"]), _sys, _ls, st.booleans()),
                min_size=1, max_size=8, unique_by=lambda t: (t[0], t[1])),
       st.one_of(st.none(), st.lists(st.sampled_from(["u1", "u2", "u3"]), unique=True)))
def test_sync_devices_matches_reference_loop(spark, specs, present):
    rows = [dict(id=i + 1, uuid=u, mount_path="/m", label="L", first_seen=OLD, last_seen=OLD, system_id=s,
                 last_sync=ls, is_active=a) for i, (u, s, ls, a) in enumerate(specs)]
    cols = ("id", "uuid", "mount_path", "label", "first_seen", "last_seen", "system_id", "last_sync", "is_active")
    df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], DEV)
    pdf = None if present is None else spark.createDataFrame([(u,) for u in present], "uuid string")
    got = sorted(tuple(r[c] for c in ("id", "uuid", "last_seen", "system_id", "last_sync", "is_active"))
                 for r in S.sync_devices(df, "me", NOW, pdf).collect())
    assert got == py_sync_devices(rows, "me", NOW, S.cutoff_of(NOW), None if present is None else set(present))
