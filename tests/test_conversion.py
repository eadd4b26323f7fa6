"""Conversion with parts, session limit and resume; manifests."""

import json
import os
import resource
from collections import Counter

import pytest

from trailmix.sources import conversion, files, manifests
from trailmix.sources.parts import Parts

ACTIONS = ("clicks", "carts", "orders")


def lines(n, start=0):
    for s in range(start, start + n):
        yield json.dumps({"session": s, "events": [{"aid": (s * 7 + k) % 50, "ts": 1000 * s + k, "type": ACTIONS[(s + k) % 3]} for k in range(1 + s * 13 % 9)]})


def made(tmp_path, n=200, files_=3):
    source = tmp_path / "raw"
    source.mkdir()
    for f in range(files_):
        (source / f"part-{f}.jsonl").write_text("\n".join(lines(n, f * n)) + "\n")
    return str(source)


def events(source):
    return Counter(
        (r["session"], e["aid"], e["ts"], ACTIONS.index(e["type"]), k)
        for name in sorted(os.listdir(source)) for line in open(f"{source}/{name}") for r in [json.loads(line)] for k, e in enumerate(r["events"])
    )


def by_part(spark, folder):
    return {r["part"]: (r["n"], r["least"], r["most"]) for r in spark.read.parquet(folder).groupBy("part").agg({"session": "count", "place": "min"}).withColumnsRenamed({"count(session)": "n", "min(place)": "least"}).join(spark.read.parquet(folder).groupBy("part").agg({"place": "max"}).withColumnRenamed("max(place)", "most"), "part").collect()}


def test_parts_are_cut_at_session_ends(spark, tmp_path):
    source, folder = made(tmp_path), str(tmp_path / "out")
    told = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100)
    assert told["status"] == "complete" and told["sessions"] == 600 and told["events"] == sum(events(source).values())
    assert Counter(tuple(r) for r in conversion.converted(spark, folder, told).collect()) == events(source)
    parts = by_part(spark, folder)
    assert len(parts) == told["parts"] > 10
    assert all(n >= 100 for k, (n, _, _) in parts.items() if k < told["parts"] - 1)
    ends = [parts[k][1:] for k in sorted(parts)]
    assert ends[0][0] == 0 and all(b[0] == a[1] + 1 for a, b in zip(ends, ends[1:], strict=False))  # in the order of the source, none split
    again = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100)
    assert again == told


def test_a_session_limit_is_taken_up_again(spark, tmp_path):
    source, folder = made(tmp_path), str(tmp_path / "out")
    told = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100, max_sessions=77)
    first = [r for r in conversion.converted(spark, folder, told).collect()]
    assert (told["status"], told["sessions"]) == ("partial", 77) and {r["session"] for r in first} == set(range(77))
    same = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100, max_sessions=77)
    assert (same["status"], same["parts"], same["sessions"]) == ("partial", told["parts"], 77)
    more = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100, max_sessions=300)
    assert more["sessions"] == 300 and more["parts"] > told["parts"]
    whole = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100)
    assert whole["status"] == "complete" and Counter(tuple(r) for r in conversion.converted(spark, folder, whole).collect()) == events(source)


def test_a_broken_run_ends_with_the_same_rows(spark, tmp_path, monkeypatch):
    source, folder = made(tmp_path), str(tmp_path / "out")
    commit, seen = Parts._commit, []

    def breaks(self):
        commit(self)
        seen.append(len(self.committed))
        if len(self.committed) >= 6:
            raise RuntimeError("killed")

    monkeypatch.setattr(Parts, "_commit", breaks)
    with pytest.raises(RuntimeError, match="killed"):
        conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100, each=3)
    monkeypatch.setattr(Parts, "_commit", commit)
    at, system = files.file_system(spark, f"{folder}/part=8")  # as of a job that was killed while it wrote
    system.mkdirs(at)
    told = conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100, each=3)
    assert Counter(tuple(r) for r in conversion.converted(spark, folder, told).collect()) == events(source)
    with pytest.raises(RuntimeError, match="another source"):
        conversion.convert(spark, source, folder, ("m", "e"), events_per_part=100)
    at, system = files.file_system(spark, f"{folder}/part=2")
    system.delete(at, True)
    with pytest.raises(RuntimeError, match="missing"):
        conversion.convert(spark, source, folder, ("m", "d"), events_per_part=100)


@pytest.mark.parametrize("line, told", [
    ("", "empty source line"),
    ('{"session": -1, "events": [{"aid": 1, "ts": 1, "type": "clicks"}]}', "invalid session"),
    ('{"session": 5, "events": []}', "no events"),
    ('{"session": 5, "events": [{"aid": -2, "ts": 1, "type": "clicks"}]}', "invalid item"),
    ('{"session": 5, "events": [{"aid": 2, "type": "clicks"}]}', "invalid timestamp"),
    ('{"session": 5, "events": [{"aid": 2, "ts": 1, "type": "views"}]}', "invalid action"),
    ('{"session": 5, "events": [{"aid": 2, "ts": 1', "MALFORMED|Malformed"),
])
def test_faulty_lines_fail(spark, tmp_path, line, told):
    (tmp_path / "x.jsonl").write_text("\n".join([*lines(2), line, *lines(1, 9)]) + "\n")
    with pytest.raises(Exception, match=told):
        conversion.convert(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "out"), ("m", "d"))


def test_an_empty_source_is_complete(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("")
    told = conversion.convert(spark, str(tmp_path / "x.jsonl"), str(tmp_path / "out"), ("m", "d"))
    assert (told["status"], told["sessions"], told["parts"]) == ("complete", 0, 0)


def test_manifests_do_not_depend_on_order(spark, tmp_path):
    source = made(tmp_path)
    found = manifests.build(spark, [source], "unit")
    names = sorted(os.listdir(source))
    assert [r["name"] for r in found["files"]] == names
    each = manifests.build(spark, [f"{source}/{n}" for n in reversed(names)], "unit")
    assert each == found != manifests.build(spark, [source], "other")
    manifests.write(spark, found, str(tmp_path / "m.json"))
    assert manifests.read(spark, str(tmp_path / "m.json")) == found
    assert manifests.identity(found, names[0]) == (found["manifest_id"], found["files"][0]["sha256"])
    for wrong in ("none.jsonl",):
        with pytest.raises(ValueError, match="0 times"):
            manifests.identity(found, wrong)
    files.write_text(spark, str(tmp_path / "m.json"), json.dumps(found | {"source": "x"}))
    with pytest.raises(ValueError, match="changed"):
        manifests.read(spark, str(tmp_path / "m.json"))
    assert manifests.differences(spark, found, source).collect() == []
    assert manifests.attested(spark, found, source) == found["manifest_id"]
    with open(f"{source}/{names[0]}", "a") as f:
        f.write("x")
    os.rename(f"{source}/{names[1]}", f"{source}/new.jsonl")
    assert {tuple(r) for r in manifests.differences(spark, found, source).collect()} == {(names[0], "changed"), (names[1], "missing"), ("new.jsonl", "unknown")}
    with pytest.raises(ValueError, match="changed"):
        manifests.attested(spark, found, source)
    with pytest.raises(FileNotFoundError):
        manifests.build(spark, [f"{source}/none-*"], "unit")


def test_digests_equal_the_jvm(spark, tmp_path):
    source = made(tmp_path)
    wanted = {r["name"]: r["sha256"] for r in files.manifest(spark, source).collect()}
    assert {r["name"]: r["sha256"] for r in manifests.hashed(spark, source).collect()} == wanted


def test_large_files_hash_in_little_memory(tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + 12345)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    size, digest = manifests.stream_digest(str(path))
    path.unlink()
    assert size == (2 << 30) + 12345 and len(digest) == 64
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # in KB
