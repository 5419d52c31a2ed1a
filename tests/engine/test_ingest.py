"""Ingest: formats, normalisation, discovery, reload."""

import gzip
import json
import os

import pyarrow as pa
import pytest

from trailspark.engine import Engine, to_json
from trailspark.queries import _bracketed
from trailspark.sources import times
from trailspark.sources.discover import catalogue_path, merge
from trailspark.sources.formats import InputError, decode_array, decode_csv, detect, records
from trailspark.sources.ingest import Workspace
from trailspark.sources.jsontext import dumps, loads, minify, normalize, split_path
from trailspark.sources.manifest import DatasetConfig, Manifest, ManifestError, parse


def manifest(folder, *datasets, **top):
    return parse(json.dumps({"datasets": list(datasets), **top}), str(folder))


def dataset(name="d", table="T", path="in.ndjson", **more):
    return {"name": name, "table": table, "path": path, "source": "s", "timestampPath": "ts", **more}


@pytest.fixture
def load(spark, tmp_path):
    def run(*datasets, files=None):
        for name, content in (files or {}).items():
            (tmp_path / name).write_bytes(content if isinstance(content, bytes) else content.encode())
        w = Workspace(spark, str(tmp_path / "ws"))
        w.load(manifest(tmp_path, *datasets))
        return w, Engine(spark, w.catalog())

    return run


def test_ndjson(load):
    lines = '{"ts":"2024-01-02T03:04:05+02:00","host":{"name":"pc"},"n":9007199254740993,"x":2.50}\r\n\n {"ts":"2024-01-02T03:04:06Z","n":7,"ok":true,"z":null}\n'
    w, e = load(dataset(), files={"in.ndjson": lines})
    assert w.datasets[0].count == 2
    got = json.loads(to_json(e.query("T | order by TimeGenerated asc | project TimeGenerated, Source, n, x, ok, z, h=tostring(host.name), host", None)))["rows"]
    assert got[0] == {"TimeGenerated": "2024-01-02T01:04:05.000000000Z", "Source": "s", "n": 9007199254740993, "x": 2.5, "ok": None, "z": None, "h": "pc", "host": {"name": "pc"}}
    assert got[1]["ok"] is True and got[1]["n"] == 7
    assert "2.50" in to_json(e.query("T | project RawData", None))
    assert {c["name"]: c["type"] for c in e.schema()["tables"][1]["columns"]}["n"] == "long"


def test_array_gzip_and_auto_time(load):
    body = json.dumps([{"ts": 1700000000, "a": 1}, {"ts": 1700000000500, "a": "x"}]).encode()
    w, e = load(dataset(path="in.json.gz"), files={"in.json.gz": gzip.compress(body)})
    rows = e.query("T | order by TimeGenerated asc | project TimeGenerated, a", None)["rows"]
    assert [r["TimeGenerated"] for r in rows] == ["2023-11-14T22:13:20.000000000Z", "2023-11-14T22:13:20.500000000Z"]
    # mixed kinds keep each row's own
    assert to_json({"rows": rows}).count('"a": 1') == 1 and '"a": "x"' in to_json({"rows": rows})


def test_csv(load):
    text = '﻿ts,source,kind,message,AuditData,serial\r\n2/01/2024 3:04:05 PM,web,login,"two\r\nlines <b>","{""ClientIP"":""1.2.3.4"",""Success"":true}",00123\r\n'
    w, e = load(dataset(path="in.csv", source="", sourcePath="source", timestampFormat="2/01/2006 3:04:05 PM"), files={"in.csv": text})
    row = e.query("T | project TimeGenerated, Source, serial, message, ip=tostring(AuditData.ClientIP)", None)["rows"][0]
    assert row == {"TimeGenerated": "2024-01-02T15:04:05.000000000Z", "Source": "web", "serial": "00123", "message": "two\nlines <b>", "ip": "1.2.3.4"}
    raw = to_json(e.query("T | project RawData", None))
    assert "\\u003cb\\u003e" in raw and '"AuditData":{"ClientIP":"1.2.3.4","Success":true}' in raw
    paths = {f["path"]: f["type"] for f in w.fields()["tables"]["T"]}
    assert paths["AuditData.ClientIP"] == "string" and paths["AuditData.Success"] == "bool" and paths['RawData["source"]'] == "string"


@pytest.mark.parametrize("text", ["a,a\n1,2\n", "a,\n1,2\n", "ts,b\n1\n", "", 'ts,b\n"x,1\n'])
def test_csv_rejects(load, text):
    with pytest.raises(InputError):
        load(dataset(path="in.csv", timestampFormat="unix"), files={"in.csv": text})


def test_all_or_nothing(spark, tmp_path, load):
    good = '{"ts":1}\n'
    w, _ = load(dataset(), files={"in.ndjson": good})
    with pytest.raises(InputError, match="record 2"):
        load(dataset(), files={"in.ndjson": good + "{bad\n{worse\n"})
    again = Workspace(spark, str(tmp_path / "ws"))
    assert [d.count for d in again.datasets] == [1]
    assert not list((tmp_path / "ws" / "staging").glob("*")) if (tmp_path / "ws" / "staging").exists() else True


def test_reload(spark, tmp_path, load):
    files = {"a.ndjson": '{"ts":1,"v":1}\n', "b.ndjson": '{"ts":2,"v":"x","only":true}\n'}
    w, e = load(dataset("a", "Shared", "a.ndjson", source="one"), dataset("b", "Shared", "b.ndjson", source="two"), files=files)
    assert e.query("Shared | count", None)["rows"] == [{"Count": 2}]
    assert dict(e.compile("Shared").types)["v"] == "dynamic"
    w2 = Workspace(spark, str(tmp_path / "ws"))
    assert w2.load(manifest(tmp_path, dataset("a", "Shared", "a.ndjson", source="one"), dataset("b", "Shared", "b.ndjson", source="two"))) == []
    (tmp_path / "a.ndjson").write_text('{"ts":1,"v":5}\n{"ts":2,"v":6}\n')
    assert w2.load(manifest(tmp_path, dataset("a", "Shared", "a.ndjson", source="one"))) == ["a"]
    assert [d.count for d in w2.datasets] == [2]


def test_events_union(load):
    files = {"z.ndjson": '{"ts":1,"shared":1,"zulu":true,"CaseKey":"a"}\n', "a.ndjson": '{"ts":1,"alpha":"q","shared":"s","casekey":"b"}\n'}
    _, e = load(dataset("z", "Zulu", "z.ndjson"), dataset("a", "Alpha", "a.ndjson"), files=files)
    types = e.compile("Events").types
    assert list(types.items()) == [("TimeGenerated", "datetime"), ("Source", "string"), ("RawData", "dynamic"), ("alpha", "string"), ("shared", "dynamic"), ("ts", "long"), ("zulu", "bool")]
    assert e.query('Events | search "q" | project alpha', None)["rows"] == [{"alpha": "q"}]


def test_late_records(load):
    inner = json.dumps({"k": json.dumps({"deep": 1})})
    lines = [json.dumps({"ts": 1, "n": i}) for i in range(5000)]
    lines += [json.dumps({"ts": 2, "payload": inner}), json.dumps({"ts": 3, "payload": inner}), '{"ts":4,"n":1,"nested":' + '{"late":123456789012345678901234567890}}']
    w, e = load(dataset(), files={"in.ndjson": "\n".join(lines)})
    paths = {f["path"] for f in w.fields()["tables"]["T"]}
    assert {"payload.k.deep", "nested.late"} <= paths
    raw = to_json(e.query("T | where ts > 1 | project RawData", None))
    assert raw.count('{"payload":{"k":{"deep":1}}') == 2 and "123456789012345678901234567890" in raw


@pytest.mark.parametrize("kind", ["json", "csv"])
def test_folder_of_files(spark, tmp_path, kind):
    """Fields of every file are found: records are numbered over the files, not in each."""
    (tmp_path / "in").mkdir()
    for f in range(3):
        key = f"only{f}"
        embedded = json.dumps({"deep": f})
        if kind == "csv":
            rows = [f'1,{i},"{embedded.replace(chr(34), chr(34) * 2)}"' if i == 3000 else f"1,{i}," for i in range(4000)]
            (tmp_path / "in" / f"{f}.csv").write_text("\n".join([f"ts,n,{key}", *rows]) + "\n")
        else:
            rows = [{"ts": 1, "n": i} | ({key: embedded} if i == 3000 else {}) for i in range(4000)]
            (tmp_path / "in" / f"{f}.json").write_text(json.dumps(rows))
    w = Workspace(spark, str(tmp_path / "ws"))
    w.load(manifest(tmp_path, dataset(path="in", format=kind, timestampFormat="unix")))
    assert w.datasets[0].count == 12_000
    e = Engine(spark, w.catalog())
    assert {"only0", "only1", "only2"} <= set(e.compile("T").types)
    if kind == "json":
        assert {"only0.deep", "only1.deep", "only2.deep"} <= {f["path"] for f in w.fields()["tables"]["T"]}
        assert e.query("T | where only2.deep == 2 | count", None)["rows"] == [{"Count": 1}]
    numbers = sorted(r["record_no"] for r in spark.read.parquet(w.datasets[0].path).select("record_no").collect())
    assert numbers == list(range(1, 12_001))


def test_indexed_path(load):
    w, e = load(dataset(indexedPaths=["src_ip", "alert.signature_id"]), files={"in.ndjson": '{"ts":1,"src_ip":"10.0.0.1","alert":{"signature_id":42}}\n{"ts":2,"dest_ip":"x"}\n'})
    c = e.compile("T | where alert.signature_id == 42 | project src_ip")
    assert "x0_alert.signature_id" in c.df._jdf.queryExecution().optimizedPlan().toString()
    assert c.df.collect()[0][0] == "10.0.0.1"
    assert "PushedFilters: [IsNotNull(f" in e.compile('T | where src_ip == "10.0.0.1"').df._jdf.queryExecution().executedPlan().toString()


def test_json_text():
    assert minify(' { "a b" : [ 1.50 , "x \\" y" ] } ') == '{"a b":[1.50,"x \\" y"]}'
    assert dumps(loads('{"b":1e3,"a":"<&>\\u2028"}')) == '{"a":"\\u003c\\u0026\\u003e\\u2028","b":1e3}'
    value, changed = normalize(loads('{"s":" {\\"t\\":\\"[1,2]\\"} ","u":"{no"}'), None)
    assert changed and dumps(value) == '{"s":{"t":[1,2]},"u":"{no"}'
    assert split_path(r"host\.name.x") == ["host.name", "x"]
    for bad in ("[1] x", "NaN", '{"a":1,}'):
        with pytest.raises(ValueError):
            loads(bad)
    assert merge("long", "real") == "mixed" and merge("null", "bool") == "bool" and merge("bool", "null") == "bool"
    assert catalogue_path(("a", "x y"), {"a": "dynamic"}) == 'a["x y"]' and catalogue_path(("a b",), {}) == 'RawData["a b"]'


@pytest.mark.parametrize(
    ("text", "layout", "want"),
    [("2/01/2024 3:04:05 PM", "2/01/2006 3:04:05 PM", "2024-01-02T15:04:05.000000000Z"), ("2024-01-02T03:04:05.123456-0230", "2006-01-02T15:04:05.999999-0700", "2024-01-02T05:34:05.123456000Z"), ("02 Jan 24 12:00", "02 Jan 06 15:04", "2024-01-02T12:00:00.000000000Z")],
)
def test_layouts(text, layout, want):
    assert times.text_of(times.parse(text, False, layout)) == want


def test_manifest():
    assert detect("a.CSV.gz") == "csv" and detect("x.evtx") == "evtx" and detect("x.log") == "json" and detect("a.csv", "json") == "json"
    for bad in (dataset(path="../x"), dataset(path="/x"), dataset(table="Events"), dataset(table="a-b"), dataset(format="xml"), dataset(extra=1), dataset(indexedPaths=["a-b"]), dataset(indexedPaths=[""]), dataset(indexedPaths=["1a"])):
        with pytest.raises(ManifestError):
            manifest(".", bad)
    with pytest.raises(ManifestError):
        manifest(".", dataset("a"), dataset("a"))
    with pytest.raises(ManifestError):
        manifest(".", dataset("a", "Sh"), dataset("b", "sh"))
    question = {"id": "q-1", "revision": 1, "title": "t", "prompt": "p", "acceptedAnswers": ["x"]}
    with pytest.raises(ManifestError):
        manifest(".", dataset(), questions=[question])
    assert manifest(".", dataset(), questions=[question], flag="f", submissionCooldown="1m").cooldown_s == 60


def test_search_reads_escapes(spark, tmp_path):
    """A letter written as an escape is found like the letter."""
    (tmp_path / "in.json").write_text('{"ts":1,"m":"\\u0050ower up"}\n{"ts":2,"m":"Power up"}\n{"ts":3,"m":"C:\\\\users"}\n')
    ws = Workspace(spark, str(tmp_path / "ws"))
    ws.load(Manifest(datasets=(DatasetConfig("d", "T", str(tmp_path / "in.json"), "json", "s", "", "ts"),)))
    engine = Engine(spark, ws.catalog())
    assert engine.compile('T | search "power"').df.count() == engine.compile('T | where m has "power"').df.count() == 2
    assert engine.compile('T | search "users"').df.count() == 1


def test_packed_lines_are_bounded(spark, tmp_path):
    with gzip.open(tmp_path / "in.json.gz", "wt") as f:
        f.write('{"ts":1,"m":"' + "x" * 5000 + '"}\n')
    wanted = Manifest(datasets=(DatasetConfig("d", "T", str(tmp_path / "in.json.gz"), "json", "s", "", "ts"),))
    with pytest.raises(InputError):
        Workspace(spark, str(tmp_path / "a"), max_input=4000).load(wanted)
    assert Workspace(spark, str(tmp_path / "b"), max_input=6000).load(wanted) == ["d"]


def test_rewritten_file_is_loaded_again(spark, tmp_path):
    """A file of a folder that keeps its size is signed by its own time, and the newest whole catalogue counts."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text('{"ts":1,"m":"one"}\n')
    wanted = Manifest(datasets=(DatasetConfig("d", "T", str(folder), "json", "s", "", "ts"),))
    ws = Workspace(spark, str(tmp_path / "ws"))
    assert ws.load(wanted) == ["d"] and ws.load(wanted) == []
    before = folder.stat()
    (folder / "a.json").write_text('{"ts":1,"m":"two"}\n')
    os.utime(folder / "a.json", (before.st_mtime + 5, before.st_mtime + 5))
    os.utime(folder, (before.st_atime, before.st_mtime))
    assert ws.load(wanted) == ["d"]
    (tmp_path / "ws" / "catalog.json.half.new").write_text("[{")
    again = Workspace(spark, str(tmp_path / "ws"))
    assert [r["m"] for r in Engine(spark, again.catalog()).compile("T | project m").df.collect()] == ["two"]


CSV_TEXT = '\ufeffts,b\r\n1,"two\r\nlines, ""é"""\r2,\n\n3,"\r\n"\n4,z'
ARRAY_TEXT = ' [{"ts":1,"m":"}, ]é\\""} , 12.5,\r\n{"a":{"b":[1,{}]}}\n,7,null] \n'


@pytest.mark.parametrize(("decode", "text", "want"), [(decode_csv, CSV_TEXT, ['{"ts":"1","b":"two\\nlines, \\"é\\""}', '{"ts":"2","b":""}', '{"ts":"3","b":"\\n"}', '{"ts":"4","b":"z"}']), (decode_array, ARRAY_TEXT, ['{"ts":1,"m":"}, ]é\\""}', "12.5", '{"a":{"b":[1,{}]}}', "7", "null"]), (decode_array, ' {"a":1}\r\n\n [2]\r{"é":3}', ['{"a":1}', "[2]", '{"é":3}'])])
def test_blocks(decode, text, want):
    """Where a file is cut into blocks does not count."""
    whole = text.encode()
    for size in range(1, len(whole) + 1):
        assert list(decode(whole[at : at + size] for at in range(0, len(whole), size))) == want


@pytest.mark.parametrize("text", ["[1,2", "[1,]", "[1 2]", "[1] 2", "[1,2,", '[{"a":1', "[", "[1]]", "[tru]", '[{"a":1}}]'])
def test_array_rejects(text):
    for size in (1, 3, 100):
        with pytest.raises(ValueError):
            list(decode_array(text.encode()[at : at + size] for at in range(0, len(text), size)))


@pytest.mark.parametrize("decode", [decode_csv, decode_array])
def test_files_are_streamed(decode):
    """A decoder holds a block or two of a file, however long it is, and gives up on a record without end."""
    taken = 0

    def blocks(start, again):
        nonlocal taken
        yield start
        while True:
            taken += 1
            yield again

    made = decode(blocks(b"ts,b\n", b"1,x\n" * 1000) if decode is decode_csv else blocks(b"[0", b',{"ts":1}' * 1000))
    for _ in range(50_000):
        next(made)
    assert taken <= 52
    endless = decode(blocks(b"ts,b\n" if decode is decode_csv else b'["', b"x" * (1 << 20)))
    taken = 0
    with pytest.raises((ValueError, InputError)):
        next(endless)
    assert taken < 12


@pytest.mark.parametrize("kind", ["array", "csv", "lines"])
def test_splits_of_files(spark, tmp_path, kind):
    """Whole files are read in order by one task each and split lines are numbered over the files, each by one Python step at most."""
    folder = tmp_path / "in"
    folder.mkdir()
    want, ends = [], ("", "\n", "\r\n")
    for f, end in enumerate(ends):
        rows = [json.dumps({"ts": 1, "n": f"{f * 4000 + i}", "m": "}\n{"}) for i in range(4000)]
        want += rows
        text = {"array": "[" + ",".join(rows) + "]", "lines": "\n".join(rows), "csv": "ts,n,m\n" + "\n".join(f'1,{f * 4000 + i},"}}\n{{"' for i in range(4000))}[kind]
        (folder / f"{f}.txt").write_text(text + end)
    conf = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = records(spark, str(folder), "csv" if kind == "csv" else "json")
        got = sorted(tuple(r) for r in df.collect())
        assert df.rdd.getNumPartitions() == 3 if kind != "lines" else df.rdd.getNumPartitions() > 12
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == (kind != "lines")
        assert {k: spark.conf.get(k) for k in conf} == conf
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [n for n, _, _ in got] == list(range(1, 12_001)) and not any(e for *_, e in got)
    assert [json.loads(raw)["n"] for _, raw, _ in got] == [json.loads(raw)["n"] for raw in want]


def test_limit_of_a_file(spark, tmp_path):
    """The input limit is a file's, so that a folder may hold any number of files."""
    folder = tmp_path / "in"
    folder.mkdir()
    for f in range(3):
        (folder / f"{f}.csv").write_text("ts,m\n" + "1,x\n" * 100)
    wanted = Manifest(datasets=(DatasetConfig("d", "T", str(folder), "csv", "s", "", "ts", "unix"),))
    assert Workspace(spark, str(tmp_path / "a"), max_input=500).load(wanted) == ["d"]
    with pytest.raises(InputError, match="400 byte"):
        Workspace(spark, str(tmp_path / "b"), max_input=400).load(wanted)


@pytest.mark.parametrize("sizes", [[1], [3], [0, 2, 0, 1], [0], []])
def test_array_is_written_as_it_streams(sizes):
    """The query's input: a partition becomes one array, and only its last object is held."""
    objects = iter(range(sum(sizes)))
    batches = [pa.RecordBatch.from_arrays([pa.array([f'{{"n":{next(objects)}}}' for _ in range(n)], pa.string())], names=["value"]) for n in sizes]
    text = " ".join(x for b in _bracketed(iter(batches)) for x in b.column(0).to_pylist())
    assert text == "" if not sum(sizes) else json.loads(text) == [{"n": n} for n in range(sum(sizes))]
