"""Names, shapes, diagnostics and limits of the language."""

import datetime as dt
import json

import pytest

from trailspark.engine import Engine, to_json
from trailspark.operators.collect import collect
from trailspark.operators.results import sort_rows
from trailspark.plans import rewrite
from trailspark.plans.errors import QueryError
from trailspark.questions import Challenge
from trailspark.sources.manifest import parse as parse_manifest

#: Three deliveries: an array of numbers, an object, nothing.
ROWS = [
    ('{"sizes":[4,9,2,9],"label":["big","red"],"unit.of.size":"kg","who":{"name":null}}', "dock-7", "Nora", "Crate arrived, seal-42 intact", "gate"),
    ('{"sizes":{"w":3},"serial":18014398509481985}', "dock-8", "omar", "Pallet returned", "gate"),
    ('{"sizes":null}', "dock-9", "Nora", "", "yard"),
]


@pytest.fixture(scope="module")
def e(spark):
    engine = Engine(spark, now=dt.datetime(2025, 3, 1, 6, 15, tzinfo=dt.timezone(dt.timedelta(hours=-5))))
    engine.register("Events", spark.createDataFrame(ROWS, "RawData string, host string, user string, message string, Source string"), {"RawData"})
    return engine


def rows(e, q):
    return json.loads(to_json(e.query(q, None)))["rows"]


def test_arrays(e):
    assert rows(e, "Events | mv-expand with_itemindex=at size=RawData.sizes limit 3 | project at, size | order by at asc") == [{"at": 0, "size": 4}, {"at": 1, "size": 9}, {"at": 2, "size": 2}]
    assert rows(e, "Events | mv-expand size=RawData.sizes to typeof(long) | summarize n=count(), total=sum(size) by host") == [{"host": "dock-7", "n": 4, "total": 24}]
    assert rows(e, "Events | mv-apply size=RawData.sizes on (extend half=size / 2 | where half >= 2) | project size, half | order by size desc, half asc") == [{"size": 9, "half": 4}, {"size": 9, "half": 4}, {"size": 4, "half": 2}]


def test_paths(e):
    assert rows(e, 'Events | where host endswith "7" | project second=tostring(RawData.label[1]), unit=tostring(RawData["unit.of.size"]), name=RawData.who.name, none=RawData.who.age.years') == [{"second": "red", "unit": "kg", "name": None, "none": None}]
    assert rows(e, "Events | where RawData.serial == 18014398509481985 | project host") == [{"host": "dock-8"}]
    assert rows(e, "Events | where RawData.serial == 18014398509481984 | count") == [{"Count": 0}]


def test_names(e):
    assert e.compile("Events | project host, user | join kind=inner (Events | project host, user, Source) on host").columns == ["host", "user", "host1", "user1", "Source"]
    assert e.compile("Events | project-away RawData, user | project-rename place=host | project-keep message, place").columns == ["place", "message"]
    assert e.compile("Events | summarize max(strlen(user)), count(), make_list(host), countif(user == 'x') by Source").columns == ["Source", "max_", "count_", "list_host", "countif_"]
    assert e.compile("Events | extend WHERE2=HOST").columns[-1] == "WHERE2"


def test_operators(e):
    assert rows(e, 'Events | where user in~ ("NORA") and message has_all ("CRATE", "seal") | project host') == [{"host": "dock-7"}]
    assert rows(e, 'Events | search "nora" and not "crate" | project host') == [{"host": "dock-9"}]
    assert rows(e, "Events | as all_ | join kind=inner (all_ | where Source == 'gate') on user | count") == [{"Count": 3}]
    assert len(rows(e, "Events | sample 2 | distinct host")) == 2
    assert rows(e, "let most = 1; let Yard = Events | where Source == 'yard'; yard | take most | project host") == [{"host": "dock-9"}]
    assert rows(e, "Events | summarize places=make_list(host), who=make_set(user) by Source | order by Source desc")[0] == {"Source": "yard", "places": ["dock-9"], "who": ["Nora"]}
    assert rows(e, 'Events | extend user=strcat(user, "!") | distinct user | order by user asc') == [{"user": "Nora!"}, {"user": "omar!"}]
    assert rows(e, "Events | where isnull(user) | summarize who=make_set(user), n=count(), long=sum(strlen(user))") == [{"who": [], "n": 0, "long": None}]
    assert rows(e, "Events | project path=@'d:\\in', key=h'pin', text=```two\nlines```, quoted=\"it's\", five=5 // the end\n | take 1") == [{"path": "d:\\in", "key": "pin", "text": "two\nlines", "quoted": "it's", "five": 5}]


def test_clock(e):
    got = rows(e, 'Events | project today=now(), before=ago(36h), then=todatetime("2025-02-28T23:00:00+01:00"), later=now() + 90m | take 1')[0]
    assert got == {"today": "2025-03-01T11:15:00.000000000Z", "before": "2025-02-27T23:15:00.000000000Z", "then": "2025-02-28T22:00:00.000000000Z", "later": "2025-03-01T12:45:00.000000000Z"}


def test_collections_are_bounded(spark):
    engine = Engine(spark)
    engine.register("N", spark.range(1200).withColumnRenamed("id", "x"))
    got = rows(engine, "N | summarize s=array_length(make_set(x)), l=array_length(make_list(x))")
    assert got == [{"s": 1000, "l": 1000}]
    assert engine.query("N", None)["rowCount"] == 1000


def test_collections_of_groups(spark):
    # a group of many rows, one of nulls alone, a null key, repeated values, text that is JSON
    data = [("hot", str(i % 1500)) for i in range(6000)] + [("none", None)] * 1100 + [(None, "b"), (None, None), (None, "a"), (None, "b"), ("json", ' {"k":1}'), ("json", '{"k":1}'), ("json", "{")]
    engine = Engine(spark)
    engine.register("T", spark.createDataFrame(data, "k string, v string").repartition(5))
    got = {r["k"]: r for r in rows(engine, "T | summarize n=count(), s=make_set(v), l=make_list(v), m=array_length(make_set(strlen(v))) + 1, t=tostring(make_list(1)) by k")}
    assert set(got) == {"hot", "none", None, "json"} and [got[k]["n"] for k in ("hot", "none", None, "json")] == [6000, 1100, 4, 3]
    assert got["hot"]["s"] == sorted(map(str, range(1500)))[:1000] and len(got["hot"]["l"]) == 1000 and got["hot"]["m"] == 5
    assert got["none"]["s"] == got["none"]["l"] == [] and got["none"]["m"] == 1
    assert got[None]["s"] == ["a", "b"] and sorted(got[None]["l"]) == ["a", "b", "b"]
    assert sorted(got["json"]["s"], key=str) == ["{", {"k": 1}] and len(got["json"]["l"]) == 3
    assert [len(json.loads(got[k]["t"])) for k in ("hot", "none", None, "json")] == [1000, 1000, 4, 3]
    assert rows(engine, "T | where k == 'absent' | summarize s=make_set(v), n=count()") == [{"s": [], "n": 0}]
    assert rows(engine, "T | where k == 'absent' | summarize s=make_set(v) by k") == []


def test_collection_bytes(spark):
    wide = spark.createDataFrame([(1, "x" * 300), (1, "y" * 300), (1, "z" * 10)], "k long, v string").coalesce(1)
    assert [r["collected"] for r in collect(wide, ["k"], "v", False, most_bytes=320).collect()] == ["[" + "x" * 300 + "," + "z" * 10 + "]"]
    assert [r["collected"] for r in collect(wide, [], "v", True, most=2).collect()] == ["[" + "x" * 300 + "," + "y" * 300 + "]"]
    assert collect(wide.limit(0), ["k"], "v", True).count() == collect(wide.limit(0), [], "v", True).count() == 0


@pytest.mark.parametrize(
    "query",
    [
        "Events | where", "Events | where Missing == 1", "Missing | take 1", "Events | extend V=now(1)", "Events | extend V=ago()", "Events | extend V=ago(host)", "Events | extend V=ago(1x)", "Events | extend V=toint()", "Events | extend V=isnull()", "Events | extend V=isempty()",
        "Events | parse message with x", "Events | summarize N=sum(count())", "Events | join (Events) on host", "Events | join kind=cross (Events) on host", "Events | union (Events | project host)", "Events | mv-apply x=RawData.items on (take 1)", "Events | project split(host, '')",
        "Events | extend d=dcount(host)", "Events | take -1", "Events | where host matches regex 'a'", "Events | project extract('(?=a)', 0, host)", "let a = 1;", "Events | project x='open", "Events | mv-expand a=RawData.items | mv-expand b=RawData.tags", "Events | project " + ", ".join(f"c{i}=1" for i in range(33)), "x" * 40_000,
    ],
)
def test_rejected(e, query):
    error = e.validate(query)
    assert isinstance(error, QueryError) and error.line >= 1 and error.column >= 1 and error.message


def test_positions(e):
    error = e.validate("Events\n| where host == 'x'\n| project Missing")
    assert (error.line, error.column, error.message) == (3, 11, "unknown column Missing")


def test_rewrites():
    q = "let n = 1;\nEvents | take n"
    assert rewrite.source(q) == "Events" and rewrite.source("let x = 1") is None
    assert rewrite.replace_source(q, "Sysmon") == "let n = 1;\nSysmon | take n" and rewrite.replace_source("| take 1", "T") == "T\n| take 1"
    assert rewrite.value_filter("Events | take 1", "a", 'x"y', True) == 'Events\n| where a != "x\\"y"\n| take 1'
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    assert rewrite.time_range("Events", start, start + dt.timedelta(hours=1)) == 'Events\n| where TimeGenerated >= datetime("2024-01-01T00:00:00.000Z") and TimeGenerated < datetime("2024-01-01T01:00:00.000Z")'


def test_sorted_rows():
    data = [{"a": "x10"}, {"a": None}, {"a": "X2"}, {"a": 3}]
    assert [r["a"] for r in sort_rows(data, "a")] == [3, "X2", "x10", None]
    assert [r["a"] for r in sort_rows(data, "a", True)] == [None, "x10", "X2", 3]


def test_questions():
    question = {"id": "q", "revision": 1, "title": "t", "prompt": "p", "acceptedAnswers": ["Yes", "y"]}
    m = parse_manifest(json.dumps({"questions": [question], "flag": "done"}))
    c, t = Challenge(m), dt.datetime(2024, 1, 1)
    assert not c.submit("q", "no", t)["correct"] and c.submit("q", "yes", t)["retryAfter"] > 0
    won = c.submit("q", " YES ", t + dt.timedelta(seconds=4))
    assert won["correct"] and won["state"]["flag"] == "done" and won["state"]["questions"][0]["attempts"] == 2
    assert c.submit("q", "yes", t)["alreadySolved"]
    question["revision"] = 2
    assert Challenge(parse_manifest(json.dumps({"questions": [question], "flag": "done"})), c.progress).state()["solved"] == 0


def test_deadline(spark):
    from pyspark.sql import functions as F

    engine = Engine(spark)
    engine.register("Slow", spark.range(4).select(F.expr("java_method('java.lang.Thread', 'sleep', 4000L + id)").alias("x")))
    with pytest.raises(TimeoutError):
        engine.query("Slow", 0.5)


def test_streams(spark, tmp_path):
    from trailspark.streaming import live

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    engine = Engine(spark)
    live.register(engine, "S", stream, {"props"})
    with pytest.raises(QueryError):
        live.rows(engine, "S | summarize count() by event_type")
    out = live.rows(engine, 'S | where event_type == "click" | extend k=tolong(props.k) | project event_id, k')
    live.to_parquet(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    want = source.where("event_type = 'click'").count()
    assert want and spark.read.parquet(str(tmp_path / "out")).count() == want
    counts = live.windowed(stream, "ts", "1 day", ("event_type",), late="0 seconds")
    q = counts.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from w").first()[0] == source.count()
    first = live.first_seen(stream, "ts", ("event_type",), "3650 days").writeStream.format("memory").queryName("f").outputMode("append").trigger(availableNow=True).start()
    first.awaitTermination(120)
    assert spark.sql("select count(*) from f").first()[0] == source.select("event_type").distinct().count()
