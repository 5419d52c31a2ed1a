"""Functions against plain Python, and rules at their limits."""

import base64
import datetime as dt
import ipaddress
import json
import math
import re
from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailspark.functions import arrow
from trailspark.functions.regex import RegexError, n_groups, term, to_java
from trailspark.functions.scalar import FUNCTIONS, Context, duration
from trailspark.functions.values import DYNAMIC, LONG, REAL, STRING, Value, literal
from trailspark.operators.expressions import term_match, word_match

CONTEXT = Context(None, lambda m: ValueError(m))


def run(spark, name, inputs, types=None, rest=()):
    """Values of a function over a column of inputs; rest: constant arguments."""
    types = types or [STRING]
    kind = {STRING: "string", DYNAMIC: "string", LONG: "bigint", REAL: "double"}
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"a{k} {kind[t]}" for k, t in enumerate(types)))
    args = [Value(F.col(f"a{k}"), t) for k, t in enumerate(types)] + [literal(v, t) for v, t in rest]
    out = FUNCTIONS[name][2](CONTEXT, args).column
    return [r[1] for r in df.select("i", out.alias("x")).orderBy("i").collect()]


def check(spark, name, table, types=None, rest=()):
    assert run(spark, name, [i for i, _ in table], types, rest) == [w for _, w in table]


def spark_json(spark, name, inputs, want):
    check(spark, name, list(zip(inputs, want, strict=True)))


def test_json(spark):
    """Documents of every JSON kind, whole and damaged, against Python's own parser."""
    inputs = ["[7,8,9,10]", "[[1,2],[3]]", '[{"x":[1]}, null]', "  []", '{"n":0}', '{"b2":[],"b1":{"c":1},"a9":"t"}', "\t{}\n", "[1 2]", '{"n"}', "true", "12.5", '"[1]"', "", None]

    def parsed(x):
        try:
            return json.loads(x)
        except (TypeError, ValueError):
            return None

    values = [parsed(x) for x in inputs]
    spark_json(spark, "array_length", inputs, [len(v) if isinstance(v, list) else None for v in values])
    spark_json(spark, "bag_keys", inputs, [json.dumps(sorted(v), separators=(",", ":")) if isinstance(v, dict) else None for v in values])


def test_todatetime(spark):
    base = dt.datetime(2021, 11, 30, 22, 58, 9, 40_000)
    written = [(base + dt.timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%S.%f") + f"{h:+03d}:00" for h in (-11, -1, 0, 5, 14)]
    assert run(spark, "todatetime", written) == [base] * 5
    assert run(spark, "todatetime", ["2021-11-30T22:58:09Z", "2021-11-30T22:58:09", "2021-11-30 22:58:09", "2020-02-29", "2021-11-30T22:58:09.987654321Z"]) == [base.replace(microsecond=0)] * 3 + [dt.datetime(2020, 2, 29), base.replace(microsecond=987_654)]
    # no such day, hour or minute; parts left out; something around it
    assert run(spark, "todatetime", ["2021-02-30", "2021-04-31T00:00:00Z", "2021-11-30T24:30:00Z", "2021-11-30T22:61:00Z", "2021-11-30T22Z", "2021-11", "at 2021-11-30", "2021-11-30T22:58:09Z!", "", None]) == [None] * 10


def test_casts(spark):
    check(spark, "tolong", [("0", 0), ("-15", -15), ("77 apples", 77), ("apples", 0), ("3.99", 3), ("", 0), (None, None)])
    check(spark, "tolong", [(7.25, 7), (-0.75, 0), (-1e40, -(2**63)), (None, None)], [REAL])
    check(spark, "toreal", [("6.5e1", 65.0), ("-.25kg", -0.25), ("kg", 0.0), (None, None)])


def test_decode(spark):
    texts = ["a", "spark", "Grüße", "日本", "tab\there", "x" * 49_152]
    check(spark, "base64_decode_tostring", [(base64.b64encode(t.encode()).decode(), t) for t in texts])
    # no padding, a foreign alphabet, line breaks, bits left over, bytes that are no text, more than is read
    bad = ["c3Bhcms", "c3B-cms=", "c3Bh\r\ncms=", "c3BhcmM9=", "YR==", base64.b64encode(b"\xc3\x28").decode(), base64.b64encode(b"x" * 49_155).decode(), None]
    check(spark, "base64_decode_tostring", [(x, None) for x in bad])
    texts = ["q=1&r=a b", "ключ", "100%", "a/b?c#d", ""]
    check(spark, "url_decode", [(quote(t, safe=""), t) for t in texts] + [("one+two%2Bthree", "one+two+three"), ("%2541", "%41")])
    check(spark, "url_decode", [("50%", None), ("%4", None), ("%zz", None), ("%C3%28", None), ("b" * 65_537, None), (None, None)])


def nested(depth):
    return '{"k":' * depth + "0" + "}" * depth


BAGS = [
    # plain names are root keys, as they are written
    ('{"host":"h","Port":null}', "host", True), ('{"host":"h","Port":null}', "Port", True), ('{"host":"h","Port":null}', "port", False), ('{"x.y":0}', "x.y", True), ('{"x":{"y":0}}', "x.y", False),
    # paths
    ('{"x":{"y":{"z":[]}}}', "$.x.y.z", True), ('{"x":{"y":{"z":[]}}}', "$.x.z", False), ('{"x":[]}', "$", True), ('{"p q":{"r.s":1}}', '$["p q"]["r.s"]', True), ("{\"it's\":0}", r"$['it\'s']", True), ('{"\u00fc":0}', '$["\\u00fc"]', True),
    # paths that are none
    ('{"x":[5]}', "$.x[0]", None), ('{"x":5}', "$..x", None), ('{"x":5}', "$.x.", None), ('{"x":5}', "$['x", None), ('{"x":5}', '$["\\q"]', None),
    # depth and length
    (nested(32), "$" + ".k" * 32, True), (nested(40), "$" + ".k" * 33, None), (json.dumps({"m" * 1024: 1}), "m" * 1024, True), (json.dumps({"m" * 1025: 1}), "m" * 1025, None),
    # no object
    ("[]", "x", None), ("7", "x", None), ('{"x":', "x", None), (None, "x", None), ('{"x":5}', None, None),
]


def test_bag_has_key(spark):
    assert run(spark, "bag_has_key", [(b, k) for b, k, _ in BAGS], [STRING, STRING]) == [w for *_, w in BAGS]
    # constant root keys stay in the JVM
    for key in ("host", "port", "x.y"):
        bags = [b for b, *_ in BAGS]
        assert run(spark, "bag_has_key", bags, [STRING], [(key, STRING)]) == [arrow.has_key(b, key) for b in bags]


def test_set_has_element(spark):
    text = [('["red","green",3]', "green", True), ('["red"]', "Red", False), ('["3"]', "3", True), ("[3,null]", "null", False), ('{"red":1}', "red", None), ("[", "red", None), (None, "red", None), ('["red"]', None, None)]
    assert run(spark, "set_has_element", [x[:2] for x in text], [STRING, STRING]) == [x[2] for x in text]
    # numbers are compared by value, however they are written; truth counts as 1 and 0
    longs = [("[25e-1,2.50e1]", 25, True), ("[24.999999999999999999]", 25, False), ("[[25]]", 25, False), ("[true]", 1, True), ("[false]", 0, True), ("25", 25, None), (json.dumps([4] * 1000), 4, True), (json.dumps([4] * 1001), 4, None)]
    assert run(spark, "set_has_element", [x[:2] for x in longs], [STRING, LONG]) == [x[2] for x in longs]
    reals = [("[0.5]", 0.5, True), ("[5e-1]", 0.5, True), ("[18014398509481985]", 18014398509481984.0, False), ("[0.5]", math.nan, None), ("[0.5]", -math.inf, None)]
    assert run(spark, "set_has_element", [x[:2] for x in reals], [STRING, REAL]) == [x[2] for x in reals]


PRIVATE = [ipaddress.ip_network(x) for x in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")]


def addresses():
    """Both ends of every private range, their outer neighbours, and some others."""
    out = [ipaddress.ip_address(int(end) + d) for n in PRIVATE for end, d in ((n[0], -1), (n[0], 0), (n[-1], 0), (n[-1], 1))]
    return [str(a) for a in out] + ["0.0.0.0", "255.255.255.255", "100.64.3.2", "198.51.100.77"]


ODD_ADDRESSES = ["172.20.1.300", "172.20.1", "172.020.1.1", "172.20.1.1.1", "fe80::1", "172.20.1.1:443", "\t172.20.1.1", "172.20.1.1 ", "", None]


def test_ipv4(spark):
    check(spark, "ipv4_is_private", [(a, any(ipaddress.ip_address(a) in n for n in PRIVATE)) for a in addresses()] + [(a, None) for a in ODD_ADDRESSES] + [("172.20.1.1/12", True), ("198.51.100.0/24", False), ("172.20.1.1/40", None)])
    lists = ["198.51.100.0/24", "172.20.1.1", "192.168.77.5/16", "0.0.0.0/1,172.16.0.0/12", " 10.0.0.0/9 , 10.128.0.0/9 ", "0.0.0.0/0"]
    ranges = [(a, x, any(ipaddress.ip_address(a) in ipaddress.ip_network(n.strip(), strict=False) for n in x.split(","))) for a in addresses() for x in lists]
    ranges += [("172.20.1.1", x, None) for x in ("172.16.0.0/12,none", "172.16.0.0/12,", "", "172.16.0.0/99", "fe80::/10", ",".join(["0.0.0.0/0"] * 129))] + [("172.20.1.1", ",".join(["0.0.0.0/0"] * 128), True)]
    ranges += [(a, "0.0.0.0/0", None) for a in ODD_ADDRESSES]
    assert run(spark, "ipv4_is_in_range", [x[:2] for x in ranges], [STRING, STRING]) == [x[2] for x in ranges]
    for list_ in (lists[3], "172.16.0.0/99"):
        assert run(spark, "ipv4_is_in_range", addresses() + ODD_ADDRESSES, [STRING], [(list_, STRING)]) == [arrow.in_range(a, list_) for a in addresses() + ODD_ADDRESSES]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["string", "long", "real"]), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=16))
def test_parse(groups):
    """Every group becomes a value of its type."""
    kinds = [k for k, _ in groups]
    shown = [f"n{n}" if k == "string" else str(n) if k == "long" else f"{n % 1000}.5" for k, n in groups]
    want = [s if k == "string" else int(s) if k == "long" else float(s) for k, s in zip(kinds, shown, strict=True)]
    pattern = "^" + ";".join([r"([^;]*)"] * len(groups)) + "$"
    assert json.loads(arrow.parse(pattern, ",".join(kinds), ";".join(shown))) == want
    # one type too few, no match, a type that is none
    assert arrow.parse(pattern, ",".join(kinds[1:] or ["string", "string"]), ";".join(shown)) is None
    assert arrow.parse(pattern, ",".join(kinds), ";".join([*shown, "x"])) is None
    assert arrow.parse(pattern, ",".join(["bool", *kinds[1:]]), ";".join(shown)) is None


def test_parse_limits():
    assert arrow.parse("z+", "", "zzz") == "[]"
    for pattern, kinds, text in (("[", "string", "z"), ("(z)" * 17, ",".join(["string"] * 17), "z" * 17), ("z+", "", "z" * 65_537), ("(z)", "long", "z"), ("(.+)", "long", str(2**63)), ("(.+)", "real", "inf"), (None, "", "z")):
        assert arrow.parse(pattern, kinds, text) is None


FIELDS = [("user", "string"), ("port", "long"), ("load", "real")]
SCHEMA = json.dumps([{"name": n, "type": t} for n, t in FIELDS])


@settings(max_examples=60, deadline=None)
@given(st.permutations(["user=eve", " port = 8080 ", "load=0.25", "other=1", "noise"]), st.sampled_from([(";", "="), ("&&", "="), ("|", "=")]))
def test_parse_kv(parts, separators):
    """Order, blanks, other keys and parts without a value do not matter."""
    pair, equals = separators
    assert json.loads(arrow.parse_kv(SCHEMA, pair, equals, pair.join(parts))) == ["eve", 8080, 0.25]


def test_parse_kv_rules():
    text = lambda body: json.loads(arrow.parse_kv(SCHEMA, ";", ":", body))
    # the first of a key counts, even if it is of the wrong type; a value may hold the sign
    assert text("user:a;user:b;port:x;port:1") == ["a", None, None] and text("user:a:b;load:nan") == ["a:b".split(";")[0], None, None] and text("") == ["", None, None]
    fields = lambda *f: json.dumps([{"name": n, "type": t} for n, t in f])
    for schema in ("", "null", "[]", '[{"type":"long"}]', fields(("", "long")), fields(("a", "date")), fields(("user", "long"), ("USER", "long"))):
        assert arrow.parse_kv(schema, ";", ":", "user:a") is None
    for pair, equals, body in (("", ":", "user:a"), (";", "", "user:a"), (";" * 17, ":", "user:a"), (None, ":", "user:a"), (";", ":", None)):
        assert arrow.parse_kv(SCHEMA, pair, equals, body) is None


def test_terms(spark):
    values = ["Disk full", "no Disk.", "DiskImage", "myDisk", "_Disk_", "éDiské", "disk", "DISK?", "disks", "RamDisk!", "Imagex", "at 2001.7.0.3", "2001x7x0x3", "12001.7.0.3", "\u212a", "k", "x\u212a", "up\nDisk\ndown", "di\u017fk", "D\u0130SK", "D\u0131sk", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")

    def hits(wanted, *args):
        return {values[r["i"]] for r in df.where(term_match(F.col("v"), wanted, *args)).collect()}

    plain = {"Disk full", "no Disk.", "_Disk_", "éDiské", "up\nDisk\ndown"}
    assert hits("Disk", True, True, True) == plain
    # the long s and the Kelvin sign are letters in another case; dotted and dotless i are not
    assert hits("Disk") == plain | {"disk", "DISK?", "di\u017fk"}
    assert hits("Disk", True, False, True) == plain | {"DiskImage"}
    assert hits("Disk", False, True, True) == plain | {"myDisk", "RamDisk!"}
    assert hits("2001.7.0.3") == {"at 2001.7.0.3"}
    assert hits("k") == {"\u212a", "k"}
    assert hits("") == set()


def test_regex_translation(spark):
    assert to_java("[[:alnum:]]+$") == r"[\p{Alnum}]+\z" and to_java("(?P<x>a)") == "(a)" and to_java("(?i)k") == "(?iu)k" and to_java("[a[b]") == r"[a\[b]"
    for bad in ("(?=a)", "(?!a)", "(?<=a)b", r"(a)\1", "(?U)a", "a++", "[a", "(", "x" * 513):
        with pytest.raises(RegexError):
            to_java(bad)
    assert n_groups(r"(a)(?:b)(?P<c>c)[(]\(") == 2
    assert spark.createDataFrame([("x\n",)], "s string").where(F.col("s").rlike(to_java("x$"))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab1_.é -", max_size=12), st.text(alphabet="ab1.", min_size=1, max_size=3))
def test_term_pattern(value, wanted):
    bounded = re.search(term(wanted).replace("(?iu)", "(?i)").replace(r"\z", r"\Z"), value) is not None
    want = any(value[i : i + len(wanted)] == wanted and (i == 0 or not re.match("[A-Za-z0-9]", value[i - 1])) and (i + len(wanted) == len(value) or not re.match("[A-Za-z0-9]", value[i + len(wanted)])) for i in range(len(value)))
    assert bounded == want


def test_durations():
    units = {"ms": 1e-3, "s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
    for unit, seconds in units.items():
        for n in ("1", "45", "0.5", "3.25"):
            assert abs(duration(n + unit).total_seconds() - float(n) * seconds) < 1e-6
    for bad in ("", "h", "3 fortnights", "12y", "9" * 30 + "d"):
        with pytest.raises(ValueError):
            duration(bad)


def test_unicode_words(spark):
    text = "Der Müller—Müllerei, MÜLLER_x und müller."
    got = {(w, s): spark.createDataFrame([(text,)], "v string").select(word_match(F.col("v"), w, s)).first()[0] for w in ("Müller", "müllere", "und", "DER", "llerei", "") for s in (False, True)}
    assert got == {("Müller", False): True, ("Müller", True): True, ("müllere", False): False, ("müllere", True): False, ("und", False): True, ("und", True): True, ("DER", False): True, ("DER", True): False, ("llerei", False): False, ("llerei", True): False, ("", False): False, ("", True): False}
