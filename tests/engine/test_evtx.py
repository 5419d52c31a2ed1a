"""Event logs built byte by byte, then read."""

import json
import struct

import pytest

from trailspark.sources.evtx import EvtxError, events

NAMES: dict[str, int] = {}


class Builder:
    """Writes one chunk; names and the template are inline where they are first used."""

    def __init__(self):
        self.chunk = bytearray(512)
        self.names: dict[str, int] = {}
        self.templates: dict[int, int] = {}

    def name(self, out: bytearray, at: int, text: str) -> None:
        here = at + len(out) + 4
        known = self.names.get(text)
        out += struct.pack("<I", known or here)
        if known is None:
            self.names[text] = here
            out += struct.pack("<IHH", 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"

    def text(self, out: bytearray, value: str) -> None:
        out += b"\x05\x01" + struct.pack("<H", len(value)) + value.encode("utf-16-le")

    def element(self, out: bytearray, at: int, name: str, attributes=(), children=()) -> None:
        out += bytes([0x41 if attributes else 0x01]) + struct.pack("<HI", 0xFFFF, 0)
        self.name(out, at, name)
        if attributes:
            size_at = len(out)
            out += b"\0\0\0\0"
            for key, value in attributes:
                out += b"\x06"
                self.name(out, at, key)
                self.put(out, at, value)
            out[size_at : size_at + 4] = struct.pack("<I", len(out) - size_at - 4)
        if not children:
            out += b"\x03"
            return
        out += b"\x02"
        for c in children:
            if isinstance(c, tuple) and c[0] == "element":
                self.element(out, at, *c[1:])
            else:
                self.put(out, at, c)
        out += b"\x04"

    def put(self, out: bytearray, at: int, value) -> None:
        if isinstance(value, str):
            self.text(out, value)
        else:
            index, optional = value
            out += bytes([0x0E if optional else 0x0D]) + struct.pack("<HB", index, 0)

    def record(self, number: int, tree, values) -> None:
        start = len(self.chunk)
        body = bytearray(b"\x0f\x01\x01\x00\x0c\x01") + struct.pack("<I", 7)
        at = start + 24
        known = self.templates.get(id(tree))
        here = at + len(body) + 4
        body += struct.pack("<I", known or here)
        if known is None:
            self.templates[id(tree)] = here
            head = len(body)
            body += bytes(24) + b"\x0f\x01\x01\x00"
            self.element(body, at, *tree[1:])
            body += b"\0"
            body[head + 20 : head + 24] = struct.pack("<I", len(body) - head - 24)
        body += struct.pack("<I", len(values))
        for type_, raw in values:
            body += struct.pack("<HBB", len(raw), type_, 0)
        for _, raw in values:
            body += raw
        size = 24 + len(body) + 4
        self.chunk += struct.pack("<IIQQ", 0x2A2A, size, number, 0) + body + struct.pack("<I", size)
        self.count = number

    def file(self) -> bytes:
        self.chunk[:8] = b"ElfChnk\0"
        self.chunk[8:24] = struct.pack("<QQ", 1, self.count)
        return b"ElfFile\0".ljust(4096, b"\0") + bytes(self.chunk).ljust(65536, b"\0") + bytes(65536)


def text(s):
    return (0x01, s.encode("utf-16-le"))


TREE = (
    "element", "Event", [("xmlns", "http://schemas")],
    [
        ("element", "System", (), [
            ("element", "Provider", [("Name", (0, False))]), ("element", "EventID", (), [(1, False)]), ("element", "Computer", (), ["TestComputer"]), ("element", "TimeCreated", [("SystemTime", (2, False))]),
            ("element", "Correlation", [("ActivityID", (3, True))]),
        ]),
        ("element", "EventData", (), [("element", "Data", [("Name", "Image")], [(4, True)]), ("element", "Data", [("Name", "Flags")], [(5, False)])]),
        ("element", "UserData", (), [("element", "LogFileCleared", (), [("element", "SubjectUserName", (), ["test"])])]),
    ],
)


def sample() -> bytes:
    b = Builder()
    time = struct.pack("<Q", 116444736000000000 + 1_700_000_000 * 10**7 + 5_000_000)
    for n in (1, 2):
        b.record(n, TREE, [text("Microsoft-Windows-Eventlog"), (0x06, struct.pack("<H", 1100 + n)), (0x11, time), (0x00, b""), text(f"C:\\{n}.exe") if n == 1 else (0x00, b""), (0x14, struct.pack("<I", 255))])
    return b.file()


def test_events():
    first, second = events(sample())
    assert first == {
        "System": {"Provider": {"Name": "Microsoft-Windows-Eventlog"}, "EventID": {"Value": 1101}, "Computer": "TestComputer", "TimeCreated": {"SystemTime": 1700000000.5}, "Correlation": None},
        "EventData": {"Image": "C:\\1.exe", "Flags": "0xff"},
        "UserData": {"LogFileCleared": {"SubjectUserName": "test"}},
    }
    assert second["System"]["EventID"]["Value"] == 1102 and second["EventData"]["Image"] is None


def test_rejects():
    good = bytearray(sample())
    for at, value in ((0, b"x"), (4096, b"x"), (4096 + 16, b"\xff" * 8), (4096 + 512, b"\0"), (4096 + 512 + 24 + 4, b"\x1b")):
        bad = bytearray(good)
        bad[at : at + len(value)] = value
        with pytest.raises(EvtxError):
            list(events(bytes(bad)))


def test_import(spark, tmp_path):
    from trailspark.engine import Engine
    from trailspark.sources.ingest import Workspace
    from trailspark.sources.manifest import parse

    (tmp_path / "in.evtx").write_bytes(sample())
    w = Workspace(spark, str(tmp_path / "ws"))
    w.load(parse(json.dumps({"datasets": [{"name": "e", "table": "Log", "path": "in.evtx", "sourcePath": "System.Provider.Name", "timestampPath": "System.TimeCreated.SystemTime"}]}), str(tmp_path)))
    rows = Engine(spark, w.catalog()).query("Log | where System.EventID.Value == 1102 | project TimeGenerated, Source, c=tostring(System.Computer), u=tostring(UserData.LogFileCleared.SubjectUserName)", None)["rows"]
    assert rows == [{"TimeGenerated": "2023-11-14T22:13:20.500000000Z", "Source": "Microsoft-Windows-Eventlog", "c": "TestComputer", "u": "test"}]
