"""Windows event logs: chunks, records and binary XML, to ordered dictionaries.

Layout: a 4 KiB file header, then 64 KiB chunks that can be read alone. Offsets
of names and templates count from the chunk's start.
"""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

HEADER, CHUNK, RECORDS = 4096, 65536, 512
#: The smallest record, so a chunk holds at most CHUNK // RECORD of them.
RECORD = 24
_MAX_DEPTH = 64


class EvtxError(ValueError):
    pass


@dataclass
class Element:
    name: str
    attributes: list[tuple[str, object]] = field(default_factory=list)
    children: list[object] = field(default_factory=list)


@dataclass
class _Slot:
    """A place that a template's instance fills."""

    index: int
    optional: bool


class _Chunk:
    def __init__(self, data: bytes):
        self.data = data
        self.names: dict[int, tuple[str, int]] = {}
        self.templates: dict[int, tuple[list[object], int]] = {}

    def name(self, offset: int) -> tuple[str, int]:
        """(name, bytes it takes) of the name at an offset."""
        if offset not in self.names:
            n = struct.unpack_from("<H", self.data, offset + 6)[0]
            self.names[offset] = (self.data[offset + 8 : offset + 8 + 2 * n].decode("utf-16-le"), 10 + 2 * n)
        return self.names[offset]

    def template(self, offset: int, depth: int) -> tuple[list[object], int]:
        """(nodes, bytes it takes) of the template definition at an offset."""
        if offset not in self.templates:
            size = struct.unpack_from("<I", self.data, offset + 20)[0]
            nodes = _Reader(self, offset + 24, offset + 24 + size, depth + 1).nodes()
            self.templates[offset] = (nodes, 24 + size)
        return self.templates[offset]


class _Reader:
    def __init__(self, chunk: _Chunk, at: int, end: int, depth: int = 0):
        if depth > _MAX_DEPTH:
            raise EvtxError("binary XML is nested too deeply")
        if end > len(chunk.data):
            raise EvtxError("binary XML runs beyond its chunk")
        self.chunk, self.data, self.at, self.end, self.depth = chunk, chunk.data, at, end, depth

    def take(self, form: str):
        size = struct.calcsize("<" + form)
        if self.at + size > self.end:
            raise EvtxError("binary XML ends early")
        got = struct.unpack_from("<" + form, self.data, self.at)
        self.at += size
        return got[0] if len(got) == 1 else got

    def name(self) -> str:
        offset = self.take("I")
        text, size = self.chunk.name(offset)
        if offset == self.at:
            self.at += size
        return text

    def nodes(self) -> list[object]:
        """Elements and values up to the end."""
        root = Element("")
        open_ = [root]
        while self.at < self.end:
            token = self.take("B")
            kind = token & 0x0F
            if token == 0x00:
                break
            if token == 0x0F:
                self.take("BBB")
            elif token == 0x0C:
                open_[-1].children.extend(self.instance())
            elif kind == 0x01:
                self.take("HI")
                e = Element(self.name())
                if token & 0x40:
                    stop = self.take("I") + self.at
                    while self.at < stop:
                        if self.take("B") & 0x0F != 0x06:
                            raise EvtxError("expected an attribute")
                        key = self.name()
                        e.attributes.append((key, self.value()))
                open_[-1].children.append(e)
                open_.append(e)
                if len(open_) > _MAX_DEPTH:
                    raise EvtxError("binary XML is nested too deeply")
            elif kind == 0x02:
                pass
            elif kind in (0x03, 0x04):
                if len(open_) < 2:
                    raise EvtxError("an element ends that was not begun")
                open_.pop()
            else:
                self.at -= 1
                open_[-1].children.append(self.value())
        return root.children

    def value(self) -> object:
        token = self.take("B")
        kind = token & 0x0F
        if kind == 0x05:
            if (t := self.take("B")) != 0x01:
                raise EvtxError(f"unexpected literal type {t}")
            n = self.take("H")
            text = self.data[self.at : self.at + 2 * n].decode("utf-16-le")
            self.at += 2 * n
            return text
        if kind in (0x0D, 0x0E):
            index, _ = self.take("HB")
            return _Slot(index, kind == 0x0E)
        if kind == 0x07:
            n = self.take("H")
            text = self.data[self.at : self.at + 2 * n].decode("utf-16-le")
            self.at += 2 * n
            return text
        if kind == 0x08:
            return chr(self.take("H"))
        if kind == 0x09:
            return {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}.get(self.name(), "")
        raise EvtxError(f"unexpected token {token:#x}")

    def instance(self) -> list[object]:
        """A template with its values filled in."""
        self.take("BI")
        offset = self.take("I")
        nodes, size = self.chunk.template(offset, self.depth)
        if offset == self.at:
            self.at += size
        n = self.take("I")
        if n > CHUNK // 4:
            raise EvtxError("too many template values")
        forms = [self.take("HBB") for _ in range(n)]
        values = []
        for length, type_, _ in forms:
            if self.at + length > self.end:
                raise EvtxError("a template value runs beyond its record")
            values.append(self.decode(type_, self.at, length))
            self.at += length
        return [x for node in nodes for x in _filled(node, values)]

    def decode(self, type_: int, at: int, n: int) -> object:
        raw = self.data[at : at + n]
        if type_ == 0x21:
            return _Nested(_Reader(self.chunk, at, at + n, self.depth + 1).nodes())
        if type_ & 0x80:
            base = type_ & 0x7F
            if base == 0x01:
                return raw.decode("utf-16-le").rstrip("\0").split("\0")
            width = _WIDTH.get(base)
            return [_scalar(base, raw[i : i + width]) for i in range(0, n, width)] if width else raw.hex()
        return _scalar(type_, raw)


@dataclass
class _Nested:
    nodes: list[object]


_WIDTH = {0x03: 1, 0x04: 1, 0x05: 2, 0x06: 2, 0x07: 4, 0x08: 4, 0x09: 8, 0x0A: 8, 0x0B: 4, 0x0C: 8, 0x0D: 4, 0x0F: 16, 0x11: 8, 0x12: 16, 0x14: 4, 0x15: 8}
_FORM = {0x03: "b", 0x04: "B", 0x05: "h", 0x06: "H", 0x07: "i", 0x08: "I", 0x09: "q", 0x0A: "Q", 0x0B: "f", 0x0C: "d"}


def _scalar(type_: int, raw: bytes) -> object:
    """A value of a base type; empty is null."""
    if type_ == 0x00 or not raw and type_ not in (0x01, 0x02):
        return None
    if type_ == 0x01:
        return raw.decode("utf-16-le").rstrip("\0")
    if type_ == 0x02:
        return raw.decode("cp1252").rstrip("\0")
    if type_ in _FORM:
        return struct.unpack("<" + _FORM[type_], raw)[0]
    if type_ == 0x0D:
        return bool(struct.unpack("<I", raw)[0])
    if type_ == 0x0F:
        return str(uuid.UUID(bytes_le=raw)).upper()
    if type_ == 0x10:
        return int.from_bytes(raw, "little")
    if type_ == 0x11:
        # 100 ns since 1601, as seconds since 1970
        return round((int.from_bytes(raw, "little") - 116444736000000000) / 1e7, 6)
    if type_ == 0x12:
        y, mo, _, d, h, mi, s, ms = struct.unpack("<8H", raw)
        return dt.datetime(y, mo, d, h, mi, s, ms * 1000, dt.timezone.utc).timestamp()
    if type_ == 0x13:
        parts = struct.unpack(f"<{raw[1]}I", raw[8 : 8 + 4 * raw[1]])
        return "S-" + "-".join(map(str, (raw[0], int.from_bytes(raw[2:8], "big"), *parts)))
    if type_ in (0x14, 0x15):
        return hex(int.from_bytes(raw, "little"))
    return raw.hex()


def _filled(node: object, values: list[object]) -> list[object]:
    """A template's node with its slots filled; empty optional slots leave nothing."""
    if isinstance(node, _Slot):
        value = values[node.index] if node.index < len(values) else None
        if isinstance(value, _Nested):
            return value.nodes
        return [] if value is None else [value]
    if isinstance(node, Element):
        attributes = []
        for key, v in node.attributes:
            got = _filled(v, values)
            if got:
                attributes.append((key, got[0]))
        return [Element(node.name, attributes, [x for c in node.children for x in _filled(c, values)])]
    return [node]


def _plain(e: Element) -> object:
    """An element as JSON: attributes and children are keys, text beside them is Value."""
    out: dict[str, object] = {k: v for k, v in e.attributes if k != "xmlns"}
    texts = [c for c in e.children if not isinstance(c, Element)]
    elements = [c for c in e.children if isinstance(c, Element)]
    for c in elements:
        named = dict(c.attributes).get("Name") if c.name == "Data" else None
        if named is not None:
            key, value = str(named), _plain(Element(c.name, [a for a in c.attributes if a[0] != "Name"], c.children))
        else:
            key, value = c.name, _plain(c)
        if key in out:
            value = [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
        out[key] = value
    text = None if not texts else texts[0] if len(texts) == 1 else "".join(map(str, texts))
    if not out and not elements and e.name != "EventID":
        return text
    if text is not None and (not elements or str(text).strip()):
        out["Value"] = text
    return out


def _records(chunk: bytes) -> Iterator[Element]:
    first, last = struct.unpack_from("<QQ", chunk, 8)
    if last < first or last - first >= CHUNK // RECORD:
        raise EvtxError("invalid record range")
    shared, at, left = _Chunk(chunk), RECORDS, last - first + 1
    while left and at + RECORD <= len(chunk):
        magic, size, _, _ = struct.unpack_from("<IIQQ", chunk, at)
        if magic != 0x00002A2A or size < RECORD + 4 or at + size > len(chunk):
            raise EvtxError(f"invalid record at {at}")
        nodes = _Reader(shared, at + RECORD, at + size - 4).nodes()
        yield from (n for n in nodes if isinstance(n, Element))
        at, left = at + size, left - 1


def events(content: bytes) -> Iterator[dict]:
    """The Event of each record."""
    if content[:8] != b"ElfFile\0":
        raise EvtxError("not an event log")
    at, number = HEADER, 0
    while at + RECORDS <= len(content):
        chunk = content[at : at + CHUNK]
        at += CHUNK
        if chunk[:8] != b"ElfChnk\0":
            # chunks that were never used are empty
            if chunk.strip(b"\0"):
                raise EvtxError(f"invalid chunk at {at - CHUNK}")
            continue
        try:
            for e in _records(chunk):
                number += 1
                value = _plain(e)
                if e.name != "Event" or not isinstance(value, dict):
                    raise EvtxError(f"record {number} holds no event")
                yield value
        except (struct.error, UnicodeDecodeError, IndexError, OverflowError) as x:
            raise EvtxError(f"chunk at {at - CHUNK}: {x}") from x
