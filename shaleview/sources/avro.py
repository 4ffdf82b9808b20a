"""Avro object container files, read without a library: one table cell a non-null field of a record."""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

Schema = dict | list | str


def _long(b: io.BytesIO) -> int:
    """A zig-zag number of variable length."""
    n = shift = 0
    while True:
        c = b.read(1)
        if not c:
            raise EOFError("avro data ends within a number")
        n |= (c[0] & 0x7F) << shift
        if c[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _bytes(b: io.BytesIO) -> bytes:
    n = _long(b)
    out = b.read(n)
    if len(out) < n:
        raise EOFError("avro data ends within a value")
    return out


def _items(b: io.BytesIO) -> Iterator[None]:
    """Once for each item of an array or map, which come in counted blocks."""
    while n := _long(b):
        if n < 0:
            n = -n
            _long(b)
        for _ in range(n):
            yield


def _value(b: io.BytesIO, schema: Schema, names: dict[str, Schema]):
    if isinstance(schema, list):
        return _value(b, schema[_long(b)], names)
    if isinstance(schema, dict):
        kind = schema["type"]
        if kind in ("record", "enum", "fixed"):
            names[schema["name"]] = schema
            names[f"{schema.get('namespace', '')}.{schema['name']}"] = schema
        if kind == "record":
            return {f["name"]: _value(b, f["type"], names) for f in schema["fields"]}
        if kind == "enum":
            return schema["symbols"][_long(b)]
        if kind == "fixed":
            return b.read(schema["size"])
        if kind == "array":
            return [_value(b, schema["items"], names) for _ in _items(b)]
        if kind == "map":
            return {_bytes(b).decode(): _value(b, schema["values"], names) for _ in _items(b)}
        return _value(b, kind, names)
    match schema:
        case "null":
            return None
        case "boolean":
            return b.read(1) == b"\1"
        case "int" | "long":
            return _long(b)
        case "float":
            return struct.unpack("<f", b.read(4))[0]
        case "double":
            return struct.unpack("<d", b.read(8))[0]
        case "bytes":
            return _bytes(b)
        case "string":
            return _bytes(b).decode()
    return _value(b, names[schema], names)


def records(data: bytes) -> Iterator[tuple[int, dict]]:
    """(number of the block, record) of a container file with codec null, deflate or zstandard."""
    b = io.BytesIO(data)
    if b.read(4) != b"Obj\1":
        raise ValueError("no avro container")
    meta = {}
    for _ in _items(b):
        key = _bytes(b).decode()
        meta[key] = _bytes(b)
    sync, schema, names = b.read(16), json.loads(meta["avro.schema"]), {}
    codec = meta.get("avro.codec", b"null").decode()
    block = 0
    while b.tell() < len(data):
        n, body = _long(b), _bytes(b)
        if codec == "deflate":
            body = zlib.decompress(body, -15)
        elif codec == "zstandard":
            import zstandard

            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        elif codec != "null":
            raise ValueError(f"avro codec {codec}")
        if b.read(16) != sync:
            raise ValueError("avro block without its mark")
        part = io.BytesIO(body)
        for _ in range(n):
            yield block, _value(part, schema, names)
        block += 1


def cells(data: bytes) -> Iterator[tuple[str, int, int, int, str]]:
    """(text, block, row, column, field) of every non-null, non-blank field; nested values are JSON."""
    for row, (block, record) in enumerate(records(data)):
        fields = record if isinstance(record, dict) else {"value": record}
        for column, (name, v) in enumerate(fields.items()):
            if isinstance(v, (dict, list)):
                v = json.dumps(v, default=lambda x: x.hex() if isinstance(x, bytes) else str(x))
            text = "" if v is None else v.hex() if isinstance(v, bytes) else str(v).strip()
            if text:
                yield text, block, row, column, name
