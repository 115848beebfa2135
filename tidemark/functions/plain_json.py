"""Plain JSON messages -> flat leaves, a batch of messages at a time.

A message is plain when nothing in it needs a rule of its own: no escapes, no key twice after
``$`` is stripped, no array inside an array, no number whose text depends on floating point.
Whatever is not plain gets NULL and is left to the expressions in ``variant``, which settle every
message; on plain ones both give the same rows.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Longer messages are not plain, so that a batch of them stays small.
PLAIN_BYTES = 16384
_DEPTH = 50
_DIGITS = 30
# Messages whose leaves are held as Python objects at a time.
_CHUNK = 512

# In a nested text: whatever is not printable ASCII, and what is escaped or tells arrays apart.
_ODD = re.compile(r"[^ -~]|[&<>\[{]").search

_LEAF = "struct<key:string,kind:string,text:string>"
_TYPE = f"struct<route:string,items:array<struct<method:string,leaves:array<{_LEAF}>>>>"


class _Whole(str):
    """Text of a number without a fraction."""


class _Fraction(str):
    """Text of a number with a fraction or an exponent."""


def _constant(text: str):
    raise ValueError(text)


_parse = json.JSONDecoder(parse_int=_Whole, parse_float=_Fraction, parse_constant=_constant).decode


def _number(value: _Whole | _Fraction) -> tuple[str, str]:
    """(kind, text) of a number."""
    if len(value) > _DIGITS:
        raise ValueError(value)
    if type(value) is _Whole:
        return "int", "0" if value == "-0" else value
    if "e" in value or "E" in value:
        number = float(value)
        # Beyond these bounds the digits depend on how a double is written.
        if not number or abs(number) >= 1 << 53 or not number.is_integer():
            raise ValueError(value)
        return "int", str(int(number))
    text = value.rstrip("0")
    if text[-1] != ".":
        return "float", text
    return "int", "0" if text in ("0.", "-0.") else text[:-1]


def _bare(key: str) -> str:
    return key[1:] if key[:1] == "$" else key


def _nested_text(value, depth: int) -> str:
    """Canonical text of what stands in an array, keys without ``$`` and in order."""
    if depth > _DEPTH:
        raise ValueError("deep")
    if type(value) is str:
        if _ODD(value):
            raise ValueError(value)
        return f'"{value}"'
    if type(value) is _Whole or type(value) is _Fraction:
        text = _number(value)[1]
        if text.lstrip("-").startswith("0.000000"):
            raise ValueError(value)
        return text
    if type(value) is list:
        if list in map(type, value):
            raise ValueError("array in array")
        return "[" + ",".join([_nested_text(item, depth + 1) for item in value]) + "]"
    if type(value) is dict:
        members = {_bare(key): item for key, item in value.items()}
        if len(members) < len(value):
            raise ValueError("key twice")
        texts = [f"{_nested_text(key, depth)}:{_nested_text(members[key], depth + 1)}" for key in sorted(members)]
        return "{" + ",".join(texts) + "}"
    return "null" if value is None else "true" if value else "false"


def _flatten(members: dict, found: dict, depth: int) -> None:
    if depth > _DEPTH:
        raise ValueError("deep")
    for key, value in members.items():
        if type(value) is dict:
            _flatten(value, found, depth + 1)
            continue
        if key[:1] == "$":
            key = key[1:]
        if key in found:
            raise ValueError(key)
        found[key] = value


class _Rows:
    """Settled messages as flat lists, which make up one Arrow column."""

    def __init__(self, only: str | None = None) -> None:
        self.only = only
        self.routes: list[str | None] = []
        self.items, self.methods, self.ends = [0], [], [0]
        self.keys, self.kinds, self.texts = [], [], []

    def add(self, payload: bytes | None) -> None:
        """A message; None if it is not plain."""
        records, leaves = len(self.methods), len(self.texts)
        try:
            route = None if payload is None or b"\\" in payload else self._settle(_parse(payload.decode()))
        except (ValueError, RecursionError):
            route = None
        if route is None:
            del self.methods[records:], self.ends[records + 1 :]
            del self.keys[leaves:], self.kinds[leaves:], self.texts[leaves:]
        self.routes.append(route)
        self.items.append(len(self.methods))

    def _settle(self, body) -> str | None:
        if type(body) is list:
            if not body or any(item is not None and type(item) is not dict for item in body):
                return None
            if self.only in (None, "event"):
                for item in body:
                    self._record(None, item or {})
            return "event"
        if type(body) is not dict:
            return None
        method = body.get("type")
        if method is not None and type(method) is not str:
            return None
        route = "event" if method == "track" else "profile"
        if self.only in (None, route):
            self._record(None if route == "event" else method, body)
        return route

    def _record(self, method: str | None, members: dict) -> None:
        found: dict = {}
        _flatten(members, found, 0)
        order = sorted(found)
        kinds, texts = self.kinds.append, self.texts.append
        for key in order:
            value = found[key]
            kind = type(value)
            if kind is str:
                kinds("string")
                texts(value)
            elif kind is _Whole or kind is _Fraction:
                name, text = _number(value)
                kinds(name)
                texts(text)
            elif value is None:
                kinds("null")
                texts("")
            elif kind is bool:
                kinds("bool")
                texts("true" if value else "false")
            else:
                kinds("array")
                texts(_nested_text(value, 1))
        self.keys += order
        self.methods.append(method)
        self.ends.append(len(self.texts))

    def column(self) -> pa.StructArray:
        def text(values: list) -> pa.Array:
            return pa.array(values, pa.string())

        leaves = pa.StructArray.from_arrays([text(self.keys), text(self.kinds), text(self.texts)], names=["key", "kind", "text"])
        per_record = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), leaves)
        records = pa.StructArray.from_arrays([text(self.methods), per_record], names=["method", "leaves"])
        per_message = pa.ListArray.from_arrays(pa.array(self.items, pa.int32()), records)
        routes = text(self.routes)
        return pa.StructArray.from_arrays([routes, per_message], names=["route", "items"], mask=routes.is_null())


def _settle_batch(payloads: pa.Array, only: str | None = None) -> pa.Array:
    parts = []
    for start in range(0, max(len(payloads), 1), _CHUNK):
        rows = _Rows(only)
        for payload in payloads[start : start + _CHUNK].cast(pa.binary()).to_pylist():
            rows.add(payload)
        parts.append(rows.column())
    return pa.concat_arrays(parts)


def settled(payload: Column, size: Column, only: str | None = None) -> Column:
    """(route, items) of a plain message, NULL for all others; no items but of the route ``only``."""

    def settle(payloads: pa.Array) -> pa.Array:
        return _settle_batch(payloads, only)

    short = F.when(size <= PLAIN_BYTES, payload)
    return F.arrow_udf(settle, _TYPE)(short)
