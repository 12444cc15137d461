"""Join Parquet files by copying their encoded column chunks and writing one new footer.

Only the footers are decoded (a Thrift struct in compact protocol); pages are copied byte for byte.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from chronofind.errors import SegmentError

# Fixed values of the formats: magic bytes, wire types, field numbers.
MAGIC = b"PAR1"
_TRUE, _FALSE, _BYTE, _I16, _I32, _I64, _DOUBLE, _BINARY, _LIST, _SET, _MAP, _STRUCT = range(1, 13)
_META_SCHEMA, _META_ROWS, _META_GROUPS = 2, 3, 4
_GROUP_COLUMNS, _GROUP_ROWS, _GROUP_OFFSET, _GROUP_SIZE, _GROUP_ORDINAL = 1, 3, 5, 6, 7
_CHUNK_FILE, _CHUNK_OFFSET, _CHUNK_META = 1, 2, 3
_COLUMN_SIZE, _COLUMN_DATA, _COLUMN_INDEX, _COLUMN_DICT, _COLUMN_BLOOM, _COLUMN_BLOOM_SIZE = 7, 9, 10, 11, 14, 15

Struct = dict[int, tuple[int, object]]


class _Reader:
    def __init__(self, buf: bytes, at: int = 0):
        self.buf, self.at = buf, at

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.buf[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        v = self.varint()
        return (v >> 1) ^ -(v & 1)

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.buf):
            raise IndexError("field runs over the end")
        out = self.buf[self.at : self.at + n]
        self.at += n
        return out

    def value(self, kind: int) -> object:
        if kind in (_I16, _I32, _I64):
            return self.zigzag()
        if kind == _BINARY:
            return self.take(self.varint())
        if kind == _STRUCT:
            return self.struct()
        if kind in (_LIST, _SET):
            head = self.take(1)[0]
            n = head >> 4 if head >> 4 < 15 else self.varint()
            inner = head & 15
            return inner, [self.take(1)[0] if inner in (_TRUE, _FALSE) else self.value(inner) for _ in range(n)]
        if kind == _DOUBLE:
            return self.take(8)
        if kind == _BYTE:
            return self.take(1)
        if kind in (_TRUE, _FALSE):
            return None
        raise SegmentError(f"wire type {kind} in a footer")

    def struct(self) -> Struct:
        out: Struct = {}
        number = 0
        while head := self.take(1)[0]:
            number = number + (head >> 4) if head >> 4 else self.zigzag()
            out[number] = (head & 15, self.value(head & 15))
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _value(kind: int, v: object) -> bytes:
    if kind in (_I16, _I32, _I64):
        return _zigzag(v)
    if kind == _BINARY:
        return _varint(len(v)) + v
    if kind == _STRUCT:
        return _struct(v)
    if kind in (_LIST, _SET):
        inner, items = v
        head = bytes([len(items) << 4 | inner]) if len(items) < 15 else bytes([0xF0 | inner]) + _varint(len(items))
        return head + b"".join(bytes([x]) if inner in (_TRUE, _FALSE) else _value(inner, x) for x in items)
    return v or b""


def _struct(fields: Struct) -> bytes:
    out, last = [], 0
    for number in sorted(fields):
        kind, v = fields[number]
        step = number - last
        out.append((bytes([step << 4 | kind]) if 0 < step < 16 else bytes([kind]) + _zigzag(number)) + _value(kind, v))
        last = number
    return b"".join(out) + b"\0"


def read_footer(content: bytes) -> Struct:
    """The footer of a whole Parquet file; SegmentError where it is damaged or encrypted."""
    if len(content) < 12 or content[:4] != MAGIC or content[-4:] != MAGIC:
        raise SegmentError("not a plain Parquet file")
    size = struct.unpack_from("<I", content, len(content) - 8)[0]
    try:
        return _Reader(content, len(content) - 8 - size).struct()
    except (IndexError, TypeError) as e:
        raise SegmentError("damaged footer") from e


def schema_bytes(footer: Struct) -> bytes:
    return _value(*footer[_META_SCHEMA])


def _span(chunk: Struct) -> tuple[int, int]:
    meta = chunk[_CHUNK_META][1]
    starts = [meta[f][1] for f in (_COLUMN_DATA, _COLUMN_INDEX, _COLUMN_DICT) if f in meta and meta[f][1] > 0]
    # A chunk without pages has no place of its own.
    return min(starts, default=4), meta[_COLUMN_SIZE][1]


def _moved(chunk: Struct, by: int) -> Struct:
    """The chunk at its new place; page indexes and Bloom filters, which lie elsewhere, are forgotten."""
    meta = {k: v for k, v in chunk[_CHUNK_META][1].items() if k not in (_COLUMN_BLOOM, _COLUMN_BLOOM_SIZE)}
    for f in (_COLUMN_DATA, _COLUMN_INDEX, _COLUMN_DICT):
        if f in meta and meta[f][1] > 0:
            meta[f] = (meta[f][0], meta[f][1] + by)
    return {_CHUNK_OFFSET: (_I64, 0), _CHUNK_META: (_STRUCT, meta)}


def _past(buf: bytes, at: int, kind: int) -> int:
    """Where the value at `at` ends."""
    if _I16 <= kind <= _I64:
        while buf[at] > 0x7F:
            at += 1
        return at + 1
    if kind == _BINARY:
        n = shift = 0
        while (b := buf[at]) > 0x7F:
            n |= (b & 0x7F) << shift
            shift += 7
            at += 1
        return at + 1 + (n | b << shift)
    if kind == _STRUCT:
        while head := buf[at]:
            at += 1
            if head < 16:
                while buf[at] > 0x7F:
                    at += 1
                at += 1
            if head & 15 > _FALSE:
                at = _past(buf, at, head & 15)
        return at + 1
    if kind in (_LIST, _SET):
        head, at = buf[at], at + 1
        n, inner = head >> 4, head & 15
        if n == 15:
            r = _Reader(buf, at)
            n, at = r.varint(), r.at
        if inner in (_TRUE, _FALSE, _BYTE):
            return at + n
        for _ in range(n):
            at = _past(buf, at, inner)
        return at
    if kind == _DOUBLE:
        return at + 8
    if kind == _BYTE:
        return at + 1
    raise SegmentError(f"wire type {kind} in a footer")


def _number(buf: bytes, at: int) -> int:
    v = shift = 0
    while (b := buf[at]) > 0x7F:
        v |= (b & 0x7F) << shift
        shift += 7
        at += 1
    v |= b << shift
    return (v >> 1) ^ -(v & 1)


def _fields(buf: bytes, at: int) -> tuple[list[tuple[int, int, int]], int]:
    """([(field, kind, place of its value)], end) of the struct at `at`."""
    out, number = [], 0
    while head := buf[at]:
        at += 1
        if head < 16:
            number, at = _number(buf, at), _past(buf, at, _I16)
        else:
            number += head >> 4
        out.append((number, head & 15, at))
        if head & 15 > _FALSE:
            at = _past(buf, at, head & 15)
    return out, at + 1


def _spliced(content: bytes, at: int, put: int, ordinal: int) -> tuple[bytes, bytes, int, int]:
    """(row group struct for its new place, its chunks' bytes, rows, end) of the row group at `at`, in
    which only the offsets are replaced. KeyError where it has more to change than those."""
    fields, end = _fields(content, at)
    cuts: list[tuple[int, bytes]] = []
    data = bytearray()
    rows = -1
    for number, kind, where in fields:
        if number == _GROUP_ROWS:
            rows = _number(content, where)
        elif number == _GROUP_COLUMNS:
            r = _Reader(content, where)
            head = r.take(1)[0]
            n, chunk_at = (r.varint(), r.at) if head >> 4 == 15 else (head >> 4, r.at)
            for _ in range(n):
                chunk, next_at = _fields(content, chunk_at)
                if any(f not in (_CHUNK_OFFSET, _CHUNK_META) for f, _, _ in chunk):
                    raise KeyError
                meta, _ = _fields(content, next(w for f, _, w in chunk if f == _CHUNK_META))
                starts, size = [], 0
                for f, _, w in meta:
                    if f in (_COLUMN_BLOOM, _COLUMN_BLOOM_SIZE):
                        raise KeyError
                    if f == _COLUMN_SIZE:
                        size = _number(content, w)
                    elif f in (_COLUMN_DATA, _COLUMN_INDEX, _COLUMN_DICT) and (v := _number(content, w)) > 0:
                        starts.append((v, w))
                if not starts and size == 0:
                    chunk_at = next_at
                    continue  # a chunk without pages
                start = min(starts)[0]
                if start < 4 or start + size > len(content) - 8:
                    raise SegmentError("a column chunk lies outside of its file")
                cuts += [(w, _zigzag(put + len(data) + v - start)) for v, w in starts]
                data += content[start : start + size]
                chunk_at = next_at
        elif number in (_GROUP_OFFSET, _GROUP_SIZE):
            cuts.append((where, b"o" if number == _GROUP_OFFSET else b"s"))
        elif number == _GROUP_ORDINAL:
            cuts.append((where, _zigzag(min(ordinal, 32_767))))
    out, done = [], at
    for where, new in sorted(cuts):
        out += [content[done:where], _zigzag(put) if new == b"o" else _zigzag(len(data)) if new == b"s" else new]
        done = _past(content, where, _I64)
    return b"".join([*out, content[done:end]]), bytes(data), rows, end


def _decoded(group: Struct, content: bytes, put: int) -> tuple[bytes, bytes, int]:
    """As _spliced, for any row group: page indexes and Bloom filters are left behind."""
    chunks, data = [], bytearray()
    for chunk in group[_GROUP_COLUMNS][1][1]:
        if _CHUNK_FILE in chunk:
            raise SegmentError("a column chunk lies in another file")
        at, size = _span(chunk)
        if at < 4 or at + size > len(content) - 8:
            raise SegmentError("a column chunk lies outside of its file")
        chunks.append(_moved(chunk, put + len(data) - at))
        data += content[at : at + size]
    group = {k: v for k, v in group.items() if k != _GROUP_ORDINAL}
    group |= {_GROUP_COLUMNS: (_LIST, (_STRUCT, chunks)), _GROUP_OFFSET: (_I64, put), _GROUP_SIZE: (_I64, len(data))}
    return _struct(group), bytes(data), group[_GROUP_ROWS][1]


@dataclass
class Joined:
    """each: (blocks, rows) of every source."""

    content: bytes
    blocks: int
    rows: int
    each: list[tuple[int, int]]


def join_files(contents: list[bytes]) -> Joined:
    """One file with all row groups of the given files, in their order.

    All must have the same schema and must not refer to other files. Files without row groups add
    nothing. The numbers of blocks and rows are checked against the sources' footers.
    """
    if not contents:
        raise SegmentError("no files to join")
    first = read_footer(contents[0])
    wanted = schema_bytes(first)
    # Files of one writer begin their footers alike, up to the end of the schema.
    lead = _struct({k: v for k, v in first.items() if k <= _META_SCHEMA})[:-1]
    out, groups, rows, each = bytearray(MAGIC), [], 0, []
    for content in contents:
        if len(content) < 12 or content[:4] != MAGIC or content[-4:] != MAGIC:
            raise SegmentError("not a plain Parquet file")
        at = len(content) - 8 - struct.unpack_from("<I", content, len(content) - 8)[0]
        seen = declared = 0
        try:
            if at < 4 or not content.startswith(lead, at):
                raise KeyError
            # The next two fields are the number of rows and the row groups.
            at += len(lead)
            if content[at] != 1 << 4 | _I64:
                raise KeyError
            declared = _number(content, at + 1)
            at = _past(content, at + 1, _I64)
            if content[at] != 1 << 4 | _LIST:
                raise KeyError
            r = _Reader(content, at + 1)
            head = r.take(1)[0]
            n, at = (r.varint(), r.at) if head >> 4 == 15 else (head >> 4, r.at)
            added = []
            put = len(out)
            for _ in range(n):
                group, data, count, at = _spliced(content, at, put, len(groups) + len(added))
                added.append((group, data, count))
                put += len(data)
        except (KeyError, IndexError, ValueError):
            footer = read_footer(content)
            if schema_bytes(footer) != wanted:
                raise SegmentError("schemas differ") from None
            declared, put, added = footer[_META_ROWS][1], len(out), []
            for decoded in footer[_META_GROUPS][1][1]:
                added.append(_decoded(decoded, content, put))
                put += len(added[-1][1])
        for group, data, count in added:
            groups.append(group)
            out += data
            seen += count
        if seen != declared:
            raise SegmentError("row groups and footer disagree on the number of rows")
        rows += seen
        each.append((len(added), seen))
    head = bytes([len(groups) << 4 | _STRUCT]) if len(groups) < 15 else bytes([0xF0 | _STRUCT]) + _varint(len(groups))
    # Field numbers are written as steps, so the fields behind the row groups are numbered from there.
    rest = _struct({k - _META_GROUPS: v for k, v in first.items() if k > _META_GROUPS})
    end = lead + bytes([1 << 4 | _I64]) + _zigzag(rows) + bytes([1 << 4 | _LIST]) + head + b"".join(groups) + rest
    return Joined(bytes(out) + end + struct.pack("<I", len(end)) + MAGIC, len(groups), rows, each)
