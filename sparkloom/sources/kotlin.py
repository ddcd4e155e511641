"""Function names in the metadata that Kotlin's compiler writes into class files, by its published format.

The annotation's strings hold a byte stream: a table of names (length first), then a message on the
class or the package of a file. Only functions, their JVM names and whether they are inline are read.
"""

from __future__ import annotations

#: Kinds of metadata, field numbers of the messages and the inline bit of a function's flags.
CLASS, FILE, PART = 1, 2, 5
FUNCTIONS = {CLASS: 9, FILE: 3, PART: 3}
OLD_FLAGS, NAME, FLAGS, SIGNATURE, SIGNATURE_NAME = 1, 2, 9, 100, 1
RECORD, RANGE, PREDEFINED, OPERATION, SUBSTRING, REPLACE, STRING = 1, 1, 2, 3, 4, 5, 6
INLINE = 1 << 10


def _bytes(d1: list[str]) -> bytes:
    """The byte stream: one byte a character after a zero mark, else seven bits a character, shifted by one."""
    text = "".join(d1)
    if text[:1] == "\0":
        return text[1:].encode("latin-1")
    out, held, bits = bytearray(), 0, 0
    for c in text.removeprefix("\uffff"):
        held |= ((ord(c) + 0x7F) & 0x7F) << bits
        bits += 7
        if bits >= 8:
            out.append(held & 0xFF)
            held >>= 8
            bits -= 8
    return bytes(out)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes):
    """(number, value) of a message: an int, or the bytes of a nested field."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise ValueError("cut short")
        yield key >> 3, value


def _numbers(value) -> list[int]:
    """A repeated number, packed or by itself."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


class _Names:
    """Names by index: records of the table say how each comes from the annotation's second array."""

    def __init__(self, table: bytes, d2: list[str]):
        self.d2, self.records = d2, []
        for number, value in _fields(table):
            if number == RECORD:
                record: dict = {}
                for n, v in _fields(value):
                    record[n] = record.get(n, []) + _numbers(v) if n in (SUBSTRING, REPLACE) else v
                self.records += [record] * record.get(RANGE, 1)

    def __getitem__(self, i: int) -> str | None:
        r = self.records[i] if i < len(self.records) else {}
        if STRING not in r and PREDEFINED in r:  # a class of the standard library, never a function
            return None
        s = r[STRING].decode() if STRING in r else self.d2[i]
        if len(cut := r.get(SUBSTRING, [])) >= 2 and 0 <= cut[0] <= cut[1] <= len(s):
            s = s[cut[0] : cut[1]]
        if len(swap := r.get(REPLACE, [])) >= 2:
            s = s.replace(chr(swap[0]), chr(swap[1]))
        if r.get(OPERATION) == 2 and len(s) >= 2:
            s = s[1:-1]
        return s.replace("$", ".") if r.get(OPERATION) else s


def functions(kind: int, d1: list[str], d2: list[str]) -> list[tuple[str, bool]] | None:
    """(JVM name, is inline) of the functions of a class or file; None for other kinds and what cannot be read."""
    if kind not in FUNCTIONS or not d1:
        return None
    try:
        data = _bytes(d1)
        size, at = _varint(data, 0)
        names, out = _Names(data[at : at + size], d2), []
        for number, value in _fields(data[at + size :]):
            if number != FUNCTIONS[kind]:
                continue
            f = dict(_fields(value))
            own = dict(_fields(f.get(SIGNATURE, b""))).get(SIGNATURE_NAME, f.get(NAME))
            old = f.get(OLD_FLAGS, 6)
            flags = f.get(FLAGS, (old & 0x3F) | (old >> 8 << 6))
            if own is not None and (name := names[own]) is not None:
                out.append((name, bool(flags & INLINE)))
        return out
    except (IndexError, ValueError, TypeError, AttributeError):
        return None
