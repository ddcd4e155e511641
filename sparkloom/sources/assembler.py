"""Class files and JARs written by their published format: constants interned, jumps by label, attributes laid out.

The counterpart of classfile.py, for facts that are to be read as class files (the test tables, the tests).
Names are internal (slashes). Code carries no stack maps, so its classes are for readers, not for running.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Hashable, Iterable
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.sources.classfile import CONSTANT_SIZE, parameter_slots

#: Fixed values of the JVM specification: tags of constants.
UTF8, INT, CLASS, STRING, FIELD, METHOD, FACE_METHOD, NAME_TYPE, HANDLE, METHOD_TYPE, DYNAMIC = 1, 3, 7, 8, 9, 10, 11, 12, 15, 16, 18
#: Fixed values of the JVM specification: opcodes by the names that `code` takes.
CALLS = {"virtual": 0xB6, "special": 0xB7, "static": 0xB8, "interface": 0xB9}
FIELDS = {"getstatic": 0xB2, "putstatic": 0xB3, "getfield": 0xB4, "putfield": 0xB5}
TYPES = {"new": 0xBB, "newarray": 0xBD, "checkcast": 0xC0, "instanceof": 0xC1}
LDC, LDC_W, SWITCH, INVOKEDYNAMIC, RETURN, NOP, LOAD, STORE = 0x12, 0x13, 0xAA, 0xBA, 0xB1, 0x00, 0x19, 0x3A
INVOKE_STATIC_HANDLE, INVOKE_VIRTUAL_HANDLE = 6, 5
FACTORY = ("java/lang/invoke/LambdaMetafactory", "metafactory", "(Ljava/lang/invoke/MethodHandles$Lookup;Ljava/lang/String;)Ljava/lang/invoke/CallSite;")
PUBLIC, STATIC, SUPER, BRIDGE, INTERFACE, ABSTRACT, SYNTHETIC = 0x1, 0x8, 0x20, 0x40, 0x200, 0x400, 0x1000


def _u2(*n: int) -> bytes:
    if len(n) == 1:
        return n[0].to_bytes(2, "big")
    return b"".join([x.to_bytes(2, "big") for x in n])


class Enum(tuple):
    """An enum constant in an annotation: (descriptor, name)."""


class Type(str):
    """A class in an annotation, by descriptor."""


class Note(tuple):
    """An annotation: (descriptor, parameters)."""


class ClassFile:
    """One class; `bytes` gives the file."""

    def __init__(self, name: str, access: int = PUBLIC | SUPER, parent: str = "java/lang/Object", faces: Iterable[str] = (), source: str | None = None, notes: Iterable[Note] = (), record: bool = False, major: int = 61):
        self.pool: dict[tuple, int] = {}
        self.names: dict[str, int] = {}
        self.constants: list[bytes] = []
        self.boots: list[bytes] = []
        self.access, self.major = access, major
        self.head = _u2(self.type(name), self.type(parent)), [self.type(f) for f in faces]
        self.members: tuple[list[bytes], list[bytes]] = ([], [])
        self.attributes = [self._attribute("SourceFile", _u2(self.utf8(source)))] if source is not None else []
        self.attributes += self._notes(notes)
        if record:
            self.attributes.append(self._attribute("Record", _u2(0)))

    # constants: each once, by tag and body

    def _constant(self, tag: int, body: bytes) -> int:
        key = (tag, body)
        if key not in self.pool:
            self.constants.append(bytes([tag]) + body)
            self.pool[key] = len(self.constants)
            if len(self.constants) > 0xFFFE:
                raise ValueError("too many constants for one class")
        return self.pool[key]

    def utf8(self, s: str) -> int:
        if s not in self.names:
            body = s.encode() if s.isascii() and "\0" not in s else self._modified(s)
            self.names[s] = self._constant(UTF8, _u2(len(body)) + body)
        return self.names[s]

    @staticmethod
    def _modified(s: str) -> bytes:
        """The format's own UTF-8: NUL as two bytes, each half of a surrogate pair by itself."""
        raw = s.encode("utf-16-be", "surrogatepass")
        units = struct.unpack(f">{len(raw) // 2}H", raw)
        return b"".join(b"\xc0\x80" if u == 0 else chr(u).encode("utf-8", "surrogatepass") for u in units)

    def type(self, name: str) -> int:
        return self._constant(CLASS, _u2(self.utf8(name)))

    def text(self, s: str) -> int:
        return self._constant(STRING, _u2(self.utf8(s)))

    def member(self, tag: int, owner: str, name: str, desc: str) -> int:
        return self._constant(tag, _u2(self.type(owner), self._named(name, desc)))

    def _named(self, name: str, desc: str) -> int:
        return self._constant(NAME_TYPE, _u2(self.utf8(name), self.utf8(desc)))

    def _handle(self, kind: int, owner: str, name: str, desc: str) -> int:
        return self._constant(HANDLE, bytes([kind]) + _u2(self.member(METHOD, owner, name, desc)))

    # attributes

    def _attribute(self, name: str, body: bytes) -> bytes:
        return _u2(self.utf8(name)) + struct.pack(">I", len(body)) + body

    def _element(self, v) -> bytes:
        if isinstance(v, Note):
            return b"@" + self._note(v)
        if isinstance(v, Enum):
            return b"e" + _u2(self.utf8(v[0]), self.utf8(v[1]))
        if isinstance(v, Type):
            return b"c" + _u2(self.utf8(v))
        if isinstance(v, list):
            return b"[" + _u2(len(v)) + b"".join(map(self._element, v))
        if isinstance(v, str):
            return b"s" + _u2(self.utf8(v))
        tag = b"Z" if isinstance(v, bool) else b"I"
        return tag + _u2(self._constant(INT, struct.pack(">i", v)))

    def _note(self, note: Note) -> bytes:
        kind, params = note
        return _u2(self.utf8(kind), len(params)) + b"".join(_u2(self.utf8(k)) + self._element(v) for k, v in params.items())

    def _notes(self, notes: Iterable[Note]) -> list[bytes]:
        notes = list(notes)
        return [self._attribute("RuntimeVisibleAnnotations", _u2(len(notes)) + b"".join(map(self._note, notes)))] if notes else []

    # members

    def field(self, name: str, desc: str, access: int = PUBLIC, notes: Iterable[Note] = ()) -> None:
        self._member(0, access, name, desc, self._notes(notes))

    def method(self, name: str, desc: str, code: Iterable[tuple] | None = None, access: int = PUBLIC, throws: Iterable[str] = (), notes: Iterable[Note] = (), params: Iterable[str] = ()) -> None:
        """params: names of the parameters, kept with the code for debuggers."""
        variables = [] if code is None else list(zip(params, parameter_slots(desc, bool(access & STATIC)), re.findall(r"\[*(?:L[^;]+;|[A-Z])", desc), strict=False))
        attributes = [] if code is None else [self._attribute("Code", self._code(list(code), variables))]
        if throws := list(throws):
            attributes.append(self._attribute("Exceptions", _u2(len(throws), *map(self.type, throws))))
        self._member(1, access, name, desc, attributes + self._notes(notes))

    def _member(self, kind: int, access: int, name: str, desc: str, attributes: list[bytes]) -> None:
        self.members[kind].append(_u2(access, self.utf8(name), self.utf8(desc), len(attributes)) + b"".join(attributes))

    def _code(self, items: list[tuple], variables: list[tuple[str, int, str]] = ()) -> bytes:
        """Items: (call kind, owner, name, desc), (field access, owner, name, desc), (type instruction, type), ("text", s),
        ("classof", type), ("lambda", name, desc, owner, method, method's desc), ("line", n), ("label", l),
        ("jump", opcode, l), ("switch", low, labels, default), ("load", slot), ("store", slot) and ("op", opcode)."""
        labels: dict = {}
        jumps = any(what in ("jump", "switch") for what, *_ in items)
        for _ in range(2 if jumps else 1):  # the first round places the labels, the second knows them
            out, lines = bytearray(), []
            for what, *args in items:
                at = len(out)
                if what == "line":
                    lines.append((at, args[0]))
                elif what == "label":
                    labels[args[0]] = at
                elif what in CALLS:
                    face = what == "interface"
                    out += bytes([CALLS[what]]) + _u2(self.member(FACE_METHOD if face else METHOD, *args)) + (b"\1\0" if face else b"")
                elif what in FIELDS:
                    out += bytes([FIELDS[what]]) + _u2(self.member(FIELD, *args))
                elif what in TYPES:
                    out += bytes([TYPES[what]]) + _u2(self.type(args[0]))
                elif what in ("text", "classof"):
                    i = self.text(args[0]) if what == "text" else self.type(args[0])
                    out += bytes([LDC, i]) if i < 256 else bytes([LDC_W]) + _u2(i)
                elif what == "lambda":
                    out += bytes([INVOKEDYNAMIC]) + _u2(self._dynamic(*args), 0)
                elif what == "jump":
                    out += bytes([args[0]]) + struct.pack(">h", labels.get(args[1], at) - at)
                elif what == "switch":
                    low, cases, default = args
                    out += bytes([SWITCH]) + bytes(3 - at % 4)
                    out += struct.pack(">iii", labels.get(default, at) - at, low, low + len(cases) - 1)
                    out += b"".join(struct.pack(">i", labels.get(c, at) - at) for c in cases)
                elif what in ("load", "store"):
                    out += bytes([LOAD if what == "load" else STORE, args[0]])
                elif what == "op":
                    out.append(args[0])
                else:
                    raise ValueError(f"unknown item {what}")
            out.append(RETURN)
        tables = [self._attribute("LineNumberTable", _u2(len(lines), *(n for pair in lines for n in pair)))] if lines else []
        if variables:
            rows = (_u2(0, len(out), self.utf8(n), self.utf8(d), slot) for n, slot, d in variables)
            tables.append(self._attribute("LocalVariableTable", _u2(len(variables)) + b"".join(rows)))
        return _u2(4, 4) + struct.pack(">I", len(out)) + bytes(out) + _u2(0, len(tables)) + b"".join(tables)

    def _dynamic(self, name: str, desc: str, owner: str, method: str, method_desc: str) -> int:
        kind = INVOKE_VIRTUAL_HANDLE
        boot = _u2(self._handle(INVOKE_STATIC_HANDLE, *FACTORY), 2, self._handle(kind, owner, method, method_desc), self._constant(METHOD_TYPE, _u2(self.utf8(method_desc))))
        if boot not in self.boots:
            self.boots.append(boot)
        return self._constant(DYNAMIC, _u2(self.boots.index(boot), self._named(name, desc)))

    def bytes(self) -> bytes:
        attributes = list(self.attributes)
        if self.boots:
            attributes.append(self._attribute("BootstrapMethods", _u2(len(self.boots)) + b"".join(self.boots)))
        names, faces = self.head
        body = _u2(self.access) + names + _u2(len(faces), *faces)
        for part in self.members:
            body += _u2(len(part)) + b"".join(part)
        body += _u2(len(attributes)) + b"".join(attributes)
        return b"\xca\xfe\xba\xbe" + _u2(0, self.major, len(self.constants) + 1) + b"".join(self.constants) + body


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, value) -> bytes:
    """A field of a message: a number, or bytes with their length."""
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def kotlin_metadata(functions: Iterable[tuple[str, bool]], file: bool = False) -> Note:
    """Metadata of a Kotlin class or file that lists (name, is inline) of its functions."""
    names, body = [], b""
    for name, inline in functions:
        # fixed values of the format: fields of a function (name, flags), its inline bit, functions of a file and of a class
        body += _message(3 if file else 9, _message(2, len(names)) + _message(9, 6 | (1 << 10 if inline else 0)))
        names.append(name)
    table = _message(1, _message(1, max(1, len(names))))
    data = _varint(len(table)) + table + body
    return Note(("Lkotlin/Metadata;", {"k": 2 if file else 1, "d1": ["\0" + data.decode("latin-1")], "d2": names}))


_MARK = re.compile(rb"<<mark(\d+)>>")
#: Line numbers that marks of two bytes can stand for.
MOST_LINES = 24


@lru_cache(100_000)
def _counted(s: str) -> bytes:
    body = s.encode() if s.isascii() and "\0" not in s else ClassFile._modified(s)
    return len(body).to_bytes(2, "big") + body


def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch of n, one stretch after the other."""
    end = np.cumsum(n)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - n), n)


def starts(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)])


@dataclass
class Rows:
    """What many files are filled with. Texts, lines and ints lie flat, row after row; `text_at` are places in `texts`, which may be shared."""

    keys: list[Hashable]
    texts: pa.Array
    text_at: np.ndarray
    n_texts: np.ndarray
    lines: np.ndarray
    n_lines: np.ndarray
    ints: np.ndarray
    n_ints: np.ndarray

    @staticmethod
    def of(rows: Iterable[tuple]) -> Rows:
        """From (key, texts, lines, ints) of each row."""
        keys, *columns = zip(*rows, strict=True)
        texts, lines, ints = ([x for row in c for x in row] for c in columns)
        counts = [np.array([len(row) for row in c], np.int64) for c in columns]
        return Rows(list(keys), pa.array(texts, pa.string()), np.arange(len(texts)), counts[0], np.array(lines, np.int64), counts[1], np.array(ints, np.int64), counts[2])

    def __iter__(self):
        texts = self.texts.to_pylist()
        at = [starts(n).tolist() for n in (self.n_texts, self.n_lines, self.n_ints)]
        for i, key in enumerate(self.keys):
            own = [slice(a[i], a[i + 1]) for a in at]
            yield key, [texts[j] for j in self.text_at[own[0]]], self.lines[own[1]].tolist(), self.ints[own[2]].tolist()

    def plain(self) -> bool:
        """Whether all fits the fields of the format, and the pieces of all rows one array."""
        fits = lambda a, low, high: not len(a) or (a.min() >= low and a.max() < high)
        whole = not self.texts.null_count and self.texts.nbytes < 1 << 26 and len(self.text_at) < 1 << 24
        return whole and fits(self.lines, 0, 1 << 16) and fits(self.ints, -(1 << 31), 1 << 31)


#: Numbers of two bytes as the format writes them.
_TWO = pa.array([n.to_bytes(2, "big") for n in range(1 << 16)], pa.binary())
#: Kinds of pieces that a form consists of.
FIXED, LENGTH, BODY, LINE, NUMBER, MADE = range(6)


def _bodies(texts: pa.Array) -> pa.Array:
    """Texts in the format's own UTF-8."""
    texts = pa.concat_arrays([texts.cast(pa.string())])  # without an offset
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if not len(raw) or (raw.max() < 128 and raw.min() > 0):
        return texts.cast(pa.binary())
    return pa.array([_counted(t)[2:] for t in texts.to_pylist()], pa.binary())


class Forms:
    """Class files that differ in texts and numbers only: a form is laid out once and filled in for each further file.

    `make(key, texts, lines, ints)` gives a file's bytes; key says all that its layout depends on. Texts that happen to be equal stay
    separate constants in a form, which the format allows. A key that occurs once is made directly by `file`; `files` lays it out.
    """

    def __init__(self, make: Callable[[Hashable, list[str], list[int], list[int]], bytes], most: int = 40_000):
        self.make, self.most = make, most
        self.forms: dict[Hashable, tuple | bool | None] = {}
        self.placed: dict[Hashable, int] = {}
        self.pieces: dict[bytes, int] = {}
        self.new_codes: list[np.ndarray] = []
        self.fixed, self.start, self.n_pieces, self.codes = pa.array([], pa.binary()), np.zeros(1, np.int64), np.zeros(0, np.int64), np.empty((3, 0), np.int32)

    def file(self, key: Hashable, texts: list[str], lines: list[int], ints: list[int]) -> bytes:
        if key not in self.forms:
            if len(self.forms) < self.most:
                self.forms[key] = None
            return self.make(key, texts, lines, ints)
        form = self.forms[key]
        if form is None:
            form = self.forms[key] = self._lay_out(key, len(texts), len(lines), len(ints))
        if form is False:
            return self.make(key, texts, lines, ints)
        fixed, places, wrapped = form
        parts = [*map(_counted, texts)]
        parts += [n.to_bytes(2, "big") for n in lines]
        parts += [n.to_bytes(4, "big", signed=True) for n in ints]
        for before, i, after in wrapped:
            body = before + parts[i][2:] + after
            parts.append(len(body).to_bytes(2, "big") + body)
        out = fixed.copy()
        out[1::2] = map(parts.__getitem__, places)
        return b"".join(out)

    def files(self, rows: Rows) -> pa.Array:
        """The bytes of each row's file: the pieces of all are taken from one array and joined by row."""
        if not rows.plain():
            return pa.array([self.make(*row) for row in rows], pa.binary())
        bodies = _bodies(rows.texts)
        size = pc.binary_length(bodies).to_numpy()
        if len(size) and size.max() > 0xFF00:  # a wrapped text must fit too
            return pa.array([self.make(*row) for row in rows], pa.binary())
        text, line, number = (starts(n) for n in (rows.n_texts, rows.n_lines, rows.n_ints))
        form = np.empty(len(rows.keys), np.int64)
        odd: list[tuple[int, Hashable]] = []
        for i, key in enumerate(rows.keys):
            known = self.placed.get(key)
            if known is None:
                known = self._place(key, int(rows.n_texts[i]), int(rows.n_lines[i]), int(rows.n_ints[i]))
            form[i] = known
            if known < 0:
                odd.append((i, key))
        made = []
        if odd:
            texts = rows.texts.to_pylist()
            for i, key in odd:
                made.append(self.make(key, [texts[j] for j in rows.text_at[text[i] : text[i + 1]]], rows.lines[line[i] : line[i + 1]].tolist(), rows.ints[number[i] : number[i + 1]].tolist()))
        self._settle()
        fixed, start, n_pieces, codes = self.fixed, self.start, self.n_pieces, self.codes
        known = form >= 0
        n = np.ones(len(form), np.int64)
        n[known] = n_pieces[form[known]]
        at = ragged(start[form[known]], n[known])
        kind, ref, add = (np.full(int(n.sum()), x, np.int64) for x in (MADE, 0, 0))
        row = np.repeat(np.arange(len(form)), n)
        inside = known[row]
        kind[inside], ref[inside], add[inside] = codes[:, at]
        base = starts([len(fixed), len(_TWO), len(bodies), len(rows.ints), len(made)])
        of = lambda k: np.flatnonzero(kind == k)
        for what, first in ((LENGTH, text), (BODY, text), (LINE, line), (NUMBER, number)):
            i = of(what)
            ref[i] += first[row[i]]
            if what in (LENGTH, BODY):
                ref[i] = rows.text_at[ref[i]]
            if what == LENGTH:
                ref[i] = size[ref[i]] + add[i]
            elif what == LINE:
                ref[i] = rows.lines[ref[i]]
        i = of(MADE)
        ref[i] = np.arange(len(i))
        ref += np.array([0, base[1], base[2], base[1], base[3], base[4]])[kind]
        wide = np.frombuffer(rows.ints.astype(">i4").tobytes(), np.uint8)
        ints = pa.Array.from_buffers(pa.binary(), len(rows.ints), [None, pa.py_buffer(np.arange(0, 4 * len(rows.ints) + 1, 4, dtype=np.int32)), pa.py_buffer(wide)])
        pool = pa.concat_arrays([fixed, _TWO, bodies, ints, pa.array(made, pa.binary())])
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts(n), pa.int32()), pool.take(pa.array(ref))), b"")

    def _place(self, key: Hashable, texts: int, lines: int, ints: int) -> int:
        """The number of a form among `codes`, as rows of kind, reference and what is added to a length; -1: to be made directly."""
        if len(self.placed) >= self.most:
            return -1
        form = self._lay_out(key, texts, lines, ints)
        if form is False:
            self.placed[key] = -1
            return -1
        out: list[tuple[int, int, int]] = []

        def fix(piece: bytes) -> None:
            if piece:
                out.append((FIXED, self.pieces.setdefault(piece, len(self.pieces)), 0))

        fixed, places, wrapped = form
        for piece, place in zip(fixed[::2], [*places, None], strict=True):
            fix(piece)
            if place is None:
                continue
            if place < texts:
                out += [(LENGTH, place, 0), (BODY, place, 0)]
            elif place < texts + lines:
                out.append((LINE, place - texts, 0))
            elif place < texts + lines + ints:
                out.append((NUMBER, place - texts - lines, 0))
            else:
                before, i, after = wrapped[place - texts - lines - ints]
                out.append((LENGTH, i, len(before) + len(after)))
                fix(before)
                out.append((BODY, i, 0))
                fix(after)
        self.new_codes.append(np.array(out, np.int32).T)
        self.placed[key] = len(self.n_pieces) + len(self.new_codes) - 1
        return self.placed[key]

    def _settle(self) -> None:
        """New forms are put behind those known."""
        if self.new_codes:
            new = list(islice(reversed(self.pieces), len(self.pieces) - len(self.fixed)))[::-1]
            self.fixed = pa.concat_arrays([self.fixed, pa.array(new, pa.binary())])
            self.n_pieces = np.concatenate([self.n_pieces, [c.shape[1] for c in self.new_codes]])
            self.start = starts(self.n_pieces)
            self.codes = np.concatenate([self.codes, *self.new_codes], axis=1)
            self.new_codes = []

    def _lay_out(self, key: Hashable, texts: int, lines: int, ints: int) -> tuple | bool:
        """Bytes as they are with a gap after each but the last, what goes into each gap (a place among texts, lines, ints and the following), and
        (before, place, after) of constants that are more than a text; False if the marks cannot be told apart."""
        if lines > MOST_LINES:
            return False
        u2 = [0xE801 + 257 * i for i in range(lines)]
        u4 = [0x5EAD0001 + 65537 * i for i in range(ints)]
        data = self.make(key, [f"<<mark{i}>>" for i in range(texts)], u2, u4)
        form, wrapped, at, last = [], [], 10, 0
        for _ in range(int.from_bytes(data[8:10], "big") - 1):
            tag, body = data[at], data[at + 3 : at + 3 + int.from_bytes(data[at + 1 : at + 3], "big")]
            if tag == UTF8 and (marks := list(_MARK.finditer(body))):
                if len(marks) > 1:
                    return False
                before, place, after = body[: marks[0].start()], int(marks[0][1]), body[marks[0].end() :]
                if before or after:
                    wrapped.append((before, place, after))
                    place = texts + lines + ints + len(wrapped) - 1
                form += [data[last : at + 1], place]
                last = at + 3 + len(body)
            elif tag == INT and (n := int.from_bytes(data[at + 1 : at + 5], "big")) in u4:
                form += [data[last : at + 1], texts + lines + u4.index(n)]
                last = at + 5
            at += 3 + len(body) if tag == UTF8 else CONSTANT_SIZE[tag]
        places = sorted((data.find(n.to_bytes(2, "big"), at), i) for i, n in enumerate(u2))
        for place, i in places:
            mark = u2[i].to_bytes(2, "big")
            if place >= 0:
                if data.find(mark, place + 1) >= 0:
                    return False
                form += [data[last:place], texts + i]
                last = place + 2
        fixed = [*form, data[last:]]
        return fixed, fixed[1::2], wrapped


def jar(entries: Iterable[tuple[str, bytes]], packed: bool = True) -> bytes:
    """A JAR of (name, content), with the same bytes for the same entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
        for name, content in entries:
            z.writestr(zipfile.ZipInfo(name), content, compress_type=zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()
