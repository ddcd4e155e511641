"""JVM class files, read once by their published format into plain records.

`parse` gives rows of one wide shape (FACT) for one class file; `sparkloom.sources.bytecode` spreads
them over Spark. Names are dotted. Of debug tables, source file, lines and the names of parameters are read.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from functools import lru_cache

from sparkloom.sources import kotlin

#: The columns of a row. `record` says which are filled:
#: class (name: super class, value: source file, names: interfaces), field, method (line: first line),
#: call (owner, name: callee), use (owner, name, desc; value: kind of usage), text (value: constant),
#: note (name: annotation; params; member null for the class), ref (owner: referenced type),
#: kotlin (name: class or file; names: JVM names of the functions its metadata lists), inline (member: a function),
#: site (owner, name, desc: what an instruction touches; value: CALL, REFERENCE, READ or WRITE; line; access: the member's),
#: param (desc: the method's; name; line: its place), local (desc: the method's; name: a parameter; value: READ or WRITE; line).
FACT = "record string, path string, class string, member string, desc string, owner string, name string, value string, line int, access int, names array<string>, params map<string,string>"
COLUMNS = [c.split()[0] for c in FACT.split(", ")]

ACC_STATIC, ACC_BRIDGE, ACC_INTERFACE, ACC_ABSTRACT, ACC_SYNTHETIC = 0x8, 0x40, 0x200, 0x400, 0x1000
#: Not a flag of the format: set here for classes that carry a Record attribute.
ACC_RECORD = 0x10000

NEWEST = 69  # major version of the format that is known here
#: Fixed value: the annotation that holds Kotlin's metadata.
METADATA = "Lkotlin/Metadata;"
_METADATA_BYTES = METADATA.encode()
#: Every kind of record.
RECORDS = ("class", "field", "method", "call", "use", "text", "note", "ref", "kotlin", "inline", "site", "param", "local", "error")


class BadClassFile(ValueError):
    """A file that is no class file, is cut short, or is newer than the format known here."""


def dotted(internal: str) -> str:
    return internal.replace("/", ".")


_OBJECT = re.compile(r"L([^;]+);")


def types_in(desc: str) -> list[str]:
    """Object types of a field or method descriptor, array elements included."""
    return [dotted(t) for t in _OBJECT.findall(desc)]


def _operands() -> list[int]:
    """Bytes of operands by opcode; -1 where they vary."""
    size = [0] * 256
    for first, last, n in (
        # fixed values of the JVM specification: first opcode, last opcode, operand bytes
        (0x10, 0x10, 1), (0x11, 0x11, 2), (0x12, 0x12, 1), (0x13, 0x14, 2), (0x15, 0x19, 1), (0x36, 0x3A, 1),
        (0x84, 0x84, 2), (0x99, 0xA8, 2), (0xA9, 0xA9, 1), (0xAA, 0xAB, -1), (0xB2, 0xB8, 2), (0xB9, 0xBA, 4),
        (0xBB, 0xBB, 2), (0xBC, 0xBC, 1), (0xBD, 0xBD, 2), (0xC0, 0xC1, 2), (0xC4, 0xC4, -1), (0xC5, 0xC5, 3),
        (0xC6, 0xC7, 2), (0xC8, 0xC9, 4),
    ):
        size[first : last + 1] = [n] * (last + 1 - first)
    return size


OPERANDS = _operands()
LDC, LDC_W, TABLESWITCH, GETSTATIC, PUTFIELD, INVOKEVIRTUAL, INVOKEINTERFACE, INVOKEDYNAMIC, WIDE, IINC = 0x12, 0x13, 0xAA, 0xB2, 0xB5, 0xB6, 0xB9, 0xBA, 0xC4, 0x84
#: Instructions on a type, and how a usage names them.
TYPE_OPS = {0xBB: "new", 0xBD: "newarray", 0xC0: "checkcast", 0xC1: "instanceof"}


def instructions(code: bytes):
    """(opcode, operand, place) of every instruction but switches: the constant's index, the local's slot, else 0."""
    at, n = 0, len(code)
    while at < n:
        op = code[at]
        size = OPERANDS[op]
        if size == -1:
            if op == WIDE:
                yield code[at + 1], code[at + 2] << 8 | code[at + 3], at
                at += 6 if code[at + 1] == IINC else 4
                continue
            else:
                base = at + 4 - at % 4
                if op == TABLESWITCH:
                    low, high = struct.unpack_from(">ii", code, base + 4)
                    end = base + 12 + 4 * (high - low + 1)
                else:
                    end = base + 8 + 8 * struct.unpack_from(">i", code, base + 4)[0]
                at = end
                continue
        if size == 1 or op == IINC:
            yield op, code[at + 1], at
        elif size:
            yield op, code[at + 1] << 8 | code[at + 2], at
        else:
            yield op, 0, at
        at += size + 1


def local_use(op: int, operand: int) -> tuple[int, str] | None:
    """(slot, READ or WRITE) of an instruction on a local variable."""
    if 0x15 <= op <= 0x19:
        return operand, "READ"
    if 0x1A <= op <= 0x2D:
        return (op - 0x1A) % 4, "READ"
    if 0x36 <= op <= 0x3A or op == IINC:
        return operand, "WRITE"
    if 0x3B <= op <= 0x4E:
        return (op - 0x3B) % 4, "WRITE"
    return None


def parameter_slots(desc: str, static: bool) -> dict[int, int]:
    """Place of each parameter by its first slot."""
    slot, out = 0 if static else 1, {}
    for place, t in enumerate(re.findall(r"\[*(?:L[^;]+;|[A-Z])", desc[1:].split(")")[0])):
        out[slot] = place
        slot += 2 if t in ("J", "D") else 1
    return out


def _utf8(raw: bytes) -> str:
    """The format's own UTF-8: two bytes for NUL, surrogate pairs as three bytes each."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


#: Bytes of a constant by its tag, the tag included; 0 where there is no such tag. Text (1) has its own length.
CONSTANT_SIZE = [0] * 256
for _size, *_tags in ((5, 3, 4, 9, 10, 11, 12, 17, 18), (9, 5, 6), (3, 7, 8, 16, 19, 20), (4, 15)):
    for _tag in _tags:
        CONSTANT_SIZE[_tag] = _size


class _Reader:
    """A class file's constants, found in one pass and read when asked for, and a position in the file."""

    def __init__(self, data: bytes, newest: int, check: bool = True):
        self.data, self.at = data, 0
        if data[:4] != b"\xca\xfe\xba\xbe":
            raise BadClassFile("no class file")
        self.at = 6
        major = self.u2()
        if major > newest:
            raise BadClassFile(f"class file version {major} (Java {major - 44})")
        self._constants(check)

    def u1(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def u2(self) -> int:
        at = self.at
        self.at = at + 2
        return self.data[at] << 8 | self.data[at + 1]

    def u4(self) -> int:
        self.at += 4
        return struct.unpack_from(">I", self.data, self.at - 4)[0]

    def take(self, n: int) -> bytes:
        self.skip(n)
        return self.data[self.at - n : self.at]

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > len(self.data):
            raise BadClassFile("cut short")

    def _constants(self, check: bool) -> None:
        data, count, at = self.data, self.u2(), self.at
        places, i = [0] * count, 1
        while i < count:
            tag = data[at]
            places[i] = at
            if tag == 1:
                at += 3 + (data[at + 1] << 8 | data[at + 2])
            else:
                size = CONSTANT_SIZE[tag]
                if not size:
                    raise BadClassFile(f"constant tag {tag}")
                at += size
                if size == 9:
                    i += 1
            i += 1
        if at > len(data):
            raise BadClassFile("cut short")
        self.at, self.places = at, places
        self.known: list = [None] * count
        self.members: dict[int, tuple[str, str, str]] = {}
        if check and not data[10:at].isascii():
            for i, place in enumerate(places):
                if place and data[place] == 1:
                    self.constant(i)

    def constant(self, i: int) -> tuple:
        """(tag, value): text, a number, or the places of other constants."""
        found = self.known[i]
        if found is None:
            data, at = self.data, self.places[i]
            tag = data[at]
            if not at:
                raise IndexError(f"no constant {i}")
            if tag == 1:
                try:
                    value = _utf8(data[at + 3 : at + 3 + (data[at + 1] << 8 | data[at + 2])])
                except UnicodeError as e:
                    raise BadClassFile(f"damaged: {e}") from e
            elif tag in (7, 8, 16, 19, 20):
                value = data[at + 1] << 8 | data[at + 2]
            elif tag == 15:
                value = (data[at + 1], data[at + 2] << 8 | data[at + 3])
            elif tag in (3, 4, 5, 6):
                value = struct.unpack_from({3: ">i", 4: ">f", 5: ">q", 6: ">d"}[tag], data, at + 1)[0]
            else:
                value = (data[at + 1] << 8 | data[at + 2], data[at + 3] << 8 | data[at + 4])
            found = self.known[i] = (tag, value)
        return found

    def text(self, i: int) -> str:
        return (self.known[i] or self.constant(i))[1]

    def class_name(self, i: int) -> str | None:
        return self.text(self.constant(i)[1]) if i else None

    def member(self, i: int) -> tuple[str, str, str]:
        """(internal owner, name, descriptor) of a field, method or interface method."""
        found = self.members.get(i)
        if found is None:
            owner, nt = self.constant(i)[1]
            found = self.members[i] = (self.class_name(owner), *self.name_and_type(nt))
        return found

    def name_and_type(self, i: int) -> tuple[str, str]:
        a, b = self.constant(i)[1]
        return self.text(a), self.text(b)

    def attributes(self):
        """(name, start, end) of a table of attributes; the position ends after it."""
        data, known, at, found = self.data, self.known, self.at + 2, []
        for _ in range(data[at - 2] << 8 | data[at - 1]):
            i = data[at] << 8 | data[at + 1]
            start = at + 6
            at = start + (data[at + 2] << 24 | data[at + 3] << 16 | data[at + 4] << 8 | data[at + 5])
            found.append(((known[i] or self.constant(i))[1], start, at))
        self.at = at
        self.skip(0)
        return found

    def pass_members(self) -> None:
        """Past a table of fields or methods."""
        data, at = self.data, self.at + 2
        for _ in range(data[at - 2] << 8 | data[at - 1]):
            at += 8
            for _ in range(data[at - 2] << 8 | data[at - 1]):
                at += 6 + (data[at + 2] << 24 | data[at + 3] << 16 | data[at + 4] << 8 | data[at + 5])
        self.at = at
        self.skip(0)

    # annotations

    def element(self, nested: list | None = None) -> str:
        """An element value as text; annotations of an array are also put into nested."""
        tag = chr(self.u1())
        if tag == "e":
            kind, name = self.text(self.u2()), self.text(self.u2())
            return f"{_simple(kind)}.{name}"
        if tag == "c":
            return _simple(self.text(self.u2()))
        if tag == "@":
            kind, params = self.annotation()[:2]
            if nested is not None:
                nested.append((kind, params))
            inner = ", ".join(f"{k}={v}" for k, v in params.items())
            return f"@{_simple(kind)}" + (f"({inner})" if inner else "")
        if tag == "[":
            parts = [self.element(nested) for _ in range(self.u2())]
            return parts[0] if len(parts) == 1 else "[" + ", ".join(parts) + "]"
        value = self.constant(self.u2())[1]
        if tag == "Z":
            return "true" if value else "false"
        if tag == "C":
            return chr(value)
        return str(value)

    def annotation(self) -> tuple[str, dict, list]:
        """(descriptor, parameters, annotations in the array `value`)."""
        kind, params, nested = self.text(self.u2()), {}, []
        for _ in range(self.u2()):
            name = self.text(self.u2())
            params[name] = self.element(nested if name == "value" and self.data[self.at] == ord("[") else None)
        return kind, params, nested

    def annotations(self, found) -> list[tuple[str, dict]]:
        """(dotted type, parameters); a container of repeated annotations is replaced by what it holds."""
        out, back = [], self.at
        for name, start, _ in found:
            if name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
                self.at = start
                for _ in range(self.u2()):
                    kind, params, nested = self.annotation()
                    kinds = {k for k, _ in nested}
                    repeated = list(params) == ["value"] and len(kinds) == 1 and _simple(min(kinds)).lower() in _simple(kind).lower()
                    out += [(dotted(k[1:-1]), p) for k, p in (nested if repeated else [(kind, params)])]
        self.at = back
        return out

    def plain(self):
        """An element value as it is: a list, a constant, or text for the other kinds."""
        tag = chr(self.data[self.at])
        if tag in "ec@":
            return self.element()
        self.at += 1
        return [self.plain() for _ in range(self.u2())] if tag == "[" else self.constant(self.u2())[1]

    def metadata(self, found) -> dict:
        """Parameters of the Kotlin metadata among a class's annotations, as they are."""
        values, back = {}, self.at
        for name, start, _ in found:
            if name == "RuntimeVisibleAnnotations":
                self.at = start
                for _ in range(self.u2()):
                    if self.text(self.u2()) == METADATA:
                        values = {self.text(self.u2()): self.plain() for _ in range(self.u2())}
                    else:
                        self.at -= 2
                        self.annotation()
        self.at = back
        return values


_PRIMITIVES = dict(zip("VZCBSIFJD", ("void", "boolean", "char", "byte", "short", "int", "float", "long", "double"), strict=True))


def _simple(desc: str) -> str:
    """A type as it is shown: the last part of its name, with [] for arrays."""
    base = desc.lstrip("[")
    name = _PRIMITIVES.get(base) or dotted(base[1:-1]).rsplit(".", 1)[-1]
    return name + "[]" * (len(desc) - len(base))


def shown_types(desc: str) -> tuple[list[str], str]:
    """(arguments, result) of a method descriptor as they are shown."""
    args, result = desc[1:].split(")")
    return [_simple(t) for t in re.findall(r"\[*(?:L[^;]+;|[A-Z])", args)], _simple(result)


def shown_type(desc: str) -> str:
    return _simple(desc)


def _bootstraps(r: _Reader, found) -> list[list[int]]:
    """Argument constants of each bootstrap method."""
    back, out = r.at, []
    for name, start, _ in found:
        if name == "BootstrapMethods":
            r.at = start
            for _ in range(r.u2()):
                r.u2()
                out.append([r.u2() for _ in range(r.u2())])
    r.at = back
    return out


#: Records that instructions make.
_IN_CODE = frozenset(("call", "use", "text", "ref", "site", "local"))


def parse(data: bytes, path: str = "", newest: int = NEWEST) -> list[dict]:
    """The rows of one class file; BadClassFile where it cannot be read."""
    return [dict(zip(COLUMNS, r, strict=True)) for r in rows(data, path, newest)]


def rows(data: bytes, path: str = "", newest: int = NEWEST, wanted: frozenset[str] | None = None) -> list[tuple]:
    """The rows of one class file in the order of COLUMNS, of the wanted records only if there are any.

    Without `wanted`, and where `error` is among them, the whole file is read; else what makes no wanted record is stepped
    over, and damage in there is not seen.
    """
    ask = _ask(wanted)
    try:
        return _parse(_Reader(data, newest, ask.whole), path, ask)
    except (IndexError, struct.error, TypeError, KeyError, AttributeError) as e:
        raise BadClassFile(f"damaged: {e}") from e


@lru_cache(100_000)
def _internal_types(desc: str) -> tuple[str, ...]:
    return tuple(_OBJECT.findall(desc))


@lru_cache(10_000)
def _slots(desc: str, static: bool) -> dict[int, int]:
    return parameter_slots(desc, static)


class _Ask:
    """What to read of a file for the wanted records."""

    def __init__(self, wanted: frozenset[str] | None):
        self.wants = {record: wanted is None or record in wanted for record in RECORDS}
        self.whole = self.wants["error"]
        asked = lambda *records: any(self.wants[x] for x in records)
        self.in_code = self.whole or asked(*_IN_CODE)
        self.bodies = self.in_code or asked("method", "param")
        self.lines = self.whole or asked("method", "param", "local", "site")
        self.only_text = self.in_code and not self.whole and not asked(*(_IN_CODE - {"text"}))
        self.notes, self.kotlin = self.whole or self.wants["note"], self.whole or asked("kotlin", "inline")
        self.members = self.bodies or self.notes or asked("field")
        self.only_class = wanted == {"class"}


@lru_cache(1000)
def _ask(wanted: frozenset[str] | None) -> _Ask:
    return _Ask(wanted)


def _parse(r: _Reader, path: str, ask: _Ask) -> list[tuple]:
    wants, in_code, bodies, notes = ask.wants, ask.in_code, ask.bodies, ask.notes
    access, own, parent = r.u2(), r.class_name(r.u2()), r.class_name(r.u2())
    faces = [r.class_name(r.u2()) for _ in range(r.u2())]
    members = []  # (is a method, access, name, descriptor, attributes)
    for method in (False, True):
        if not ask.members:
            r.pass_members()
            continue
        for _ in range(r.u2()):
            members.append((method, r.u2(), r.text(r.u2()), r.text(r.u2()), r.attributes()))
    attributes = r.attributes()
    source = None
    for name, start, _ in attributes:
        if name == "SourceFile":
            r.at = start
            source = r.text(r.u2())
        elif name == "Record":
            access |= ACC_RECORD
    cls, out, seen = dotted(own), [], set()
    if wants["class"]:
        out.append(("class", path, cls, None, None, None, parent and dotted(parent), source, None, access, [dotted(f) for f in faces], None))
        if ask.only_class:
            return out
    refs, calls, uses, sites, locals_, texts = (wants[x] for x in ("ref", "call", "use", "site", "local", "text"))
    boots = _bootstraps(r, attributes) if in_code else []

    def row(record, member=None, desc=None, owner=None, name=None, value=None, line=None, access=None, names=None, params=None) -> None:
        if wants[record]:
            out.append((record, path, cls, member, desc, owner, name, value, line, access, names, params))

    def refer(*internal: str | None) -> None:
        for t in internal:
            if t and t not in seen and not t.startswith("["):
                seen.add(t)
                out.append(("ref", path, cls, None, None, dotted(t), None, None, None, None, None, None))

    def refer_all(desc: str) -> None:
        for t in _internal_types(desc):
            if t not in seen:
                seen.add(t)
                out.append(("ref", path, cls, None, None, dotted(t), None, None, None, None, None, None))

    def use(member: str, owner: str, name: str, desc: str, kind: str) -> None:
        if (key := ("use", member, owner, name, desc, kind)) not in seen:
            seen.add(key)
            out.append(("use", path, cls, member, desc, dotted(owner), name, kind, None, None, None, None))

    def call(member: str, owner: str, name: str) -> None:
        if (key := ("call", member, owner, name)) not in seen:
            seen.add(key)
            out.append(("call", path, cls, member, None, dotted(owner), name, None, None, None, None, None))

    def note(found, member: str | None = None, desc: str | None = None) -> None:
        if notes and found:
            for name, params in r.annotations(found):
                row("note", member, desc, None, name, params=params)

    def body(name: str, start: int, flags: int, own_desc: str) -> int | None:
        """Records of a method's code; its first line."""
        data, at = r.data, start + 8
        r.at = end = at + (data[start + 4] << 24 | data[start + 5] << 16 | data[start + 6] << 8 | data[start + 7])
        r.skip(0)
        code = data[at:end]
        if ask.only_text and b"\x12" not in code and b"\x13" not in code:
            return None
        lines, variables = [], []
        if ask.lines:
            r.skip(8 * r.u2())  # exception table
        for what, at, _ in r.attributes() if ask.lines else ():
            if what == "LineNumberTable":
                n = r.data[at] << 8 | r.data[at + 1]
                flat = struct.unpack_from(f">{2 * n}H", r.data, at + 2)
                lines += zip(flat[::2], flat[1::2], strict=True)
            elif what == "LocalVariableTable":
                back, r.at = r.at, at
                variables += [(r.u2(), r.u2(), r.text(r.u2()), r.u2(), r.u2()) for _ in range(r.u2())]
                r.at = back
        if len(lines) > 1:
            lines.sort()
        first = lines[0][1] if lines else None
        named = {}
        if variables:
            places = _slots(own_desc, bool(flags & ACC_STATIC))
            named = {slot: (n, size) for first, size, n, _, slot in variables if first == 0 and slot in places}
            for slot, (n, _) in sorted(named.items()):
                row("param", name, own_desc, None, n, line=places[slot])
        if not in_code:
            return first
        starts = [at for at, _ in lines]

        def line_of(at: int) -> int | None:
            k = bisect_right(starts, at)
            return lines[k - 1][1] if k else None

        def touch(at: int, owner: str, n: str, d: str, called: str | None, used: str, kind: str) -> None:
            """What an instruction on a member of owner makes; called: null where it is no call."""
            if calls and called is not None:
                call(name, owner, called)
            if uses:
                use(name, owner, n, d, used)
            if sites:
                line = line_of(at)
                if (key := ("site", name, own_desc, owner, n, d, kind, line)) not in seen:
                    seen.add(key)
                    out.append(("site", path, cls, name, d, dotted(owner), n, kind, line, flags, None, None))
            if refs:
                refer(owner)
                refer_all(d)

        for op, i, at in instructions(code):
            if INVOKEVIRTUAL <= op <= INVOKEINTERFACE:
                owner, n, d = r.member(i)
                touch(at, owner, n, d, n, "METHOD_CALL", "CALL")
            elif GETSTATIC <= op <= PUTFIELD:
                owner, n, d = r.member(i)
                touch(at, owner, n, d, f"<field:{n}>" if owner != own else None, "FIELD_ACCESS", "READ" if op % 2 == 0 else "WRITE")
            elif op in (LDC, LDC_W):
                tag, value = r.constant(i)
                if tag == 8:
                    value = r.text(value)
                    if texts:
                        row("text", name, value=value)
                elif tag == 7:
                    t = r.text(value)
                    if t.startswith("["):
                        if refs:
                            refer_all(t)
                    else:
                        if refs:
                            refer(t)
                        if calls and t != own:
                            call(name, t, "<class-literal>")
            elif op == INVOKEDYNAMIC:
                boot, nt = r.constant(i)[1]
                made = r.name_and_type(nt)[1]
                if refs:
                    refer_all(made)
                for arg in boots[boot]:
                    if r.constant(arg)[0] == 15:
                        owner, n, d = r.member(r.constant(arg)[1][1])
                        touch(at, owner, n, d, n, "METHOD_CALL", "REFERENCE")
            elif op in TYPE_OPS:
                t = r.class_name(i)
                if uses:
                    use(name, t, TYPE_OPS[op], "", "TYPE_REFERENCE")
                if refs:
                    refer(t)
            elif locals_ and named and (touched := local_use(op, i)):
                n, size = named.get(touched[0], (None, 0))
                if n is not None and at < size:
                    line = line_of(at)
                    if (key := ("local", name, own_desc, n, touched[1], line)) not in seen:
                        seen.add(key)
                        row("local", name, own_desc, None, n, touched[1], line)
        return first

    note(attributes)
    if ask.kotlin and _METADATA_BYTES in r.data and (data := r.metadata(attributes)):
        known = kotlin.functions(data.get("k", 1), data.get("d1", []), data.get("d2", []))
        if known is not None:
            row("kotlin", name="class" if data.get("k", 1) == kotlin.CLASS else "file", names=[n for n, _ in known])
            for n in dict.fromkeys(n for n, inline in known if inline):
                row("inline", n)
    if refs:
        refer(parent, *faces)
    for method, flags, name, desc, found in members:
        if refs:
            refer_all(desc)
        line = None
        for what, start, _ in found:
            if what == "Code":
                line = body(name, start, flags, desc) if bodies else None
            elif what == "Exceptions" and in_code:
                r.at = start
                thrown = [r.class_name(r.u2()) for _ in range(r.u2())]
                if refs:
                    refer(*thrown)
        record = "method" if method else "field"
        if wants[record]:
            out.append((record, path, cls, name, desc, None, None, None, line, flags, None, None))
        if notes:
            note(found, name, desc)
    return out
