"""Many class files read at once with numpy: each step is taken in all files of a batch, one constant, member, attribute or instruction a step.

It reads what is common. A file in which anything else turns up (damage, text that is not ASCII, nested annotations, wide
instructions, tables of local variables, ...) is marked as odd and left to classfile.py, which alone decides what is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sparkloom.sources import classfile as C
from sparkloom.sources.assembler import ragged, starts

ARROW = pa.schema(
    [(c, pa.string()) for c in C.COLUMNS[:8]] + [("line", pa.int32()), ("access", pa.int32()), ("names", pa.list_(pa.string())), ("params", pa.map_(pa.string(), pa.string()))]
)
#: Constants, members or bytes of code of files that are read here: longer ones would keep a whole batch waiting.
MOST = 4096
#: Records that can be made here; where another one is wanted, files are read one by one.
HERE = frozenset(C.RECORDS) - {"ref"}
_OPERANDS = np.array(C.OPERANDS)
#: Bytes of a constant by its tag, for text without what it says, and more than any file has where there is no such tag.
_SIZE = np.array([3 if tag == 1 else size or 1 << 40 for tag, size in enumerate(C.CONSTANT_SIZE)])
_SLOTS = np.where(_SIZE == 9, 2, 1)
_TEXT, _CLASS, _STRING, _NAME_TYPE, _HANDLE, _DYNAMIC = 1, 7, 8, 12, 15, 18
_METHOD_CALL, _FIELD_ACCESS, _TYPE_REFERENCE = range(3)
_USED = pa.array(["METHOD_CALL", "FIELD_ACCESS", "TYPE_REFERENCE"])
_TOUCHED = pa.array(["CALL", "REFERENCE", "READ", "WRITE"])
#: What a type instruction is called, by its place here.
_TYPE_OPS = np.array(sorted(C.TYPE_OPS))
_ON_TYPE = np.isin(np.arange(256), _TYPE_OPS)
_OP_NAMES = pa.array([C.TYPE_OPS[op] for op in sorted(C.TYPE_OPS)])


def dotted(names: pa.Array) -> pa.Array:
    valid, offsets, data = names.buffers()
    if data is None or not len(names):
        return names
    raw = np.frombuffer(data, np.uint8)
    return pa.Array.from_buffers(names.type, len(names), [valid, offsets, pa.py_buffer(np.where(raw == ord("/"), np.uint8(ord(".")), raw))], names.null_count, names.offset)


def _ids(names: pa.Array) -> np.ndarray:
    return names.dictionary_encode().indices.to_numpy()


def _first(columns: list[np.ndarray]) -> np.ndarray:
    """Places of the rows that differ in a column from all rows before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        most = int(c.max()) + 1
        if size * most >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * most + c, size * most
    return np.sort(np.unique(key, return_index=True)[1])


def _every(start: np.ndarray, n: np.ndarray, step: int) -> np.ndarray:
    """start, start + step, ... of each stretch of n."""
    return np.repeat(start, n) + step * ragged(np.zeros(len(n), np.int64), n)


class Files:
    """The files of a batch; `odd` marks those that are to be read one by one."""

    def __init__(self, content: pa.Array, newest: int = C.NEWEST):
        content = content if isinstance(content, pa.BinaryArray) else content.cast(pa.binary())
        ends = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + len(content) + 1].astype(np.int64)
        raw = np.frombuffer(content.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        self.raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.two = self.raw.astype(np.uint16) << 8
        self.two[:-1] |= self.raw[1:]
        self.start, self.end = ends[:-1] - ends[0], ends[1:] - ends[0]
        self.n = len(content)
        self.odd = self.end - self.start < 24
        self.at = self.start.copy()
        self._look(newest)
        self._constants()

    def u2(self, at: np.ndarray) -> np.ndarray:
        return self.two[at].astype(np.int64)

    def u4(self, at: np.ndarray) -> np.ndarray:
        return self.u2(at) << 16 | self.u2(at + 2)

    def i4(self, at: np.ndarray) -> np.ndarray:
        return (self.u4(at) ^ 0x80000000) - 0x80000000

    def reject(self, file: np.ndarray, bad: np.ndarray) -> None:
        self.odd[file[bad]] = True

    def inside(self, file: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Places that are cut at the file's end, where the file becomes odd."""
        self.reject(file, at > self.end[file])
        return np.minimum(at, self.end[file])

    def _look(self, newest: int) -> None:
        some = np.flatnonzero(~self.odd)
        at = self.start[some]
        self.odd[some] = (self.u4(at) != 0xCAFEBABE) | (self.u2(at + 6) > newest)

    def _constants(self) -> None:
        self.count = self.u2(np.minimum(self.start + 8, len(self.raw) - 16))
        self.odd |= self.count > MOST
        self.count[self.odd] = 0
        self.first = starts(self.count)[:-1]
        self.places = np.zeros(int(self.count.sum()), np.int64)
        file = np.flatnonzero(~self.odd)
        at, end = self.at[file] + 10, self.end[file]
        slot, last = self.first[file] + 1, (self.first + self.count)[file]
        while True:
            more = slot < last
            if not more.all():
                self.at[file[~more]] = at[~more]
                file, at, end, slot, last = (x[more] for x in (file, at, end, slot, last))
            if not len(file):
                break
            tag = self.raw[at]
            self.places[slot] = at
            at = at + _SIZE[tag] + np.where(tag == _TEXT, self.two[at + 1], 0)
            slot = slot + _SLOTS[tag]
            over = at > end  # no such tag, or cut short
            if over.any():
                self.odd[file[over]] = True
                file, at, end, slot, last = (x[~over] for x in (file, at, end, slot, last))
        # texts as stretches of the files, with what is between them
        where = np.flatnonzero((self.places > 0) & (self.raw[self.places] == _TEXT) & ~np.repeat(self.odd, self.count))
        self.text_no = np.full(len(self.places), -1, np.int64)
        self.text_no[where] = np.arange(len(where))
        self.text_at = self.places[where] + 3
        self.text_size = self.u2(self.places[where] + 1)
        bounds = np.empty(2 * len(where) + 1, np.int32)
        bounds[:-1:2], bounds[1::2], bounds[-1] = self.text_at, self.text_at + self.text_size, len(self.raw)
        self.texts = pa.Array.from_buffers(pa.string(), 2 * len(where), [None, pa.py_buffer(bounds), pa.py_buffer(self.raw)])
        high = np.flatnonzero(self.raw >= 128)
        if len(where) and len(high):
            j = np.searchsorted(self.text_at, high, "right") - 1
            hit = (j >= 0) & (high < (self.text_at + self.text_size)[j])
            self.odd[np.searchsorted(self.start, high[hit], "right") - 1] = True

    # constants; what is not as expected makes the file odd and gives any other constant

    def place(self, file: np.ndarray, i: np.ndarray, *tags: int) -> np.ndarray:
        fine = (i > 0) & (i < self.count[file])
        at = np.where(fine, self.places[np.where(fine, self.first[file] + i, 0)], 0) if len(self.places) else np.zeros(len(i), np.int64)
        among = np.zeros(256, bool)
        among[list(tags)] = True
        fine &= (at > 0) & among[self.raw[at]]
        self.reject(file, ~fine)
        return np.where(fine, at, 0)

    def text(self, file: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The text's number."""
        fine = (i > 0) & (i < self.count[file])
        no = np.where(fine, self.text_no[np.where(fine, self.first[file] + i, 0)], -1) if len(self.places) else np.full(len(i), -1)
        self.reject(file, no < 0)
        return np.maximum(no, 0)

    def class_name(self, file: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.text(file, self.u2(self.place(file, i, _CLASS) + 1))

    def named(self, file: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.place(file, i, _NAME_TYPE)
        return self.text(file, self.u2(at + 1)), self.text(file, self.u2(at + 3))

    def member(self, file: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = self.place(file, i, 9, 10, 11)
        return self.class_name(file, self.u2(at + 1)), *self.named(file, self.u2(at + 3))

    def is_text(self, no: np.ndarray, word: bytes) -> np.ndarray:
        if not len(self.text_at):
            return np.zeros(len(no), bool)
        hit = self.text_size[no] == len(word)
        some = np.flatnonzero(hit)
        at = self.text_at[no[some]]
        hit[some] = (self.raw[at[:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(axis=1)
        return hit

    def take(self, no: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
        return self.texts.take(pa.array(2 * no, mask=null))

    # structure

    def attributes(self, file: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """((place in file of the table it is of, name, start, end) of each attribute, where each table ends)."""
        of, after, out = np.arange(len(file)), at + 2, []
        left = self.u2(at)
        at = after.copy()
        while True:
            more = (left > 0) & ~self.odd[file[of]]
            after[of[~more]] = at[~more]
            of, at, left = of[more], at[more], left[more]
            if not len(of):
                break
            at = self.inside(file[of], at + 6)
            begin = at
            at = self.inside(file[of], at + self.u4(at - 4))
            out.append((of, self.text(file[of], self.u2(begin - 6)), begin, at))
            left = left - 1
        found = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        order = np.argsort(found[0], kind="stable")
        return tuple(c[order] for c in found), after

    def read(self) -> None:
        """Heads, members and attributes."""
        self.fine = np.flatnonzero(~self.odd)
        file, at = self.fine, self.at[self.fine]
        at = self.inside(file, at + 8)
        self.access, own, above, n = (self.u2(at - k) for k in (8, 6, 4, 2))
        self.own = self.class_name(file, own)
        self.no_parent = above == 0
        self.parent = self.class_name(file, np.where(self.no_parent, own, above))
        self.faces_at, self.n_faces = at, n
        at = self.inside(file, at + 2 * n)
        members, attributes, total = [], [], 0
        for method in (False, True):
            left, row = self.u2(at), np.arange(len(file))
            self.reject(file, left > MOST)
            at = self.inside(file, at + 2)
            while True:
                more = (left[row] > 0) & ~self.odd[file[row]]
                row = row[more]
                if not len(row):
                    break
                here = self.inside(file[row], at[row] + 6)
                flags, name, desc = (self.u2(here - k) for k in (6, 4, 2))
                found, at[row] = self.attributes(file[row], np.minimum(here, self.end[file[row]]))
                members.append((row, np.full(len(row), method), flags, self.text(file[row], name), self.text(file[row], desc), np.arange(total, total + len(row))))
                attributes.append((found[0] + total, *found[1:]))
                total += len(row)
                left[row] -= 1
        at = self.inside(file, at + 2) - 2
        self.attribute, _ = self.attributes(file, at)
        empty = [np.zeros(0, np.int64)]
        row, method, flags, name, desc, number = (np.concatenate(c) for c in zip(*members, strict=True)) if members else empty * 6
        order = np.argsort(row, kind="stable")
        self.m_row, self.m_method, self.m_access, self.m_name, self.m_desc = row[order], method[order].astype(bool), flags[order], name[order], desc[order]
        new = np.empty(len(order), np.int64)
        new[number[order]] = np.arange(len(order))
        found = [np.concatenate(c) for c in zip(*attributes, strict=True)] if attributes else empty * 4
        self.m_attribute = (new[found[0]], *found[1:]) if len(order) else found

    def bodies(self, variables: bool) -> None:
        """Code and lines of methods. variables: files with tables of local variables become odd."""
        of, name, start, _ = self.m_attribute
        code = self.is_text(name, b"Code")
        of, start = of[code], start[code]
        file = self.fine[self.m_row[of]]
        self.reject(file, (np.bincount(of, minlength=len(self.m_row))[of] > 1) | ~self.m_method[of])
        at = self.inside(file, start + 8)
        self.reject(file, self.u4(at - 4) > MOST)
        self.c_member, self.c_at = of, at
        at = self.c_end = self.inside(file, at + self.u4(at - 4))
        at = self.inside(file, at + 2)
        at = self.inside(file, at + 8 * self.u2(at - 2) + 2) - 2
        (which, name, start, _), _ = self.attributes(file, at)
        if variables and len(which):
            self.reject(file[which], self.is_text(name, b"LocalVariableTable"))
        lines = self.is_text(name, b"LineNumberTable")
        which, start = which[lines], start[lines]
        n = self.u2(start)
        self.reject(file[which], start + 2 + 4 * n > self.end[file[which]])
        n = np.where(self.odd[file[which]], 0, n)
        entry, at = np.repeat(which, n), _every(start + 2, n, 4)
        pc_, line = self.u2(at), self.u2(at + 2)
        order = np.lexsort((line, pc_, entry))
        self.l_code, self.l_pc, self.l_line = entry[order], pc_[order], line[order]
        # the first line of each member
        self.m_line = np.full(len(self.m_row), -1)
        least = np.flatnonzero(np.diff(self.l_code, prepend=-1))
        self.m_line[self.c_member[self.l_code[least]]] = self.l_line[least]

    def line_of(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The line of an instruction, -1 where there is none."""
        k = np.searchsorted(self.l_code << 33 | self.l_pc, code << 33 | at, "right") - 1
        if not len(self.l_code):
            return np.full(len(code), -1)
        return np.where((k >= 0) & (self.l_code[k] == code), self.l_line[k], -1)

    def instructions(self) -> tuple[np.ndarray, ...]:
        """(code, opcode, operand, place in the code) of instructions on constants."""
        code, out = np.flatnonzero(self.c_end > self.c_at), []
        at, file = self.c_at[code], self.fine[self.m_row[self.c_member]]
        while len(code):
            op = self.raw[at]
            size = _OPERANDS[op].astype(np.int64)
            self.reject(file[code], op == C.WIDE)
            end = at + size + 1
            switch = np.flatnonzero((size < 0) & (op != C.WIDE))
            if len(switch):
                s = at[switch] - self.c_at[code[switch]]
                base = at[switch] + 4 - s % 4
                self.reject(file[code[switch]], base + 12 > self.c_end[code[switch]])
                base = np.minimum(base, len(self.raw) - 16)
                table = op[switch] == C.TABLESWITCH
                n = np.where(table, self.i4(base + 8) - self.i4(base + 4) + 1, self.i4(base + 4))
                self.reject(file[code[switch]], n < 0)
                end[switch] = base + np.where(table, 12 + 4 * n, 8 + 8 * n)
            self.reject(file[code], end > self.c_end[code])
            on = np.flatnonzero(((op >= C.GETSTATIC) & (op <= C.INVOKEDYNAMIC)) | (op == C.LDC) | (op == C.LDC_W) | _ON_TYPE[op])
            if len(on):
                operand = np.where(op[on] == C.LDC, self.raw[at[on] + 1], self.u2(at[on] + 1))
                out.append((code[on], op[on].astype(np.int64), operand, at[on] - self.c_at[code[on]]))
            more = (end < self.c_end[code]) & ~self.odd[file[code]]
            code, at = code[more], end[more]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4

    def handles(self, row: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in i, constant of the member) of the handles among the arguments of dynamic calls."""
        of, name, start, _ = self.attribute
        table = self.is_text(name, b"BootstrapMethods")
        of, at = of[table], start[table] + 2
        self.reject(self.fine[of], np.bincount(of, minlength=len(self.fine))[of] > 1)
        left, out = self.u2(at - 2), []
        number = np.zeros(len(of), np.int64)
        while True:
            more = (left > number) & ~self.odd[self.fine[of]]
            of, at, left, number = of[more], at[more], left[more], number[more]
            if not len(of):
                break
            at = self.inside(self.fine[of], at + 4)
            n, begin = self.u2(at - 2), at
            at = self.inside(self.fine[of], at + 2 * n)
            out.append((of << 16 | number, begin, n))
            number = number + 1
        key, begin, n = (np.concatenate(c) for c in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
        order = np.argsort(key)
        key, begin, n = key[order], begin[order], n[order]
        file = self.fine[row]
        asked = row << 16 | self.u2(self.place(file, i, _DYNAMIC) + 1)
        k = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        known = key[k] == asked if len(key) else np.zeros(len(asked), bool)
        self.reject(file, ~known)
        use = np.flatnonzero(known & ~self.odd[file])
        k = k[use]
        which = np.repeat(use, n[k])
        argument = self.place(file[which], self.u2(_every(begin[k], n[k], 2)), *range(3, 21))
        hit = self.raw[argument] == _HANDLE
        return which[hit], self.u2(argument[hit] + 2)

    def notes(self) -> tuple[np.ndarray, ...]:
        """(row, kind's text, note number) of each annotation of a class; its parameters are kept as p_note, p_name, p_kind, p_value.

        Files with annotations of members are odd."""
        holds = lambda name: self.is_text(name, b"RuntimeVisibleAnnotations") | self.is_text(name, b"RuntimeInvisibleAnnotations")
        self.reject(self.fine[self.m_row[self.m_attribute[0]]], holds(self.m_attribute[1]))
        of, name, start, _ = self.attribute
        hit = np.flatnonzero(holds(name))
        self.reject(self.fine[of[hit]], np.bincount(of[hit], minlength=len(self.fine))[of[hit]] > 1)
        row, at = of[hit], start[hit] + 2
        left, out, params, total = self.u2(at - 2), [], [], 0
        while True:
            more = (left > 0) & ~self.odd[self.fine[row]]
            row, at, left = row[more], at[more], left[more] - 1
            if not len(row):
                break
            file = self.fine[row]
            at = self.inside(file, at + 4)
            kind, n = self.text(file, self.u2(at - 4)), self.u2(at - 2)
            number = np.arange(total, total + len(row))
            total += len(row)
            out.append((row, kind, number))
            some = np.arange(len(row))
            while True:
                some = some[(n[some] > 0) & ~self.odd[file[some]]]
                if not len(some):
                    break
                here = self.inside(file[some], at[some] + 5)
                tag = self.raw[here - 3]
                shape = np.select([tag == ord("s"), tag == ord("Z"), np.isin(tag, [ord(t) for t in "BIS"])], [0, 1, 2], -1)
                self.reject(file[some], shape < 0)
                value, is_text, is_int = self.u2(here - 2), shape == 0, shape > 0
                value[is_text] = self.text(file[some[is_text]], value[is_text])
                value[is_int] = self.i4(self.place(file[some[is_int]], value[is_int], 3) + 1)
                params.append((number[some], self.text(file[some], self.u2(here - 5)), shape, value, file[some]))
                at[some] = here
                n[some] -= 1
        found = [np.concatenate(c) for c in zip(*params, strict=True)] if params else [np.zeros(0, np.int64)] * 5
        order = np.argsort(found[0], kind="stable")
        self.p_note, self.p_name, self.p_kind, self.p_value, file = (c[order] for c in found)
        if len(file):
            once = np.zeros(len(file), bool)
            once[_first([self.p_note, _ids(self.take(self.p_name))])] = True
            self.reject(file, ~once)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def rows(content: pa.Array, paths: pa.Array, wanted: frozenset[str]) -> tuple[list[pa.RecordBatch], np.ndarray]:
    """(rows of the wanted records, which files are odd: of these there are no rows)."""
    if wanted <= {"kotlin", "inline"}:
        return [], pc.match_substring(content, C._METADATA_BYTES).to_numpy(zero_copy_only=False)
    ask, f = C._ask(wanted), Files(content)
    f.read()
    code = note = None
    if ask.whole or ask.kotlin:
        f.odd |= pc.match_substring(content, C._METADATA_BYTES).to_numpy(zero_copy_only=False)
    if ask.bodies:
        f.bodies(ask.whole or ask.wants["param"] or ask.wants["local"])
    if ask.in_code:
        if len(f.m_row):
            f.reject(f.fine[f.m_row[f.m_attribute[0]]], f.is_text(f.m_attribute[1], b"Exceptions"))
        code = _touched(f)
    if ask.notes:
        note = f.notes()
    # all is read: what is odd by now has no rows
    of, name, start, _ = f.attribute
    f.reject(f.fine[of], (f.is_text(name, b"SourceFile")) & (start + 2 > f.end[f.fine[of]]))
    source, no_source = np.zeros(len(f.fine), np.int64), np.ones(len(f.fine), bool)
    hit = f.is_text(name, b"SourceFile")
    source[of[hit]], no_source[of[hit]] = f.text(f.fine[of[hit]], f.u2(start[hit])), False
    face_row = np.repeat(np.arange(len(f.fine)), f.n_faces)
    face_at = np.repeat(f.faces_at, f.n_faces) + 2 * (ragged(f.faces_at, f.n_faces) - np.repeat(f.faces_at, f.n_faces))
    faces = f.class_name(f.fine[face_row], f.u2(np.minimum(face_at, len(f.raw) - 2)))
    good = ~f.odd[f.fine]
    if not good.any():
        return [], f.odd
    own = dotted(f.take(f.own))
    path = paths.take(pa.array(f.fine))
    out: list[pa.RecordBatch] = []

    def add(record: str, row: np.ndarray, **columns: pa.Array) -> None:
        if len(row):
            at = pa.array(row)
            known = {"record": pa.repeat(record, len(row)), "path": path.take(at), "class": own.take(at), **columns}
            out.append(pa.RecordBatch.from_arrays([known[c.name] if c.name in known else pa.nulls(len(row), c.type) for c in ARROW], schema=ARROW))

    number = lambda v, null=None: pa.array(v.astype(np.int32), mask=null)
    if ask.wants["class"]:
        row = np.flatnonzero(good)
        record = np.zeros(len(f.fine), bool)
        record[of[f.is_text(name, b"Record")]] = True
        names = dotted(f.take(faces[good[face_row]]))
        names = pa.ListArray.from_arrays(pa.array(starts(f.n_faces[row]), pa.int32()), names)
        add("class", row, name=dotted(f.take(f.parent[row], f.no_parent[row])), value=f.take(source[row], no_source[row]), access=number(f.access[row] | np.where(record[row], C.ACC_RECORD, 0)), names=names)
    for record, method in (("field", False), ("method", True)):
        if ask.wants[record]:
            m = np.flatnonzero((f.m_method == method) & good[f.m_row]) if len(f.m_row) else np.zeros(0, np.int64)
            line = f.m_line[m] if method else np.full(len(m), -1)
            add(record, f.m_row[m], member=f.take(f.m_name[m]), desc=f.take(f.m_desc[m]), line=number(line, line < 0), access=number(f.m_access[m]))
    if code is not None:
        _add_code(f, code, good, ask.wants, add, own)
    if note is not None and ask.wants["note"]:
        row, kind, no = note
        keep = np.flatnonzero(good[row])
        keep = keep[np.argsort(no[keep], kind="stable")]
        row, kind, no = row[keep], kind[keep], no[keep]
        kinds = f.take(kind).dictionary_encode()
        named = pa.array([C.dotted(k[1:-1]) for k in kinds.dictionary.to_pylist()], pa.string()).take(kinds.indices)
        p = np.flatnonzero(np.isin(f.p_note, no))
        shape, value = f.p_kind[p], f.p_value[p]
        shown = pc.if_else(pa.array(shape == 1), pc.if_else(pa.array(value != 0), "true", "false"), pc.cast(pa.array(value), pa.string()))
        shown = pc.if_else(pa.array(shape == 0), f.take(np.where(shape == 0, value, 0)), shown)
        n = np.bincount(np.searchsorted(no, f.p_note[p]), minlength=len(no))
        add("note", row, name=named, params=pa.MapArray.from_arrays(pa.array(starts(n), pa.int32()), f.take(f.p_name[p]), shown))
    return out, f.odd


def _touched(f: Files) -> dict[str, tuple[np.ndarray, ...]]:
    """Instructions on members (code, place, owner, name, desc, kind of use, kind of site), on types (code, type, name) and on constants (code, text)."""
    code, op, i, at = f.instructions()
    file = f.fine[f.m_row[f.c_member[code]]]
    on = np.flatnonzero((op >= C.GETSTATIC) & (op <= C.INVOKEINTERFACE))
    field = op[on] <= C.PUTFIELD
    members = [(code[on], at[on], *f.member(file[on], i[on]), np.where(field, _FIELD_ACCESS, _METHOD_CALL), np.where(field, 2 + op[on] % 2, 0))]
    on = np.flatnonzero(op == C.INVOKEDYNAMIC)
    if len(on):
        f.named(file[on], f.u2(f.place(file[on], i[on], _DYNAMIC) + 3))
        which, constant = f.handles(f.m_row[f.c_member[code[on]]], i[on])
        on = on[which]
        members.append((code[on], at[on], *f.member(file[on], constant), np.full(len(on), _METHOD_CALL), np.ones(len(on), np.int64)))
    on = np.flatnonzero(_ON_TYPE[op])
    types = code[on], f.class_name(file[on], i[on]), np.searchsorted(_TYPE_OPS, op[on])
    on = np.flatnonzero((op == C.LDC) | (op == C.LDC_W))
    place = f.place(file[on], i[on], 3, 4, _CLASS, _STRING)
    tag = f.raw[place]
    texts, literals = on[tag == _STRING], on[tag == _CLASS]
    return {
        "member": tuple(np.concatenate(c) for c in zip(*members, strict=True)),
        "type": types,
        "text": (code[texts], f.text(file[texts], f.u2(place[tag == _STRING] + 1))),
        "literal": (code[literals], f.text(file[literals], f.u2(place[tag == _CLASS] + 1))),
    }


def _add_code(f: Files, found: dict, good: np.ndarray, wants: dict[str, bool], add, own: pa.Array) -> None:
    keep = lambda columns: tuple(c[good[f.m_row[f.c_member[columns[0]]]]] for c in columns)
    code, at, owner, name, desc, used, kind = keep(found["member"])
    member = f.c_member[code]
    row = f.m_row[member]
    t_code, t_type, t_op = keep(found["type"])
    t_member = f.c_member[t_code]
    number = lambda v, null=None: pa.array(v.astype(np.int32), mask=null)
    if wants["text"]:
        c, text = keep(found["text"])
        add("text", f.m_row[f.c_member[c]], member=f.take(f.m_name[f.c_member[c]]), value=f.take(text))
    if not (wants["use"] or wants["site"] or wants["call"]):
        return
    owners, names = dotted(f.take(owner)), f.take(name)
    owner_id, name_id, desc_id = _ids(owners), _ids(names), _ids(f.take(desc))
    by = f.take(f.m_name[member])
    if wants["use"]:
        all_by = pa.concat_arrays([by, f.take(f.m_name[t_member])])
        types = dotted(f.take(t_type))
        owner_, name_ = pa.concat_arrays([owners, types]), pa.concat_arrays([names, _OP_NAMES.take(pa.array(t_op))])
        desc_ = pa.concat_arrays([f.take(desc), pa.repeat("", len(t_code))])
        row_, kind_ = np.concatenate([row, f.m_row[t_member]]), np.concatenate([used, np.full(len(t_code), _TYPE_REFERENCE)])
        first = _first([row_, _ids(all_by), _ids(owner_), _ids(name_), _ids(desc_), kind_])
        i = pa.array(first)
        add("use", row_[first], member=all_by.take(i), desc=desc_.take(i), owner=owner_.take(i), name=name_.take(i), value=_USED.take(pa.array(kind_[first])))
    if wants["site"]:
        line = f.line_of(code, at)
        first = _first([row, _ids(by), _ids(f.take(f.m_desc[member])), owner_id, name_id, desc_id, kind, line + 1])
        i, line = pa.array(first), line[first]
        add("site", row[first], member=by.take(i), desc=f.take(desc[first]), owner=owners.take(i), name=names.take(i), value=_TOUCHED.take(pa.array(kind[first])), line=number(line, line < 0), access=number(f.m_access[member[first]]))
    if wants["call"]:
        c, text = keep(found["literal"])
        not_array = f.raw[f.text_at[text]] != ord("[") if len(text) else np.zeros(0, bool)
        c, text = c[not_array], text[not_array]
        c_member = f.c_member[c]
        field = pc.binary_join_element_wise("<field:", names, ">", "")
        called = pc.if_else(pa.array(used == _FIELD_ACCESS), field, names)
        by_ = pa.concat_arrays([by, f.take(f.m_name[c_member])])
        owner_ = pa.concat_arrays([owners, dotted(f.take(text))])
        called_ = pa.concat_arrays([called, pa.repeat("<class-literal>", len(c))])
        row_ = np.concatenate([row, f.m_row[c_member]])
        other = pc.not_equal(owner_, own.take(pa.array(row_))).to_numpy(zero_copy_only=False) if len(row_) else np.zeros(0, bool)
        some = np.flatnonzero(other | np.concatenate([used == _METHOD_CALL, np.zeros(len(c), bool)]))
        first = some[_first([row_[some], *(_ids(a.take(pa.array(some))) for a in (by_, owner_, called_))])]
        i = pa.array(first)
        add("call", row_[first], member=by_.take(i), owner=owner_.take(i), name=called_.take(i))
