"""The star-schema tables as class files: rows become classes inside Arrow batches, `sparkloom.sources.bytecode` reads them.

A part is a class com.<type>.<brand>.P<key>: an interface, data class, record, abstract, annotated or plain class
by its size, with fields, accessors, annotations, text and Kotlin metadata. Of 50 parts one is no class file and one is
too new. An order is a class com.orders.<status>.O<key>; each of its line numbers is a method, each line an
instruction on the line's part or supplier. A supplier is a Kotlin file com.suppliers.S<key>Kt of test code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.sources import assembler as S, bytecode as B
from sparkloom.util import table

FILE = "path string, content binary"
#: Columns of an order's line.
LINE = ("number", "quantity", "part", "supplier", "status")
DESCRIBE = "(ILjava/lang/String;)Ljava/lang/String;"


@lru_cache(None)
def _forms(make: Callable[..., bytes]) -> S.Forms:
    """A worker's forms serve all its tasks."""
    return S.Forms(make)


def _build(rows: Callable[[pa.RecordBatch], S.Rows], make: Callable[..., bytes]):
    """rows gives what each row's file is filled with; the first text is the file's own name."""

    def run(batches):
        forms = _forms(make)
        for batch in batches:
            if batch.num_rows:
                found = rows(batch)
                names = found.texts.take(pa.array(found.text_at[S.starts(found.n_texts)[:-1]]))
                paths = pc.binary_join_element_wise(names, ".class", "")
                yield pa.RecordBatch.from_arrays([paths, forms.files(found)], names=["path", "content"])

    return run


def _columns(batch: pa.RecordBatch, *names: str) -> Iterable[tuple]:
    return zip(*(B.values(batch.column(n)) for n in names), strict=True)


def _parts(batch: pa.RecordBatch) -> Iterable[tuple]:
    for k, size, name, title in _columns(batch, "k", "size", "name", "title"):
        kind = min(size // 10, 2) if size < 30 else 3 + (size >= 35) + (size >= 40)
        form = (k % 50 == 7, k % 50 == 8, kind, size % 2 == 0, *(k % n == 0 for n in (2, 3, 4, 5, 7, 8, 9, 10, 11, 13)))
        yield form, [name, f"P{k}.kt", f"P{k}", f"/p/{k}", title, f"a{size}"], [size, k % 100 + 1, k % 100 + 3], [size]


def _part_texts(batch: pa.RecordBatch) -> S.Rows:
    return S.Rows.of(_parts(batch))


def _part(form: tuple, texts: list[str], lines: list[int], ints: list[int]) -> bytes:
    own, source, short, route_path, title, tag = texts
    broken, new, kind, even, by2, by3, by4, by5, by7, by8, by9, by10, by11, by13 = form
    if broken:
        return b"PK\3\4 no class"
    face, data, record = kind == 0, kind == 1, kind == 2
    access = S.PUBLIC | (S.INTERFACE | S.ABSTRACT if face else S.SUPER) | (S.ABSTRACT if kind == 3 else 0)
    parent = "java/lang/Record" if record else "com/shared/Base" if by4 and not face else "java/lang/Object"
    faces = ["com/shared/Priced"] * by3 + ["java/io/Serializable"] * (by2 and by3)
    notes = []
    if kind == 4:
        notes.append(S.Note(("Ljakarta/persistence/Entity;", {"name": short, "lazy": by2, "rank": ints[0]})))
    if by11:
        notes.append(S.Note(("Lcom/shared/Tags;", {"value": [S.Note(("Lcom/shared/Tag;", {"value": t})) for t in (tag, "b")]})))
    if data:
        notes.append(S.kotlin_metadata([("describe", by2), ("getPrice", False), ("component1", False), ("copy", False)]))
    c = S.ClassFile(own, access, parent, faces, None if by5 else source, notes, record, 99 if new else 61)
    if not face:
        c.field("price", "D")
        if even:
            c.field("owner", "Lcom/shared/Owner;")
        if by7:
            c.field("tags", "[[Ljava/lang/String;")
        if by9:
            c.field("cache", "I", S.PUBLIC | S.SYNTHETIC)
            c.field("INSTANCE", f"L{own};", S.PUBLIC | S.STATIC)
        c.method("<init>", "()V", [("special", parent, "<init>", "()V")])
        c.method("getPrice", "()D", [("line", lines[0]), ("getfield", own, "price", "D")])
    route = [S.Note(("Lcom/shared/Route;", {"path": route_path, "verb": S.Enum(("Lcom/shared/Verb;", "GET")), "type": S.Type("Lcom/shared/Owner;")}))] if kind >= 4 else []
    body = [("line", lines[1]), ("op", S.NOP), ("text", title), ("line", lines[2]), ("load", 2), ("static", "java/lang/String", "valueOf", "(I)Ljava/lang/String;")]
    c.method("describe", DESCRIBE, None if face else body, S.PUBLIC | (S.ABSTRACT if face else 0), ["java/io/IOException"] if by13 else [], route, ["count", "title"])
    if data:
        c.method("component1", "()D", [("getfield", own, "price", "D")])
        c.method("copy", f"(D)L{own};", [("text", "copied")])
        if not by2:
            c.method("size", "()I", [])
    if by8:
        c.method("compareTo", "(Ljava/lang/Object;)I", [], S.PUBLIC | S.BRIDGE | S.SYNTHETIC)
    if by10:
        c.method("access$getPrice", "()D", [("text", "hidden")], S.STATIC | S.SYNTHETIC)
    return c.bytes()


def _orders(batch: pa.RecordBatch) -> Iterable[tuple]:
    """Rows (k, priority, name, lines); lines in the order that they have in the class."""
    lines = batch.column("lines")
    found, at = lines.flatten(), 0
    numbers, quantities, *names = (B.values(found.field(c)) for c in LINE)
    mixed = [None] * (3 * len(found))
    for i, column in enumerate(names):
        mixed[i::3] = column
    for k, priority, name, n in zip(*(B.values(c) for c in (*map(batch.column, ("k", "priority", "name")), pc.list_value_length(lines))), strict=True):
        end = at + n
        yield (k % 4 != 1, *numbers[at:end]), [name, f"O{k}.kt", priority, *mixed[3 * at : 3 * end]], quantities[at:end], [int(priority[0])]
        at = end


def _order_rows(batch: pa.RecordBatch) -> S.Rows:
    """What `_orders` gives, without a row at a time."""
    lines, k, priority = batch.column("lines"), batch.column("k"), batch.column("priority")
    found, n = lines.flatten(), pc.list_value_length(lines)
    numbers, quantities, *names = (found.field(c) for c in LINE)
    if any(c.null_count for c in (lines, k, priority, found, numbers, quantities)):
        return S.Rows.of(_orders(batch))
    n, k, numbers = n.to_numpy(), k.to_numpy(), numbers.to_numpy()
    count, first = len(k), np.arange(len(k))
    own = pc.binary_join_element_wise("O", pc.cast(batch.column("k"), pa.string()), ".kt", "")
    # places in the columns' concatenation: three texts of an order, then three of each of its lines
    at = np.empty(3 * (count + len(found)), np.int64)
    start = 3 * (first + S.starts(n)[:-1])
    for c in range(3):
        at[start + c] = c * count + first
    line = 3 * (np.arange(len(found)) + np.repeat(first, n) + 1)
    for c in range(3):
        at[line + c] = 3 * count + c * len(found) + np.arange(len(found))
    raw = numbers.astype(np.int64).tobytes()
    ends = (8 * S.starts(n)).tolist()
    keys = [(known, raw[a:b]) for known, a, b in zip((k % 4 != 1).tolist(), ends[:-1], ends[1:], strict=True)]
    ints = np.array([int(p[0]) for p in B.values(priority)], np.int64)
    texts = pa.concat_arrays([c.cast(pa.string()) for c in (batch.column("name"), own, priority, *names)])
    return S.Rows(keys, texts, at, 3 + 3 * n.astype(np.int64), quantities.to_numpy().astype(np.int64), n.astype(np.int64), ints, np.ones(count, np.int64))


def _held(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, as one row of an order is not one class."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _grouped(batches: Iterable[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows of `order_rows` as (k, priority, name, lines), lines by number and quantity. An order that a batch ends in waits for the next; lines without an order are left out."""
    rest = None
    for batch in _held(batches, rows):
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        k = batch.column("k").to_numpy()
        last = int(np.searchsorted(k, k[-1]))
        rest = batch.slice(last)
        if last:
            yield _nested(batch.slice(0, last))
    if rest is not None:
        yield _nested(rest)


def _in_order(batch: pa.RecordBatch) -> np.ndarray:
    """Places of rows sorted by k in order of k, line, number and quantity."""
    k, line = batch.column("k").to_numpy(), batch.column("line").to_numpy()
    number, quantity = (pc.fill_null(batch.column(c), 0).to_numpy() for c in ("number", "quantity"))
    if min(number.min(), quantity.min()) < 0 or max(number.max(), quantity.max()) >= 1 << 16:
        return np.lexsort((quantity, number, line, k))
    rank = np.cumsum(np.diff(k, prepend=k[0]) != 0)
    return np.argsort(rank << 33 | line.astype(np.int64) << 32 | number.astype(np.int64) << 16 | quantity, kind="stable")


def _nested(batch: pa.RecordBatch) -> pa.RecordBatch:
    batch = batch.take(pa.array(_in_order(batch)))
    k, is_order = batch.column("k").to_numpy(), batch.column("line").to_numpy() == 0
    orders = np.flatnonzero(is_order)
    # the lines of a key follow its orders
    end = np.searchsorted(k, k[orders], "right")
    before = np.concatenate([[0], np.cumsum(is_order)])
    start = np.searchsorted(k, k[orders])
    start += before[end] - before[start]
    offsets = np.concatenate([[0], np.cumsum(end - start)])
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], end - start)
    lines = batch.select(list(LINE)).take(pa.array(places)).to_struct_array()
    own = batch.select(["k", "priority", "name"]).take(pa.array(orders))
    return pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines)], names=["k", "priority", "name", "lines"])


def _order(form: tuple, texts: list[str], lines: list[int], ints: list[int]) -> bytes:
    name, source, priority = texts[:3]
    c = S.ClassFile(name, source=source if form[0] else None, notes=[S.Note(("Lcom/shared/Priority;", {"value": priority, "level": ints[0]}))])
    numbers = np.frombuffer(form[1], np.int64).tolist() if isinstance(form[-1], bytes) else form[1:]
    methods: dict[int, list] = {}
    for i, n in enumerate(numbers):
        part, supplier, status = texts[3 + 3 * i : 6 + 3 * i]
        code = methods.setdefault(n, [])
        if n % 2:
            code.append(("line", lines[i]))
        if n == 1:
            code += [("virtual", part, "describe", DESCRIBE)] * 2
        elif n == 2:
            code += [("label", len(code)), ("getfield", part, "price", "D"), ("jump", 0xA7, len(code))]
        elif n == 3:
            code.append(("new", part))
        elif n == 4:
            code.append(("lambda", "get", "()Ljava/util/function/Supplier;", part, "getPrice", "()D"))
        elif n == 5:
            code.append(("text", status))
        elif n == 6:
            code += [("switch", 0, ["end"], "end"), ("label", "end"), ("classof", part)]
        else:
            code += [("checkcast", part), ("static", supplier, "ext", "(Ljava/lang/Object;)V")]
    for n, code in methods.items():
        c.method(f"line{n}", "()V", code)
    return c.bytes()


def _suppliers(batch: pa.RecordBatch) -> Iterable[tuple]:
    for own, nation, balance in _columns(batch, "name", "nation", "balance"):
        yield balance < 0, [own, f"(Lcom/nations/N{nation};)V"], [], []


def _supplier_texts(batch: pa.RecordBatch) -> S.Rows:
    return S.Rows.of(_suppliers(batch))


def _supplier(inline: bool, texts: list[str], lines: list[int], ints: list[int]) -> bytes:
    own, desc = texts
    c = S.ClassFile(own, source="Suppliers.kt", notes=[S.kotlin_metadata([("ext", inline), ("of", False)], file=True)])
    c.method("ext", desc, [("getstatic", "com/shared/Registry", "ALL", "Ljava/util/List;")], S.PUBLIC | S.STATIC)
    c.method("of", "(I)V", [], S.PUBLIC | S.STATIC)
    c.method("list", "([Ljava/lang/String;)V", [], S.PUBLIC | S.STATIC)
    return c.bytes()


def _dealt(rows: DataFrame, key: str = "name") -> DataFrame:
    """Small rows make large files and long work, so they are dealt out by hand, to no fewer tasks than a shuffle has."""
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)


def _part_name() -> F.Column:
    return F.concat(F.lit("com/"), F.lower("p_type"), F.lit("/"), F.lower(F.translate("p_brand", "#", "")), F.lit("/P"), F.col("p_partkey").cast("string"))


def part_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_name").alias("title"), _part_name().alias("name"))
    return _dealt(rows)


def order_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders (line 0) and their lines (line 1), dealt out by order in one shuffle and sorted by it; `_grouped` puts a batch's lines in order.

    A class holds the lines of one order, so no class grows with the tables.
    """
    part = table(spark, d, "part").select("p_partkey", _part_name().alias("part"))
    line = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    status = F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string"))
    no = lambda c, kind: F.lit(None).cast(kind).alias(c)
    facts = (F.col("l_linenumber").alias("number"), F.col("l_quantity").cast("int").alias("quantity"), "part", F.concat(F.lit("com/suppliers/S"), F.col("l_suppkey").cast("string"), F.lit("Kt")).alias("supplier"), status.alias("status"))
    lines = line.select(F.col("l_orderkey").alias("k"), F.lit(1).alias("line"), *facts, no("priority", "string"), no("name", "string"))
    inner = F.when(F.col("o_orderkey") % 10 == 3, "$1").otherwise("")
    name = F.concat(F.lit("com/orders/"), F.lower("o_orderstatus"), F.lit("/O"), F.col("o_orderkey").cast("string"), inner)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("line"), *(no(c, lines.schema[c].dataType) for c in LINE), F.col("o_orderpriority").alias("priority"), name.alias("name"))
    return _dealt(orders.union(lines.filter("k is not null")), "k").sortWithinPartitions("k")


def supplier_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.concat(F.lit("com/suppliers/S"), F.col("s_suppkey").cast("string"), F.lit("Kt")).alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return _dealt(rows)


def part_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content)."""
    return part_rows(spark, d).mapInArrow(_build(_part_texts, _part), FILE)


def supplier_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content)."""
    return supplier_rows(spark, d).mapInArrow(_build(_supplier_texts, _supplier), FILE)


def part_facts(spark: SparkSession, d: str, records: Iterable[str] | None = None) -> DataFrame:
    return B.parse_made(part_rows(spark, d), _build(_part_texts, _part), records=records)


def order_facts(spark: SparkSession, d: str, records: Iterable[str] | None = None) -> DataFrame:
    files = _build(_order_rows, _order)
    return B.parse_made(order_rows(spark, d), lambda batches: files(_grouped(batches)), records=records)


def supplier_facts(spark: SparkSession, d: str, records: Iterable[str] | None = None) -> DataFrame:
    return B.parse_made(supplier_rows(spark, d), _build(_supplier_texts, _supplier), "test", records=records)


def facts(spark: SparkSession, d: str, records: Iterable[str] | None = None) -> DataFrame:
    """The facts of all classes; records: only these of them."""
    return part_facts(spark, d, records).union(order_facts(spark, d, records)).union(supplier_facts(spark, d, records))
