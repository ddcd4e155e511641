"""Class files and JARs as Spark tables: one parse of each file, then plain views of its facts.

`read_classes` and `read_jars` give the fact table (classfile.FACT and source_set). Write it once as
Parquet; each view below is a projection of it. Files that cannot be read become rows of `errors`.
A view of a method takes overloads as one, as call edges have no descriptors.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.functions import names as N
from sparkloom.operators.navigation import generated_method
from sparkloom.sources import classbatch, classfile as C, jars

UNKNOWN = "<unknown>"
#: Annotations that compilers write.
COMPILER_NOTES = ("kotlin.Metadata", "kotlin.jvm.internal.SourceDebugExtension", "kotlin.coroutines.jvm.internal.DebugMetadata", "org.jetbrains.annotations.NotNull", "org.jetbrains.annotations.Nullable")
#: Fixed value: the field that holds a singleton.
SINGLETON = "INSTANCE"

_ARROW = classbatch.ARROW
#: Files of a batch that are read at once, no fewer and no more bytes of them.
FEWEST, MOST_BYTES = 64, 1 << 28


def _error(path: str, reason: object, wanted: frozenset[str] | None) -> list[tuple]:
    return [("error", path, None, None, None, None, None, str(reason), None, None, None, None)] if wanted is None or "error" in wanted else []


def _rows(data: bytes, path: str, wanted: frozenset[str] | None) -> list[tuple]:
    try:
        return C.rows(data, path, wanted=wanted)
    except C.BadClassFile as e:
        return _error(path, e, wanted)


def values(column: pa.Array) -> list:
    """A column as a list, by way of numpy, which is about ten times as fast as `to_pylist` and has no null numbers."""
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    columns[-1] = [None if p is None else list(p.items()) for p in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


#: What a damaged or encrypted archive or entry raises.
UNREADABLE = (zipfile.BadZipFile, zlib.error, RuntimeError, NotImplementedError, EOFError, ValueError)


def _entries(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Class files of a JAR, each as path!/entry."""
    with zipfile.ZipFile(io.BytesIO(data)) as jar:
        for entry in jar.infolist():
            if entry.filename.endswith(".class"):
                name = f"{path}!/{entry.filename}"
                try:
                    content = jar.read(entry)
                except UNREADABLE as e:  # the other entries of the JAR are still read
                    content = e
                yield name, content


def _at_once(batch: pa.RecordBatch, wanted: frozenset[str]) -> tuple[list[pa.RecordBatch], pa.RecordBatch]:
    """(facts of the files that can be read at once, the other files)."""
    paths, content = batch.columns
    if batch.num_rows < FEWEST or content.nbytes > MOST_BYTES or content.null_count or paths.null_count:
        return [], batch
    found, odd = classbatch.rows(content, paths, wanted)
    return found, batch.filter(pa.array(odd))


def _parse(jars: bool, wanted: frozenset[str] | None, rows: int = 20_000):
    at_once = not jars and wanted is not None and wanted <= classbatch.HERE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            if at_once:
                found, batch = _at_once(batch, wanted)
                for made in found:
                    yield from (made.slice(i, rows) for i in range(0, made.num_rows, rows))
            for path, data in zip(values(batch.column(0)), batch.column(1), strict=True):
                try:
                    for name, content in _entries(path, data.as_py()) if jars else [(path, data.as_py())]:
                        held += _error(name, f"{type(content).__name__}: {content}", wanted) if isinstance(content, Exception) else _rows(content, name, wanted)
                        if len(held) >= rows:
                            yield _batch(held)
                            held = []
                except UNREADABLE as e:
                    held += _error(path, e, wanted)
        if held:
            yield _batch(held)

    return run


def _wanted(records: Iterable[str] | None) -> frozenset[str] | None:
    if records is None:
        return None
    if unknown := set(records) - set(C.RECORDS):
        raise ValueError(f"no such records: {sorted(unknown)}")
    return frozenset(records)


def parse_files(files: DataFrame, source_set: str = "prod", jars: bool = False, records: Iterable[str] | None = None) -> DataFrame:
    """Facts of class files (or JARs) that are rows (path, content), wherever they come from.

    records: only these are made (`NEEDS` says what a view is made of); without `error` among them a file is read
    no further than they ask, so damage elsewhere in it is not seen.
    """
    return files.select("path", "content").mapInArrow(_parse(jars, _wanted(records)), C.FACT).withColumn("source_set", F.lit(source_set))


def parse_made(rows: DataFrame, files: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], source_set: str = "prod", records: Iterable[str] | None = None) -> DataFrame:
    """Facts of class files that `files` makes of rows, as batches of (path, content), read in the task that made them."""
    parse = _parse(False, _wanted(records))
    return rows.mapInArrow(lambda batches: parse(files(batches)), C.FACT).withColumn("source_set", F.lit(source_set))


def _read(spark: SparkSession, paths: list[str], pattern: str, jars: bool, source_set: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(paths)
    return parse_files(files, source_set, jars)


def read_classes(spark: SparkSession, paths: list[str], source_set: str = "prod") -> DataFrame:
    """Facts of all class files below the folders."""
    return _read(spark, paths, "*.class", False, source_set)


def read_jars(spark: SparkSession, paths: list[str], source_set: str = "prod", whole: bool = False) -> DataFrame:
    """Facts of all classes in the JARs (files or folders).

    Only the directories of the archives are read first; their entries are dealt out in stretches of about `jars.STRETCH`
    bytes and read by range, so one large JAR is the work of many tasks. whole: each JAR is one row that Spark
    reads, for stores that pyarrow cannot open.
    """
    if whole:
        return _read(spark, paths, "*.jar", True, source_set)
    return jars.entries(spark, paths).mapInArrow(_parse_entries, C.FACT).withColumn("source_set", F.lit(source_set))


def _parse_entries(batches: Iterable[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for name, content in jars.contents(batches):
        held += _error(name, content, None) if isinstance(content, str) else _rows(content, name, None)
        if len(held) >= rows:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


#: The records that each view, and each preview of operators.renames, reads.
NEEDS = {
    "errors": ("error",),
    "classes": ("class",),
    "project_classes": ("class",),
    "source_sets": ("class",),
    "call_edges": ("call",),
    "declared_methods": ("method",),
    "supertypes": ("class",),
    "class_index": ("class",),
    "fields": ("field",),
    "field_accessors": ("field", "method"),
    "symbols": ("class", "field", "method"),
    "bridge_methods": ("method",),
    "inline_methods": ("inline",),
    "delegated_methods": ("kotlin", "method"),
    "annotations": ("note",),
    "string_constants": ("class", "text"),
    "class_kinds": ("class", "method", "note"),
    "package_deps": ("class", "ref"),
    "receiver_types": ("method",),
    "find_usages": ("class", "use"),
    "find_usages_type": ("class", "field", "method", "use"),
    "class_details": ("class", "field", "method", "note"),
    "rename_method": ("class", "method", "site"),
    "rename_parameter": ("class", "field", "local", "method", "param", "site"),
    "rename_property": ("class", "field", "method", "param", "site"),
    "move_class": ("class", "ref"),
}


def _of(facts: DataFrame, record: str) -> DataFrame:
    return facts.filter(F.col("record") == record)


def _has(flag: int) -> Column:
    return F.col("access").bitwiseAND(flag) != 0


def errors(facts: DataFrame) -> DataFrame:
    """(path, reason) of files that could not be read."""
    return _of(facts, "error").select("path", F.col("value").alias("reason"))


def classes(facts: DataFrame) -> DataFrame:
    """(class, source_file, source_path, user_defined)."""
    package, file = N.package_name(F.col("class")), F.col("value")
    path = F.when(file.isNull(), UNKNOWN).when(package == "", file).otherwise(F.concat(F.translate(package, ".", "/"), F.lit("/"), file))
    return _of(facts, "class").select("class", F.coalesce(file, F.lit(UNKNOWN)).alias("source_file"), path.alias("source_path"), (~N.is_synthetic(F.col("class"))).alias("user_defined")).distinct()


def project_classes(facts: DataFrame) -> DataFrame:
    """(class): top-level names."""
    return _of(facts, "class").select(N.top_level(F.col("class")).alias("class")).distinct()


def source_sets(facts: DataFrame, order: list[str]) -> DataFrame:
    """(class, source_set); of several sets the one that comes last in order."""
    place = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in order)), F.col("source_set")), F.lit(0))
    return _of(facts, "class").groupBy("class").agg(F.max_by("source_set", F.struct(place, "source_set")).alias("source_set"))


def call_edges(facts: DataFrame) -> DataFrame:
    """(caller_class, caller_method, callee_class, callee_method), distinct."""
    return _of(facts, "call").select(F.col("class").alias("caller_class"), F.col("member").alias("caller_method"), F.col("owner").alias("callee_class"), F.col("name").alias("callee_method")).distinct()


def declared_methods(facts: DataFrame) -> DataFrame:
    """(class, method, line): line is the least first line of the overloads."""
    return _of(facts, "method").groupBy("class", F.col("member").alias("method")).agg(F.min("line").alias("line"))


def supertypes(facts: DataFrame) -> DataFrame:
    """(supertype, implementor, source_file): interfaces and super classes but Object, of classes that are not synthetic."""
    above = F.array_compact(F.concat("names", F.array("name")))
    rows = _of(facts, "class").filter(~N.is_synthetic(F.col("class")))
    return rows.select(F.explode(above).alias("supertype"), F.col("class").alias("implementor"), F.coalesce("value", F.lit(UNKNOWN)).alias("source_file")).filter("supertype <> 'java.lang.Object'").distinct()


def class_index(facts: DataFrame) -> DataFrame:
    """(class, source_file, super_class, interfaces); no super class where it is Object."""
    return _of(facts, "class").select("class", F.coalesce("value", F.lit(UNKNOWN)).alias("source_file"), F.when(F.col("name") != "java.lang.Object", F.col("name")).alias("super_class"), F.col("names").alias("interfaces"))


def fields(facts: DataFrame) -> DataFrame:
    """(class, field, type) without synthetic fields and singletons."""
    shown = F.element_at(F.split(F.translate(F.regexp_replace("desc", r"^\[*L?|;$", ""), "/", "."), r"\."), -1)
    base = F.regexp_replace("desc", r"^\[+", "")
    kind = F.when(F.length(base) > 1, shown)
    for letter, name in C._PRIMITIVES.items():
        kind = kind.when(base == letter, name)
    array = F.repeat(F.lit("[]"), F.length("desc") - F.length(base))
    return _of(facts, "field").filter(~_has(C.ACC_SYNTHETIC) & (F.col("member") != SINGLETON)).select("class", F.col("member").alias("field"), F.concat(kind, array).alias("type"))


def field_accessors(facts: DataFrame) -> DataFrame:
    """(class, method) of get, set and is methods that are named after a field of their class."""
    found = F.regexp_extract("member", r"^(?:get|set|is)([A-Z].*)$", 1)
    named = F.concat(F.lower(F.substring(found, 1, 1)), F.substring(found, 2, 1 << 30))
    methods = _of(facts, "method").select("class", F.col("member").alias("method"), named.alias("field")).filter("field <> ''")
    return methods.join(fields(facts).select("class", "field"), ["class", "field"], "left_semi").select("class", "method").distinct()


def own_methods(facts: DataFrame) -> DataFrame:
    """Method rows that a person wrote: not generated, not synthetic, no accessor of a field."""
    methods = _of(facts, "method").filter(~generated_method(F.col("member")) & ~_has(C.ACC_SYNTHETIC))
    return methods.join(field_accessors(facts).withColumnRenamed("method", "member"), ["class", "member"], "left_anti")


def symbols(facts: DataFrame) -> DataFrame:
    """(package, class, symbol, kind, source_file)."""
    found = fields(facts).select("class", F.col("field").alias("symbol"), F.lit("FIELD").alias("kind")).union(own_methods(facts).select("class", F.col("member").alias("symbol"), F.lit("METHOD").alias("kind")))
    return found.join(classes(facts).select("class", "source_file"), "class").select(N.package_name(F.col("class")).alias("package"), "class", "symbol", "kind", "source_file").distinct()


def bridge_methods(facts: DataFrame) -> DataFrame:
    """(class, method)."""
    return _of(facts, "method").filter(_has(C.ACC_BRIDGE)).select("class", F.col("member").alias("method")).distinct()


def inline_methods(facts: DataFrame) -> DataFrame:
    """(class, method) of Kotlin's inline functions, whose calls leave no edges."""
    return _of(facts, "inline").select("class", F.col("member").alias("method")).distinct()


def delegated_methods(facts: DataFrame) -> DataFrame:
    """(class, method) of Kotlin classes' methods that their metadata does not list, as the compiler adds for delegation.

    Bridges, synthetic methods and constructors are no such methods; files and other languages have none.
    """
    known = _of(facts, "kotlin").filter("name = 'class'").select("path", "class", F.col("names").alias("known"))
    methods = _of(facts, "method").filter(~_has(C.ACC_BRIDGE) & ~_has(C.ACC_SYNTHETIC) & ~F.col("member").isin("<init>", "<clinit>"))
    return methods.join(known, ["path", "class"]).filter(~F.array_contains("known", F.col("member"))).select("class", F.col("member").alias("method")).distinct()


def annotations(facts: DataFrame) -> DataFrame:
    """(class, method, annotation, params): method null for the class; generated methods, fields and compilers' own annotations are left out."""
    found = _of(facts, "note").filter(~F.col("name").isin(*COMPILER_NOTES))
    # a field's descriptor has no parameter list
    found = found.filter(F.col("member").isNull() | (F.col("desc").startswith("(") & ~generated_method(F.col("member"))))
    return found.select("class", F.col("member").alias("method"), F.col("name").alias("annotation"), "params")


def annotated(found: DataFrame, pattern: str, methods: bool = False) -> DataFrame:
    """(class, methods): classes with an annotation that matches on them or, if asked, on a method; the matching methods, sorted."""
    hit = found.filter(F.col("annotation").rlike("(?i)" + pattern))
    if not methods:
        hit = hit.filter("method is null")
    return hit.groupBy("class").agg(F.array_sort(F.collect_set("method")).alias("methods"))


def string_constants(facts: DataFrame, pattern: str = "") -> DataFrame:
    """(class, method, value, source_file) of string literals in methods that are not generated; pattern: a regex to be found."""
    found = _of(facts, "text").filter(~generated_method(F.col("member")) & F.col("value").rlike(pattern)).select("class", F.col("member").alias("method"), "value")
    return found.join(classes(facts).select("class", "source_file"), "class").select("class", "method", "value", "source_file")


def class_kinds(facts: DataFrame, models: Iterable[str] = ()) -> DataFrame:
    """(class, kind): interface, record, annotated model, abstract, data class, else concrete."""
    is_model = _of(facts, "note").filter(F.col("member").isNull() & F.col("name").isin(*models)).select("class").distinct().withColumn("model", F.lit(True))
    parts = _of(facts, "method").filter(F.col("member").isin("component1", "copy")).groupBy("class").agg((F.countDistinct("member") == 2).alias("data"))
    rows = _of(facts, "class").join(is_model, "class", "left").join(parts, "class", "left")
    kind = F.when(_has(C.ACC_INTERFACE), "INTERFACE").when(_has(C.ACC_RECORD), "RECORD").when(F.col("model"), "ANNOTATED_MODEL").when(_has(C.ACC_ABSTRACT), "ABSTRACT").when(F.col("data"), "DATA_CLASS")
    return rows.select("class", kind.otherwise("CONCRETE").alias("kind")).distinct()


def package_deps(facts: DataFrame, external: bool = False, prefix: str = "", targets: bool = True) -> DataFrame:
    """(src_pkg, tgt_pkg, src_class, tgt_class), distinct, of top-level classes in different packages.

    Targets are classes of the same facts unless external; prefix holds for both ends, or with
    targets false for the source only.
    """
    own = project_classes(facts)
    refs = _of(facts, "ref").select(N.top_level(F.col("class")).alias("src_class"), N.top_level(F.col("owner")).alias("tgt_class")).distinct()
    if not external:
        refs = refs.join(own.withColumnRenamed("class", "tgt_class"), "tgt_class", "left_semi")
    refs = refs.filter(F.col("src_class").startswith(prefix) & (F.lit(not targets) | F.col("tgt_class").startswith(prefix)))
    return refs.select(N.package_name(F.col("src_class")).alias("src_pkg"), N.package_name(F.col("tgt_class")).alias("tgt_pkg"), "src_class", "tgt_class").filter("src_pkg <> tgt_pkg")


def receiver_types(facts: DataFrame) -> DataFrame:
    """(class, receiver): the first parameter's type, where it is a class, of static methods of file facades (*Kt)."""
    first = F.regexp_extract("desc", r"^\(L([^;]+);", 1)
    methods = _of(facts, "method").filter(_has(C.ACC_STATIC) & N.simple_name(F.col("class")).endswith("Kt") & (first != ""))
    return methods.select("class", F.translate(first, "/", ".").alias("receiver")).distinct()


USE = ("caller_class", "caller_method", "source_file", "target_owner", "target_name", "target_descriptor", "kind")


def _used(owner: str | None, method: str | None, field: str | None, type: str | None) -> Column:
    """Which `use` rows `find_usages` takes."""
    no, target, name = F.lit(False), F.col("owner"), F.col("name")
    by_owner = no if owner is None else target.rlike("(?i)" + owner)
    by_type = no if type is None else target.rlike("(?i)" + type)
    named = F.lit(True) if method is None else name == method
    if field is not None:
        title = field[:1].upper() + field[1:]
        by_owner &= F.when(F.col("value") == "METHOD_CALL", name.isin(*(p + title for p in ("get", "set", "is")))).otherwise(name == field)
    else:
        by_owner &= named
    return F.when(F.col("value") == "TYPE_REFERENCE", by_type).otherwise(by_owner | (by_type & named))


def usage_facts(facts: DataFrame, owner: str | None = None, method: str | None = None, field: str | None = None, type: str | None = None) -> DataFrame:
    """The rows and columns that `find_usages` reads of facts, asked the same; worth writing in place of the facts."""
    rows = (F.col("record") != "use") | _used(owner, method, field, type)
    return facts.filter(rows).select("record", "class", "member", "owner", "name", "desc", "value")


def find_usages(facts: DataFrame, owner: str | None = None, method: str | None = None, field: str | None = None, type: str | None = None, outside: str | None = None, generated: bool = True) -> DataFrame:
    """Sites (USE, distinct) where something is used.

    owner and type are case-insensitive regexes of which one at least is needed; method is exact; field
    is exact, takes get, set and is methods of that name too, and does not go with method. type finds
    instructions on the type and members of the type, and declarations that name it. Callers inside the
    package `outside` are left out, and generated callers unless wanted.
    """
    if owner is None and type is None:
        raise ValueError("find_usages needs owner or type")
    if field is not None and method is not None:
        raise ValueError("field and method exclude each other")
    used = _of(facts, "use").filter(_used(owner, method, field, type))
    sites = used.select("class", "member", "owner", "name", "desc", "value")
    if type is not None:
        inside = F.transform(F.regexp_extract_all("desc", F.lit(r"L([^;]+);"), F.lit(1)), lambda t: F.translate(t, "/", "."))
        says = facts.filter(F.col("record").isin("field", "method") & F.exists(inside, lambda t: t.rlike("(?i)" + type)))
        is_field = F.col("record") == "field"
        sites = sites.union(says.select("class", F.when(is_field, "<field>").otherwise(F.col("member")), F.when(is_field, F.col("class")).otherwise(F.lit(type)), "member", "desc", F.lit("TYPE_REFERENCE")))
    if outside is not None:
        sites = sites.filter(~F.col("class").startswith(outside + "."))
    if not generated:
        sites = sites.filter(~generated_method(F.col("member")) & ~N.is_generated(F.col("class")))
    files = _of(facts, "class").select("class", F.coalesce("value", F.lit(UNKNOWN)).alias("source_file")).dropDuplicates(["class"])
    found = sites.join(files, "class")
    return found.select(*(F.col(c).alias(n) for c, n in zip(("class", "member", "source_file", "owner", "name", "desc", "value"), USE, strict=True))).distinct()


DETAIL = "class string, source_file string, super_class string, interfaces array<string>, fields array<string>, methods array<string>, annotations array<string>"


def class_details(facts: DataFrame, pattern: str = "") -> DataFrame:
    """One row (DETAIL) per class that matches: members as `name: type` and `name(types): type` in order of name."""
    index = class_index(facts).filter(F.col("class").rlike("(?i)" + pattern) & ~N.is_synthetic(F.col("class")))
    short = lambda t: F.element_at(F.split(t, r"[./]"), -1)

    def shown(t: Column) -> Column:
        base = F.regexp_replace(t, r"^\[+", "")
        name = F.when(F.length(base) > 1, short(F.regexp_replace(base, r"^L|;$", "")))
        for letter, word in C._PRIMITIVES.items():
            name = name.when(base == letter, word)
        return F.concat(name, F.repeat(F.lit("[]"), F.length(t) - F.length(base)))

    args = F.array_join(F.transform(F.regexp_extract_all(F.regexp_extract("desc", r"^\((.*)\)", 1), F.lit(r"(\[*(?:L[^;]+;|[A-Z]))"), F.lit(1)), shown), ", ")
    result = shown(F.regexp_extract("desc", r"\)(.*)$", 1))
    gather = lambda df, c, name: df.groupBy("class").agg(F.array_sort(F.collect_list(c)).alias(name))
    own = gather(fields(facts), F.concat_ws(": ", "field", "type"), "fields")
    methods = gather(own_methods(facts), F.concat(F.col("member"), F.lit("("), args, F.lit("): "), result), "methods")
    notes = gather(annotations(facts).filter("method is null"), F.col("annotation"), "annotations")
    out = index
    for part in (own, methods, notes):
        out = out.join(part, "class", "left")
    none = F.array().cast("array<string>")
    return out.select("class", "source_file", "super_class", "interfaces", *(F.coalesce(c, none).alias(c) for c in ("fields", "methods", "annotations")))
