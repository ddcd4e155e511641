"""What a rename or a move would touch, told from class files: the places (file, line, kind), for many targets at once.

No source is written. Facts are those of `sources.bytecode`; targets are rows, so one pass answers for all of them.
A companion object counts as its class. Lines are null where a class keeps none. Every result has the
columns of the targets, then `kind`, `site_class`, `site_method`, `source_path` and `line`, distinct rows.
Null targets touch nothing; repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import names as N
from sparkloom.operators.graph import fixpoint
from sparkloom.sources import bytecode as B, classfile as C
from sparkloom.util import Scratch

#: How Kotlin names a companion's class, and a method's entry for calls that leave out arguments.
COMPANION, DEFAULTS = "$Companion", "$default"
#: Methods that compilers make of a class's properties; the second kind only where it has no lines.
COPIES, SHOWN = r"^(copy|component\d+)$", ("toString", "hashCode", "equals")
SITE = ("kind", "site_class", "site_method", "source_path", "line")


def _of(facts: DataFrame, record: str) -> DataFrame:
    return facts.filter(F.col("record") == record)


def _flag(flag: int) -> Column:
    return F.col("access").bitwiseAND(flag) != 0


def _owners(targets: DataFrame) -> DataFrame:
    """Targets with `owner`: the class, and its companion."""
    rows = targets.dropna().distinct()
    return rows.select("*", F.explode(F.array("class", F.concat("class", F.lit(COMPANION)))).alias("owner"))


def _written(facts: DataFrame) -> DataFrame:
    """Instruction sites in code that a person wrote: lambda bodies count, bridges and entries for left-out arguments do not."""
    made = _flag(C.ACC_BRIDGE) | F.col("member").endswith(DEFAULTS) | F.col("member").startswith("access$")
    rows = _of(facts, "site").filter(~made)
    return rows.select(F.col("class").alias("site_class"), F.col("member").alias("site_method"), F.col("owner").alias("at"), "name", "desc", F.col("value").alias("kind"), "line")


def _methods(facts: DataFrame) -> DataFrame:
    """(owner, name, desc, line) of declared methods, bridges left out."""
    return _of(facts, "method").filter(~_flag(C.ACC_BRIDGE)).select(F.col("class").alias("owner"), F.col("member").alias("name"), "desc", "line")


def _located(found: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    files = B.classes(facts).groupBy(F.col("class").alias("site_class")).agg(F.min("source_path").alias("source_path"))
    return found.join(files, "site_class").select(*keys, *SITE).distinct()


def _above(facts: DataFrame) -> DataFrame:
    """(at, super): every class with what it extends and implements."""
    return _of(facts, "class").select(F.col("class").alias("at"), F.explode(F.array_compact(F.concat("names", F.array("name")))).alias("super")).distinct()


def _calls(facts: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """wanted (class, method, owner) with the sites that call or refer to what the owner declares.

    A site names the type it calls through. Types below the owner stand for it as long as none between
    declares the same name and descriptor: they are found in rounds, downwards from the owners, so only
    what lies below a target is ever walked. An owner outside the facts declares whatever is called.
    """
    sites = _written(facts).filter(F.col("kind").isin("CALL", "REFERENCE"))
    named = wanted.select("*", F.explode(F.array("method", F.concat("method", F.lit(DEFAULTS)))).alias("name"))
    sites = scratch.keep(sites.join(named.select("name").distinct(), "name", "left_semi"))
    declared = scratch.keep(_methods(facts).select(F.col("owner").alias("at"), "name", "desc").join(named.select("name").distinct(), "name", "left_semi").distinct())
    known = _of(facts, "class").select(F.col("class").alias("owner")).distinct()
    inside = named.join(declared.withColumnRenamed("at", "owner"), ["owner", "name"])
    outside = named.join(known, "owner", "left_anti").join(sites.select("name", "desc").distinct(), "name")
    columns = ["class", "method", "name", "desc"]
    start = inside.select(*columns, F.col("owner").alias("at")).unionByName(outside.select(*columns, F.col("owner").alias("at")))
    below = scratch.keep(_above(facts).select(F.col("at").alias("sub"), F.col("super").alias("at")))
    step = lambda now: now.join(below, "at").select(*columns, F.col("sub").alias("at")).join(declared, ["at", "name", "desc"], "left_anti")
    reach = fixpoint(start, step, scratch)
    return reach.join(sites, ["at", "name", "desc"])


def rename_method(facts: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Sites of renaming targets (class, method).

    DECLARATION: in the class, its companion, and classes that extend or implement it directly (anonymous ones and
    those further below are not asked). CALL: what resolves to the class or its companion, calls with left-out
    arguments included. REFERENCE: a method reference, which is no call in the source.
    """
    wanted = scratch.keep(_owners(targets.select("class", "method")))
    direct = B.supertypes(facts).select(F.col("supertype").alias("class"), F.col("implementor").alias("owner")).distinct()
    places = wanted.union(targets.select("class", "method").dropna().distinct().join(direct, "class").select("class", "method", "owner"))
    own = _methods(facts).select("owner", F.col("name").alias("method"), "line").join(places, ["owner", "method"])
    made = own.select("class", "method", F.lit("DECLARATION").alias("kind"), F.col("owner").alias("site_class"), F.col("method").alias("site_method"), "line")
    used = _calls(facts, wanted, scratch).select("class", "method", "kind", "site_class", "site_method", "line")
    return _located(made.union(used), facts, ["class", "method"])


def rename_parameter(facts: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Sites of renaming targets (class, method, param); constructors are methods `<init>`.

    PARAMETER: the declaration. READ, WRITE: lines of the body that use it. CALL: calls that may name the argument.
    CASCADE: a method that the body calls on a line that reads the parameter, and that has a parameter of the same
    name; the site is that method. PROPERTY: the class has a field of the name too, so the whole property may be meant.
    """
    keys = ["class", "method", "param"]
    wanted = scratch.keep(_owners(targets.select(keys)))
    params = scratch.keep(_of(facts, "param").select(F.col("class").alias("owner"), F.col("member").alias("method"), "desc", F.col("name").alias("param")).distinct())
    hit = scratch.keep(wanted.join(params, ["owner", "method", "param"]))
    lines = _methods(facts).withColumnRenamed("name", "method")
    site = lambda rows, kind: rows.select(*keys, F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), "site_class", "site_method", "line")
    made = hit.join(lines, ["owner", "method", "desc"]).withColumns({"site_class": F.col("owner"), "site_method": F.col("method")})
    local = _of(facts, "local").select(F.col("class").alias("owner"), F.col("member").alias("method"), "desc", F.col("name").alias("param"), "value", "line")
    body = scratch.keep(hit.join(local, ["owner", "method", "desc", "param"]).withColumns({"site_class": F.col("owner"), "site_method": F.col("method")}))
    calls = _calls(facts, hit.select("class", "method", "owner").distinct(), scratch)
    stub = F.col("name").endswith(DEFAULTS)  # its descriptor is not the method's
    calls = calls.join(hit.select(*keys, F.col("desc").alias("own")).distinct(), ["class", "method"]).filter((F.col("desc") == F.col("own")) | stub).filter("kind = 'CALL'")
    reads = body.filter("value = 'READ'").select(*keys, "site_class", "site_method", F.col("line").alias("read")).distinct()
    on = _written(facts).filter("kind = 'CALL'").join(reads, ["site_class", "site_method"]).filter(F.col("line").eqNullSafe(F.col("read")))
    on = on.select(*keys, F.col("at").alias("owner"), F.regexp_replace("name", r"\$default$", "").alias("called"), F.when(~stub, F.col("desc")).alias("seen"))
    same = params.withColumnRenamed("method", "called").join(lines.withColumnRenamed("method", "called"), ["owner", "called", "desc"])
    passed = on.join(same, ["owner", "called", "param"]).filter(F.col("seen").isNull() | (F.col("seen") == F.col("desc")))
    passed = passed.filter((F.col("owner") != F.col("class")) | (F.col("called") != F.col("method"))).withColumns({"site_class": F.col("owner"), "site_method": F.col("called")})
    fields = _of(facts, "field").select(F.col("class").alias("owner"), F.col("member").alias("param")).distinct()
    whole = hit.filter("method = '<init>'").join(fields, ["owner", "param"]).withColumns({"site_class": F.col("owner"), "site_method": F.col("method"), "line": F.lit(None).cast("int")})
    found = site(made, "PARAMETER").union(site(body, F.col("value"))).union(site(calls, "CALL")).union(site(passed, "CASCADE")).union(site(whole, "PROPERTY"))
    return _located(found, facts, keys)


def rename_property(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Sites of renaming targets (class, property).

    FIELD: the declaration. PARAMETER: a constructor that takes it by this name. READ, WRITE: uses of the field or
    of its accessors (getX, isX, setX; of a property isX: isX and setX), references to them included. ARGUMENT: calls of the
    class's methods and constructors with a parameter of this name, copy among them, which may name it. Code that the
    compiler makes, and the accessors themselves, are no sites.
    """
    keys = ["class", "property"]
    wanted = _owners(targets.select(keys))
    name = F.col("property")
    title = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
    bare = F.when(name.rlike("^is[A-Z]"), F.substring(name, 3, 1 << 30)).otherwise(title)
    reader = F.when(name.rlike("^is[A-Z]"), F.array(name)).otherwise(F.array(F.concat(F.lit("get"), title), F.concat(F.lit("is"), title)))
    accessors = F.concat(F.transform(reader, lambda x: F.struct(x.alias("name"), F.lit("READ").alias("as"))), F.array(F.struct(F.concat(F.lit("set"), bare).alias("name"), F.lit("WRITE").alias("as"))))
    ways = wanted.select(*keys, F.col("owner").alias("at"), F.inline(accessors))
    fields = _of(facts, "field").filter(~_flag(C.ACC_SYNTHETIC)).select(F.col("class").alias("owner"), F.col("member").alias("property"))
    made = wanted.join(fields, ["owner", "property"]).select(*keys, F.lit("FIELD").alias("kind"), F.col("owner").alias("site_class"), F.lit(None).cast("string").alias("site_method"), F.lit(None).cast("int").alias("line"))
    params = _of(facts, "param").select(F.col("class").alias("owner"), F.col("member").alias("method"), "desc", F.col("name").alias("property")).distinct()
    has = wanted.join(params, ["owner", "property"])
    lines = _methods(facts).withColumnRenamed("name", "method")
    taken = has.filter("method = '<init>'").join(lines, ["owner", "method", "desc"]).select(*keys, F.lit("PARAMETER"), F.col("owner"), "method", "line")
    by_compiler = F.col("site_method").rlike(COPIES) | (F.col("site_method").isin(*SHOWN) & F.col("line").isNull())
    sites = _written(facts).filter(~by_compiler)
    on_field = sites.filter(F.col("kind").isin("READ", "WRITE")).join(wanted.select(*keys, F.col("owner").alias("at"), F.col("property").alias("name")), ["at", "name"])
    on_access = sites.filter(F.col("kind").isin("CALL", "REFERENCE")).join(ways, ["at", "name"]).withColumn("kind", F.col("as"))
    used = on_field.select(*keys, "kind", "site_class", "site_method", "line").union(on_access.select(*keys, "kind", "site_class", "site_method", "line"))
    itself = ways.select(*keys, F.col("at").alias("site_class"), F.col("name").alias("site_method"))
    used = used.join(itself, [*keys, "site_class", "site_method"], "left_anti").select(*keys, "kind", "site_class", "site_method", "line")
    stub = F.col("name").endswith(DEFAULTS)
    calls = sites.filter("kind = 'CALL'").select("site_class", "site_method", "line", F.col("at").alias("owner"), F.regexp_replace("name", r"\$default$", "").alias("method"), F.when(~stub, F.col("desc")).alias("seen"))
    named = calls.join(has, ["owner", "method"]).filter(F.col("seen").isNull() | (F.col("seen") == F.col("desc"))).select(*keys, F.lit("ARGUMENT"), "site_class", "site_method", "line")
    return _located(made.union(taken).union(used).union(named), facts, keys)


def move_class(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """(class, new_class, kind, site_class, source_path, new_path) of moving targets (class, new_class).

    A file facade (…Kt) moves every top-level class of its file with it, each under its own name in the new package; another
    class moves alone, with its nested classes. MOVED: a moved class; new_path is its file in the new package, named
    after new_class where the file is named after the class. REFERENCE: a class outside the move that refers to a moved one.
    References are dealt out twice, by their own class and by the moved one; those into packages that nothing moves in are left out first.
    """
    keys = ["class", "new_class"]
    scratch = Scratch(facts.sparkSession, "move")
    rows = targets.select(keys).dropna().distinct()
    files = scratch.keep(B.classes(facts).select(F.col("class").alias("site_class"), "source_path").distinct())
    top = N.top_level(F.col("site_class"))
    facade = F.col("class").endswith("Kt")
    heads = files.filter("site_class like '%Kt'").select(F.col("site_class").alias("class"), "source_path")
    heads = scratch.keep(rows.filter(facade).join(heads, "class").filter(F.col("source_path") != B.UNKNOWN))
    whole = heads.join(files.select(top.alias("top"), "source_path"), "source_path").select(*keys, "top")
    here = files.filter(F.col("site_class") == top).select(F.col("site_class").alias("class"))
    alone = scratch.keep(rows.join(here, "class", "left_semi").select(*keys, F.col("class").alias("top")))
    many = scratch.keep(whole.union(alone.filter(facade)).distinct())
    moved = alone.filter(~facade).union(many)
    package, stem = F.translate(N.package_name(F.col("new_class")), ".", "/"), lambda c: F.regexp_replace(N.simple_name(c), "Kt$", "")
    file, kind = F.element_at(F.split("source_path", "/"), -1), F.regexp_extract("source_path", r"(\.[^./]*)$", 1)
    named = F.when(file == F.concat(stem(F.col("class")), kind), F.concat(stem(F.col("new_class")), kind)).otherwise(file)
    path = F.when(F.col("source_path") == B.UNKNOWN, F.lit(None)).otherwise(F.when(package == "", named).otherwise(F.concat(package, F.lit("/"), named)))
    there = moved.join(files.withColumn("top", top), "top").select(*keys, F.lit("MOVED").alias("kind"), "site_class", "source_path", path.alias("new_path"))
    packages = scratch.keep(moved.select(N.package_name(F.col("top")).alias("package")).distinct())
    refs = _of(facts, "ref").select(F.col("class").alias("site_class"), N.top_level(F.col("owner")).alias("top"), N.package_name(N.top_level(F.col("owner"))).alias("package"))
    refs = refs.filter(F.col("top") != top).join(packages, "package", "left_semi").select("site_class", "top")
    refs = refs.repartition("site_class").distinct().join(files, "site_class")
    site = lambda using: using.select(*keys, F.lit("REFERENCE"), "site_class", "source_path", F.lit(None).cast("string"))
    out = there.union(site(alone.filter(~facade).join(refs, "top")))  # one moved class for each target, so rows are distinct
    if many.isEmpty():
        return out
    own = many.select(*keys, F.col("top").alias("own"))
    using = many.join(refs, "top").withColumn("own", top).join(own, [*keys, "own"], "left_anti")
    return out.union(site(using).distinct())
