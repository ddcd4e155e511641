"""The star-schema tables seen as facts about a code base. All rows are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.util import table


def file_changes(spark: SparkSession, d: str) -> DataFrame:
    """An order is a commit, its customer the author, its parts the files."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"), F.col("l_quantity").cast("int").alias("added"), F.col("l_linenumber").alias("deleted"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date"), F.col("o_custkey").cast("string").alias("author"))
    return lines.join(orders, "l_orderkey").withColumnRenamed("l_orderkey", "commit_seq")


def classes(spark: SparkSession, d: str) -> DataFrame:
    """A part is a class in the package com.<type>.<brand>."""
    name = F.concat(F.lit("com."), F.lower("p_type"), F.lit("."), F.lower(F.translate("p_brand", "#", "")), F.lit(".P"), F.col("p_partkey").cast("string"))
    kind = F.when(F.col("p_size") < 10, "INTERFACE").when(F.col("p_size") < 20, "DATA_CLASS").when(F.col("p_size") < 45, "CONCRETE")
    return table(spark, d, "part").select("p_partkey", name.alias("class"), kind.alias("kind"), "p_size")


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """The class on a line calls the class on the next line of the order; flag and status name the methods."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    c = classes(spark, d).select("p_partkey", "class")
    a = lines.join(c, lines.l_partkey == c.p_partkey).select("l_orderkey", "l_linenumber", F.col("class").alias("caller_class"), F.concat(F.lit("m"), "l_returnflag").alias("caller_method"))
    b = lines.join(c, lines.l_partkey == c.p_partkey).select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("class").alias("callee_class"), F.concat(F.lit("m"), "l_linestatus").alias("callee_method"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("caller_class", "caller_method", "callee_class", "callee_method").distinct()


def trade_graph(spark: SparkSession, d: str) -> DataFrame:
    """Customer nation -> supplier nation, where it is ordered 1.5 times as often as the mean pair."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supp = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("tgt"))
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    w = line.join(o, line.l_orderkey == o.o_orderkey).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(supp, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("w"))
    mean = w.agg((F.sum("w") / F.count(F.lit(1))).alias("mean"))
    return w.crossJoin(F.broadcast(mean)).filter("src <> tgt and w > 1.5 * mean").select("src", "tgt")


def next_classes(spark: SparkSession, d: str) -> DataFrame:
    """(src, tgt): each class to the class on the line after it in its first order, and in its last."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next"))
    step = F.struct("l_orderkey", "l_linenumber", "next")
    ends = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy("l_partkey").agg(F.min(step).alias("first"), F.max(step).alias("last"))
    pairs = ends.select("l_partkey", F.explode(F.array("first.next", "last.next")).alias("next"))
    named = lambda key, name: classes(spark, d).select(F.col("p_partkey").alias(key), F.col("class").alias(name))
    return pairs.join(named("l_partkey", "src"), "l_partkey").join(named("next", "tgt"), "next").select("src", "tgt").distinct()


def supertypes(spark: SparkSession, d: str) -> DataFrame:
    """A package's interface of the least key is implemented by the package's concrete classes."""
    c = classes(spark, d).withColumn("pkg", F.regexp_extract("class", r"^(.*)\.", 1))
    first = c.filter("kind = 'INTERFACE'").groupBy("pkg").agg(F.min_by("class", "p_partkey").alias("supertype"))
    return c.filter("kind = 'CONCRETE'").join(first, "pkg").select("supertype", F.col("class").alias("implementor"))


def declared_methods(spark: SparkSession, d: str) -> DataFrame:
    """Every class declares the methods that lines can name."""
    return classes(spark, d).select("class", F.explode(F.array(*(F.lit(f"m{x}") for x in "AFNOR"))).alias("method"))


def supertype_index(spark: SparkSession, d: str) -> DataFrame:
    """Every class with its supertypes: concrete ones their package's interface, that one its type's first, which has an outside type above it."""
    c = classes(spark, d).withColumn("pkg", F.regexp_extract("class", r"^(.*)\.", 1)).withColumn("type", F.regexp_extract("class", r"^(com\.[^.]*)\.", 1))
    first = c.filter("kind = 'INTERFACE'").groupBy("pkg", "type").agg(F.min_by("class", "p_partkey").alias("supertype"), F.min("p_partkey").alias("k"))
    top = first.groupBy("type").agg(F.min_by("supertype", "k").alias("top"))
    own = c.filter("kind = 'CONCRETE'").join(first.select("pkg", "supertype"), "pkg", "left").select("class", "supertype")
    middle = first.join(top, "type").filter("supertype <> top").select(F.col("supertype").alias("class"), F.col("top").alias("supertype"))
    outside = top.select(F.col("top").alias("class"), F.concat(F.lit("java.lang."), F.initcap(F.element_at(F.split("type", r"\."), -1))).alias("supertype"))
    rest = c.filter("kind <> 'CONCRETE' or kind is null").join(middle.union(outside).select("class"), "class", "left_anti").select("class", F.lit(None).cast("string").alias("supertype"))
    return own.union(middle).union(outside).union(rest).select("class", "supertype", F.lit("INTERFACE").alias("kind"), F.lit(0).alias("place"))


def service_edges(spark: SparkSession, d: str) -> DataFrame:
    """A customer's class calls the supplier of each line, by a method named after the line's flag; a supplier calls the customer of its own number, and itself."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    line = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus").join(o, "l_orderkey")
    cust, supp = lambda c: F.concat(F.lit("app.client.C"), c.cast("string")), lambda c: F.concat(F.lit("app.store.S"), c.cast("string"))
    calls = line.select(cust(F.col("o_custkey")).alias("caller_class"), F.lit("buy").alias("caller_method"), supp(F.col("l_suppkey")).alias("callee_class"), F.concat(F.lit("sell"), "l_returnflag").alias("callee_method"))
    back = table(spark, d, "supplier").join(table(spark, d, "customer").select("c_custkey"), F.col("s_suppkey") == F.col("c_custkey")).select(supp(F.col("s_suppkey")), F.lit("send"), cust(F.col("c_custkey")), F.lit("take"))
    own = table(spark, d, "supplier").select(supp(F.col("s_suppkey")), F.lit("sellA"), supp(F.col("s_suppkey")), F.lit("count"))
    return calls.union(back).union(own).distinct()


def service_classes(spark: SparkSession, d: str) -> DataFrame:
    """(class, note): customers with a mark by their segment, and suppliers."""
    note = F.when(F.col("c_mktsegment") == "BUILDING", "org.springframework.stereotype.Service").when(F.col("c_mktsegment") == "MACHINERY", "org.springframework.transaction.annotation.Transactional")
    c = table(spark, d, "customer").select(F.concat(F.lit("app.client.C"), F.col("c_custkey").cast("string")).alias("class"), note.alias("note"))
    return c.union(table(spark, d, "supplier").select(F.concat(F.lit("app.store.S"), F.col("s_suppkey").cast("string")), F.when(F.col("s_acctbal") < 0, "org.springframework.cache.annotation.Cacheable")))


def service_tests(spark: SparkSession, d: str) -> DataFrame:
    """A user of an event tests the customer of that number."""
    return table(spark, d, "events").select(F.concat(F.lit("app.client.C"), F.col("user_id").cast("string")).alias("class"), F.lit("buy").alias("method")).distinct()


def log_texts(spark: SparkSession, d: str) -> DataFrame:
    """(log): a customer's orders as a log of changes, with renames, binary files, build output and both kinds of line ends."""
    line = table(spark, d, "lineitem")
    name = F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    path = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("build/x"), name))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("src/{old => new}/"), name))
        .when(F.col("l_returnflag") == "A", F.concat(F.lit("src/{ => deep}/{b}/"), name))
        .when(F.col("l_linestatus") == "F", F.concat(F.lit("lib/a.kt => lib/"), name))
        .otherwise(F.concat(F.lit("src/"), name))
    )
    count = lambda c: F.when(F.col("l_tax") < 0.02, F.lit("-")).otherwise(c.cast("int").cast("string"))
    row = F.concat_ws("\t", count(F.col("l_quantity")), count(F.col("l_linenumber")), path)
    commits = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    head = F.concat(F.lit("--h"), F.col("o_orderkey").cast("string"), F.lit("--"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("--"), F.lit("Ann "), F.col("o_custkey").cast("string"))
    end = F.when(F.col("o_custkey") % 2 == 0, F.lit("\n")).otherwise(F.lit("\r\n"))
    text = table(spark, d, "orders").join(commits, "o_orderkey", "left").select("o_custkey", F.concat(head, end, F.coalesce(F.concat_ws("", F.transform("rows", lambda r: F.concat(r, end))), F.lit("")), end).alias("text"))
    return text.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("text")), "").alias("log")).select("log")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Methods of all classes, and a field of each class without a kind."""
    c = classes(spark, d).select(F.regexp_extract("class", r"^(.*)\.", 1).alias("package"), "class", "kind")
    m = c.select("package", "class", F.explode(F.array(*(F.lit(f"m{x}") for x in "AFNOR"))).alias("symbol"), F.lit("METHOD").alias("kind"))
    return m.union(c.filter("kind is null").select("package", "class", F.lit("valueOfPart"), F.lit("FIELD")))


def notes(spark: SparkSession, d: str) -> DataFrame:
    """(class, method, annotation): on classes by size, on the method mA of the greatest."""
    c = classes(spark, d)
    name = F.when(F.col("p_size") < 10, "jakarta.persistence.Entity").when(F.col("p_size") < 20, "org.springframework.stereotype.Service").when(F.col("p_size") < 30, "org.springframework.transaction.annotation.Transactional").when(F.col("p_size") < 40, "com.acme.Own")
    of_class = c.select("class", F.lit(None).cast("string").alias("method"), name.alias("annotation")).filter("annotation is not null")
    return of_class.union(c.filter("p_size >= 35").select("class", F.lit("mA"), F.lit("jakarta.ws.rs.GET")))
