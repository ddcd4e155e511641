"""Source text to tokens, one pass per file in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Keywords of both languages.
KEYWORDS = frozenset(
    """abstract as break class continue do else enum false finally for fun if import in interface
    internal is null object open package private protected public return sealed super this throw
    true try val var when while
    boolean byte case catch char const default double extends final float goto implements
    instanceof int long native new short static strictfp switch synchronized throws transient void
    volatile
    by companion constructor crossinline data delegate dynamic field file get init inline inner
    lateinit noinline operator out override reified set suspend tailrec typealias vararg where""".split()
)
#: Operators of several characters, in the order they are tried.
OPERATORS = ("===", "!==", "==", "!=", "<=", ">=", "&&", "||", "->", "::", "+=", "-=", "*=", "/=", "%=", "++", "--", "..", "?:", "?.")

_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)"
    r"|(?P<literal>\"\"\".*?(?:\"\"\"|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|\d[\w.]*)"
    r"|(?P<word>[^\W\d]\w*)"
    r"|(?P<op>" + "|".join(map(re.escape, OPERATORS)) + r"|[-+*/%=<>!&|^~?:;.,(){}\[\]@#])",
    re.S,
)
TOKENS = "file string, offset int, type string, text string, line int"


def tokenize(source: str) -> list[tuple[str, str, int]]:
    """(type, text, line). Comments and white space are skipped; a line break inside a plain string is not counted."""
    out, line, at = [], 1, 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            at += 1
            continue
        text, kind = m[0], m.lastgroup
        if kind == "literal":
            out.append(("LITERAL", text, line))
        elif kind == "word":
            out.append(("KEYWORD" if text in KEYWORDS else "IDENTIFIER", text, line))
        elif kind == "op":
            out.append(("OPERATOR", text, line))
        if kind == "skip" or text.startswith('"""'):
            line += text.count("\n")
        at = m.end()
    return out


def token_table(files: DataFrame) -> DataFrame:
    """(file, text) -> a row per token; null texts have none."""

    def run(batches):
        for pdf in batches:
            for file, text in zip(pdf["file"], pdf["text"], strict=True):
                found = tokenize(text or "")
                if found:
                    kinds, texts, lines = zip(*found, strict=True)
                    yield pd.DataFrame({"file": file, "offset": range(len(found)), "type": kinds, "text": texts, "line": lines})

    return files.selectExpr("cast(file as string) file", "text").mapInPandas(run, TOKENS)


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(file, text) of the Kotlin and Java files below a folder, named by their path from it; Spark reads no empty file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{kt,java}").load(root)
    top = F.lit(root.rstrip("/").split("://")[-1].lstrip("/") + "/")
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "")
    return found.select(F.substring(path, F.length(top) + 1, F.length(path)).alias("file"), F.decode("content", "UTF-8").alias("text"))


def line_counts(files: DataFrame) -> DataFrame:
    """(file, lines): lines as an editor counts them, a last line break opening none."""
    text = F.regexp_replace("text", "\\r\\n?", "\n")
    lines = F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1))
    return files.select("file", F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(lines).cast("long").alias("lines"))
