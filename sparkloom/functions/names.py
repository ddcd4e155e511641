"""Column helpers for dotted class and package names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def package_name(c: Column) -> Column:
    """Before the last dot; empty without one."""
    return F.regexp_extract(c, r"^(.*)\.", 1)


def simple_name(c: Column) -> Column:
    """After the last dot, then before the first dollar sign."""
    return F.substring_index(F.substring_index(c, ".", -1), "$", 1)


def is_test(c: Column) -> Column:
    return simple_name(c).rlike("Test(Kt)?$")


def is_generated(c: Column) -> Column:
    return c.contains("$")


def is_synthetic(c: Column) -> Column:
    return c.rlike(r"\$\d+$|\$lambda\$")


def top_level(c: Column) -> Column:
    return F.substring_index(c, "$", 1)


def outer_class(c: Column) -> Column:
    """Cut at the last dollar sign; null without one."""
    return F.when(c.contains("$"), F.regexp_extract(c, r"^(.*)\$", 1))


def collapse_lambda(c: Column) -> Column:
    """Drop trailing $N, and with it a trailing $lower..., until nothing changes: any number of such endings at once."""
    return F.regexp_replace(c, r"(?:(?:\$[a-z][^$]*)?\$\d+)+$", "")


def candidate_names(simple: Column) -> Column:
    """Array: the name without its last Kt or Test, without its last two of them, and so on; no empty name."""
    ends = F.regexp_extract_all(F.regexp_extract(simple, "((?:Kt|Test)+)$", 1), F.lit("(Kt|Test)"), 1)
    cut = lambda i: F.regexp_replace(simple, F.concat(F.lit("(?:Kt|Test){"), i.cast("string"), F.lit("}$")), F.lit(""))
    # a sequence from 1 to 0 would run backwards
    some = F.filter(F.transform(F.sequence(F.lit(0), F.size(ends)), cut), lambda x, i: (i > 0) & (x != ""))
    return some


def truncate_package(c: Column, depth: int, root: str = "") -> Column:
    """Without the prefix `root.`, the first `depth` segments; a package equal to root is not stripped."""
    stripped = F.when(c.startswith(root + "."), F.substring(c, len(root) + 2, 1 << 30)).otherwise(c) if root else c
    return F.array_join(F.slice(F.split(stripped, r"\."), 1, depth), ".")


def name_filter(pattern: str, qualified: Column, path: Column, simple: Column, file: Column) -> Column:
    """Case-insensitive search; a pattern with a dot looks at qualified names and paths, else at simple names and files."""
    p = "(?i)" + pattern
    return (qualified.rlike(p) | path.rlike(p)) if "." in pattern else (simple.rlike(p) | file.rlike(p))
