"""Duplicate groups of token sequences: each copy once, beside its group's first.

A match is a pair of places from which `least` tokens or more are equal, as long as they stay equal; in one file
the two ranges may not overlap. By falling length (ties by file and place of the first, then of the second) a match
stays unless both its ranges lie in ranges of matches that stay. That rule reads as sequential, but has a closed form:

- of the matches at a place only the longest can find its range uncovered, and
- a place's range is covered by then exactly if a longer place's range, from further left, contains it.

So the matches that stay are the first match of each place whose longest range is in no longer one: a group of m
copies gives m - 1 rows, all found by running maxima over the files.

The longest match of a place with other files comes from a search by sixteenths over hashes of token ranges: places that
agree on the next i * 16^k tokens with another file, for the greatest i below 16, go on together, with two places (of
different files) of each group that agrees on a step more; hashes of all i are made in one round, of which there are at most five below 2^20 tokens. Only places that are not all preceded by the
same token take part, others lie in a longer match. To tell them, one place in about `least` / 4 is hashed and dealt out first: equal windows pick
the same piece of theirs as anchor, so if one file alone holds an anchor, or equal tokens precede it wherever it is found, no match starts at a window
that picks it, and the window is not written. Matches within a file are found in the file's own row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.util import Scratch

ENDS = "file string, off int, length int, pfile string, poff int"
PAIRS = "file_a string, start_a int, file_b string, start_b int, length int"
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


class Ranges:
    """Hashes of any range of a file's tokens."""

    def __init__(self, tokens):
        x = np.asarray(tokens, np.int64).view(np.uint64)
        self.n = len(x)
        up = np.cumprod(np.append(np.uint64(1), np.full(self.n, _BASE, np.uint64)), dtype=np.uint64)
        self.down = np.cumprod(np.append(np.uint64(1), np.full(self.n, _BACK, np.uint64)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum(_mix(x) * up[:-1], dtype=np.uint64))

    def of(self, start: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def common(self, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
        """How many tokens are equal from a and b, a before b, of which `known` are known to be."""
        size = np.full(len(a), known)
        step = 1 << max(1, self.n).bit_length()
        while step := step >> 1:
            fits = np.flatnonzero(b + size + step <= self.n)
            same = self.of(a[fits] + size[fits], step) == self.of(b[fits] + size[fits], step)
            size[fits[same]] += step
        return size


def _files(batch: pa.RecordBatch):
    """(file, tokens) of the rows of a batch."""
    tokens = batch.column(1)
    flat, at = tokens.values.to_numpy(zero_copy_only=False), tokens.offsets.to_numpy().tolist()
    for file, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
        yield file, flat[a:b]


def _gathered(found, names: list[str], rows: int = 200_000):
    """Batches of about `rows` rows of tuples of columns: arrays of one length, and texts that stand for all their rows."""
    held: list[tuple] = []
    n = 0

    def flush():
        counts = [next(len(x) for x in h if not isinstance(x, str)) for h in held]
        columns = []
        for c in zip(*held, strict=True):
            if isinstance(c[0], str):
                columns.append(pa.array(c, pa.string()).take(pa.array(np.repeat(np.arange(len(c)), counts))))
            else:
                columns.append(pa.array(np.concatenate(c)))
        return pa.RecordBatch.from_arrays(columns, names=names)

    for h in found:
        held.append(h)
        n += next(len(x) for x in h if not isinstance(x, str))
        if n >= rows:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _picks(ranges: Ranges, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For the window of `least` tokens at each place where its anchor is; the hash of what an anchor holds at each place; how many places a window picks from.

    A window's anchor is the least, then first, of its pieces of least // 2 tokens: windows of equal tokens pick alike.
    """
    size = max(1, least // 2)
    held = ranges.of(np.arange(ranges.n - size + 1), size)
    wide = least - size + 1
    return np.arange(ranges.n - least + 1) + np.lib.stride_tricks.sliding_window_view(held, wide).argmin(1), held, wide


def _anchors(least: int):
    """Anchors of a file: hash of what they hold, and of the tokens before that a window could begin after; near a file's start that is its own."""

    def of(file: str, tokens: np.ndarray) -> tuple:
        ranges = Ranges(tokens)
        picks, held, wide = _picks(ranges, least)
        at = np.unique(picks)
        left = np.full(len(at), hash_of(file))
        far = at >= wide
        left[far] = ranges.of(at[far] - wide, wide).view(np.int64)
        return file, at.astype(np.int32), held[at].view(np.int64), left

    def run(batches):
        found = (of(file, tokens) for batch in batches for file, tokens in _files(batch) if len(tokens) >= least)
        yield from _gathered(found, ["file", "off", "h", "before"])

    return run


def _windows(least: int):
    """Places of a file whose anchors are listed: hash of their window, and of the token before; that of a file's start is its own."""

    def of(file: str, tokens: np.ndarray, anchors: np.ndarray) -> tuple:
        ranges = Ranges(tokens)
        listed = np.zeros(ranges.n, bool)
        listed[anchors] = True
        at = np.flatnonzero(listed[_picks(ranges, least)[0]])
        before = np.append(np.int64(hash_of(file)), tokens)
        return file, at.astype(np.int32), ranges.of(at, least).view(np.int64), before[at]

    def found(batches):
        for batch in batches:
            flat, at = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            for row, (file, tokens) in enumerate(_files(batch)):
                yield of(file, tokens, flat[at[row] : at[row + 1]])

    return lambda batches: _gathered(found(batches), ["file", "off", "h", "before"])


def hash_of(s: str) -> int:
    return int(pd.util.hash_array(np.array([s], object))[0].view(np.int64))


def _own_pairs(tokens: np.ndarray, least: int, pairs: int = 1_000_000):
    """Matches (starts, later starts, lengths) within a file that no token to the left makes longer, some pairs at a time."""
    n = len(tokens) - least + 1
    if n < 2:
        return
    ranges = Ranges(tokens)
    h = ranges.of(np.arange(n), least)
    order = np.argsort(h, kind="stable")
    new = h[order][1:] != h[order][:-1]
    if new.all():
        return
    cut = np.flatnonzero(np.concatenate(([True], new, [True])))
    size = np.diff(cut)
    before = np.append(np.int64(0), tokens[: n - 1])
    first = order[cut[:-1]]
    unlike = np.add.reduceat(before[order] != np.repeat(before[first], size), cut[:-1]) > 0
    partners = np.repeat(np.where((size > 1) & ((first == 0) | unlike), cut[1:], 0), size) - np.arange(n) - 1
    left = np.flatnonzero(partners > 0)
    upto = np.cumsum(partners[left])
    for some in np.split(left, np.flatnonzero(np.diff(upto // pairs)) + 1):
        if not len(some):
            continue
        m = partners[some]
        q = np.repeat(some, m)
        a, b = order[q], order[q + 1 + np.arange(len(q)) - np.repeat(np.cumsum(m) - m, m)]
        starts = (before[b] != before[a]) | (a == 0)
        a, b = a[starts], b[starts]
        long = ranges.common(a, b, least)
        short = np.minimum(long, b - a)  # ranges that would overlap start later
        good = short >= least
        if good.any():
            yield (a + long - short)[good], (b + long - short)[good], short[good]


def _within(least: int):
    """Ends of the matches within one file (ENDS)."""

    def of(file: str, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple:
        both, other = np.append(a, b).astype(np.int32), np.append(b, a).astype(np.int32)
        return file, both, np.append(length, length).astype(np.int32), file, other

    def run(batches):
        found = (of(file, *match) for batch in batches for file, tokens in _files(batch) for match in _own_pairs(tokens, least))
        yield from _gathered(found, ["file", "off", "length", "pfile", "poff"])

    return run


#: Lengths that a round of the search tries at once, the known one among them.
FAN = 16


def _next(step: int):
    """Places with the hashes of the i * step tokens after those they are known to share, and of a step less, for each i that the file has room for."""

    def of(file: str, tokens: np.ndarray, group: np.ndarray, off: np.ndarray, lo: np.ndarray, search: np.ndarray) -> tuple:
        ranges, start = Ranges(tokens), off.astype(np.int64) + lo
        at, i, h, less = [], [], [], []
        for k in range(FAN):
            fits = np.flatnonzero(start + k * step <= ranges.n)
            at.append(fits)
            i.append(np.full(len(fits), k, np.int32))
            h.append(ranges.of(start[fits], k * step).view(np.int64))
            less.append(ranges.of(start[fits], max(0, k - 1) * step).view(np.int64))
        at = np.concatenate(at)
        return group[at], file, off[at], lo[at], search[at], np.concatenate(i), np.concatenate(h), np.concatenate(less)

    def places(batches):
        for batch in batches:
            columns = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(k) for k in range(2, 6))]
            for row, (file, tokens) in enumerate(_files(batch)):
                yield of(file, tokens, *(flat[at[row] : at[row + 1]] for flat, at in columns))

    return lambda batches: _gathered(places(batches), ["set", "file", "off", "lo", "search", "i", "h", "less"])


def _two(places: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the first places of its first two files, with their rank."""
    order = Window.partitionBy(*by).orderBy("file")
    first = places.groupBy(*by, "file").agg(F.min("off").alias("off"), F.min("lo").alias("lo"))
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 2)


def _starting(places: DataFrame) -> DataFrame:
    """Places (file, off, h, before) of hashes that two files hold, not all after the same."""
    ends = places.groupBy("h").agg(*(F.min(c).alias(f"{c}0") for c in ("file", "before")), *(F.max(c).alias(f"{c}1") for c in ("file", "before")))
    return places.join(ends.filter("file0 <> file1 and before0 <> before1").select("h"), "h")


def _further(looked: DataFrame, step: int) -> DataFrame:
    """The places that go on, each in the set of those that agree on as many steps as it does with another file.

    All groups lie inside sets, so rows are dealt out once, by set, and windows see the rest.
    """
    group = ["set", "i", "h"]
    w, longest = Window.partitionBy(*group), Window.partitionBy("set", "file", "off", "lo", "search").orderBy(F.desc("i"), F.desc("h"))
    found = looked.repartition("set").withColumns({"f0": F.min("file").over(w), "f1": F.max("file").over(w), "any": F.max("search").over(w)}).filter("f0 <> f1 and any")
    # two places of each group that goes on may be partners of those that end a step before it: the first of its first two files
    by = Window.partitionBy(*group, "less").orderBy("file", "off")
    new = F.coalesce(F.lag("file").over(by) != F.col("file"), F.lit(True))
    found = found.drop("f0", "f1", "any").withColumn("far", F.row_number().over(longest) == 1).withColumn("new", new)
    found = found.withColumn("nth", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.struct("i", "h", (F.col("lo") + F.col("i") * step).alias("lo"), F.col("search"))
    stand = F.struct((F.col("i") - 1).alias("i"), F.col("less").alias("h"), (F.col("lo") + (F.col("i") - 1) * step).alias("lo"), F.lit(False).alias("search"))
    both = F.array_compact(F.array(F.when(F.col("far"), own), F.when((F.col("i") > 0) & F.col("new") & (F.col("nth") <= 2), stand)))
    rows = found.select("set", "file", "off", F.inline(both))
    rows = rows.withColumn("alive", F.max("search").over(w)).filter("alive")
    return rows.select(F.xxhash64(*group, F.lit(step)).alias("set"), "file", "off", "lo", "search")


def _across(files: DataFrame, longest: int, least: int, scratch: Scratch) -> DataFrame:
    """The longest match of places with other files (ENDS), with the first of its partners."""
    hashed = "file string, off int, h long, before long"
    anchors = scratch.keep(files.mapInArrow(_anchors(least), hashed))
    wants = scratch.keep(_starting(anchors).groupBy("file").agg(F.collect_list("off").alias("w")))
    scratch.drop(anchors)
    places = scratch.keep(files.join(wants, "file").select("file", "tokens", "w").mapInArrow(_windows(least), hashed))
    now = scratch.keep(_starting(places).select(F.col("h").alias("set"), "file", "off", F.lit(least).alias("lo"), F.lit(True).alias("search")))
    scratch.drop(places, wants)
    step = 1
    while step * FAN <= longest - least:
        step *= FAN
    while step:
        wants = now.groupBy("file").agg(F.collect_list(F.struct("set", "off", "lo", "search")).alias("w")).select("file", *(F.col(f"w.{c}") for c in ("set", "off", "lo", "search")))
        tried = files.join(wants, "file").select("file", "tokens", "set", "off", "lo", "search").mapInArrow(_next(step), "set long, file string, off int, lo int, search boolean, i int, h long, less long")
        before, now = now, scratch.keep(_further(tried, step))
        scratch.drop(before)
        step //= FAN
    firsts = _two(now, ["set"]).groupBy("set").agg(*(F.min(F.when(F.col("rank") == r, F.struct("file", "off"))).alias(f"p{r}") for r in (1, 2)))
    found = now.filter("search").join(firsts, "set").withColumn("p", F.when(F.col("p1.file") != F.col("file"), F.col("p1")).otherwise(F.col("p2")))
    return found.select("file", "off", F.col("lo").alias("length"), F.col("p.file").alias("pfile"), F.col("p.off").alias("poff")).filter("pfile is not null")


def settle(ends: DataFrame) -> DataFrame:
    """The matches (PAIRS) that stay, from both ends (ENDS) of all that matter."""
    best = ends.groupBy("file", "off").agg(F.max("length").alias("length"))
    earlier = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("off") + F.col("length")
    open_ = best.withColumn("cover", F.max(reach).over(earlier)).filter(F.col("cover").isNull() | (F.col("cover") < reach)).select("file", "off", "length")
    own, other = F.struct(F.col("file").alias("f"), F.col("off").alias("o")), F.struct(F.col("pfile").alias("f"), F.col("poff").alias("o"))
    at = ends.join(open_, ["file", "off", "length"]).withColumn("own", own).withColumn("other", other)
    first = at.groupBy("own", "length").agg(F.coalesce(F.min(F.when(F.col("other") < F.col("own"), F.col("other"))), F.min("other")).alias("other"))
    a, b = F.least("own", "other"), F.greatest("own", "other")
    return first.select(a.alias("a"), b.alias("b"), "length").select(F.col("a.f").alias("file_a"), F.col("a.o").alias("start_a"), F.col("b.f").alias("file_b"), F.col("b.o").alias("start_b"), "length").distinct()


def duplicate_groups(tokens: DataFrame, scratch: Scratch, least: int = 50) -> DataFrame:
    """(PAIRS and first and last line of both) of the matches that stay, from tokens (file, offset, text, line; type if there is one).

    Offsets run from 0 in each file. Ranges are compared by 64-bit hashes. A file is worked on in one row.
    """
    what = F.xxhash64("type", "text") if "type" in tokens.columns else F.xxhash64("text")
    one = tokens.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", what.alias("t"), "line"))).alias("s"))
    kept = scratch.keep(one.filter(F.size("s") >= least).select("file", F.col("s.t").alias("tokens"), F.col("s.line").alias("lines")))
    files = kept.select("file", "tokens")
    longest = files.agg(F.max(F.size("tokens"))).first()[0] or 0
    within = files.mapInArrow(_within(least), ENDS)
    ends = scratch.keep(within.union(_across(files, longest, least, scratch)) if longest else within)
    runs = scratch.keep(settle(ends))
    for side in ("a", "b"):
        lines = kept.select(F.col("file").alias(f"file_{side}"), "lines")
        start = F.col(f"start_{side}")
        ends_at = (F.get("lines", at).alias(f"{end}_line_{side}") for end, at in (("first", start), ("last", start + F.col("length") - 1)))
        runs = runs.join(lines, f"file_{side}").select(*runs.columns, *ends_at)
    return runs
