"""Queries on source text and on annotations of frameworks, and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import clones, diffs, presets as R
from sparkloom.plans import adapters as A, catalogue
from sparkloom.sources import gitlog as L, tokens as T
from sparkloom.util import Scratch, table


def word_tokens(s, d):
    """(file, offset, text, line): the words of each document in their lines."""
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line", "row"))
    by_line = docs.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("line", "row"))).alias("rows"))
    row_words = lambda r: F.regexp_extract_all(r["row"], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    words = F.flatten(F.transform("rows", lambda r: F.transform(row_words(r), lambda w: F.struct((r["line"] + 1).alias("line"), w.alias("text")))))
    return by_line.select("file", F.posexplode(words).alias("offset", "t")).select("file", "offset", "t.text", "t.line")


#: Annotations inside and outside the lists of frameworks, by a customer's nation.
MARKS = ("org.springframework.lang.Nullable", "jakarta.annotation.Nullable", "jakarta.annotation.PostConstruct", "org.springframework.context.annotation.Bean", "org.junit.jupiter.api.Test")


def _marks(s, d):
    mark = F.element_at(F.array(*map(F.lit, MARKS)), F.col("c_nationkey") % 5 + 1)
    method = F.when(F.col("c_custkey") % 2 == 0, "open")
    return table(s, d, "customer").select(F.concat(F.lit("app.client.C"), F.col("c_custkey").cast("string")).alias("class"), method.alias("method"), mark.alias("annotation"))


def _listed(s, d):
    a = F.col("annotation")
    return _marks(s, d).select("class", "method", R.framework_of(a).alias("framework"), R.is_entry_point(a).alias("entry"), R.is_entry_point(a, ["Spring"]).alias("but_spring"))


def _hints(s, d):
    notes = _marks(s, d)
    return R.entry_point_hints(notes.select("class", F.explode(F.array(F.lit("open"), F.lit("close"))).alias("method")), notes)


def _diffs(s, d):
    """Each document against itself with some words changed and some lines joined."""
    docs = table(s, d, "documents").select("doc_id", F.col("text").alias("before"))
    return diffs.diff_lines(docs.withColumn("after", F.replace(F.replace("before", F.lit("er\n"), F.lit("er ")), F.lit(" of "), F.lit(" for "))), ["doc_id"])


def _log_files(s, d):
    """The logs of all customers as files of the shared folder, read by ranges of 1 MB."""
    scratch = Scratch(s, "logs")
    folder = f"{scratch.base}/text"
    A.log_texts(s, d).repartition(4, "log").write.text(folder)
    return L.read_log(s, folder, 1 << 20).select("hash", "date", "author", "path", "added", "deleted")


def queries() -> dict:
    return {
        "git_log_files": _log_files,
        "text_diffs": _diffs,
        "source_tokens": lambda s, d: T.token_table(table(s, d, "documents").select(F.col("doc_id").alias("file"), "text")).select("file", "offset", "type", "text"),
        "entry_points_listed": _listed,
        "entry_point_hints": _hints,
        "duplicates": lambda s, d: clones.duplicate_groups(word_tokens(s, d), Scratch(s, "duplicates")),
    }


def oracle_sql() -> dict[str, str]:
    quoted = lambda words: ", ".join(f"'{w}'" for w in sorted(words))
    escaped = "|".join("".join("\\" + c for c in op) for op in T.OPERATORS)
    skip = r"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\z)"
    literal = r'"""(?:.|\n)*?(?:"""|\z)|"(?:\\(?:.|\n)|[^"\\])*(?:"|\z)|' + r"''(?:\\(?:.|\n)|[^''\\])*(?:''|\z)|\d[\w.\pL]*"
    token = rf"{skip}|{literal}|[\pL_][\pL\pN_]*|{escaped}|[-+*/%=<>!&|^~?:;.,()\{{\}}\[\]@#]"
    marks = f"ma as (select 'app.client.C' || c_custkey class, case when c_custkey % 2 = 0 then 'open' end \"method\", c_nationkey % 5 n, [{', '.join(repr(m) for m in MARKS)}][c_nationkey % 5 + 1] a from customer)"
    return {
        "git_log_files": catalogue.oracle_sql()["git_log"],
        "text_diffs": """
            with pa as (select doc_id, regexp_split_to_array(text, '\\r\\n|\\n|\\r') a,
              regexp_split_to_array(replace(replace(text, 'er' || chr(10), 'er '), ' of ', ' for '), '\\r\\n|\\n|\\r') b from documents where text is not null),
            li as (select doc_id, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) line from pa),
            xy as (select doc_id, line, a[line] x, b[line] y from li)
            select doc_id, line::integer line, '-' sign, x text from xy where x is distinct from y and x is not null
            union all select doc_id, line::integer, '+', y from xy where x is distinct from y and y is not null""",
        "entry_points_listed": f"""
            with {marks}
            select class, "method", case n when 2 then 'jakarta' when 3 then 'spring' when 4 then 'junit' end framework, n >= 2 entry, n in (2, 4) but_spring from ma""",
        "entry_point_hints": f"""
            with {marks}, me as (select class, unnest(case when "method" is null then ['open', 'close'] else ['open'] end) "method", n, a from ma)
            select class, "method", '@' || split_part(a, '.', -1) || ' is a ' || case n when 2 then 'jakarta' when 3 then 'spring' else 'junit' end
              || ' entry point; invoked by the framework at runtime.' hint from me where n >= 2""",
        "source_tokens": f"""
            with fo as (select doc_id, regexp_extract_all(coalesce(text, ''), '{token}') t from documents),
            un as (select doc_id, unnest(t) text, unnest(range(len(t))) k from fo),
            ke as (select * from un where not (starts_with(text, '//') or starts_with(text, '/*')))
            select doc_id::varchar file, (row_number() over (partition by doc_id order by k) - 1)::integer "offset",
              case when regexp_matches(text, '^["''0-9]') then 'LITERAL' when text in ({quoted(T.KEYWORDS)}) then 'KEYWORD'
                when regexp_matches(text, '^[\\pL_]') then 'IDENTIFIER' else 'OPERATOR' end "type", text
            from ke""",
        "duplicates": """
            with ro as (select doc_id::varchar file, unnest(string_split(text, chr(10))) r, unnest(range(len(string_split(text, chr(10))))) line from documents),
            wo as (select file, line, regexp_extract_all(r, '[^\\x20\\x09-\\x0D]+') w from ro),
            un as (select file, line, unnest(w) t, unnest(range(len(w))) k from wo),
            tk as (select file, line + 1 line, t, row_number() over (partition by file order by line, k) - 1 o from un),
            wi as (select file, o, md5(string_agg(t, ' ') over v) h, count(*) over v m from tk
              window v as (partition by file order by o rows between current row and 49 following)),
            pr as (select x.file fa, x.o a, y.file fb, y.o - x.o d from wi x join wi y on x.h = y.h and (x.file, x.o) < (y.file, y.o) where x.m = 50 and y.m = 50),
            il as (select *, a - row_number() over (partition by fa, fb, d order by a) island from pr),
            le as (select fa, a, fb, a + d b, d, max(a) over (partition by fa, fb, d, island) - a + 50 n from il),
            ok as (select * from le where fa <> fb or d >= n),
            en as (select fa f, a o, n, fb pf, b po from ok union all select fb, b, n, fa, a from ok),
            be as (select f, o, max(n) n from en group by 1, 2),
            co as (select *, max(o + n) over (partition by f order by o rows between unbounded preceding and 1 preceding) c from be),
            op as (select f, o, n from co where c is null or c < o + n),
            fi as (select f, o, n, coalesce(min((pf, po)) filter ((pf, po) < (f, o)), min((pf, po))) p from en join op using (f, o, n) group by 1, 2, 3),
            pa as (select distinct least((f, o), p) a, greatest((f, o), p) b, n from fi),
            fl as (select struct_extract_at(a, 1) file_a, struct_extract_at(a, 2) start_a, struct_extract_at(b, 1) file_b, struct_extract_at(b, 2) start_b, n from pa)
            select file_a, start_a::integer start_a, file_b, start_b::integer start_b, n::integer length,
              w.line::integer first_line_a, x.line::integer last_line_a, y.line::integer first_line_b, z.line::integer last_line_b
            from fl join tk w on w.file = file_a and w.o = start_a join tk x on x.file = file_a and x.o = start_a + n - 1
            join tk y on y.file = file_b and y.o = start_b join tk z on z.file = file_b and z.o = start_b + n - 1""",
    }
