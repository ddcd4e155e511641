"""The thin queries op1 to op13 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.util import Scratch, table

#: Words of the contracts as a regular expression.
_WORD = "[^\\x20\\x09-\\x0D]+"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.toxicity import score_documents, train

    held = lambda: F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op1"), ~held())
    return score_documents(docs, model).select("doc_id", held().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.pii import BASE, find_personal

    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = find_personal(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in BASE]
    return out.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.rules import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op7"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.cover import near_pairs

    return near_pairs(table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.suffix import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.automaton import dedup_windows

    out = dedup_windows(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.packing import pack_documents
    from sparkloom.llm.tokens import public

    out = pack_documents(table(spark, sf_dir, "documents"), public("byte_bpe_50k.json"), Scratch(spark, "op2"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sparkloom.llm.bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.binary_ids import read_files, write_files
    from sparkloom.llm.tokens import public

    files, dictionary = write_files(table(spark, sf_dir, "documents"), public("word_bpe_49k.json"), Scratch(spark, "op10"))
    return read_files(files, dictionary).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), Scratch(spark, "op9")).select("doc_id", "n_shingles", "component_id")


def periodized(docs: DataFrame) -> DataFrame:
    """documents as operator 11's query takes them: of a tenth by hash, the words from a place on repeat their first ones."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.withColumn("h", h).withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))))
    some = words.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    some = some.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    text = F.concat_ws(" ", F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), rest))
    return some.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.runs import find_runs

    out = find_runs(periodized(table(spark, sf_dir, "documents")))
    # greatest length / period exactly: fractions are compared crosswise
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    first = F.aggregate(F.slice("runs", 2, 1 << 30), F.element_at("runs", 1), lambda x, y: F.when(ahead(y, x), y).otherwise(x))
    best = out.withColumn("best", F.when(F.size("runs") > 0, first))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli")
    own = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *own, milli, F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.onebit import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, Scratch(spark, "op12"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkloom.llm.bitslice import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(x * 256).cast("double")))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("v"))
    return hard_negatives(rows, F.col("id") % 50 == 0, Scratch(spark, "op13"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_packing, op3_suffix_dedup, op4_pii, op5_substring_dedup, op6_byte_bpe, op7_quality_rules, op8_embedding_dedup, op9_jaccard_join, op10_binary_ids, op11_periodic_runs, op12_nearest, op13_hard_negatives, pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL of what SQL can say; tests compare the other queries with brute force."""
    from sparkloom.llm import search_sql

    words = "wo as (select doc_id, unnest(w) word, unnest(range(len(w))) k from (select doc_id, regexp_extract_all({0}, '" + _WORD + "') w from documents))"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    reach = "re as (select id, id other from no union select re.id, li.b from re join li on re.other = li.a), co as (select id, min(other) component_id from re group by 1)"
    return {
        "op11_periodic_runs": search_sql.RUNS,
        "op12_nearest": search_sql.NEAREST,
        "op13_hard_negatives": search_sql.NEGATIVES,
        "op3_suffix_dedup": search_sql.SUBSTRINGS,
        "op5_substring_dedup": f"with {words.format('text')}, wi as (select doc_id, k, string_agg(word, ' ') over w s, count(*) over w n from wo window w as (partition by doc_id order by k rows between current row and 19 following)),"
        " ag as (select doc_id, k, row_number() over (partition by s order by doc_id, k) > 1 again from wi where n = 20),"
        " co as (select doc_id, k, word, coalesce(max(case when again then k end) over (partition by doc_id order by k) + 20 > k, false) gone from wo left join ag using (doc_id, k)),"
        " su as (select doc_id, count(*) n_words, count(*) filter (gone) n_removed, string_agg(word, ' ' order by k) filter (not gone) kept from co group by 1)"
        " select doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from documents left join su using (doc_id)",
        "op8_embedding_dedup": "with recursive us as (select vec_id id, label, embedding::double[] e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding::double[], lambda x: x * x)) > 0),"
        " li as (select x.id a, y.id b from us x join us y on x.label = y.label and x.id <> y.id and len(x.e) = len(y.e) where case when len(x.e) = len(y.e) then list_cosine_similarity(x.e, y.e) end >= 0.98),"
        f" no as (select vec_id id from embeddings), {reach}, cn as (select a id, count(*) n from li group by 1)"
        " select id vec_id, coalesce(n, 0) n_links, component_id, id = component_id kept from co left join cn using (id)",
        "op9_jaccard_join": f"with recursive {words.format(lower)}, nw as (select doc_id, count(*) m from wo group by 1), sh as (select doc_id, string_agg(word, ' ') over w s, count(*) over w n from wo window w as (partition by doc_id order by k rows between current row and 2 following)),"
        " se as (select distinct doc_id, s from sh join nw using (doc_id) where n = 3 or m < 3 and n = m), sz as (select doc_id, count(*) n from se group by 1),"
        " pa as (select x.doc_id a, y.doc_id b, count(*) shared from se x join se y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),"
        " li as (select a, b from pa join sz x on a = x.doc_id join sz y on b = y.doc_id where 100 * shared >= 90 * (x.n + y.n - shared)),"
        f" no as (select doc_id id from documents), {reach} select co.id doc_id, coalesce(n, 0) n_shingles, component_id from co left join sz on sz.doc_id = co.id",
    }
