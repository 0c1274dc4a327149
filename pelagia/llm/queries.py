"""The operators on the test tables, under the contracts of their queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm import decontaminate, exact_dedup, licences, lm, minhash, packing, parity_join, periodic, pii, quality, token_files, warc, whitening
from pelagia.llm.tables import held_out, table

BYTE_VOCABULARY, BYTE_IDS = public_tokenizers.path("byte_bpe_50k.json"), 50_257
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


QUALITY_THRESHOLD = 0.3


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, folder, "labels").where(~out).select("doc_id", F.col("quality").alias("label"))
    vectors, network = quality.fit(docs, labels)
    scored = docs.select("doc_id", out.alias("held_out"), quality.scorer(docs, vectors, network)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_THRESHOLD).cast("int"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = decontaminate.hit_words(F.col("starts"), F.col("ends"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (n_hit > 0).alias("contaminated"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), WORD_VOCABULARY, end=1, capacity=4096)
    return packed.drop("ids")


def op4_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return parity_join.similarity_classes(table(spark, folder, "documents"), n=3, percent=90)


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return lm.scores(docs, held_out(F.col("doc_id"), 7, 2), BYTE_VOCABULARY, BYTE_IDS, end=BYTE_IDS - 1)


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", pii.spans("text").alias("found"))
    plain = F.filter("found", lambda s: s["plain"])

    def number(kind: str):
        return F.size(F.filter(plain, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, pii.KINDS), F.sha2(pii.listed(plain), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"))


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"), longest=True).drop("chars")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.round_trip(table(spark, folder, "pages"), least=0)
    return read.where("quarantined is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select("doc_id", licences.scan("text").alias("found"))
    names = F.transform("found.matches", lambda m: m["licence"])
    return found.select("doc_id", F.size("found.matches").cast("long").alias("n_matches"), F.col("found.unknown").alias("n_unknown"),
                        F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licences"), licences.listed(F.col("found.matches")).alias("spans"))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), BYTE_VOCABULARY, BYTE_IDS, end=2, with_ids=False)


def _repeating(text: pa.Array, number: pa.Array) -> pa.Array:
    """Word i >= a becomes word a + (i - a) % p, with a and p from the number; null stays null."""
    out = []
    for whole, g in zip(text.to_pylist(), number.to_pylist()):
        words = None if whole is None else whole.encode().split()
        if words:
            n = len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]
        out.append(None if words is None else b" ".join(words).decode())
    return pa.array(out, pa.string())


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its id repeats a stretch up to its end."""
    h: Column = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    repeating = F.arrow_udf(_repeating, "string")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    return docs.select("doc_id", F.when(chosen, repeating(F.when(chosen, F.col("text")), F.floor(h / 10))).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(table(spark, folder, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                F.floor(1000 * F.col("best.length") / (-F.col("best.period"))).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), n=3, percent=85)


def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), "vec_id", "embedding", components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_parity_sketch_join": op4_parity_sketch_join,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_pii": op6_pii,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_licences": op9_licences,
    "op10_token_files": op10_token_files,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_minhash_near_dedup": op12_minhash_near_dedup,
    "op13_embedding_whitening": op13_embedding_whitening,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def similarity_sql(percent: int, columns: str) -> str:
    """Components of documents whose sets of three-word shingles are alike."""
    return rf"""
        with recursive words as (
            select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
        sets as (
            select doc_id, list_distinct(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
            from words),
        tokens as (select doc_id, len(s) as n, unnest(s) as token from sets),
        links as (
            select a.doc_id as a, b.doc_id as b from tokens a join tokens b on a.token = b.token and a.doc_id <> b.doc_id
            group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
        labels as (select a as doc_id, min(b) as component_id from reach group by a)
        select {columns} from sets join labels using (doc_id)
    """


ORACLE: dict[str, str] = {
    "op2_decontamination": rf"""
        with cut as (
            select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        items as (
            select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        windows as (
            select distinct item_id, least(10, len(w)) as n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') as t
            from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from items where len(w) > 0)),
        places as (
            select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as t
            from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from cut) join (select distinct n from windows) on i + n - 1 <= len(w)),
        found as (select doc_id, i, p.n, item_id from places p join windows using (n, t)),
        hit as (select doc_id, count(distinct word_no) as n_hit from (select doc_id, unnest(range(i, i + n)) as word_no from found) group by 1),
        named as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
            from (select distinct doc_id, cast(item_id as varchar) as item from found) group by 1)
        select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from cut left join hit using (doc_id) left join named using (doc_id)
    """,
    "op4_parity_sketch_join": similarity_sql(90, "doc_id, len(s) as n_shingles, component_id"),
    "op12_minhash_near_dedup": similarity_sql(85, "doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept"),
    "op8_warc": """
        with payload as (
            select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
        named as (
            select page_id, html, max(page_id) over (partition by hex) as largest,
                   array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       ((('0x' || substr(hex, (k // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (k % 4))) & 31)::int + 1, 1)), '') as digest
            from payload)
        select page_id, strlen(html) as payload_bytes, digest as payload_digest,
               case when page_id < largest then 'revisit' else 'response' end as record_type,
               case when page_id < largest then largest end as refers_to
        from named
    """,
    "op7_exact_dedup": r"""
        with bare as (
            select doc_id, length(coalesce(text, '')) as chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as bare
            from documents),
        ranked as (
            select *, first_value(doc_id) over w as keep_id, count(*) over (partition by bare) as group_size,
                   row_number() over w = 1 as kept
            from bare window w as (partition by bare order by chars desc, doc_id))
        select doc_id, keep_id, group_size, kept, sha256(bare) as text_sha256 from ranked
    """,
}
