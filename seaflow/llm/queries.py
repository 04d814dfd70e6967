"""The registered queries of this subpackage, and their SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seaflow.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    html_extraction,
    language_id,
    line_dedup,
    ngram_join,
    packing,
    periodic_runs,
    phrase_mining,
    secret_scan,
    token_output,
    toxicity,
)
from seaflow.llm.storage import new_path, package_on_workers, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.with_language(docs.select("doc_id", "text"), language_id.learn(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_recurring_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_dropped")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    found = byte_bpe.encoded(table(spark, sf_dir, "documents"), ranks)
    listed = F.to_json("ids")  # the ids with commas, in brackets
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.substring(listed, F.lit(2), F.length(listed) - 2), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extraction.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.as_text(secret_scan.in_order(F.concat("base", "linked"))).alias("spans"),
    )


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        definition = file.read()
    path = new_path(spark, "tokens")
    token_output.write(table(spark, sf_dir, "documents"), path, definition, end_id=2)
    return token_output.checksums(spark, path)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.scored(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        language_id.held_out().alias("held_out"),
        "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(table(spark, sf_dir, "documents"))


def _with_repeats(text: Column, doc_id: Column) -> Column:
    """The texts that op11 is asked about: in every tenth document, by a hash of its id, the words from one on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i)))
        return F.when(n > 0, F.array_join(again, " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated).getItem(0)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", _with_repeats(docs["text"], docs["doc_id"]).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("r"))))["r"]
    return (
        periodic_runs.periodic_runs(asked)
        .withColumn("longest", longest)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("longest.start").alias("start"),
            F.col("longest.length").alias("length"),
            F.col("longest.period").alias("period"),
            F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    found = packing.pack(table(spark, sf_dir, "documents"), definition, end_id=2)
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def _ready(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        package_on_workers(spark)
        return query(spark, sf_dir)

    return run


_QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_id": op2_language_id,
    "op3_line_dedup": op3_line_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_extraction": op5_html_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_output": op8_token_output,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_packing": op12_packing,
    "op13_phrase_mining": op13_phrase_mining,
}
QUERIES = {name: _ready(query) for name, query in _QUERIES.items()}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
            FROM documents
        ), ranked AS (
            SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size
            FROM bare
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM ranked
    """,
}
