"""The queries of the language-model operators; ``queries()`` and ``oracle_sql()`` feed the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_table, table
from . import boilerplate, encoding, language, markup, packing, pii, residue, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "lang_samples")).select("page_id", "node_id")


def p1_clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_free_pages(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "lang_samples"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.boilerplate_nodes(*(table(spark, sf_dir, t) for t in ("nodes", "pages", "lang_samples")))


def p2_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_bodies(*(table(spark, sf_dir, t) for t in ("nodes", "pages", "lang_samples")))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_labels(*(table(spark, sf_dir, t) for t in ("nodes", "pages", "lang_samples")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_labels(spark, sf_dir).where("kind in ('page', 'text')").select("page_id", "node_id", "lang")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_segments(*(table(spark, sf_dir, t) for t in ("nodes", "pages", "lang_samples")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.damaged_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "lang_samples")).select("page_id", "node_id")


def p4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.damaged_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "lang_samples")).select("page_id", "node_id", "restored")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "lang_samples")).select("page_id", "node_id", "markup")


def p5_clean_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.markup_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "lang_samples"))


def p5_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"))


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_budgets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.mentions(table(spark, sf_dir, "documents")).select("doc_id", "kind", "start_char")


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_documents(table(spark, sf_dir, "documents"))


# ------------------------------------------------------------------ what SQL can check of them
def p6_empties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, and which have no ids: null and empty texts, no others."""
    return tokens.encode_documents(table(spark, sf_dir, "documents")).select("doc_id", (F.size("ids") == 0).alias("empty"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each budget: documents packed, containers beyond the capacity, documents whose
    pieces leave gaps or overlap, and documents cut although they fit."""
    docs, budgets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_budgets")
    sizes = scratch_table(tokens.count_tokens(docs, "doc_id", "text", "n_tokens"), "sizes")
    packed = scratch_table(packing.pack(sizes, budgets, "doc_id", "n_tokens"), "packed")
    over = packed.groupBy("budget_id", "container_id").agg(F.sum("piece_tokens").alias("n")).join(F.broadcast(budgets), "budget_id")
    over = over.groupBy("budget_id").agg(F.count(F.when(F.col("n") > F.col("capacity_tokens"), 1)).alias("n_over"))
    w = Window.partitionBy("budget_id", "doc_id").orderBy("start_token")
    pieces = packed.withColumn("gap", F.col("start_token") != F.lag(F.col("start_token") + F.col("piece_tokens"), 1, 0).over(w))
    per = pieces.groupBy("budget_id", "doc_id").agg(F.sum("piece_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.max("gap").alias("gap"))
    per = per.join(sizes, "doc_id").join(F.broadcast(budgets), "budget_id")
    found = per.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("gap") | (F.col("n") != F.col("n_tokens")), 1)).alias("n_gaps"), F.count(F.when((F.col("k") > 1) & (F.col("n_tokens") <= F.col("capacity_tokens")), 1)).alias("n_cut"),
    )
    return found.join(over, "budget_id").select("budget_id", "n_docs", "n_over", "n_gaps", "n_cut")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: mentions outside the text, empty or overlapping, of which there
    should be none, and whether the text without them is kept by the redaction."""
    docs = table(spark, sf_dir, "documents")
    w = Window.partitionBy("doc_id").orderBy("start_char")
    found = pii.mentions(docs).withColumn("bad", (F.col("end_char") <= F.col("start_char")) | (F.col("start_char") < F.lag("end_char", 1, 0).over(w)))
    mark = F.create_map(*[x for k, v in pii.PLACEHOLDERS.items() for x in (F.lit(k), F.lit(len(v)))])
    per = found.groupBy("doc_id").agg(F.count(F.when(F.col("bad"), 1)).alias("bad"), F.max("end_char").alias("last"), F.sum(mark[F.col("kind")] - (F.col("end_char") - F.col("start_char"))).alias("grown"))
    n = F.coalesce(F.length("text"), F.lit(0))
    done = pii.redact_documents(docs).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("m"))
    rows = docs.select("doc_id", n.alias("n")).join(done, "doc_id").join(per, "doc_id", "left")
    return rows.select("doc_id", (F.coalesce("bad", F.lit(0)) + (F.coalesce("last", F.lit(0)) > F.col("n")).cast("int")).alias("n_bad"), (F.col("m") == F.col("n") + F.coalesce("grown", F.lit(0))).alias("kept"))


_SQL = {
    "p6_empties": "select doc_id, coalesce(text, '') = '' as empty from documents",
    "p7_checks": "select b.budget_id, (select count(*) from documents where coalesce(text, '') <> '') as n_docs, 0 as n_over, 0 as n_gaps, 0 as n_cut from pack_budgets b",
    "p8_checks": "select doc_id, 0 as n_bad, true as kept from documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_clean_pages, p2_found, p2_main_body, p3_found, p3_labels, p3_segments, p4_found, p4_restored,
        p5_found, p5_clean_nodes, p5_clean_documents, p6_ids, p6_empties, p7_pack, p7_checks, p8_found, p8_redacted, p8_checks,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
