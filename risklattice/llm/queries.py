"""One registered query per operator: thin digests of the operators' outputs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklattice.llm import align, chunks, decontaminate, html, lines, mixing, neighbours, pieces, pii, ranked, simhash, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_neighbours")
def op1(spark, sf):
    found = neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op2_token_counts")
def op2(spark, sf):
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_repeated_passages")
def op3(spark, sf):
    return chunks.repeated_passages(table(spark, sf, "documents"))


@query("op4_decontaminate")
def op4(spark, sf):
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op5_personal_data")
def op5(spark, sf):
    found = pii.find_personal_data(table(spark, sf, "documents"))
    base = list(pii.PATTERNS)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(base).cast("binary"), 256).alias("base_sha256"), pii.as_text([*base, "id"]).alias("spans"))


@query("op6_line_dedup", lines.SQL)
def op6(spark, sf):
    out = lines.dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op7_simhash")
def op7(spark, sf):
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", simhash.as_hex("fp").alias("fingerprint"), "component_id")


@query("op8_main_text")
def op8(spark, sf):
    return html.extract_pages(table(spark, sf, "pages"))


@query("op9_toxicity")
def op9(spark, sf):
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst_start", "worst_end", "worst_score")


@query("op10_mixing", mixing.SQL)
def op10(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_piece_encoding")
def op11(spark, sf):
    import public_tokenizers

    found = pieces.encode(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    digests = {"ids_sha256": "packed", "decoded_sha256": F.col("decoded").cast("binary"), "spans_sha256": F.concat("starts", "ends")}
    return found.select("doc_id", "n_tokens", *(F.sha2(column, 256).alias(name) for name, column in digests.items()))


@query("op12_ranked_search", ranked.SQL)
def op12(spark, sf):
    return ranked.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_alignment")
def op13(spark, sf):
    import public_tokenizers

    found = align.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    counted = align.with_counts(found.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("pipeline")
def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
