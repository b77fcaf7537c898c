"""Overlapping token windows of documents, and what they do to label counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens, window_spans


def chunk_index(docs: DataFrame, n_tokens: Column, size: int, overlap: int, carry: tuple[str, ...]) -> DataFrame:
    """One row for each window: carried columns, chunk_idx, total_chunks, start_token, end_token."""
    counted = docs.select(*carry, n_tokens.alias("_n"))  # once for each row, not for each window
    return counted.select(*carry, F.explode(window_spans(F.col("_n"), size, overlap)).alias("w")).select(*carry, "w.*")


def chunk_texts(docs: DataFrame, text: str, size: int, overlap: int, carry: tuple[str, ...], tokens: Column | None = None) -> DataFrame:
    """The windows with their text; a document of one window keeps its text as it is. Labels are carried to each window."""
    toks = whitespace_tokens(F.col(text)) if tokens is None else tokens
    own = docs.select(*carry, F.col(text).alias("_t"), toks.alias("_k"))
    rows = own.select(*carry, "_t", "_k", F.explode(window_spans(F.size("_k"), size, overlap)).alias("w"))
    piece = F.array_join(F.slice("_k", (F.col("w.start_token") + 1).cast("int"), (F.col("w.end_token") - F.col("w.start_token")).cast("int")), " ")
    return rows.select(*carry, F.when(F.col("w.total_chunks") == 1, F.col("_t")).otherwise(piece).alias("input"), F.col("w").alias("chunk_info"))


def subword_texts(docs: DataFrame, text: str, ends: Column, size: int, overlap: int, carry: tuple[str, ...]) -> DataFrame:
    """The windows of a tokenizer's own tokens with their text, cut from the document by ``ends``, the byte behind each token.

    As ``chunk_texts``: a document of one window keeps its text, labels are carried to each window. Where a window begins
    or ends within a character, its bytes show as the replacement character, as in a decoded run of tokens.
    """
    own = docs.select(*carry, F.coalesce(text, F.lit("")).alias("_t"), ends.alias("_e"))
    rows = own.select(*carry, "_t", "_e", F.explode(window_spans(F.size("_e"), size, overlap)).alias("w"))
    begin = F.coalesce(F.get("_e", (F.col("w.start_token") - 1).cast("int")), F.lit(0))
    end = F.coalesce(F.get("_e", (F.col("w.end_token") - 1).cast("int")), F.lit(0))
    piece = F.make_valid_utf8(F.substring(F.col("_t").cast("binary"), begin + 1, end - begin).cast("string"))
    return rows.select(*carry, F.when(F.col("w.total_chunks") == 1, F.col("_t")).otherwise(piece).alias("input"), F.col("w").alias("chunk_info"))


def chunk_stats(index: DataFrame, key: str) -> DataFrame:
    """Documents, windows, and shares of documents with one and with several: one row."""
    per = index.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    docs, multi = F.count(F.lit(1)), F.count_if(F.col("n") > 1)
    return per.agg(
        docs.alias("documents"), F.sum("n").alias("total_chunks"), (F.sum("n") / docs).alias("chunks_per_doc"), F.count_if(F.col("n") == 1).alias("single_chunk_docs"),
        multi.alias("multi_chunk_docs"), (F.count_if(F.col("n") == 1) * 100.0 / docs).alias("single_chunk_pct"), (multi * 100.0 / docs).alias("multi_chunk_pct"),
        F.max("n").alias("max_chunks"),
    )


def chunk_distribution(index: DataFrame, key: str) -> DataFrame:
    """Documents by their number of windows."""
    return index.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks")).groupBy("n_chunks").agg(F.count(F.lit(1)).alias("n_docs"))


def label_inflation(docs: DataFrame, codes: str, n_chunks: Column) -> DataFrame:
    """Instances of each label by document and by window (where a document's labels count once for each window)."""
    rows = docs.select(F.explode(codes).alias("f_code"), n_chunks.cast("long").alias("k"))
    return rows.groupBy("f_code").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("k").alias("n_chunks")).withColumn("ratio", F.col("n_chunks") / F.col("n_docs"))
