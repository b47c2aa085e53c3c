"""Rendering node sets for prompts: structured, fused and toon formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import paths

# One-letter codes of categories.
CODES = {
    "decision": "D", "fact": "F", "facts": "F", "rule": "R", "rules": "R", "constraint": "C", "constraints": "C", "risk": "K", "risks": "K",
    "guidance": "G", "note": "N", "task": "T", "preference": "P", "entity": "E", "conversation": "V", "insight": "I",
}
TEXT_FIELDS = ["text", "content", "description", "summary"]


def text_of(df: DataFrame) -> Column:
    """The first text field that is not empty, else the JSON of the data."""
    b = paths.bind(df)
    return F.coalesce(*[F.nullif(b.value(f).string, F.lit("")) for f in TEXT_FIELDS], b.whole())


def truncated(text: Column, max_chars: int) -> Column:
    if max_chars <= 0:
        return text
    return F.when(F.char_length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("…"))).otherwise(text)


def _category(df: DataFrame, default: str) -> Column:
    return F.coalesce(paths.bind(df).value("category").string, F.lit(default))


def _score(df: DataFrame) -> Column:
    return F.coalesce(paths.bind(df).value("score").number, F.lit(0.0))


def structured(df: DataFrame, max_chars: int = 0) -> DataFrame:
    data = F.struct(_category(df, "unknown").alias("category"), truncated(text_of(df), max_chars).alias("text"), _score(df).alias("score"))
    return df.withColumn("data", data)


def toon(df: DataFrame, max_chars: int = 0) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    code = F.coalesce(F.element_at(codes, _category(df, "other")), F.lit("?"))
    line = F.concat(F.lit("["), code, F.lit("|"), F.format_string("%.1f", _score(df)), F.lit("] "), truncated(text_of(df), max_chars))
    return df.withColumn("data", F.struct(line.alias("toon")))


def fused(df: DataFrame, max_chars: int = 0) -> DataFrame:
    """One row ``__fused__``: a heading per category in order, then its lines in input (id) order."""
    line = F.concat(F.lit("[score "), F.format_string("%.1f", _score(df)), F.lit("] "), truncated(text_of(df), max_chars))
    rows = df.select("id", _category(df, "other").alias("c"), line.alias("line"))
    per = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("rows"), F.count(F.lit(1)).alias("n"))
    block = F.concat(F.lit("## "), "c", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    all_ = per.select("c", block.alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("c", "block"))).alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    text = F.array_join(F.transform("b", lambda r: r["block"]), "\n")
    return all_.select(F.lit("__fused__").alias("id"), F.struct(text.alias("text"), F.col("n").alias("count")).alias("data"))


def transform(df: DataFrame, format: str, max_chars: int = 0) -> DataFrame:
    return {"structured": structured, "fused": fused, "toon": toon}[format](df, max_chars)
