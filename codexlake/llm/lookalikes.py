"""Texts that look the same but hold different characters: one consistent form, and pairs that agree in it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexlake.llm.characters import consistent_form, per_distinct
from codexlake.runtime import table


def form_of(column: str | Column, fold_case: bool = True) -> Column:
    """The consistent form of a string column, worked out once for each distinct value of an Arrow batch.

    Null stays null; empty and blank texts give the empty string; texts of any length are taken whole.
    """

    def forms(texts: pd.Series) -> pd.Series:
        return per_distinct(texts, lambda t: consistent_form(t, fold_case))

    return F.pandas_udf(forms, "string")(column)


def _is_blank(column: str) -> Column:
    return F.length(F.regexp_replace(F.col(column), r"[\s\p{Z}\p{Cf}]", "")) == 0


def same_look(responses: DataFrame, lines: DataFrame) -> DataFrame:
    """Responses whose text or joined chars differ from their line's text but look the same.

    Columns ``response_id``, ``line_id``, ``field_name`` (``text`` or ``char``), distinct.  Null or blank
    line texts and null or empty values give nothing; null elements of the char array are skipped; a line
    that is given with several texts matches if any of them does; repeated rows and extra columns change
    nothing; empty tables give an empty result.
    """
    own = lines.where(F.col("line_id").isNotNull() & F.col("text").isNotNull()).where(~_is_blank("text")).select("line_id", F.col("text").alias("line_text")).distinct()
    chars = F.array_join(F.transform("character_confidences", lambda x: x["char"]), "")
    said = responses.where(F.col("line_id").isNotNull()).select("response_id", "line_id", "text", chars.alias("char")).where(F.coalesce(F.length("text"), F.lit(0)) + F.coalesce(F.length("char"), F.lit(0)) > 0)
    pairs = said.join(own, "line_id").where((F.coalesce("text", "line_text") != F.col("line_text")) | (F.coalesce("char", "line_text") != F.col("line_text")))

    def agree(text: pd.Series, char: pd.Series, line: pd.Series) -> pd.DataFrame:
        forms: dict[str, str] = {}

        def form(t: str) -> str:
            if t not in forms:
                forms[t] = consistent_form(t, fold_case=False)
            return forms[t]

        def same(values: pd.Series) -> list[bool]:
            return [bool(v) and v != own_text and form(v) == form(own_text) for v, own_text in zip(values, line, strict=True)]

        return pd.DataFrame({"text": same(text), "char": same(char)})

    hits = pairs.select("response_id", "line_id", F.pandas_udf(agree, "text boolean, char boolean")("text", "char", "line_text").alias("hit"))
    fields = F.filter(F.array(F.when(F.col("hit.text"), "text"), F.when(F.col("hit.char"), "char")), lambda x: x.isNotNull())
    return hits.select("response_id", "line_id", F.explode(fields).alias("field_name")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look(table(spark, sf_dir, "transcribe_responses"), table(spark, sf_dir, "release_lines"))


def p2_line_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's text beside its consistent form."""
    lines = table(spark, sf_dir, "release_lines").where(F.col("text").isNotNull()).select("line_id", "text").distinct()
    return lines.withColumn("consistent_text", form_of("text"))
