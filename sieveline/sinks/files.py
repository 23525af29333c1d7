"""Results as files.

Sorted output keeps its order across part files: Spark writes range-sorted
partitions in order, so results are not squeezed through one task. Joining the
parts into one file is left to the reader of the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import shaping

def layout(verdicts: DataFrame, output: dict | None = None) -> DataFrame:
    """The columns a table reader gets: a template's, the chosen, or the usual."""
    cfg = output or {}
    if cfg.get("template"):
        return shaping.render(verdicts, cfg["template"])
    out = shaping.flatten(verdicts, cfg.get("columns"))
    if not cfg.get("columns") and "extras" in verdicts.columns:
        note = F.try_element_at(F.col("extras"), F.lit("attribution"))
        out = shaping.flatten(verdicts.withColumn("attribution", note),
                              [*shaping.DEFAULT_COLUMNS, "attribution"])
    return out


def write_csv(verdicts: DataFrame, path: str, output: dict | None = None) -> None:
    rows = shaping.sheet_safe(layout(verdicts, output))
    # Columns rarely empty on purpose: nulls and empty cells are both blank.
    (rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8")
     .option("escape", '"').option("emptyValue", "").csv(path))
    write_attribution(verdicts, path.rstrip("/") + ".ATTRIBUTION")


def write_jsonl(verdicts: DataFrame, path: str) -> None:
    verdicts.write.mode("overwrite").json(path)
    write_attribution(verdicts, path.rstrip("/") + ".ATTRIBUTION")


def write_json(verdicts: DataFrame, path: str) -> None:
    """``{"attribution": [...], "results": [...]}`` as text part files whose
    concatenation, in name order, is the document. No task holds it all."""
    def lines(rows: DataFrame, part: int, at, value, first) -> DataFrame:
        comma = F.when(at == first, F.lit("")).otherwise(F.lit(","))
        return rows.select(F.lit(part).alias("part"), at.cast("long").alias("at"), F.concat(comma, value).alias("value"))

    notes = shaping.attributions(verdicts)
    quoted = F.regexp_extract(F.to_json(F.array("attribution")), r"(?s)^\[(.*)\]$", 1)
    marks = verdicts.sparkSession.createDataFrame(
        [(0, 0, '{"attribution": ['), (2, 0, '], "results": ['), (4, 0, "]}")], "part int, at long, value string")
    body = F.to_json(F.struct(*[F.col(c) for c in verdicts.columns]))
    (marks.unionByName(lines(notes, 1, F.col("first_ord"), quoted, notes.agg(F.min("first_ord").alias("f")).scalar()))
     .unionByName(lines(verdicts, 3, F.col("ord"), body, verdicts.agg(F.min("ord").alias("f")).scalar()))
     .orderBy("part", "at").select("value").write.mode("overwrite").text(path))


def write_split(verdicts: DataFrame, path: str, output: dict) -> None:
    """One folder per group value, ``split_by``'s filename-safe form."""
    key = shaping.split_key(verdicts, output["split_by"])
    keyed = layout(verdicts.withColumn("_split", key), {**output, "columns": [
        *(output.get("columns") or shaping.DEFAULT_COLUMNS), "_split"]}) if not output.get("template") else \
        shaping.render(verdicts.withColumn("_split", key), {**output["template"], "_split": "_split"})
    # by group, with large groups split: a file or a few for each, not one from every task
    shaping.sheet_safe(keyed).hint("rebalance", "_split").write.mode("overwrite").option("header", True).partitionBy("_split").csv(path)


def write_attribution(verdicts: DataFrame, path: str) -> bool:
    """Licence notices beside the data, first seen first; none, no file."""
    if "extras" not in verdicts.columns:
        return False
    notes = shaping.attributions(verdicts)
    if not notes.head(1):
        return False
    notes.orderBy("first_ord").select(F.col("attribution").alias("value")) \
        .write.mode("overwrite").text(path)
    return True


def write_reviews(reviews: DataFrame, verdicts: DataFrame, path: str, everything: bool = False) -> None:
    from ..operators.reviews import reviews_of
    reviews_of(reviews, verdicts, everything).write.mode("overwrite").json(path)
