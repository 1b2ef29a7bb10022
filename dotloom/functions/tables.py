"""Table functions for SQL."""

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from dotloom.operators.rle import row_runs, text_counts

RUNS = ("y", "xs", "xe")


class MaskRuns:
    """``mask_runs(TABLE(masks))``: the row runs of compressed masks.

    ``masks`` has ``size`` (array of height and width), ``counts`` (string) and any other columns; a row (other columns, y, xs, xe)
    comes out for each run. Null, empty and unreadable masks give none. A table without these columns, or with a column y,
    xs or xe, is an error at analysis.
    """

    @staticmethod
    def analyze(masks: AnalyzeArgument) -> AnalyzeResult:
        if not masks.isTable:
            raise ValueError("mask_runs takes TABLE(masks)")
        fields = {f.name: f for f in masks.dataType.fields}
        if not isinstance(getattr(fields.get("size"), "dataType", None), ArrayType) or not isinstance(getattr(fields.get("counts"), "dataType", None), StringType):
            raise ValueError("mask_runs needs columns size (array) and counts (string)")
        if clash := sorted(set(fields) & set(RUNS)):
            raise ValueError(f"mask_runs adds {clash[0]}, which the table has")
        out = StructType([f for n, f in fields.items() if n not in ("size", "counts")])
        for name in RUNS:
            out = out.add(name, LongType())
        return AnalyzeResult(out)

    def eval(self, mask: Row) -> Iterator[tuple]:
        if mask["size"] is None or mask["counts"] is None:
            return
        rest = tuple(v for n, v in mask.asDict().items() if n not in ("size", "counts"))
        try:
            runs = row_runs(text_counts(mask["counts"]), *mask["size"])
        except (ValueError, TypeError):
            return
        for run in runs:
            yield (*rest, *(int(v) for v in run))


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    spark.udtf.register("mask_runs", udtf(MaskRuns))
