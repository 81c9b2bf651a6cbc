"""Table functions for SQL: transcripts to steps, and the matches of a pattern.

    SELECT t.conv_id, s.* FROM transcripts t, LATERAL parse_steps(t.text) s
    SELECT * FROM grep_rows(TABLE(SELECT doc_id AS id, text FROM documents), 'license', 100, 5)

Their columns are told by `analyze` when the query is planned, and wrong arguments are refused there.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from trailforge.functions.transcripts import steps_of

STEPS = StructType().add("step", IntegerType()).add("action", StringType()).add("observation", StringType()).add("ids", ArrayType(StringType())).add("start", IntegerType()).add("end", IntegerType())


@udtf
class ParseSteps:
    """The steps of a transcript."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, StringType):
            raise ValueError("parse_steps takes a text")
        return AnalyzeResult(STEPS)

    def eval(self, text: str) -> Iterator[tuple]:
        for s in steps_of(text):
            yield s["step"], s["action"], s["observation"], s["ids"], s["start"], s["end"]


def matches(text: str | None, pattern: str, context: int, most: int) -> Iterator[tuple[int, int, str]]:
    """(n, start, excerpt) of the first matches of a literal, upper and lower case alike."""
    text = text or ""
    low, wanted = text.lower(), pattern.lower()
    at, n = low.find(wanted), 0
    while at >= 0 and n < most and wanted:
        n += 1
        begin, end = max(0, at - context), min(len(text), at + len(wanted) + context)
        yield n, at, ("..." if begin else "") + text[begin:end] + ("..." if end < len(text) else "")
        at = low.find(wanted, at + len(wanted))


@udtf
class GrepRows:
    """The matches in the rows of a table with columns id and text; rows are read where they lie, without a shuffle, unless the call says PARTITION BY."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, pattern: AnalyzeArgument, context: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not {"id", "text"} <= set(rows.dataType.names):
            raise ValueError("grep_rows takes a table with the columns id and text")
        if not isinstance(pattern.dataType, StringType):
            raise ValueError("the pattern of grep_rows is a text")
        return AnalyzeResult(StructType().add("id", rows.dataType["id"].dataType if "id" in rows.dataType.names else LongType()).add("n", IntegerType()).add("start", IntegerType()).add("excerpt", StringType()))

    def eval(self, rows: Row, pattern: str, context: int, most: int) -> Iterator[tuple]:
        for n, start, excerpt in matches(rows["text"], pattern, context, most):
            yield rows["id"], n, start, excerpt


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to SQL."""
    spark.udtf.register("parse_steps", ParseSteps)
    spark.udtf.register("grep_rows", GrepRows)
    return spark
