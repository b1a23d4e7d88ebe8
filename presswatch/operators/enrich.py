"""Row enrichment by a user-supplied extractor, with bounded retry."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswatch.functions.replies import field_columns, parsed_reply, with_price, with_token_columns
from presswatch.functions.scalars import article_text, fill_template
from presswatch.schemas import RAW_REPLY, REPLY_FIELDS

# A prompt goes in; reply text and token counts come out.
Extractor = Callable[[str], tuple[str, dict[str, int]]]

DEFAULT_TEMPLATE = (
    "Read the news article below and answer with one JSON object with the keys "
    + ", ".join(REPLY_FIELDS)
    + ". RelevantKeywords holds 3 to 5 words taken from the article; Relevance is Yes or No; "
    "AlertFlag is Red, Yellow or Green, and Green when Relevance is No.\n\nArticle:\n{news_content}\n"
)

BATCH_BYTES = 16 << 20  # of an Arrow batch: articles of any length, not a number of them
_USAGE = pa.struct([(f.name, pa.int32()) for f in RAW_REPLY["LLM_Token_Usage"].dataType.fields])


def attempt(extract: Extractor, prompt: str, max_attempts: int = 2, wait_seconds: float = 60.0) -> dict:
    """One row's call. Only a rate limit (``429`` in the error) is tried again; any failure gives nulls."""
    for number in range(1, max_attempts + 1):
        try:
            text, usage = extract(prompt)
            return {"text": text, "usage": usage, "attempts": number, "error": None}
        except Exception as problem:  # the row is marked failed, the job goes on
            error = str(problem)
            if "429" not in error:
                break
            if number < max_attempts:
                time.sleep(wait_seconds)
    return {"text": None, "usage": None, "attempts": number, "error": error}


def with_prompt(df: DataFrame, template: str = DEFAULT_TEMPLATE, title: str = "Title",
                text: str = "Description") -> DataFrame:
    return df.withColumn("prompt", fill_template(template, news_content=article_text(F.col(title), F.col(text))))


def with_replies(df: DataFrame, make_extractor: Callable[[], Extractor], max_attempts: int = 2,
                 wait_seconds: float = 60.0, partitions: int | None = None) -> DataFrame:
    """Call the extractor for each row's ``prompt``.

    The extractor and its client are made inside the task. ``partitions`` evens the rows out and
    caps the number of calls in flight. Batches are bounded by bytes.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if partitions:
        df = df.repartition(partitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = make_extractor()
        for batch in batches:
            replies = [attempt(extract, p, max_attempts, wait_seconds) for p in batch.column("prompt").to_pylist()]
            added = {
                "LLM_Response": pa.array([r["text"] for r in replies], pa.string()),
                "LLM_Token_Usage": pa.array([r["usage"] for r in replies], _USAGE),
                "attempts": pa.array([r["attempts"] for r in replies], pa.int32()),
                "error": pa.array([r["error"] for r in replies], pa.string()),
            }
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return df.mapInArrow(run, T.StructType(df.schema.fields + RAW_REPLY.fields))


def with_enrichment(df: DataFrame, model: str, as_of: Column) -> DataFrame:
    """Raw replies to the stored columns; a reply that is not a JSON object fails its row to all nulls."""
    reply = F.col("_reply")
    df = df.withColumn("_reply", parsed_reply(F.col("LLM_Response"))).withColumns({
        "LLM_Response": F.when(reply.isNotNull(), F.col("LLM_Response")),
        "LLM_Token_Usage": F.when(reply.isNotNull(), F.col("LLM_Token_Usage")),
        **field_columns(reply),
    }).drop("_reply")
    df = with_price(with_token_columns(df), model)
    stamp = F.when(F.col("LLM_Response").isNotNull(), F.date_trunc("second", as_of))
    return df.withColumn("API_Timestamp", stamp).drop("prompt", "attempts", "error")
