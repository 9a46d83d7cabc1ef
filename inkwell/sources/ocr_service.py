"""The second OCR as an iterator over Arrow batches with a client that the caller plugs in, and its answers in one form."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Client = Callable[[Sequence[bytes]], Sequence[tuple[str, float]]]

_REGION = "array<struct<text:string,confidence:double>>"
_ANSWER = f"struct<text:string,confidence:double,text_regions:{_REGION},result:{_REGION},data:{_REGION}>"


def parsed_answer(answer: Column) -> Column:
    """struct<text, confidence> of an answer in any of its layouts, the first that is there: a text of its own, the text region with
    the highest confidence, the first of ``result``, the first of ``data``. Text that is no JSON, or has none, gives the empty text
    with confidence 0."""
    a = F.from_json(answer, _ANSWER)
    by_confidence = F.array_sort(F.filter(a["text_regions"], lambda r: r["text"].isNotNull()), lambda x, y: F.when(F.coalesce(x["confidence"], F.lit(0.0)) > F.coalesce(y["confidence"], F.lit(0.0)), -1).when(F.coalesce(x["confidence"], F.lit(0.0)) < F.coalesce(y["confidence"], F.lit(0.0)), 1).otherwise(0))
    own = F.when(a["text"].isNotNull(), F.struct(a["text"].alias("text"), a["confidence"].alias("confidence")))
    best = F.coalesce(own, F.get(by_confidence, 0), F.get(a["result"], 0), F.get(a["data"], 0))
    return F.struct(F.coalesce(best["text"], F.lit("")).alias("text"), F.coalesce(best["confidence"], F.lit(0.0)).alias("confidence"))


def recognise(images: DataFrame, client: Callable[[], Client], id_col: str = "id", image: str = "image", batch: int = 32, tasks: int | None = None) -> DataFrame:
    """(id, text, confidence, state, error, duration_ms) of every image. ``client`` is called once per task and returns what sends one
    batch; answers that are missing count as the empty text with confidence 0; an exception marks its whole batch as errors.
    ``tasks`` bounds how many clients work at once. Null images are errors and are not sent."""
    kind = images.schema[id_col].dataType.simpleString()
    rows = images.select(F.col(id_col).alias("id"), F.col(image).alias("image"))
    rows = rows if tasks is None else rows.coalesce(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = client()
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch].copy()
                there = part["image"].notna()
                part["text"], part["confidence"], part["state"], part["error"] = "", 0.0, "error", "no image"
                began = time.monotonic()
                try:
                    got = list(send([bytes(b) for b in part.loc[there, "image"]])) if there.any() else []
                    got = (got + [("", 0.0)] * int(there.sum()))[: int(there.sum())]
                    part.loc[there, ["text", "confidence"]] = pd.DataFrame(got, index=part.index[there], columns=["text", "confidence"])
                    part.loc[there, "state"], part.loc[there, "error"] = "ready", None
                except Exception as e:  # the batch is marked, the stage goes on
                    part.loc[there, "error"] = str(e)
                part["duration_ms"] = int((time.monotonic() - began) * 1000 / max(1, len(part)))
                yield part[["id", "text", "confidence", "state", "error", "duration_ms"]]

    return rows.mapInPandas(run, f"id {kind}, text string, confidence double, state string, error string, duration_ms int").withColumnRenamed("id", id_col)
