"""Later resolution of citations, and adjudication of conflict pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .citations import extract, resolve


def on_demand(chunks: DataFrame, edges: DataFrame, exact: DataFrame, chapters: DataFrame, confidence: float = 0.9) -> DataFrame:
    """New CITES edges of chunks(id, text): their citations resolved strictly, without self and known edges."""
    found = chunks.select(F.col("id").alias("src"), F.explode(extract(F.col("text"))).alias("citation"))
    hits = resolve(found, exact, chapters, chapter_fallback=False).where("target is not null and target <> src")
    new = hits.select("src", F.col("target").alias("dst")).distinct().withColumn("rel_type", F.lit("CITES"))
    return new.join(edges.select("src", "dst", "rel_type"), ["src", "dst", "rel_type"], "left_anti").withColumn("confidence", F.lit(confidence))


def retry(unresolved: DataFrame, exact: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, still unresolved) of unresolved(source, citation, rel_type) against a grown index, chapters included."""
    rows = resolve(unresolved, exact, chapters, chapter_fallback=True)
    done = rows.where("target is not null and target <> source").select(F.col("source").alias("src"), F.col("target").alias("dst"), "rel_type").distinct()
    return done, rows.where("target is null").select(*unresolved.columns)


VERDICT = "a long, b long, conflict boolean, description string, resolution string"
REQUIRED = ("conflict", "description", "resolution")


def adjudicate(pairs: DataFrame, texts: DataFrame, judge: Callable[[str, str], dict], chars: int = 500, tries: int = 3) -> DataFrame:
    """Verdicts on pairs(a, b) by a pluggable judge that sees the first ``chars`` of both texts; an answer
    without the required keys is asked for again, then counts as no conflict."""
    t = texts.select("id", F.substring("text", 1, chars).alias("t"))
    rows = pairs.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(frames: Iterator):
        import pandas as pd

        for pdf in frames:
            out = []
            for a, b, ta, tb in zip(pdf.a, pdf.b, pdf.ta, pdf.tb):
                answer: dict = {}
                for _ in range(tries):
                    got = judge(ta, tb)
                    if isinstance(got, dict) and set(REQUIRED) <= got.keys():
                        answer = got
                        break
                out.append((a, b, bool(answer.get("conflict", False)), str(answer.get("description", "")), str(answer.get("resolution", ""))))
            yield pd.DataFrame(out, columns=["a", "b", *REQUIRED])

    return rows.select("a", "b", "ta", "tb").mapInPandas(run, VERDICT)
