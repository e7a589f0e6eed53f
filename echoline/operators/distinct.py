"""Sequential dedup by two keys: a row goes if a row kept before it has its id or its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .durable import durable

#: White space that does not tell ids or texts apart.
EDGE = " \t\n\r\x0b\x0c"


def text_mark(text: Column) -> Column:
    """Digest of a text without white space around it; null where nothing is left."""
    body = F.btrim(text, F.lit(EDGE))
    return F.when(body != "", F.substring(F.sha2(body, 256), 1, 32))


def first_by_id_or_text(
    rows: DataFrame, position: str, id_col: str = "id", text_col: str = "text", max_rounds: int = 200, mark_col: str | None = None, known: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """What a walk in the order of ``position`` (ties by id, then text) keeps, and the rounds that it took.

    Ids and texts are compared without white space around them; rows without either go.  Each round keeps the rows that
    are first of their id and of their text among those left, and drops whoever shares an id or text with them, so the
    result is the walk's own.  Rounds are as many as the longest chain of rows that each decide the next, a few on real data;
    more than ``max_rounds`` raise.  Only positions and digests move; groups are reduced to their first row before any
    shuffle, and nothing is gathered.  Of rows that agree in position, id and text one is kept.

    ``mark_col`` holds the texts' ``text_mark`` where rows have it already; then the texts move only if the result's are
    used, and once.  Rows whose id is the first column of ``known`` take no part.
    """
    mark = F.col(mark_col) if mark_col is not None else text_mark(F.col(text_col))
    usable = rows.withColumns({"_i": F.nullif(F.btrim(F.col(id_col), F.lit(EDGE)), F.lit("")), "_t": mark}).where("_i IS NOT NULL AND _t IS NOT NULL")
    slim = usable.select(F.col("_i").alias("i"), F.col("_t").alias("t"), F.col(position).alias("p")).groupBy("i", "t").agg(F.min("p").alias("p"))
    if known is not None:
        slim = slim.join(known.select(F.btrim(F.col(known.columns[0]), F.lit(EDGE)).alias("i")), "i", "left_anti")
    left, kept, rounds = durable(slim), None, 0
    while True:
        order = F.struct("p", "i", "t")
        by_id = left.groupBy("i").agg(F.min(order).alias("a"))
        by_text = left.groupBy("t").agg(F.min(order).alias("b"))
        told = Observation()
        judged = left.join(by_id, "i").join(by_text, "t").withColumn("first", (order == F.col("a")) & (order == F.col("b")))
        judged = durable(judged.select("i", "t", "p", "first").observe(told, F.count_if(~F.col("first")).alias("rest")))
        chosen = judged.where("first").select("i", "t", "p")
        kept, rounds = chosen if kept is None else kept.union(chosen), rounds + 1
        rest = judged.where("NOT first")
        if not told.get.get("rest", 0):
            break
        if rounds == max_rounds:
            raise RuntimeError(f"{max_rounds} rounds did not decide all rows")
        left = durable(rest.join(chosen.select("i"), "i", "left_anti").join(chosen.select("t"), "t", "left_anti").select("i", "t", "p"))
    # The kept position is the least of its id and text; as a bound it leaves the join dealt by these two, as the next step is.
    out = usable.join(kept.select(F.col("i").alias("_i"), F.col("t").alias("_t"), F.col("p").alias("_p")), ["_i", "_t"])
    out = out.where((F.col(position) <= F.col("_p")) | F.col("_p").isNull())
    return out.dropDuplicates(["_i", "_t"]).select(*rows.columns), rounds
