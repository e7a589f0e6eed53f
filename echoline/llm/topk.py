"""Exact top-k inner-product search pruned by multi-resolution segment statistics.

Vectors are quantised to floor(scale * x).  For a segment of n components with means m and deviations s,
``q.c <= n * (mq * mc + sq * sc)`` (equivalently, a lower bound of the distance); the sum over segments bounds the
score, tighter with finer segments.  Candidates pass the levels coarse to fine against each query's k-th best score
so far; survivors get exact integer scores, so pruning never changes the result.

Rows are dealt into blocks of bounded size by their length (norm) and a hash.  All queries first meet one block, whose
k-th best score is a bound for each; then a query goes only to the blocks, and a block only to the groups of queries,
where norm times norm can still reach that bound, and starts there with it.  Every pair of a group and a block is one
task's work; the k best of each pair are merged per query.

Defined results: rows with null id, null vector, or null or non-finite components take no part; vectors of other
lengths than the query's are not compared; a query never returns its own row, but other rows of its id; ties go to the
smaller id; rows that repeat an id are separate rows; scores outside 64 bits are held at the range's end; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, column

LEVELS = (1, 4, 16)
QUERY_BLOCK, ROW_BLOCK, STRIDE = 2048, 8192, 1024


def _statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of the segments of each row."""
    d = x.shape[1]
    edges = np.unique(np.linspace(0, d, min(segments, d) + 1).astype(int))
    n = np.diff(edges).astype(np.float64)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / n
    spread = np.sqrt(np.maximum(np.add.reduceat(x * x, edges[:-1], axis=1) / n - mean * mean, 0))
    return n, mean, spread


def _profile(x: np.ndarray, weigh: bool) -> list[np.ndarray]:
    out = []
    for level in LEVELS:
        n, mean, spread = _statistics(x, level)
        out.append(np.hstack([mean * n, spread * n] if weigh else [mean, spread]))
    return out


def _whole(x: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) as integers of any size; products beyond doubles are taken as fractions."""
    scaled = scale * x
    return [math.floor(y) if math.isfinite(y) else math.floor(Fraction(float(a)) * Fraction(scale)) for a, y in zip(x, scaled.tolist(), strict=True)]


def _exact(q: np.ndarray, c: np.ndarray, at_q: np.ndarray, at_c: np.ndarray, safe: bool, given: tuple[np.ndarray, np.ndarray, float] | None = None) -> np.ndarray:
    """Integer scores of pairs; where doubles can't hold them, from the ``given`` vectors and scale, held at 64 bits."""
    out = np.empty(len(at_q), np.int64)
    if not safe:
        raw_q, raw_c, scale = given if given is not None else (q, c, 1.0)
        whole_q, whole_c = ({i: _whole(x[i], scale) for i in np.unique(at).tolist()} for x, at in ((raw_q, at_q), (raw_c, at_c)))
    for i in range(0, len(at_q), 1 << 16):
        a, b = at_q[i : i + (1 << 16)], at_c[i : i + (1 << 16)]
        if safe:
            out[i : i + len(a)] = np.einsum("ij,ij->i", q[a], c[b]).astype(np.int64)
        else:
            for j, (u, v) in enumerate(zip(a.tolist(), b.tolist(), strict=True), i):
                score = sum(x * y for x, y in zip(whole_q[u], whole_c[v], strict=True))
                out[j] = max(-(1 << 63), min((1 << 63) - 1, score))
    return out


def search_block(q_rows: np.ndarray, q: np.ndarray, bar: np.ndarray, ids: np.ndarray, own: np.ndarray, rows: np.ndarray, k: int, given: tuple[np.ndarray, np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of each query's k best rows that reach its ``bar``; row numbers tell its own.

    A bound that overflows says nothing, so its pair is scored; ``given`` has the vectors before scaling, and the scale.
    """
    bar = bar.copy()
    biggest = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(rows).max(initial=0)), 1.0) * max(q.shape[1], 1)
    safe = biggest < 2.0**53
    with np.errstate(over="ignore", invalid="ignore"):
        return _search(q_rows, q, bar, ids, own, rows, k, given, biggest, safe)


def _search(q_rows, q, bar, ids, own, rows, k, given, biggest, safe):
    top_q = np.empty(0, np.int64)
    top_c, top_s = np.empty(0, np.int64), np.empty(0, np.int64)
    q_levels = _profile(q, True)
    for start in range(0, len(rows), STRIDE):
        part = rows[start : start + STRIDE]
        alive = q_rows[:, None] != own[None, start : start + STRIDE]
        for q_level, c_level in zip(q_levels, _profile(part, False), strict=True):
            bound = q_level @ c_level.T
            alive &= ~np.isfinite(bound) | (bound + (np.abs(bound) + biggest * 1e-6) * 1e-6 + 1 >= bar[:, None])
            if not alive.any():
                break
        at_q, at_c = np.nonzero(alive)
        if not len(at_q):
            continue
        score = _exact(q, part, at_q, at_c, safe, given and (given[0], given[1][start : start + STRIDE], given[2]))
        keep = score >= bar[at_q]
        top_q, top_c, top_s = (np.concatenate([a, b[keep]]) for a, b in ((top_q, at_q), (top_c, at_c + start), (top_s, score)))
        order = np.lexsort((ids[top_c], -top_s.astype(object) if not safe else -top_s, top_q))
        top_q, top_c, top_s = top_q[order], top_c[order], top_s[order]
        first = np.searchsorted(top_q, top_q, side="left")
        place = np.arange(len(top_q)) - first
        keep = place < k
        last = place == k - 1
        bar[top_q[last]] = np.maximum(bar[top_q[last]], top_s[last])
        top_q, top_c, top_s = top_q[keep], top_c[keep], top_s[keep]
    return top_q, top_c, top_s


def top_k(
    vectors: DataFrame, is_query: Column, *, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows that meet ``is_query``, against all rows but their own."""
    scratch = Scratch(vectors.sparkSession)
    doubles = column(vector_col).cast("array<double>")
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.least(F.greatest(x * scale, F.lit(-1e150)), F.lit(1e150))), 2.0)))
    usable = vectors.where(column(id_col).isNotNull() & column(vector_col).isNotNull() & (F.size(column(vector_col)) > 0) & finite)
    usable = usable.select(column(id_col).cast("long").alias("id"), column(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), norm.alias("norm"))
    # a level holds norms within a factor of 2^(1/8)
    level = F.when(F.col("norm") > 0, F.floor(F.log2("norm") * 8)).otherwise(-9999).cast("int")
    usable = scratch.keep(usable.select("*", level.alias("level"), F.monotonically_increasing_id().alias("row")))
    levels = usable.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"), F.count_if("q").alias("queries")).collect()  # at most 16,385 levels of a double
    if not levels:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    groups = max(1, -(-sum(x.queries for x in levels) // QUERY_BLOCK))
    blocks = {x.level: -(-x.n // ROW_BLOCK) for x in levels}
    dealt = F.xxhash64("id", "row")
    deal = lambda n: F.pmod(dealt, F.lit(n).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    queries = usable.where("q").select("id", "v", "row", "norm", deal(groups).alias("qb"))
    n_rows = sum(x.n for x in levels)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            lengths, others = left["v"].map(len).to_numpy(), right["c_v"].map(len).to_numpy()
            for d in np.unique(lengths):
                a, b = left[lengths == d], right[others == d]
                if not len(b):
                    continue
                raw_q, raw_c = (np.stack(x.to_numpy()).astype(np.float64) for x in (a["v"], b["c_v"]))
                with np.errstate(over="ignore"):
                    q, c = np.floor(scale * raw_q), np.floor(scale * raw_c)
                i, j, s = search_block(a["row"].to_numpy(), q, a["bar"].to_numpy(np.float64), b["c_id"].to_numpy(), b["c_row"].to_numpy(), c, k, (raw_q, raw_c, scale))
                found.append(pd.DataFrame({"query_id": a["id"].to_numpy()[i], "query_row": a["row"].to_numpy()[i], "vec_id": b["c_id"].to_numpy()[j], "score": s}))
        return pd.concat(found) if found else pd.DataFrame({n: np.empty(0, np.int64) for n in ("query_id", "query_row", "vec_id", "score")})

    kind = "query_id long, query_row long, vec_id long, score long"
    other = [F.col(c).alias(f"c_{c}") for c in ("id", "v", "row")]  # names of its own, or the two sides' columns are taken for one
    probe = usable.where(deal(max(1, n_rows // ROW_BLOCK)) == 0).select(*other, every.alias("qb"))
    first = queries.withColumn("bar", F.lit(float("-inf"))).groupBy("qb").cogroup(probe.groupBy("qb")).applyInPandas(search, kind)
    bars = first.groupBy("query_row").agg(F.min("score").cast("double").alias("bar"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    bars = scratch.keep(bars.select(F.col("query_row").alias("row"), "bar"))
    queries = queries.join(bars, "row", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    queries = scratch.keep(queries)
    # norm times norm bounds the score; the margin covers the rounding of doubles
    reaches = lambda most: F.col("norm") * most * (1 + 1e-9) + 1 >= F.col("bar")
    listed = F.array(*[F.struct(F.lit(x.level).alias("level"), F.lit(float(x.most)).alias("most"), F.lit(blocks[x.level] - 1).cast("long").alias("last")) for x in sorted(levels)])
    sent = queries.withColumn("at", F.explode(F.filter(listed, lambda x: reaches(x["most"]))))
    needed = scratch.keep(sent.select("qb", F.col("at.level").alias("level")).distinct())
    sent = sent.select("id", "v", "row", "bar", "qb", F.col("at.level").alias("level"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("at.last"))).alias("cb"))
    many = F.create_map(*[F.lit(x).cast("long") if i % 2 else F.lit(x) for level, n in blocks.items() for i, x in enumerate((level, n))])
    rows = usable.select(*other, "level", F.pmod(dealt, many[F.col("level")]).alias("cb")).join(bounded(needed), "level")
    found = sent.groupBy("qb", "level", "cb").cogroup(rows.groupBy("qb", "level", "cb")).applyInPandas(search, kind)
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
