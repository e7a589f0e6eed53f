"""Ranked lexical search: postings in term buckets, whole-number BM25-like scores, the best documents of each item.

1. Each document's terms are counted where the document lies; the terms that items ask for become postings (term_id, row,
   doc_id, tf, n), written once, gathered by term bucket and sorted by term.  A bucket that a frequent term makes large is
   split by adaptive execution.  One entry per document under no term carries its length, for N and L.
2. Document frequencies give weights, and for each term the most that a posting of it adds to a score.
3. Items join their rarest terms; documents that lead there are scored in full.  The k-th of these scores is a score that
   at least k documents reach.  Frequent terms that together add less than half of it are left out: only the postings of the
   others are joined, summed per item and document, and a document whose sum cannot reach the k-th score even with all that
   the left-out terms could add goes.  The bounds are whole numbers that no score exceeds, so this loses nothing.
4. The rest are scored in full: their postings join the item's terms, scores are summed by item and document, and
   ``row_number`` over the item takes the first k.

Defined results: null and empty texts have no terms, rank nowhere and do not count in N; items without terms get no rows;
each row of documents and of items stands for itself, also where ids repeat; null ids rank after others of the same score;
an empty table gives no rows; terms and texts of any length are taken whole; other columns are ignored, whatever their
names.  Products of term counts, documents and lengths must stay within 64 bits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, bounded, column

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TO_LOWER = str.maketrans(UPPER, UPPER.lower())

#: Buckets of terms, postings of an item's rarest terms that lead to the first documents, term bytes that may be broadcast.
BUCKETS, FIRST, TERM_BYTES = 256, 20_000, 16 << 20

#: Terms are left out while together they add less than the k-th score over this: more leave fewer documents to score in full.
SHARE = 2


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, term, tf): a row per term of a document, and one under the empty term; row tells documents apart."""
    find = re.compile(TERM).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            each = np.array(sizes)
            long = [pa.array(np.repeat(np.array(x, np.int64), each)) for x in (rows, lengths)]
            ids_of = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), each)))
            return pa.RecordBatch.from_arrays([long[0], ids_of, long[1], pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], ["row", "doc_id", "n", "term", "tf"])

        row = TaskContext.get().partitionId() << 40
        rows, ids, lengths, sizes, terms, tfs = [], [], [], [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row += 1
                found: Counter[str] = Counter()
                for word, tf in Counter(find(text.as_py() or "")).items():
                    found[word.translate(TO_LOWER)] += tf
                if not found:
                    continue
                rows.append(row)
                ids.append(doc_id)
                lengths.append(found.total())
                sizes.append(len(found) + 1)
                terms += ["", *found]
                tfs += [0, *found.values()]
                if len(terms) >= 30_000:
                    yield pack()
                    rows, ids, lengths, sizes, terms, tfs = [], [], [], [], [], []
        if rows:
            yield pack()

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, "row long, doc_id long, n long, term string, tf long")


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, q): how often an item's text has a term; item tells rows of one id apart."""
    low = F.translate(column(text_col).cast("string"), UPPER, UPPER.lower())
    each = items.select(column(item_col).alias("item_id"), low.alias("low")).withColumn("item", F.monotonically_increasing_id())
    return each.select("item", "item_id", F.explode(F.regexp_extract_all("low", F.lit(TERM), F.lit(0))).alias("term")).groupBy("item", "item_id", "term").agg(F.count(F.lit(1)).alias("q"))


def search(
    docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    scratch = Scratch(docs.sparkSession)
    asked = scratch.keep(item_terms(items, item_col, item_text_col))
    terms = scratch.keep(asked.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()
    wanted = terms.union(docs.sparkSession.createDataFrame([("", -1)], "term string, term_id long"))
    wanted = F.broadcast(wanted) if size.n <= BROADCAST_ROWS and size.b <= TERM_BYTES else wanted
    found = term_counts(docs, id_col, text_col).join(wanted, "term").select("term_id", "row", "doc_id", "tf", "n")
    bucket = F.pmod(F.hash("term_id"), F.lit(BUCKETS))
    postings = scratch.keep(found.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term_id"), "zstd")

    total = postings.where("term_id = -1").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    docs_n, words = total.n, total.l or 1
    part = F.expr(f"(1000000000 * tf) div (1000 * tf + 12 * (100 - 25 + ((25 * n * {docs_n}L) div {words}L)))")
    weight = F.floor(1000 * F.log((F.lit(2.0) * docs_n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    stats = postings.where("term_id >= 0").groupBy("term_id").agg(F.count(F.lit(1)).alias("df"), F.max(part).alias("top"))
    stats = scratch.keep(stats.select("term_id", "df", weight.alias("w"), (weight * F.col("top")).alias("top")))
    each = asked.join(bounded(terms), "term").join(bounded(stats), "term_id").select("item", "term_id", "q", "w", "df", (F.col("q") * F.col("top")).alias("most"))
    order = Window.partitionBy("item").orderBy(F.desc("most"), "term_id").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("item").orderBy("most", F.desc("term_id")).rowsBetween(Window.unboundedPreceding, 0)
    each = scratch.keep(each.withColumns({"seen": F.sum("df").over(order) - F.col("df"), "left": F.sum("most").over(after)}))

    def sums(which: DataFrame, rows: DataFrame) -> DataFrame:
        """(item, row, doc_id, score) over the given terms of items and the postings in ``rows``."""
        adds = F.col("q") * F.col("w") * part
        return rows.join(bounded(which.select("item", "term_id", "q", "w")), [c for c in ("item", "term_id") if c in rows.columns]).groupBy("item", "row", "doc_id").agg(F.sum(adds).alias("score"))

    def first(scores: DataFrame, n: int) -> DataFrame:
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        return scores.where("score > 0").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    def whole(which: DataFrame) -> DataFrame:
        """Full scores of the pairs (item, row)."""
        pairs = which.select("item", F.col("row").alias("row"))
        return sums(each, postings.join(bounded(pairs), "row"))

    lead = scratch.keep(first(sums(each.where(F.col("seen") < FIRST), postings), 5 * k).select("item", "row"))
    bar = scratch.keep(first(whole(lead), k).where(F.col("rank") == k).select("item", F.col("score").alias("bar")))
    judged = each.join(bounded(bar), "item", "left").withColumn("bar", F.coalesce("bar", F.lit(1).cast("long")))
    judged = scratch.keep(judged.withColumn("needed", F.col("left") * SHARE >= F.col("bar")))
    rest = judged.groupBy("item").agg(F.coalesce(F.max(F.when(~F.col("needed"), F.col("left"))), F.lit(0)).alias("rest"), F.max("bar").alias("bar"))
    reach = sums(judged.where("needed"), postings).join(bounded(scratch.keep(rest)), "item").where(F.col("score") + F.col("rest") >= F.col("bar"))
    likely = scratch.keep(reach.select("item", "row"))
    names = asked.select("item", "item_id").distinct()
    out = first(whole(likely), k).join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    out = scratch.keep(out)
    scratch.drop(*[frame for _, frame in list(scratch.paths.values()) if frame is not out])
    return out
