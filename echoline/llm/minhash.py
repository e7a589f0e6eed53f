"""Near-duplicate documents: MinHash, banding, sequential Bayesian verification, exact confirmation.

A document's set are its distinct five-word shingles (64-bit digests).  Equal sets are joined into classes by their
128-bit digest first, so copies never meet in pairs.  Classes are banded; every class meets the smallest one of each of
its buckets, and the likeliest of these is confirmed.  Confirmed links join components; pairs within one need no more.
Buckets of at most ``CELL`` classes that still hold several components pair across components.  The classes of larger
ones are indexed anew by single shingles: with all shingles of a set ordered by how many of those sets hold them, rarest
first, two sets of the wanted similarity share one among the first few (prefix filter), and where the first shared one
stands bounds the similarity (position filter).  That loses no pair, and large groups of near copies fall apart by what
is their own; a group that still shares a key is linked through one, then several random members before what is left
over is paired across components.  Candidates compare signatures in batches and go as soon as the posterior probability
of the wanted similarity is under ``miss``; the survivors are confirmed on full sets, which are hashed once.

Banding finds a pair at the threshold with probability 1 - (1 - 0.75^4)^32 = 0.999995, a closer one more likely.

Defined results: null and wordless texts have an empty set and link with nothing; texts under five words have one
shingle, the whole word sequence; rows, not ids, are linked, so an id on several texts loses no link; null ids are
documents like others and rank last, so a component of theirs alone has a null id; an empty table gives an empty
result; texts of any length are taken whole, in pieces of ``PIECE`` bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, column, components, mark_again, text_hash, unused

WORDS, PERCENT = 5, 75
ROWS, BANDS = 4, 32
SIZE = ROWS * BANDS
BATCH = 32
#: Buckets of more classes are indexed anew; the size of the random groups of further star rounds.
CELL, STAR = 16, 8
#: Further star rounds are held (at most as many) while more pairs than this for each row would be left to compare.
LEFT, ROUNDS = 1024, 4
#: Classes whose signatures (128 bytes) are broadcast at most.
SIGNATURE_ROWS = 60_000
PIECE = 1 << 20
#: Rows of shingle sets are handed on in batches of about this many shingles.
BATCH_SHINGLES = 1 << 20

_rng = np.random.default_rng(712)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**32, SIZE, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, SIZE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(_UNBASE, 1 << 12)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if n > len(_UP):
        size = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(_UNBASE, size)
    return _UP, _DOWN


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def word_digests(raw: bytes) -> np.ndarray:
    """64-bit digests of the words of a lower-cased text, pieces at a time, cut at white space."""
    if len(raw) <= PIECE:
        return _word_digests(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_word_digests(raw[at:end]))
        at = end
    return np.concatenate(out)


def _word_digests(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[b]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    if not len(edges):
        return np.empty(0, np.uint64)
    starts, ends = edges[::2], edges[1::2]
    up, down = _tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUE[b] * up[: len(b)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct digests of the text's shingles."""
    words = word_digests((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        whole = np.uint64(n) * _PLACE[WORDS]
        for k in range(n):
            whole = whole + words[k : k + 1] * _PLACE[k]
        return _mix(whole)
    parts = words[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        parts = parts + words[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(parts))


def signature(shingles: np.ndarray) -> np.ndarray:
    x, best = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SIZE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, ((x[i : i + 1024, None] ^ _XOR) * _TIMES).min(axis=0), out=best)
    return best


def band_keys(full: np.ndarray) -> np.ndarray:
    rows = full.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _PLACE[ROWS]
    for k in range(ROWS):
        key = _mix(key + rows[:, k] * _PLACE[k])
    return key.view(np.int64)


def least_matches(miss: float, percent: int = PERCENT) -> dict[int, int]:
    """After n compared hashes, the matches below which P(similarity >= threshold) < miss, under a uniform prior.

    The posterior after m of n matches is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
    """
    t, out = percent / 100, {}
    for n in range(BATCH, SIZE + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, n_shingles, h1, h2, sig, keys); t digests the text, h1 and h2 the set; null where that is empty.

    ``keys`` are the bands' digests; ``sig`` keeps one byte of each hash, which can only add matches.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sigs, keys = [], [], [], []
            for text in batch.column(2):
                own = shingle_set(text.as_py())
                n.append(len(own))
                digests.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(own) else (None, None))
                full = signature(own) if len(own) else None
                sigs.append((full >> np.uint32(8)).astype(np.uint8).tobytes() if len(own) else None)
                keys.append(band_keys(full) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "t", "n_shingles", "h1", "h2", "sig", "keys"],
            )

    slim = docs.select(column(id_col).cast("long").alias("doc_id"), text_hash(column(text_col)).alias("t"), column(text_col).alias("text"))
    return slim.mapInArrow(sign, "doc_id long, t long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>")


def set_classes(signed: DataFrame) -> DataFrame:
    """(node, first, rows, n, sig, keys) of each distinct set; ``first`` is its first row, null ids last."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    return (
        signed.where("h1 IS NOT NULL").groupBy("h1", "h2")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("rows"), F.any_value("n_shingles").alias("n"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id())
    )


def sets_of(docs: DataFrame, chosen: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, shingles) of the classes ``chosen`` (node, first), hashed where the texts are read; a repeated row repeats."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack() -> pa.RecordBatch:
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "shingles"])

        nodes, sets, held = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                nodes.append(node)
                sets.append(shingle_set(text.as_py()))
                held += len(sets[-1])
                if held >= BATCH_SHINGLES:
                    yield pack()
                    nodes, sets, held = [], [], 0
        if nodes:
            yield pack()

    listed = bounded(chosen.select("node", F.col("first.doc_id").alias("d"), F.col("first.t").alias("t")))
    slim = docs.select(column(id_col).cast("long").alias("doc_id"), text_hash(column(text_col)).alias("own"), column(text_col).alias("text"))
    joined = slim.join(listed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("own") == F.col("t")))
    return joined.select("node", "text").mapInArrow(hashed, "node long, shingles array<long>")


def likely(pairs: DataFrame, sigs: DataFrame, miss: float, percent: int = PERCENT) -> DataFrame:
    """(a, b, matches) of the pairs that no batch of hashes rules out."""
    bar = least_matches(miss, percent)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SIZE) for i in (2, 3))
            alive, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
            for at in range(0, SIZE, BATCH):
                matches[alive] += (one[alive, at : at + BATCH] == two[alive, at : at + BATCH]).sum(axis=1)
                alive = alive[matches[alive] >= bar[at + BATCH]]
            if len(alive):
                kept = pa.array(alive)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(matches[alive])], ["a", "b", "matches"])

    side = lambda x: bounded(sigs.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")), SIGNATURE_ROWS)
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, matches long")


def confirm(pairs: DataFrame, sets: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    ids = bounded(scratch.keep(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    needed = sets.join(ids, "node", "left_semi")
    full = pairs.select("a", "b").join(needed.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(
        needed.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"
    )
    shared = F.size(F.array_intersect("x", "y"))
    return full.where((100 + percent) * shared >= percent * (F.size("x") + F.size("y"))).select("a", "b")


def _best(hopeful: DataFrame) -> DataFrame:
    """Of each b's likely partners the likeliest."""
    return hopeful.groupBy("b").agg(F.max(F.struct("matches", -F.col("a"))).alias("m")).select((-F.col("m.col2")).alias("a"), "b")


def _mixed(members: DataFrame, joined: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` (key, node, ...) with their component c, of the keys that hold several; low is the smallest of them."""
    own = members.join(bounded(joined), "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    keys = own.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "low")
    return scratch.keep(own.join(bounded(scratch.keep(keys)), "key"))


def prefixes(sets: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, node, n, place, first): the shingles under which sets of the similarity meet, among those of ``nodes``.

    ``place`` is the shingle's place (from 1) among its set's, those that fewest sets hold first.  Of two sets that are
    similar enough, the smaller holds a shared shingle among its ``first`` ones, the other one in any row given here.
    """
    # dealt out anew, as crowded classes may lie in few files
    rows = sets.join(nodes, "node", "left_semi").repartition("node").select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("key"))
    held = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    own = Window.partitionBy("node")
    alone = F.col("n") - F.count(F.lit(1)).over(own)
    placed = rows.join(held, "key").withColumn("place", alone + F.row_number().over(own.orderBy("held", "key")))
    least = lambda top, bottom: F.expr(f"n - ({top} * n + {bottom} - 1) div {bottom} + 1")
    placed = placed.where(F.col("place") <= least(percent, 100))
    return placed.select("key", "node", "n", "place", (F.col("place") <= least(2 * percent, 100 + percent)).alias("first"))


def _within(one: str, two: str, percent: int) -> str:
    """SQL: whether the sizes and places of rows ``one`` (of the smaller set) and ``two`` allow the similarity."""
    return (
        f"{one}.first AND ({one}.n < {two}.n OR ({one}.n = {two}.n AND {one}.node < {two}.node)) AND 100 * {one}.n >= {percent} * {two}.n"
        f" AND {100 + percent} * (least({one}.n - {one}.place, {two}.n - {two}.place) + 1) >= {percent} * ({one}.n + {two}.n)"
    )


def near_duplicates(docs: DataFrame, *, miss: float = 1e-6, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, t, n_shingles, component_id, kept, first), one per row; t is the text's digest.

    ``component_id`` is the smallest id of the row's component, ``kept`` where that is the row's own; ``first`` holds
    for one id and text of each component, and for all wordless rows.
    """
    scratch, names = Scratch(docs.sparkSession), {"id_col": id_col, "text_col": text_col}
    signed = scratch.keep(signatures(docs, **names))
    classes = scratch.keep(set_classes(signed))
    found = scratch.keep(_links(docs, classes, scratch, miss, percent, names))
    scratch.clear(signed, classes, found)
    joined = scratch.keep(components(found))
    linked = classes.select("node", "first", "rows", "h1", "h2").join(bounded(joined), "node", "left").where("component IS NOT NULL OR rows > 1")
    linked = scratch.keep(linked.withColumn("component", F.coalesce("component", "node")))
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    heads = scratch.keep(linked.select("h1", "h2", "component").join(heads, "component").select("h1", "h2", "head"))
    whole = signed.select("doc_id", "t", "n_shingles", "h1", "h2").join(bounded(heads), ["h1", "h2"], "left")
    alone = F.col("head").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    first = alone | (F.col("head.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("head.t") == F.col("t")))
    result = scratch.keep(whole.select("doc_id", "t", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first")))
    scratch.clear(result)
    return result


def _links(docs: DataFrame, classes: DataFrame, scratch: Scratch, miss: float, percent: int, names: dict) -> DataFrame:
    """Confirmed links (a, b) of classes, enough to join every component."""
    banded = classes.select("node", "n", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count(F.lit(1)).alias("members")).where("a < z")
    shared = scratch.keep(shared.select("key", "a", "members"))
    members = scratch.keep(banded.join(bounded(shared), "key"))
    nodes = scratch.keep(members.select("node").distinct())
    chosen = scratch.keep(classes.join(bounded(nodes), "node", "left_semi").select("node", "first", "sig"))
    sets = scratch.keep(sets_of(docs, chosen, **names))
    if sets.count() != chosen.count():  # rows that repeat id and text
        sets = scratch.keep(sets.groupBy("node").agg(F.any_value("shingles").alias("shingles")))

    def linked(pairs: DataFrame, best: bool) -> DataFrame:
        met = scratch.keep(pairs.select("a", "b").distinct())
        hopeful = likely(met, chosen, miss, percent)
        hopeful = scratch.keep(_best(hopeful) if best else hopeful.select("a", "b"))
        found = scratch.keep(confirm(hopeful, sets, scratch, percent))
        scratch.drop(met, hopeful)
        return found

    links = linked(members.where("a <> node").select("a", F.col("node").alias("b")), True)
    joined = scratch.keep(components(links))
    mixed = _mixed(members.drop("a"), joined, scratch)
    scratch.drop(shared, members, nodes)
    scratch.release()
    few = mixed.where(F.col("members") <= CELL).select("key", "node", "n", "c")
    size = F.expr(f"x.c <> y.c AND x.node < y.node AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    apart = few.alias("x").join(few.alias("y"), "key").where(size).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    links = links.union(linked(apart, False))
    crowded = scratch.keep(mixed.where(F.col("members") > CELL).select("node").distinct())
    if crowded.isEmpty():
        return links

    keyed = scratch.keep(prefixes(sets, bounded(crowded), percent))
    groups = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count_if("first").alias("firsts")).where("a < z AND firsts > 0")
    keyed = scratch.keep(keyed.join(bounded(scratch.keep(groups.select("key"))), "key", "left_semi"))
    either = f"x.c <> y.c AND (({_within('x', 'y', percent)}) OR ({_within('y', 'x', percent)}))"
    for number in range(1 + ROUNDS):
        met = _mixed(keyed, joined, scratch)
        if number:
            sums = met.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.expr("c <> low")).alias("out"))
            row = sums.agg(F.sum(F.col("m") * F.col("out")).alias("left"), F.sum("m").alias("rows")).first()
            if not row.rows or row.left <= LEFT * row.rows:
                break
            sizes = scratch.keep(sums.select("key", F.expr(f"1 + m div {STAR}").alias("cells")))
            cell = F.expr(f"pmod(xxhash64(key, node, {number}), cells)").alias("cell")
            met = scratch.keep(met.join(bounded(sizes), "key").withColumn("key", F.struct("key", cell)).drop("cells"))
        # the one with the fewest rarer shingles is nearest to what the group has in common
        centre = met.groupBy("key").agg(F.min(F.struct("place", "n", "node", "first", "c")).alias("y"))
        stars = met.alias("x").join(centre, "key").where(either)
        links = links.union(linked(stars.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")), True))
        joined = scratch.keep(components(links))
        scratch.release()
    met = _mixed(keyed, joined, scratch)
    rest = met.where("c <> low").alias("x").join(met.alias("y"), "key").where(f"(y.c = y.low OR x.node < y.node) AND {either}")
    return links.union(linked(rest.select(F.expr("least(x.node, y.node)").alias("a"), F.expr("greatest(x.node, y.node)").alias("b")), False))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; wordless rows all stay.

    Of rows that repeat id and text one stays.  Extra columns pass through, whatever their names.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    scratch, found = Scratch(docs.sparkSession), near_duplicates(docs, **options)
    key, mark, again = unused(docs, "gone_id", "gone_text", "again")
    listed = bounded(scratch.keep(found.where("NOT first").select(F.col("doc_id").alias(key), F.col("t").alias(mark)).distinct()))
    left = docs.join(listed, column(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash(column(text_col)) == F.col(mark)), "left_anti")
    repeated = found.where("first AND n_shingles > 0").groupBy("doc_id", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = mark_again(left, repeated.select("doc_id", "t"), again, id_col, text_col, scratch)
    return marked.where(~F.col(again)).drop(again)
