"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines (trimmed) that are equal form a class by 128-bit digest, and the join sees each text once, under a number of its
own.  Lines of at least ``min_chars`` characters within edit distance ``TAU`` = 2 are linked, and linked lines form one
class.  Two lines within distance 2 share at least one of three segments of the shorter one, near the same place; so a
line indexes its three segments under its length, and probes, for every length it could match, the substrings at the few
places where a segment may have shifted to.

A key with many lines is not joined: what its lines have before and behind the segment must agree within the edits
that segment's place allows each side, so those sides are segmented under that key in turn (``LEVELS`` times at most),
and lines that share long parts meet only where the rest agrees as well.  Lines that meet are paired where the parities
of their counts of characters and of neighbouring two differ in so few classes that two edits can explain it.
Candidates are verified by banded bit-parallel edit distance: for each number of errors one word holds the reachable
diagonals of the band, and a character of the text moves all of them at once.

The first occurrence of a class, by (doc_id, line number), stays.

Defined results: null texts have no lines; empty lines are always kept and listed nowhere; lines under ``min_exact``
characters (braces, bullets, numbers) are classes of their own and always kept; those from there to ``min_chars`` are
only matched exactly, as two edits are a large part of them; null ids rank last, by their texts' digests, as do several
texts of one id after the line number; of rows that repeat id and text one counts as the first, the others' lines as
later occurrences; an empty table gives an empty result; lines and texts of any length are taken whole; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, column, components, mark_again, repeated_rows, text_hash, unused

TAU = 2
MIN_CHARS, MIN_EXACT = 20, 10
#: A key with more index rows than this is segmented again.
HOT, LEVELS = 12, 4
BLANK = " \t\r\f\x0b"
#: An encoding of four bytes a character; keys are hashed from it.
WIDE = "UTF-32"


def _digests() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def occurrences(docs: DataFrame, id_col: str, text_col: str, again: str) -> DataFrame:
    """(doc_id, t, again, line_no, line, h1, h2) of non-empty lines; t is the text's digest."""
    lines = docs.select(
        column(id_col).cast("long").alias("doc_id"),
        text_hash(column(text_col)).alias("t"),
        column(again).alias("again"),
        F.posexplode(F.split(column(text_col), "\n")).alias("line_no", "line"),
    ).withColumn("line", F.btrim("line", F.lit(BLANK)))
    return lines.where("line <> ''").select("*", *_digests())


def _places(tau: int, size: Column, n: Column, probe: Column) -> Column:
    """Segments (j, start, at, length) of a piece of ``size``; for probes of length n also where they may have shifted to."""
    parts = tau + 1
    base, longer = F.floor(size / parts).cast("int"), (size % parts).cast("int")

    def segment(j: int) -> Column:
        length = base + (F.lit(j) >= parts - longer).cast("int")
        start = base * j + F.greatest(F.lit(0), F.lit(j) - (parts - longer))
        shift = n - size
        low = F.greatest(F.lit(0), start - j, start + shift - (tau - j))
        high = F.least(n - length, start + j, start + shift + (tau - j))
        low, high = F.when(probe, low).otherwise(start), F.when(probe, high).otherwise(start)
        spots = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda q: F.struct(F.lit(j).alias("j"), start.alias("start"), q.alias("at"), length.alias("length")))

    return F.concat(*[segment(j) for j in range(parts)])


def _deeper(rows: DataFrame) -> DataFrame:
    """One more segment of every row's piece: its key, and the pieces to either side of it.

    A row's ``text`` (length n, hypothesised size ``size``) may differ by ``budget`` edits from its partner's.  Some
    segment j of budget + 1 matches with at most j edits before it and at most budget - j behind it, so a side without
    edits is empty, and only a middle segment leaves two sides, of one edit each.  Such sides take turns: the one cut
    is then put off (``text2``) while the other is cut next.
    """

    def cut(budget: int) -> DataFrame:
        n, size = F.col("n"), F.col("size")
        out = rows.where(F.col("budget") == budget).withColumn("s", F.explode(_places(budget, size, n, F.col("probe"))))
        j, at, length, start = (F.col(f"s.{k}") for k in ("j", "at", "length", "start"))
        key = F.xxhash64("key", j, F.encode(F.substring(F.col("text"), at + 1, length), WIDE)).alias("key")
        left = F.struct(F.substring(F.col("text"), F.lit(1), at).alias("text"), start.alias("size"), at.alias("n"))
        after = F.substring(F.col("text"), at + length + 1, n)
        right = F.struct(after.alias("text"), (size - start - length).alias("size"), (n - at - length).alias("n"))
        if budget == 1:  # what is left of the piece waits, the other one is next
            kept = F.when(j == 0, right).otherwise(left)
            other = F.struct(F.col("text2").alias("text"), F.col("size2").alias("size"), F.col("n2").alias("n"))
            first, second, rest = other, kept, F.lit(1)
        else:
            none = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(0).alias("n"))
            middle = j == 1
            first, second = F.when(j == 2, left).otherwise(right), F.when(middle, left).otherwise(none)
            rest = F.when(middle, 1).otherwise(2)
        out = out.select(key, "id", "probe", rest.alias("budget"), first.alias("p"), second.alias("q"))
        return out.select("key", "id", "probe", "budget", "p.text", "p.size", "p.n", *[F.col(f"q.{k}").alias(f"{k}2") for k in ("text", "size", "n")])

    return cut(TAU).unionByName(cut(1))


def _roots(lines: DataFrame) -> DataFrame:
    """A line's index row under its own length, and its probes under every length it may match."""
    n = F.col("n")
    kinds = F.array(
        F.struct(F.lit(False).alias("probe"), n.alias("size")),
        *[F.struct(F.lit(True).alias("probe"), (n - d).alias("size")) for d in range(TAU + 1)],
    )
    rows = lines.select("id", F.col("line").alias("text"), F.length("line").alias("n"))
    rows = rows.select("id", "text", "n", F.explode(kinds).alias("k"))
    return rows.select(
        F.xxhash64("k.size").alias("key"), "id", "k.probe", F.lit(TAU).alias("budget"), "text", "k.size", "n",
        F.lit("").alias("text2"), F.lit(0).alias("size2"), F.lit(0).alias("n2"),
    )


def _first_keys(lines: DataFrame) -> DataFrame:
    """The same (key, id, probe) as one ``_deeper`` step from ``_roots`` gives.

    The places are a constant list exploded beside the line, so the generated code stays small enough to be compiled;
    in a fixed-width encoding, made once a line, a substring is a slice.
    """
    parts, places = TAU + 1, []
    for shift in range(TAU + 1):
        for j in range(parts):
            if shift == 0:
                places.append((False, shift, j, 0))
            places += [(True, shift, j, move) for move in range(max(-j, shift - (TAU - j)), min(j, shift + (TAU - j)) + 1)]
    listed = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("probe", "shift", "j", "move"), place, strict=True)]) for place in places])
    rows = lines.select("id", F.encode("line", WIDE).alias("wide"), F.length("line").alias("n"))
    rows = rows.select("id", "wide", "n", F.inline(listed)).withColumn("size", F.col("n") - F.col("shift"))
    n, j = F.col("n"), F.col("j")
    base, longer = F.floor(F.col("size") / parts).cast("int"), F.col("size") % parts
    length = base + (j >= F.lit(parts) - longer).cast("int")
    at = base * j + F.greatest(F.lit(0), j - (F.lit(parts) - longer)) + F.col("move")
    rows = rows.select("id", "wide", "n", "probe", "size", "j", at.alias("at"), length.alias("length"))
    rows = rows.where((F.col("at") >= 0) & (F.col("at") + F.col("length") <= n))
    piece = F.substring(F.col("wide"), F.col("at") * 4 + 1, F.col("length") * 4)
    return rows.select(F.xxhash64(F.xxhash64("size"), j, piece).alias("key"), "id", "probe")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (key, id, probe, hot) of the keys under which different lines meet; one exchange, by key."""
    own = Window.partitionBy("key")
    return (
        rows.select("key", "id", "probe").repartition("key")
        .select("key", "id", "probe", F.min("id").over(own).alias("a"), F.max("id").over(own).alias("b"), F.count_if(~F.col("probe")).over(own).alias("n"))
        .where("a < b AND n > 0")
        .select("key", "id", "probe", (F.col("n") > HOT).alias("hot")).distinct()
    )


def _parities(line: Column) -> Column:
    """Two words of 64 bits: bit c is the parity of the number of characters, and of neighbouring two, of class c.

    An edit flips two bits of the first and four of the second at most.
    """

    def word(codes: Column) -> Column:
        return F.aggregate(codes, F.lit(0).cast("long"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), c % 64)))

    codes = F.transform(F.split(line, ""), lambda c: F.ascii(c) * 37 + F.lit(11))
    twos = F.zip_with(codes, F.slice(codes, F.lit(2), F.size(codes)), lambda c, d: c * 3 + F.coalesce(d, F.lit(0)))
    return F.struct(word(codes).alias("ones"), word(twos).alias("twos"))


def _pairs(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs that meet under a key and whose parities allow the distance."""
    marked = rows.join(bounded(bits), "id")
    index = marked.where("NOT probe").select("key", F.col("id").alias("x"), F.col("bits").alias("u"))
    probes = marked.where("probe").select("key", F.col("id").alias("y"), F.col("bits").alias("w"))
    apart = lambda k: F.bit_count(F.col(f"u.{k}").bitwiseXOR(F.col(f"w.{k}")))
    met = index.join(probes, "key").where((F.col("x") != F.col("y")) & (apart("ones") <= 2 * TAU) & (apart("twos") <= 4 * TAU))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def candidates(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of numbers of lines that share segments, and (id, line) of all lines that share a key."""
    found = scratch.keep(_shared(_first_keys(lines)))
    ids = scratch.keep(found.select("id").distinct())
    texts = scratch.keep(lines.join(bounded(ids), "id", "left_semi"))
    bits = scratch.keep(texts.select("id", _parities(F.col("line")).alias("bits")))
    pairs = scratch.keep(_pairs(found.where("NOT hot"), bits))
    hot = found.where("hot")
    if hot.isEmpty():
        return pairs, texts
    ids = scratch.keep(hot.select("id").distinct())
    rows = _deeper(_roots(texts.join(bounded(ids), "id", "left_semi")))
    for level in range(2, LEVELS + 1):
        keys = hot.select("key", "id", "probe").distinct()
        rows = scratch.keep(rows.join(keys, ["key", "id", "probe"], "left_semi").distinct())
        inner = scratch.keep(_deeper(rows))
        found = scratch.keep(_shared(inner))
        last = level == LEVELS
        pairs = pairs.union(scratch.keep(_pairs(found if last else found.where("NOT hot"), bits)))
        hot = found.where("hot")
        if last or hot.isEmpty():
            break
        rows = inner
    return pairs.distinct(), texts


def within(one: Column, two: Column, tau: int = TAU) -> Column:
    """Whether two strings are within ``tau`` edits.

    Bit d of word e is set where the prefixes of lengths j + d - tau and j are within e errors.  One step: a match keeps
    a diagonal, an error moves to the next word by substitution (same diagonal), insertion (one lower) or deletion (one
    higher, in the same step).
    """
    both = F.array(F.struct(F.split(one, "").alias("p"), F.split(two, "").alias("t")))
    return F.transform(both, lambda s: _within(s["p"], s["t"], tau))[0]  # splits each text once


def _within(p: Column, t: Column, tau: int) -> Column:
    mask = (1 << (2 * tau + 1)) - 1
    start = F.struct(*[F.lit(sum(1 << (tau + d) for d in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)])

    def moved(state: Column, match: Column) -> Column:
        words = []
        for e in range(tau + 1):
            word = state[f"r{e}"].bitwiseAND(match)
            if e:
                before = state[f"r{e - 1}"]
                word = word.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[-1], 1)).bitwiseAND(F.lit(mask))
            words.append(word)
        return F.struct(*[w.alias(f"r{e}") for e, w in enumerate(words)])

    def step(state: Column, j: Column) -> Column:
        c, match = F.get(t, j), F.lit(0)
        for d in range(2 * tau + 1):
            match = match + F.when((j + (d - tau) >= 0) & F.coalesce(F.get(p, j + (d - tau)) == c, F.lit(False)), 1 << d).otherwise(0)
        once = F.transform(F.array(match), lambda m: moved(state, m))[0]  # binds the match word, evaluated once
        return F.when(state[f"r{tau}"] == 0, state).otherwise(once)

    end = F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step)
    diagonal = F.size(p) - F.size(t) + tau
    reached = F.call_function("shiftright", end[f"r{tau}"], diagonal.cast("int")).bitwiseAND(F.lit(1)) == 1
    return (F.abs(F.size(p) - F.size(t)) <= tau) & reached


def links(lines: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of numbers of different lines within the distance, and (id, line) of lines that may be in one."""
    pairs, texts = candidates(lines, scratch)
    one = texts.select(F.col("id").alias("a"), F.col("line").alias("p"))
    two = texts.select(F.col("id").alias("b"), F.col("line").alias("t"))
    return scratch.keep(pairs.join(one, "a").join(two, "b").where(within(F.col("p"), F.col("t"))).select("a", "b").distinct()), texts


def _whole(power: int) -> Column:
    return F.lit(Decimal(1 << power)).cast("decimal(20,0)")


def line_classes(
    docs: DataFrame, *, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, t, again, line_no, class_doc_id, class_line_no, n_links, kept), one row per non-empty line.

    ``class_*`` is the first occurrence of the line's class; ``n_links`` counts the other texts that its text is
    linked with directly; t is the document's digest, ``again`` marks rows that repeat another one's id and text.
    """
    scratch, (again,) = Scratch(docs.sparkSession), unused(docs, "again")
    marked = mark_again(docs, repeated_rows(docs, id_col, text_col, scratch), again, id_col, text_col, scratch)
    return _classes(marked, again, min_chars, min_exact, id_col, text_col, Scratch(docs.sparkSession))


def _classes(marked: DataFrame, again: str, min_chars: int, min_exact: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    every = occurrences(marked, id_col, text_col, again)
    unique = every.where(F.length("line") >= max(min_chars, min_exact)).select("line").distinct()
    unique = scratch.keep(unique.select(F.monotonically_increasing_id().alias("id"), "line"), "zstd")
    edges, texts = links(unique, scratch)
    scratch.clear(edges, texts)
    joined = components(edges)
    degree = edges.select("a").union(edges.select("b")).groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    linked = scratch.keep(joined.join(degree.withColumnRenamed("a", "node"), "node").withColumnRenamed("node", "id"))
    linked = scratch.keep(texts.join(bounded(linked), "id").select(*_digests(), "component", "n_links"))
    slim = every.select("doc_id", "t", "again", "line_no", (F.length("line") < min_exact).alias("short"), "h1", "h2")
    near = slim.join(bounded(linked), ["h1", "h2"], "left")
    alone = F.col("component").isNull()
    # place as one number of fixed width, so it is aggregated by hash: id (nulls last, by text), line, text, repetition
    own_id = F.coalesce(F.col("doc_id").cast("decimal(20,0)") + _whole(63), F.shiftrightunsigned("t", 1).cast("decimal(20,0)") + _whole(64)).cast("decimal(20,0)")
    tail = F.col("line_no").cast("long") * F.lit(1 << 29) + F.col("t").bitwiseAND(F.lit((1 << 28) - 1)) * 2 + F.col("again").cast("long")
    near = near.select(
        "doc_id", "t", "again", "line_no", "short", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("h1")).otherwise(F.col("component")).alias("c1"), F.when(alone, F.when(F.col("h2") == 0, 1).otherwise(F.col("h2"))).otherwise(0).alias("c2"),
        (own_id * _whole(60) + tail.cast("decimal(19,0)")).cast("decimal(38,0)").alias("rank"),
    )
    first = near.where("NOT short").groupBy("c1", "c2").agg(F.min("rank").alias("first"), F.max("rank").alias("other")).where("first <> other")
    first = scratch.keep(first.drop("other"))
    placed = near.join(first, ["c1", "c2"], "left").withColumn("first", F.coalesce("first", "rank"))
    rest = F.col("first") % _whole(60)
    head = ((F.col("first") - rest) / _whole(60)).cast("decimal(20,0)")
    result = placed.select(
        "doc_id", "t", "again", "line_no",
        F.when(head < _whole(64), head - _whole(63)).cast("long").alias("class_doc_id"), F.shiftright(rest.cast("long"), 29).cast("int").alias("class_line_no"),
        "n_links", (F.col("first") == F.col("rank")).alias("kept"),
    )
    scratch.clear(linked, first)
    return result


def drop_repeated_lines(
    docs: DataFrame, *, min_chars: int = MIN_CHARS, min_exact: int = MIN_EXACT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without the lines that ``line_classes`` does not keep; texts that lose all lines go.

    The dropped line numbers of one document are gathered beside its text.  ``n_chars`` follows the text.
    """
    scratch, names = Scratch(docs.sparkSession), docs.columns
    again, key, mark, more, gone = unused(docs, "again", "gone_id", "gone_text", "gone_again", "gone")
    marked = mark_again(docs, repeated_rows(docs, id_col, text_col, scratch), again, id_col, text_col, scratch)
    within_run = Scratch(docs.sparkSession)
    classes = _classes(marked, again, min_chars, min_exact, id_col, text_col, within_run)
    lost = classes.where("NOT kept").groupBy(F.col("doc_id").alias(key), F.col("t").alias(mark), F.col("again").alias(more))
    lost = scratch.keep(lost.agg(F.collect_set("line_no").alias(gone)))
    within_run.clear()
    same = column(id_col).cast("long").eqNullSafe(F.col(key)) & (text_hash(column(text_col)) == F.col(mark)) & (F.col(again) == F.col(more))
    both = marked.join(lost, same, "left")
    rest = F.filter(F.split(column(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    hit, text = F.col(gone).isNotNull(), unused(both, "left_text")[0]
    both = both.withColumn(text, F.when(hit, F.array_join(rest, "\n")).otherwise(column(text_col)))
    both = both.where(~hit | (F.btrim(F.col(text), F.lit(BLANK + "\n")) != ""))
    length = F.when(hit, F.length(text).cast("long")).otherwise(column("n_chars")) if "n_chars" in names else None
    return both.select(*[F.col(text).alias(n) if n == text_col else length.alias(n) if n == "n_chars" else column(n) for n in names])
