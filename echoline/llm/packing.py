"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become token ids with id 0 at the end; those longer than a sequence are cut into full pieces (the first one
may be shorter).  Full pieces are sequences of their own.  All others are dealt into shards of bounded size, and each
shard is packed by a grouping genetic algorithm: crossover injects whole well-filled bins of the other parent, drops
the bins that hold duplicates of their pieces and best-fits the displaced pieces.  Several islands evolve each shard in
separate tasks; between epochs an island's best solution migrates to the next.  Pieces in poorly filled bins of all
shards are then pooled and packed again, so that few bins stay open however many shards there are.

Defined results: a null text is empty (one token, id 0); rows that repeat an id are separate documents; an empty table
gives no sequences; other columns are ignored; the length of a text is not limited.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SEQUENCE = 2048
SHARD_PIECES = 4096
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 5, 4
#: Bins under this share of a sequence are opened again in the pooled round.
POOL_BELOW = 0.99
END_ID = 0


# --- tokens --------------------------------------------------------------------------------------------------------


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes are themselves, others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Token ids of a text as the byte-level BPE file ``path`` defines them.

    The file's vocabulary is run by the faster of two libraries; texts with one of its special strings go through the
    library that reads the file itself, and so does every text if the two disagree on a probe.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [x["content"] for x in spec.get("added_tokens", [])]
    slow = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype="<u4")
    chars = _byte_of_char()
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    quick = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    fast = lambda text: quick.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    probe = "It's  a\tprobe:\n\n 12.5 %, déjà vu, 漢字 <>  end  "
    if not np.array_equal(slow(probe), fast(probe)):
        return slow
    return lambda text: slow(text) if any(s in text for s in special) else fast(text)


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([END_ID], "<u4")).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids))):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the genetic algorithm on one shard ----------------------------------------------------------------------------
# A solution is a list of bins, a bin a list of positions in ``sizes`` (descending).


class _Open:
    """Bins by free room, for best fit: a bit mask tells which rooms occur."""

    def __init__(self, capacity: int):
        self.mask, self.by_room = 0, [[] for _ in range(capacity + 1)]

    def add(self, room: int, at: int) -> None:
        self.by_room[room].append(at)
        self.mask |= 1 << room

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that is enough."""
        fitting = self.mask >> need
        if not fitting:
            return None
        room = need + (fitting & -fitting).bit_length() - 1
        own = self.by_room[room]
        at = own.pop()
        if not own:
            self.mask ^= 1 << room
        return room, at


def best_fit(sizes: list[int], bins: list[list[int]], loose: list[int], capacity: int) -> list[list[int]]:
    """Put ``loose`` pieces, in their order, into ``bins`` (changed) or new ones."""
    rooms = _Open(capacity)
    for at, own in enumerate(bins):
        rooms.add(capacity - sum(sizes[i] for i in own), at)
    for i in loose:
        s = sizes[i]
        found = rooms.take(s)
        if found is None:
            bins.append([i])
            rooms.add(capacity - s, len(bins) - 1)
        else:
            room, at = found
            bins[at].append(i)
            rooms.add(room - s, at)
    return bins


def fitness(sizes: list[int], bins: list[list[int]], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins of unequal filling (room gathered in few bins)."""
    return -len(bins), sum((sum(sizes[i] for i in own) / capacity) ** 2 for own in bins)


def crossover(sizes: list[int], one: list[list[int]], other: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    full = [own for own in other if sum(sizes[i] for i in own) >= 0.97 * capacity] or other[:1]
    chosen = [full[k] for k in rng.permutation(len(full))[: max(1, len(full) // 2)]]
    taken = {i for own in chosen for i in own}
    kept, loose = [list(own) for own in chosen], []
    for own in one:
        if taken.isdisjoint(own):
            kept.append(list(own))
        else:
            loose += [i for i in own if i not in taken]
    return best_fit(sizes, kept, sorted(loose), capacity)


def mutate(sizes: list[int], bins: list[list[int]], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Empty the worst-filled bins and a few others; best-fit their pieces in nearly descending order."""
    order = sorted(range(len(bins)), key=lambda k: sum(sizes[i] for i in bins[k]))
    drop = set(order[: max(2, len(bins) // 20)]) | set(rng.integers(0, len(bins), max(1, len(bins) // 50)).tolist())
    loose = [i for k in drop for i in bins[k]]
    noise = dict(zip(loose, rng.uniform(0.9, 1.0, len(loose)), strict=True))
    loose.sort(key=lambda i: -sizes[i] * noise[i])
    return best_fit(sizes, [list(own) for k, own in enumerate(bins) if k not in drop], loose, capacity)


def to_labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, own in enumerate(bins):
        out[own] = k
    return out


def to_bins(labels: np.ndarray) -> list[list[int]]:
    order = np.argsort(labels, kind="stable")
    edges = np.flatnonzero(np.diff(labels[order])) + 1
    return [x.tolist() for x in np.split(order, edges)]


def evolve(sizes: np.ndarray, population: list[np.ndarray], seed: int, capacity: int = SEQUENCE) -> list[np.ndarray]:
    """The population after some generations, best first; an empty one is begun with best fit (decreasing)."""
    rng, own = np.random.default_rng(seed), sizes.tolist()
    n, least = len(own), -(-int(sizes.sum()) // capacity)
    pool = [to_bins(x) for x in population]
    for k in range(len(pool), POPULATION):
        noise = np.ones(n) if k == 0 else rng.uniform(0.8, 1.0, n)
        pool.append(best_fit(own, [], np.argsort(-sizes * noise, kind="stable").tolist(), capacity))
    ranked = sorted(((fitness(own, b, capacity), k, b) for k, b in enumerate(pool)), key=lambda x: (x[0], -x[1]), reverse=True)
    for g in range(GENERATIONS):
        if -ranked[0][0][0] <= least:
            break
        children = []
        for c in range(2):
            a, b = rng.choice(len(ranked), 2, replace=False)
            child = crossover(own, ranked[min(a, b)][2], ranked[max(a, b)][2], capacity, rng)
            if rng.random() < 0.66:
                child = mutate(own, child, capacity, rng)
            children.append((fitness(own, child, capacity), POPULATION * (g + 2) + c, child))
        ranked = sorted([*ranked, *children], key=lambda x: (x[0], -x[1]), reverse=True)[:POPULATION]
    return [to_labels(x[2], n) for x in ranked]


# --- Spark ---------------------------------------------------------------------------------------------------------


def _pack_round(items: DataFrame, shards: int, number: int) -> DataFrame:
    """Add sequence_id, offset and filled to items; sizes of a shard, not its rows, travel between the epochs."""
    columns = [c for c in items.columns if c != "shard"]
    kind = "shard long, island int, sizes binary, labels binary, count int"
    dealt = materialize(
        items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(shards)))
    )

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(frame["length"].to_numpy().astype(np.int32))[::-1].tobytes()
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame([(shard, k, sizes, b"", 0) for k in range(ISLANDS)], columns=["shard", "island", "sizes", "labels", "count"])

    def step(epoch: int):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("count", ascending=False, kind="stable")
            shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
            raw = next(x for x in frame["sizes"] if x)
            sizes = np.frombuffer(raw, np.int32)
            n = len(sizes)
            found = [np.frombuffer(x, np.int32)[k * n : (k + 1) * n] for x, c in zip(frame["labels"], frame["count"], strict=True) for k in range(c)]
            found = evolve(sizes, found, seed=(number * 31 + epoch) * 1_000_003 + shard * 7 + island)
            rows = [(shard, island, raw, np.concatenate(found).tobytes(), len(found))]
            if epoch + 1 < EPOCHS:
                rows.append((shard, (island + 1) % ISLANDS, b"", found[0].tobytes(), 1))
            else:
                rows = [(shard, island, b"", found[0].tobytes(), 1)]
            return pd.DataFrame(rows, columns=["shard", "island", "sizes", "labels", "count"])

        return run

    state = dealt.select("shard", "length").groupBy("shard").applyInPandas(begin, kind)
    for epoch in range(EPOCHS):
        state = state.groupBy("shard", "island").applyInPandas(step(epoch), kind)

    def place(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("length", ascending=False, kind="stable")
        choices = [np.frombuffer(x, np.int32) for x in right.sort_values("island")["labels"]]
        labels = min(choices, key=lambda x: int(x.max()))
        base = (number << 56) | (int(left["shard"].iloc[0]) << 20)
        left = left.assign(sequence_id=base + labels.astype(np.int64))
        group = left.groupby("sequence_id")["length"]
        return left.assign(offset=group.cumsum() - left["length"], filled=group.transform("sum"))[[*columns, "sequence_id", "offset", "filled"]]

    types = dict(items.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", sequence_id long, offset long, filled long"
    return dealt.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(place, schema)


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    every = materialize(pieces(docs, tokenizer, id_col=id_col, text_col=text_col))
    result = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = every.where(F.col("length") == SEQUENCE).select(
        *result[:5], (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    items = every.where(F.col("length") < SEQUENCE)
    shards = lambda df: max(1, -(-df.count() // SHARD_PIECES))
    first = materialize(_pack_round(items, shards(items), 1))
    done = F.col("filled") >= POOL_BELOW * SEQUENCE
    pooled = first.where(~done).select(*result[:5])
    second = _pack_round(pooled, shards(pooled), 2)
    return full.unionByName(first.where(done).select(*result)).unionByName(second.select(*result))
