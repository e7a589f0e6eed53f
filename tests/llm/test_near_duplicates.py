"""Near-duplicate rows against all pairs: repeated and null ids, crowded groups, every stage of the search."""

import random

import pytest

from echoline.llm import minhash


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def expected(rows, percent=75):
    """(component_id, first) of each row by all pairs of rows."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids) if ids else None
    return out


def edited(rng, words, k):
    words = list(words)
    for at in rng.sample(range(len(words)), k):
        words[at] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("cell", [4])
def test_crowded_groups(spark, monkeypatch, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rng = random.Random(cell)
    rows, stems = [], [[f"w{rng.randrange(500)}" for _ in range(n)] for n in (60, 90, 140)]
    for stem in stems:
        rows += [(len(rows) + i, edited(rng, stem, rng.choice([0, 1, 1, 2, 3, 4]))) for i in range(45)]
    rows += [(500 + i, edited(rng, stems[0] + stems[1], 1) + f" tail{i} " * (i % 9)) for i in range(20)]
    rows += [(600 + i, " ".join(stems[2][: 100 + 2 * i])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = expected(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    assert {k: r.component_id for k, r in got.items()} == {rows[i][0]: c for i, c in want.items()}
    assert all(r.kept == (r.doc_id == r.component_id) == r.first for r in got.values())
    assert 10 < len(set(want.values())) < len(rows)


def test_rows_not_ids(spark):
    rng = random.Random(2)
    w, v = ([f"{x}{rng.randrange(300)}" for _ in range(40)] for x in "wv")
    plus = lambda x: " ".join(x) + " more"
    rows = [(1, " ".join(w)), (5, " ".join(v)), (5, plus(w)), (9, plus(v)), (None, plus(w)), (None, "alone in its group of words"), (None, "alone in its group of words"),
            (7, None), (7, ""), (8, " \n"), (11, "twice the same row with its id"), (11, "twice the same row with its id"), (12, "One"), (13, "one")]
    extra = [(i, t, f"x{n}", n) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(extra, "doc_id long, text string, gone_id string, `a.b` int").repartition(3)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in minhash.near_duplicates(df).collect())
    assert got == sorted((str(rows[i][0]), str(c)) for i, c in expected(rows).items())
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    left = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    want = [rows[i] for i in (0, 1, 5, 7, 8, 9, 10, 12)]
    assert left == sorted((str(i), str(t)) for i, t in want)
    assert minhash.keep_one(df.limit(0)).count() == 0 and minhash.near_duplicates(df.limit(0)).count() == 0


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PIECE", 1000)
    words = [f"w{i % 997}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:20_000], "other", *words[20_000:]])), (3, "x" * 200_000), (4, "X" * 200_000)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3}
