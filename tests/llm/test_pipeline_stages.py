"""Every stage of the pipeline against a plain restatement on the stage's own input."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from test_near_duplicates import expected
from test_operators import distance, grouped

from echoline.llm import language, lines, mixing


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def near(a, b):
    """Within two edits; cheap bounds first."""
    x, y = Counter(a), Counter(b)
    return abs(len(a) - len(b)) <= 2 and sum((x - y).values()) <= 2 and sum((y - x).values()) <= 2 and distance(a, b) <= 2


def plain_lines(rows):
    """The texts without repeated lines; None where a text goes."""
    seen = [(k, i, x.strip(lines.BLANK)) for k, t in rows if t for i, x in enumerate(t.split("\n"))]
    unique = sorted({x for *_, x in seen if len(x) >= lines.MIN_CHARS}, key=len)
    edges = []
    for i, a in enumerate(unique):
        for b in unique[i + 1 :]:
            if len(b) > len(a) + 2:
                break
            if near(a, b):
                edges.append((a, b))
    group, first = grouped(unique, edges), {}
    for k, i, x in sorted(seen):
        if len(x) >= lines.MIN_EXACT:
            first.setdefault(group.get(x, x), (k, i))
    out = {}
    for k, t in rows:
        parts = (t or "").split("\n")
        left = [p for i, p in enumerate(parts) if len(x := p.strip(lines.BLANK)) < lines.MIN_EXACT or first[group.get(x, x)] == (k, i)]
        out[k] = t if len(left) == len(parts) else "\n".join(left) if "".join(left).strip(lines.BLANK + "\n") else None
    return {k: t for k, t in out.items() if t is not None or dict(rows)[k] is None}


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # near copies whose lines differ by more than two edits, so that they outlive the line stage
    copies = docs.where("NOT contains(text, '\n') AND n_chars > 600").orderBy("doc_id").limit(6)
    copies = copies.withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.concat(F.lit("Another head. "), "text", F.lit(" And a tail."))})
    docs = docs.unionByName(copies)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out, before = spark.read.parquet(str(tmp_path / name)), rows_of(docs)
        if name != "packing":
            assert out.columns == columns
        got = rows_of(out) if name != "packing" else []
        if name == "language_id":
            kept = {r.doc_id for r in language.identify(docs).where("kept").collect()}
            assert sorted(got) == sorted(x for x in before if x[0] in kept) and len(got) >= 0.9 * len(before)
        elif name == "line_dedup":
            assert dict(got) == plain_lines(before) and got != before
        elif name == "near_dedup":
            component = expected(before)
            assert sorted(k for k, _ in got) == sorted(k for i, (k, _) in enumerate(before) if component[i] == k) and len(got) < len(before)
        elif name == "source_mix":
            plan = {r.doc_id: r.repeats for r in mixing.mix_plan(docs).collect()}
            assert Counter(k for k, _ in got) == Counter({k: n for k, n in plan.items() if n})
            words = Counter()
            for r in mixing.mix_plan(docs).collect():
                words[r.source, r.target] += r.taken
            assert all(abs(target - taken) <= max(2, 0.1 * target) for (_, target), taken in words.items())  # few documents a source
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == {k for k, _ in before} and sum(r.start == 0 for r in rows) == len(before)
            fill = Counter()
            for r in rows:
                fill[r.sequence_id] += r.length
            assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * sum(fill.values()) / 2048 + 1
        seen.append(name)
        docs = out
    assert seen == ["language_id", "line_dedup", "near_dedup", "source_mix", "packing"]
