"""Line dedup on repeated and null ids, short lines, clashing columns, and the pipeline's stage that drops lines."""

from echoline.llm import lines

LONG = "a line that is long enough to be compared"
ROWS = [
    (1, f"{LONG}\n}}\nshort line\nonly here, and of some length", "x"),
    (2, f"{LONG}s\n}}\nshort line\nfirst of the second document", "y"),
    (2, f"{LONG}\nfirst of another text of that id", "z"),
    (None, f"no id, but this line is here twice\n{LONG}", "n1"),
    (None, f"no id, but this line is here twice\n{LONG}!", "n2"),
    (7, "the same row, twice in the table\nwith two lines in it", "r"),
    (7, "the same row, twice in the table\nwith two lines in it", "r"),
    (8, None, "e"), (9, "", "e"), (10, " \n\n ", "e"), (11, LONG, "gone"),
    (12, "x" * 50_000 + "\n" + "x" * 50_000 + "y", "long"),
]
SCHEMA = "doc_id long, text string, gone string, again int, `a.b` string, n_chars long"


def frame(spark):
    return spark.createDataFrame([(i, t, k, 1, k, len(t or "")) for i, t, k in ROWS], SCHEMA).repartition(3)


def test_rows_are_told_apart(spark):
    got = lines.line_classes(frame(spark)).collect()
    kept = sorted((str(r.doc_id), r.line_no) for r in got if r.kept)
    assert kept.count(("7", 0)) == kept.count(("7", 1)) == 1 and kept.count(("None", 0)) == 1 and ("None", 1) not in kept
    assert {("1", 0), ("1", 1), ("1", 2), ("2", 1), ("2", 3), ("12", 0)} <= set(kept) and not {("2", 2), ("12", 1), ("11", 0)} & set(kept)
    assert kept.count(("2", 0)) == 0 and kept.count(("2", 1)) == 2  # the second one is the other text's
    assert all(r.n_links >= 1 for r in got if (r.doc_id, r.line_no) in ((1, 0), (12, 0), (11, 0)))
    by = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got if r.doc_id in (1, 11, 12)}
    assert by[(11, 0)] == (1, 0) and by[(12, 1)] == (12, 0)
    assert lines.line_classes(frame(spark).limit(0)).count() == 0


def test_dropped_lines(spark):
    df = frame(spark)
    out = lines.drop_repeated_lines(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text if r.text is None or len(r.text) < 99 else len(r.text), r["a.b"]) for r in out.collect())
    by = {k: sorted(x[1] for x in got if x[0] == k and x[1] is not None) for k in {x[0] for x in got}}
    assert by["1"] == [ROWS[0][1]] and by["2"] == ["first of another text of that id", "}\nfirst of the second document"]
    assert by["None"] == ["no id, but this line is here twice"] and by["7"] == [ROWS[5][1]] and by["12"] == [50_000]
    assert by["8"] == [] and by["9"] == [""] and by["10"] == [" \n\n "] and "11" not in by
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    assert lines.drop_repeated_lines(df.limit(0)).columns == df.columns
    assert lines.drop_repeated_lines(df.drop("n_chars", "again")).count() == out.count()
