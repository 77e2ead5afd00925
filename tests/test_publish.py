import pytest

from ringside.plans import publish
from ringside.sources import files


def test_generations(spark, tmp_path):
    root = f"file://{tmp_path}/gen"
    with pytest.raises(publish.NotPublished):
        publish.current(spark, root)
    one = spark.range(10).toDF("x")
    first = publish.publish(spark, root, {"t": one})
    assert publish.publish(spark, root, {"t": one.repartition(3)}) == first  # a replay, whatever the order of rows
    assert publish.read_current(spark, root, "t").count() == 10
    with pytest.raises(ValueError, match="too few"):
        publish.publish(spark, root, {"t": spark.range(2).toDF("x")}, {"t": lambda df: ["too few rows"] if df.count() < 5 else []})
    assert publish.current(spark, root).endswith(first) and publish.validate(spark, root) == []
    second = publish.publish(spark, root, {"t": spark.range(20).toDF("x")})
    assert second != first and publish.read_current(spark, root, "t").count() == 20


def test_failures_change_nothing(spark, tmp_path, monkeypatch):
    """While tables are written, before the folder is renamed, before the pointer is replaced."""
    root, one, two = f"file://{tmp_path}/gen", spark.range(10).toDF("x"), spark.range(20).toDF("x")
    first = publish.publish(spark, root, {"t": one})
    seen = lambda: (publish.current(spark, root), publish.read_current(spark, root, "t").count(), publish.validate(spark, root))
    before = seen()

    def fails(*_, **__):
        raise OSError("lost")

    for name in ("table_digest", "_create"):
        with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
            m.setattr(publish, name, fails)
            publish.prepare(spark, root, {"t": two})
        assert seen() == before
    staged = publish.prepare(spark, root, {"t": two})
    with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
        m.setattr(publish, "replace_text", fails)
        publish.commit(spark, staged)
    assert seen() == before and not list((tmp_path / "gen" / "_staging").iterdir())
    again = publish.prepare(spark, root, {"t": two.repartition(3)})
    assert again.generation == staged.generation and publish.commit(spark, again, first) == "published"
    assert publish.read_current(spark, root, "t").count() == 20
    with pytest.raises(publish.Conflict):
        publish.publish(spark, root, {"t": spark.range(3).toDF("x")}, expected=first)
    assert publish.publish(spark, root, {"t": two}, expected="something") == staged.generation  # a replay is no conflict
    assert publish.write_text_once(spark, f"{root}/note.txt", "a\nb") == "written" and publish.write_text_once(spark, f"{root}/note.txt", "a\nb") == "same"
    with pytest.raises(publish.Conflict):
        publish.write_text_once(spark, f"{root}/note.txt", "c")


def test_write_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(5).toDF("x")
    assert publish.write_once(rows, path) == "written" and publish.write_once(rows, path) == "same"
    with pytest.raises(ValueError, match="other rows"):
        publish.write_once(spark.range(6).toDF("x"), path)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], "k string, v int, occurrences long")
    new = spark.createDataFrame([("a", 9, 1), ("c", 3, 1)], "k string, v int, occurrences long")
    assert sorted(map(tuple, publish.upserted(old, new, ["k"]).collect())) == [("a", 9, 3), ("b", 1, 1), ("c", 3, 1)]


def test_scans(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿Red_Fighter;blue_fighter;Event_Date;winner\n Ann ;Bea;2020-01-01;Red\n", encoding="utf-8")
    rows = files.aliased(files.delimited(spark, f"file://{tmp_path}/s.csv", ";"))
    assert [(r.red_name, r.blue_name, r.event_date, r.outcome, r.method) for r in rows.collect()] == [("Ann", "Bea", "2020-01-01", "Red", None)]
    with pytest.raises(ValueError, match="rounds"):
        files.aliased(files.delimited(spark, f"file://{tmp_path}/s.csv", ";"), ("rounds",))
    (tmp_path / "q.md").write_text("# x\n| id | a |\n| review-1 | yes |\n| review-2 | no |\n")
    assert [tuple(r) for r in files.markdown_table(spark, f"file://{tmp_path}/q.md", ["id", "a"]).orderBy("id").collect()] == [("review-1", "yes"), ("review-2", "no")]
    (tmp_path / "d.csv").write_text("id,decision\n1,accept\n")
    assert files.exact_header(spark, f"file://{tmp_path}/d.csv", ["id", "decision"]).count() == 1
    with pytest.raises(ValueError, match="header"):
        files.exact_header(spark, f"file://{tmp_path}/d.csv", ["id", "other"])
    (tmp_path / "l.jsonl").write_text('{"id": "a", "n": 1}\n')
    assert files.ledger(spark, f"file://{tmp_path}/l.jsonl", "id string, n long").first().n == 1
    assert files.blobs(spark, f"file://{tmp_path}/l.jsonl").first().size == 20


def test_records_across_splits(spark, tmp_path):
    """Quoted line breaks anywhere, doubled quotes, blank lines, several files: each record with its line and its number."""
    import csv
    import io
    import random

    r, expected = random.Random(2), []
    for k in range(3):
        out = io.StringIO()
        rows = [["a", "b"]] + [["".join(r.choice('xy"\n;, ') for _ in range(r.randrange(12))), f"{k}-{i}"] for i in range(300)]
        for i, row in enumerate(rows):
            line = out.getvalue().count("\n") + 1
            csv.writer(out, delimiter=";", lineterminator="\n", quoting=csv.QUOTE_MINIMAL if i % 2 else csv.QUOTE_ALL).writerow(row)
            if i:
                expected.append((line, row[0].strip(" "), row[1]))
            if i % 40 == 7:
                out.write("\n")
        (tmp_path / f"f{k}.csv").write_text(out.getvalue())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        rows = files.delimited(spark, f"file://{tmp_path}/f*.csv", ";")
        assert rows.rdd.getNumPartitions() > 1
        found = sorted((x.line, x.a or "", x.b) for x in rows.collect())
        numbers = sorted(x.number for x in files.records(spark, f"file://{tmp_path}/f0.csv").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == sorted(expected) and len(set(numbers)) == 301
    (tmp_path / "g.csv").write_text("a;c\n1;2\n")
    with pytest.raises(ValueError, match="different headers"):
        files.delimited(spark, f"file://{tmp_path}/*.csv", ";")


def test_locator(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(files.redacted_locator(F.lit("https://me:pw@host/a?key=1#x")).alias("u")).first().u
    assert one == "https://host/a"
