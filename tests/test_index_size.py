"""An index at size: what it is made of is looked at once, and tasks grow in number, not in rows."""

from pulsegrid.operators import index


def docs_of(spark, n=60):
    return spark.createDataFrame([(i, f"evler haberler k{i % 7} a{i}") for i in range(n)], "id long, text string")


def test_texts_are_looked_at_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    made = index.build(docs_of(spark).mapInArrow(count, "id long, text string"), "id", "text", str(tmp_path / "i"))
    assert seen.value == 60 and index.find(spark, made, "haber k3").count() == 9


def test_tasks_follow_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "ROWS", 16)
    made = index.build(docs_of(spark), "id", "text", str(tmp_path / "i"), stems=False)
    assert index.tasks(made.rows(spark)) == 15  # 240 postings
    asked = spark.createDataFrame([(k, f"haberler k{k}") for k in range(7)], "q long, text string")
    got = sorted(map(tuple, index.find_all(made, asked, "q", "text").collect()))
    assert got == sorted((i % 7, i) for i in range(60))
