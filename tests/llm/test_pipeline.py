import corpus_pipeline as P
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    good = [(i, f"the river and stone number {i} over the old road, with light in the night and wind {i * 7}.", "en", f"s{i % 3}", 1) for i in range(60)]
    junk = [(100 + i, "$$$ ### " * 20 + "x" * i, "en", "s1", 1) for i in range(30)]
    near = [(200, good[0][1] * 6, "en", "s0", 1), (201, good[0][1] * 6 + " end", "en", "s0", 1), (5, good[5][1], "en", "s2", 1)]
    empty = [(300, "12 34", "en", None, 0), (None, good[1][1] + " no key here at all", "en", "s1", 1)]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame(good + junk + near + empty, shape).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100)) for r in good[:40] + junk[:20]], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [d]
    for _, stage in P.STAGES[:4]:
        kept.append(P.cut(stage(spark, kept[-1], sf)))
        assert kept[-1].columns == d.columns
    assert kept[1].where("doc_id between 100 and 130").count() == 0 and kept[1].where("doc_id < 60").count() == 61
    assert kept[2].where("doc_id = 300").count() == 0
    ids = [r.doc_id for r in kept[3].collect()]
    assert 200 in ids and 201 not in ids and ids.count(5) == 1 and None in ids
    assert kept[4].exceptAll(kept[3]).isEmpty() and kept[3].exceptAll(kept[4]).isEmpty()
    packed = P.STAGES[4][1](spark, kept[4], sf)
    assert packed.select("doc_id").distinct().count() == kept[4].count()
    assert P.run(spark, sf).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_near_duplicates_of_one_id(spark, tmp_path):
    """Texts of one id are documents of their own; equal rows are one; columns may clash with inner names."""
    one, two = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(1, one), (1, two), (2, one + " end"), (3, ""), (3, ""), (4, two + " end"), (None, one), (None, one)]
    shape = "doc_id long, text string, id string, h int, n int, slot string"
    d = spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], shape)
    kept = P.near_duplicates(spark, d, str(tmp_path))
    assert kept.columns == d.columns
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == sorted([(2, one + " end"), (4, two + " end"), (3, ""), (0, one), (0, one)])
    assert P.near_duplicates(spark, d.limit(0), str(tmp_path)).collect() == []
    mixed = P.mix(spark, d.withColumn("source", F.lit("s")), str(tmp_path))
    assert mixed.columns == [*d.columns, "source"] and mixed.count() == 8


def test_the_driver_gives_freed_memory_back(spark, monkeypatch):
    """After each table that the stages cut; long plans would pile it up."""
    from archlake.llm import jaccard, mixing, packing, store

    assert store.settle(spark)
    assert {P.cut, jaccard.cut, mixing.cut, packing.cut} == {store.cut}
    settled = []
    monkeypatch.setattr(store, "settle", settled.append)
    assert store.cut(spark.range(3)).count() == 3 and settled == [spark]
