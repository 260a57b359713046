"""Places where the code did less than the whole job: one test per finding."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from archlake.llm import audio, licenses, mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_packing_follows_the_mix(spark, monkeypatch):
    rows = [(i, "river stone " * (1 + i % 3), "en", "a" if i < 40 else "b", 1) for i in range(80)]
    docs = P.cut(spark.createDataFrame(rows, DOCS))
    monkeypatch.setattr(P, "WINDOW", 32)

    def packed(share):
        weights = spark.createDataFrame([("a", share), ("b", 1.0)], "source string, weight double")
        monkeypatch.setattr(mixing, "tempered_weights", lambda _: weights)
        got = P.pack(spark, P.cut(P.mix(spark, docs, "")), "").collect()
        slots = {r.doc_id: (r.slot, r.row_in_block) for r in mixing.mix(docs, weights).collect()}
        assert sorted(r.doc_id for r in got) == list(range(80))
        firsts = {}
        for r in got:
            firsts[r.sequence_id] = min(firsts.get(r.sequence_id, (1 << 40, 0)), slots[r.doc_id])
        assert sorted(firsts) == list(range(len(firsts)))
        assert [firsts[s] for s in sorted(firsts)] == sorted(firsts.values())
        for length in {r.length for r in got}:  # within a sequence pieces of one length follow the slots
            same = [(r.sequence_id, r.offset, slots[r.doc_id]) for r in got if r.length == length]
            for s in {x[0] for x in same}:
                own = [x[2] for x in sorted(same) if x[0] == s]
                assert own == sorted(own)
        return {r.doc_id: (r.sequence_id, r.offset) for r in got}

    even, tilted = packed(1.0), packed(20.0)
    assert even != tilted and max(s for s, _ in even.values()) > 5


def test_licenses_of_one_block(spark):
    mit, apache, stray = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "subject to the following"
    full = licenses.WORDINGS[4][2]
    texts = [f"{mit} {apache}", f"{mit}\n{mit}", f"We are {stray} rules of the house. {mit}", f"{full} {mit}", f"{apache}\n" * 200, f"{full}\n" * 20]
    want = [["MIT", "Apache-2.0"], ["MIT", "MIT"], ["MIT"], ["Apache-2.0", "MIT"], ["Apache-2.0"] * 200, ["Apache-2.0"] * 20]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, (text, names) in enumerate(zip(texts, want, strict=True)):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [r.license for r in own] == names
        assert all(text[r.start : r.end] in (mit, apache, full) for r in own)


def test_short_recordings_are_classes_by_content(spark):
    media = [(1, b"one short text"), (2, b"another"), (3, b"one short text"), (4, None), (5, b""), (6, b"another" * 90), (7, b"another" * 90)]
    got = audio.align(spark.createDataFrame(media, "doc_id long, media binary"), "id = 1", "doc_id", "media").collect()
    assert {r.id: r.other for r in got} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6} and {r["items"] for r in got} == {0}
