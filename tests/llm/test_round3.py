"""Exact copies, source divergence and vector codes against brute force or SQL, and on odd inputs."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from archlake.llm import queries as Q
from archlake.llm import audio, codebooks, divergence, jaccard, licenses, mixing, radix

DATA = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _rank string, g string, rid long, n long"


def docs(spark, rows):
    """rows: (doc_id, text, lang, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, None, "x", "y", 7, 1) for r in rows], SHAPE)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", [n for n in sorted(Q.ORACLE) if int(n[2:].split("_")[0]) > 10])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got, want = Q.QUERIES[name](spark, DATA), con.sql(Q.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert Counter(map(tuple, got.collect())) == Counter(tuple(v[i] for i in at) for v in want.fetchall())


# ---------------------------------------------------------------- exact copies


def copies_by_hand(rows):
    """Counter of (key, keep_id, size, sha) and the number of kept rows of each text."""
    groups = defaultdict(list)
    for k, t, *_ in rows:
        groups[(t or "").translate(str.maketrans(UPPER, UPPER.lower()))].append(k)
    out, each = Counter(), {}
    for t, ks in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        best = max((k for k in ks if k is not None), default=None)
        each[sha] = best
        out.update((k, best, len(ks), sha) for k in ks)
    return out, each


def check_copies(spark, rows, frame=None):
    got = radix.mark_copies(docs(spark, rows) if frame is None else frame).collect()
    want, best = copies_by_hand(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(best.keys())
    assert all(r.doc_id == best[r.text_sha256] for r in got if r.kept)


def test_copies_at_digit_borders(spark):
    """Texts that are equal up to any border of a digit, end there, or differ in the last byte or in case only."""
    rows, long = [], "abÄcdefg hijk" * 30_000
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 16_384, 16_385, 262_144, 262_150):
        t = long.encode()[:n].decode("utf-8", "ignore")
        rows += [t, t, t.upper(), t + "x", t[:-1] + "y", t[:-1] + "y" if n % 2 else t]
    check_copies(spark, [(i * 7 % 1000, t, None, None) for i, t in enumerate(rows)])


def test_copies_random(spark):
    rng = np.random.default_rng(4)
    parts = ["the ", "The ", "éa", "ÉA", "x" * 70, "y" * 900]
    rows = [(int(i), "".join(rng.choice(parts, rng.integers(0, 5))), None, None) for i in rng.permutation(2000)]
    check_copies(spark, rows)


def test_copies_odd(spark):
    rows = [(1, None, None, None), (2, "", "a", "b"), (3, "Same", None, None), (3, "same", None, None), (3, "other", None, None), (None, "same", None, None), (None, "no key", None, None), (None, "NO KEY", None, None), (5, "long " * 400_000, None, None), (6, "LONG " * 400_000, None, None)]
    check_copies(spark, rows)
    assert radix.mark_copies(docs(spark, rows).limit(0)).collect() == []


def test_copies_of_one_text_hold_most_rows(spark):
    """More copies than a heavy group needs, over two digits, with keys that are text."""
    frame = spark.range(6000).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 < 2, F.lit("Hot " * 30)).otherwise(F.concat(F.lit("hot " * 30), "id")).alias("text"))
    got = radix.mark_copies(frame)
    assert got.where("group_size = 4000 and keep_id = '999'").count() == got.where("group_size = 4000").count() == 4000
    assert got.where("kept").count() == 2001


# ---------------------------------------------------------------- divergence of sources


def audit_by_hand(rows, least, top):
    words, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
        found = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in low).split(" ")
        found = [w for w in found if w]
        groups.add((lang, source))
        words[lang, source].update(found)
        documents[lang].update(set(found))
    out = set()
    for lang, source in groups:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def share(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = share(words[lang, source])
        q = share(sum((words[lang, s] for s in sources), Counter()))
        pairs = []
        for other in sources:
            if other != source:
                o = share(words[lang, other])
                pairs.append((sum(abs(p[t] - o[t]) for t in kept), other))
        own = [(p[t] - q[t], t) for t in kept if words[lang, source][t] and p[t] > q[t]]
        for part, found, n in (("pair", pairs, len(pairs)), ("term", own, top)):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
            out |= {(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)}
    return out


def check_audit(spark, rows, least, top):
    got = divergence.audit(docs(spark, rows), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = list(map(tuple, got.collect()))
    assert len(got) == len(set(got)) and set(got) == audit_by_hand(rows, least, top)


def test_divergence_random(spark):
    """Many sources, skewed terms, shared and single ones; alike rows and paths that begin alike."""
    rng = np.random.default_rng(7)
    vocabulary = [f"{c}{d}" for c in "aBcdéf漢" for d in ("x", "Yy", "z-", "w1w")]
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    rows = []
    for i in range(600):
        lang, source = str(rng.choice(["en", "de", None])), f"s{min(int(rng.exponential(3)), 11)}"
        rows.append((i, " ".join(rng.choice(vocabulary, rng.integers(0, 30), p=weight / weight.sum())), None if lang == "None" else lang, source))
    check_audit(spark, rows, 5, 4)
    check_audit(spark, rows, 60, 50)


def test_divergence_odd(spark):
    long = "Wort straße " * 150_000
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "same same", "en", "a"), (3, "same same", "en", "a"), (None, "Same 12 other_other", "en", "b"), (4, "...", "en", "c"), (5, long, "de", "a"), (6, "Wort", "de", "b"), (7, "x", "fr", "alone")]
    check_audit(spark, rows, 1, 50)
    check_audit(spark, rows, 2, 1)
    check_audit(spark, rows, 100, 50)
    assert divergence.audit(docs(spark, rows).limit(0)).collect() == []


def test_terms_are_not_cut_between_blocks():
    text = ("Ünder den Linden, " * 120_000)[:-2]
    found = [t for block in divergence.terms(text) for t in block]
    assert Counter(found) == {"Ünder": 120_000, "den": 120_000, "linden": 120_000} and sum(1 for _ in divergence.terms(text)) > 1


def test_tree_meets_each_pair_once():
    """Corrections of a tree of sorted rows equal those of the single rows."""
    rng = np.random.default_rng(2)
    none = rng.integers(1, 50, 9)
    rows = Counter()
    for _ in range(300):
        on = np.flatnonzero(rng.random(9) < 0.5)
        rows[tuple((int(i), int(none[i] + rng.integers(0, 4)), int(none[i])) for i in on)] += 1
    tree, want = divergence.Tree(), Counter()
    for path, n in sorted(rows.items()):
        tree.insert(*(np.array(v, np.int64) for v in zip(*path, strict=True)) if path else [np.empty(0, np.int64)] * 3, n)
        for b in range(len(path)):
            for a in range(b):
                (i, s, x), (j, t, y) = path[a], path[b]
                want[i, j] += n * (abs(s - t) - abs(s - y) - abs(x - t) + abs(x - y))
    tree.leave(0)
    i, j, v = tree.pairs()
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), v.tolist(), strict=True)) == {k: n for k, n in want.items() if n}


# ---------------------------------------------------------------- vector codes

VECTORS = "vec_id long, embedding array<float>, label string, n long, q string, kind string"


def codes_by_hand(vectors, parts, entries, rounds, scale):
    """vectors: (id, whole numbers) in the order of ids; plain distances in Python's whole numbers."""
    width = -(-max(len(x) for _, x in vectors) // parts)
    cells = [[(list(x) + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for _, x in vectors]
    books = [[c[p] for c in cells[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda c: [min(range(len(books[p])), key=lambda e: (apart(c[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        to = [nearest(c) for c in cells]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, t in zip(cells, to, strict=True) if t[p] == e]
                if mine:
                    books[p][e] = [sum(v) // len(mine) for v in zip(*mine, strict=True)]
    to = [nearest(c) for c in cells]
    return books, ["".join(f"{e:02x}" for e in t) for t in to], [sum(apart(c[p], books[p][t[p]]) for p in range(parts)) for c, t in zip(cells, to, strict=True)]


@pytest.mark.parametrize(("scale", "spread"), [(1024, 1.0), (8, 1.0), (1024, 2e3), (1024, 1e6)])
def test_codes_equal_plain_distances(spark, scale, spread):
    """With many ties (a coarse scale) and with numbers that machine words can't square."""
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(400, 10)) * rng.choice([0.01, 0.3], (400, 1)) * spread).astype(np.float32)
    x[50:90] = x[10:50]
    ids = rng.permutation(400)
    frame = spark.createDataFrame([(int(i), [float(v) for v in row], f"l{i % 3}" if i % 5 else None, 1, "q", "k") for i, row in zip(ids, x, strict=True)], VECTORS).repartition(5)
    rows, codec = codebooks.compress(frame, entries=40, scale=scale)
    got = {r.vec_id: r for r in rows.collect()}
    whole = sorted((int(i), [int(np.floor(float(v) * scale)) for v in row]) for i, row in zip(ids, x, strict=True))
    if spread == 1e6:
        assert max(abs(v) for _, r in whole for v in r) > 1 << 29
    books, codes, errors = codes_by_hand(whole, 4, 40, 4, scale)
    assert [b.tolist() for b in codec.books] == books
    assert [(got[i].code, got[i].error) for i, _ in whole] == list(zip(codes, errors, strict=True))
    by_label = Counter()
    for (i, _), e in zip(whole, errors, strict=True):
        by_label[i % 3 if i % 5 else None] += e
    assert all(got[i].label_error == by_label[i % 3 if i % 5 else None] for i, _ in whole)
    assert codec.decode(got[0].code) == [v for p in range(4) for v in books[p][int(got[0].code[2 * p : 2 * p + 2], 16)]]


def test_bounds_spare_distances_and_b_falls(spark):
    """Over rounds fewer parts are worked out against all entries, and the state keeps fewer of them."""
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(size=(6000, 8))).astype(np.int64)
    books, moves, state, scans, b = x[:128].copy(), None, None, [], codebooks.KEPT
    for _ in range(8):
        if state is None:
            state = codebooks.Bounds.fresh(x, books, b)
        else:
            state = state.narrowed(b)
            state.moved(moves[0])
            needs = state.settle(x, books)
            scans.append(int(needs[0]))
            b = codebooks._next_b(dict(enumerate(needs.tolist())), b)
        d = codebooks.distances(x, books)
        assert (state.kept[:, 0] == d.argmin(1)).all()
        assert (state.upper.astype(float) >= np.sqrt(d.min(1))).all()
        rest = d.copy()
        np.put_along_axis(rest, state.kept.astype(np.int64), 1 << 60, axis=1)
        assert (state.lower[:, -1].astype(float) <= np.sqrt(rest.min(1))).all()
        totals = [{"part": 0, "entry": e, "pos": p, "n": int((state.kept[:, 0] == e).sum()), "total": int(x[state.kept[:, 0] == e, p].sum())} for e in np.unique(state.kept[:, 0]).tolist() for p in range(8)]
        new, moves = codebooks._moved([books], totals)
        books = new[0]
    assert scans[-1] < len(x) / 2 and scans[-1] < scans[0] and b <= codebooks.KEPT


def test_codes_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, "a"), (2, [1.0, None, 2.0], "a"), (3, [nan, 1.0], "a"), (4, [1.0, -inf], None), (5, [0.5, 0.25], None), (5, [0.5, 0.25], None), (6, [], "b"), (7, [1.0] * 5, "b"), (None, [0.1], "b")]
    frame = spark.createDataFrame([(*r, 1, "q", "k") for r in rows], VECTORS)
    out, codec = codebooks.compress(frame)
    got = out.collect()
    assert sorted(str(r.vec_id) for r in got) == ["5", "5", "6", "7", "None"] and all(r.error == r.label_error == 0 for r in got)
    assert len(codec.books[0]) == 5 and codebooks.entries_of(spark, codec).count() == 20
    none, empty = codebooks.compress(frame.limit(0))
    assert none.collect() == [] and empty.text() == ""
    with pytest.raises(Exception, match="too large"):
        codebooks.compress(spark.createDataFrame([(1, [1e30], "a", 1, "q", "k")], VECTORS))


def test_many_rows_of_one_label(spark):
    """A label with most rows is dealt to many tasks."""
    frame = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"), F.when(F.col("id") % 3 == 0, F.col("id")).cast("int").alias("label"))
    rows, _ = codebooks.compress(frame, rounds=1)
    got = rows.agg(F.count("*").alias("n"), F.sum("error").alias("e")).first()
    hot = rows.join(frame.where("label is null").select("vec_id"), "vec_id", "left_semi").agg(F.min("label_error").alias("a"), F.max("label_error").alias("b"), F.sum("error").alias("e")).first()
    assert got.n == 4000 and hot.a == hot.b == hot.e


# ---------------------------------------------------------------- licenses


def test_near_relatives_are_told_apart():
    """Wordings that aren't in the list as they stand: other names, years, comment signs and line ends."""
    gpl = "This file is part of Foo.\n\nFoo is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as\npublished by the Free Software Foundation, either version {} of\nthe License, or (at your option) any later version."
    grant = licenses.WORDINGS[[w[0] for w in licenses.WORDINGS].index("MIT-0")][2]
    warranty = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
    cases = [
        (gpl.format("", 3), {"GPL-3.0"}), (gpl.format("Lesser ", 3), {"LGPL-3.0"}), (gpl.format("Affero ", 3), {"AGPL-3.0"}), (gpl.format("", 2), {"GPL-2.0"}), (gpl.format("Lesser ", "2.1"), {"LGPL-2.1"}),
        ("Copyright 2001 Foo\n" + licenses._BSD_HEAD.replace("1. ", "* ").replace("2. ", "* ") + licenses._BSD_END, {"BSD-2-Clause"}),
        (licenses._BSD_HEAD + licenses._BSD_THIRD.replace("the copyright holder nor the names of its contributors", "Foo Inc. nor the names of its staff") + licenses._BSD_END, {"BSD-3-Clause"}),
        ("# " + licenses._BSD_HEAD[:150].replace("modification", "modification") + " are met:", {"BSD"}),
        (grant + warranty, {"MIT-0"}),
        (grant[:-1] + ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", {"MIT"}),
        ("This photo is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.", {"CC-BY-NC-SA-3.0"}),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", {"ISC"}),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", {"0BSD"}),
        ("This program is free of charge: you can modify it in the general public's interest, whatever version 3 says.", set()),
    ]
    scanner = licenses.Scanner()
    for text, names in cases:
        assert {got["license"] for _, _, got in scanner.confirmed(text.encode())} == names, text
    assert len({w[0] for w in licenses.WORDINGS}) >= 25


def test_spdx_lines(spark):
    rows = [(1, "x\n// SPDX-License-Identifier: Apache-2.0\ncode", None, None), (None, "é SPDX-License-Identifier: MIT OR GPL-2.0-only WITH Classpath-exception-2.0 */", None, None), (3, "SPDX-License-Identifier:", None, None), (4, None, None, None)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert {k: r.license for k, r in got.items()} == {1: "Apache-2.0", None: "MIT OR GPL-2.0-only WITH Classpath-exception-2.0"}
    assert rows[0][1].encode()[got[1].start : got[1].end] == b"SPDX-License-Identifier: Apache-2.0" and got[1].wording is None
    assert rows[1][1].encode()[got[None].start : got[None].end].endswith(b"exception-2.0")


# ---------------------------------------------------------------- audio


def test_alignments_of_texts_by_all_offsets():
    """Every stretch that any offset of two different recordings has is found, for queries with few votes and with very many."""
    rng = np.random.default_rng(12)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(30)]
    texts = [b" ".join(words[i] for i in rng.integers(0, 30, rng.integers(150, 500))) for _ in range(24)]
    texts += [texts[0][:900] + b"xyz" + texts[0][900:], texts[1][400:], texts[2][:700] + texts[3], b"ab " * 900, b"ab " * 500 + texts[4], texts[5] * 2]
    items = [audio.fingerprint(t) for t in texts]
    s, m = audio.Settings(), audio.Match()
    shard = audio.Shard(list(range(len(items))), items)
    want = {q: {(o, *x) for o in range(len(items)) if o != q for x in audio.stretches(items[q], items[o], list(range(-len(items[q]) + 1, len(items[o]))), s, m)} for q in range(len(items))}
    assert sum(map(len, want.values())) >= 8
    for held in (audio.HELD_VOTES, 1000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(audio, "HELD_VOTES", held)
            patch.setattr(audio, "HELD_OVERLAP", held)
            for q in range(len(items)):
                assert set(shard.align(q, items[q], s, m)) == want[q]


# ---------------------------------------------------------------- near duplicates


def test_near_duplicates_with_large_keys(spark):
    """Keys up to the largest bigint, also where one repeats with different texts."""
    top, text = (1 << 63) - 1, "one two three four five six seven eight nine ten eleven twelve"
    rows = [(top, text, None, None), (top - 5, text + " x", None, None), (-3, text, None, None), (top, "other words altogether here now", None, None), (7, "other words altogether here now", None, None), (None, text, None, None), (1 << 62, "", None, None)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs(spark, rows), jaccard.Rule(words=4, num=85, den=100)).collect())
    assert got == Counter([(top, -3), (top - 5, -3), (-3, -3), (top, -3), (7, -3), (None, None), (1 << 62, 1 << 62)])
    gone = {(r.doc_id, r.h is None) for r in jaccard.copies(docs(spark, rows), jaccard.Rule(words=4, num=85, den=100)).collect()}
    assert {d for d, _ in gone} == {top, top - 5}


# ---------------------------------------------------------------- mixing


@pytest.mark.parametrize("n", [65, 300])
def test_many_sources_are_less_than_one_block_off(spark, n):
    """With one source that has nearly half of all slots."""
    weights = mixing.whole_weights(spark.range(n).selectExpr("case when id > 0 then concat('s', id) end as source", "1 + id * 7919 % 97 + if(id = 0, 40 * %d, 0) as weight".replace("%d", str(n))))
    rows = mixing.period_schedule(weights).collect()
    period = rows[0].period
    assert sorted(x for r in rows for x in r.slots) == list(range(period)) and len(rows) == n
    for r in rows:
        for i, slot in enumerate(r.slots):
            assert i - r.units * slot / period < 1 and r.units * slot / period - i < 1 and abs(i + 1 - r.units * (slot + 1) / period) < 1
