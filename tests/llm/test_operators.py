"""The numbered operators against brute force, exact round trips or held-out rows, and on odd inputs."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from archlake.llm import audio, bpe, gam, jaccard, langid, licenses, maxent, mixing, packing, sharding, topk
from archlake.llm.blocks import pieces
from archlake.llm.components import components

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _rank string"
WORDS = "the of and river stone a cloud to wind in light over tree house road night".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x") for i, t, s in rows], SHAPE)


def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and a column that clashes with inner names."""
    rows = [(1, None, None), (2, "", "a"), (3, "same text here now", "a"), (4, "same text here now", None), (4, "same text here now", None), (None, "no key", "b"), (5, "word " * 60_000, "b"), (6, " \n\t", "b"), (7, "漢字 😀 don't <|endoftext|>", "a")]
    return docs(spark, rows)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 60))) for _ in range(n)]


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 8, 100])
def test_jump_hash(spark, shards):
    got = spark.range(-200, 800).select("id", sharding.jump_shard(F.col("id"), shards).alias("s")).collect()
    assert all(r.s == jump(r.id, shards) for r in got)


def test_sharding(spark):
    got = sharding.shard_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts(300, 1))]), 8).collect()
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    rows = sharding.shard_documents(odd(spark), 8).collect()
    assert len(rows) == 9 and {r.doc_id: r.size for r in rows}[1] == 1
    assert sharding.shard_documents(odd(spark).limit(0), 8).collect() == []


def test_bpe_equals_tokenizer():
    import public_tokenizers as P

    model = bpe.load(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(3)
    signs = [" ", "  ", "\n", "\t", "a", "B", "é", "ɐ", "1", "23", "!", "'", "'s", "×", " ", "漢字", "😀", "<|endoftext|>", "\x1c", "ª"]
    cases = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(3000)] + ["", " "]
    got = []
    for lo, hi, data, offs in pieces(pa.array(cases), 2000):
        ids, at = model.encode(data, offs)
        got += [ids[at[i] : at[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [x.ids for x in model.whole.encode_batch(cases, add_special_tokens=False)]


def test_packing_round_trip(spark):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    table = odd(spark).unionByName(docs(spark, [(100 + i, t, "s") for i, t in enumerate(texts(80, 2))]))
    rows = packing.pack(table, path, window=64).collect()
    whole = bpe.load(path).whole
    for r in table.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        own = {(p.start, p.length, p.ids_crc32, p.doc_tokens) for p in rows if p.doc_id == r.doc_id}
        assert sum(p[1] for p in own) == len(ids) and {p[3] for p in own} == {len(ids)}
        assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c, _ in own)
    by = {}
    for p in sorted(rows, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert max(by.values()) <= 64 and sum(by.values()) >= 0.95 * 64 * len(by)
    assert packing.pack(table.limit(0), path).collect() == []


def test_plan_uses_every_piece():
    h = np.random.default_rng(5).integers(0, 40, 129)
    h[0] = 0
    used = np.zeros(129, np.int64)
    for lengths, n in packing.plan(h, 128):
        assert sum(lengths) <= 128
        for k in lengths:
            used[k] += n
    assert (used == h).all()


def test_topk_brute_force(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.2, (260, 16)).astype(np.float32)
    x[50:70] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (350, [None] * 16), (400, [float("nan")] * 16)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(t, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    q = np.floor(256 * x.astype(float)).astype(np.int64)
    for i in range(0, 260, 50):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(260) if j != i))[:5]
        assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert sorted(got) == list(range(0, 260, 50)) and topk.top_k(t.limit(0), F.lit(True)).collect() == []


def test_topk_odd_inputs(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.0, 0.0]), (2, [1.0, 0.5]), (2, [-1.0, 0.0]), (3, [1.0, 0.5, 0.25]), (50, [0.5]), (100, [0.25]), (None, [1.0, 1.0]), (5, [])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "q": F.lit(1), "w": F.lit(2)})
    got = sorted(tuple(r) for r in topk.top_k(t, F.col("vec_id") % 50 == 0, k=2).collect())
    x = 256 * 256 + 128 * 128
    assert got == [(0, 1, 2, x), (0, 2, 1, 0), (50, 1, 100, 128 * 64), (100, 1, 50, 64 * 128)]
    zeros = spark.createDataFrame([(i, [0.0] * 3) for i in range(4)], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(zeros, F.col("vec_id") == 0, k=2).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0)]


def test_topk_segments_stop_on_proof():
    """Segments hold all postings by descending impact, and stopping early gives the same as all products."""
    rng = np.random.default_rng(31)
    x = np.floor(256 * rng.normal(0, 0.2, (500, 8))).astype(np.int64)
    x[:40] *= 50
    shard = topk.Shard(np.arange(500), x)
    dense = np.zeros(x.size, np.int64)
    dense[shard.place] = shard.value
    assert (dense.reshape(x.shape) == x).all()
    least = [np.abs(shard.value[a:b]).min() for a, b in shard.segments()]
    assert all(np.abs(shard.value[a:b]).max() < low for (a, b), low in zip(shard.segments()[1:], least))
    at, ids, score = shard.best(np.arange(500), x, 3)
    for i in range(500):
        want = sorted((-int(x[i] @ x[j]), j) for j in range(500) if j != i)[:3]
        assert [(-s, j) for s, j in zip(score[at == i].tolist(), ids[at == i].tolist())] == want


def earliest_deadlines(units):
    """Which source takes each slot of a period, by brute force: units as (minus units, name) in the order of ties."""
    period, done, taken = -sum(u for u, _ in units), [0] * len(units), []
    for t in range(period):
        due = [(math.ceil((done[k] + 1) * period / -u), k) for k, (u, _) in enumerate(units) if done[k] < -u and done[k] * period // -u <= t]
        done[min(due)[1]] += 1
        taken.append(units[min(due)[1]][1])
    return taken


def test_pfair_windows_and_deviation(spark):
    table = docs(spark, [(i, "t", f"s{0 if i % 3 else i % 7}") for i in range(900)]).unionByName(docs(spark, [(2000, None, None), (None, "t", "s1"), (None, "t", "s1")]))
    weights = mixing.tempered_weights(table, resolution=100)
    rows = mixing.mix(table, weights, block_rows=2).collect()
    assert len(rows) == 903 and all(r.release <= r.slot < r.deadline for r in rows)
    slots = {(r.source, r.block): r.slot for r in rows}
    assert len(set(slots.values())) == len(slots)
    plan = mixing.period_schedule(weights).collect()
    units, period = {r.source: r.units for r in plan}, plan[0].period
    assert sum(units.values()) == period and 95 <= period <= 105
    taken = earliest_deadlines(sorted(((-u, s) for s, u in units.items()), key=lambda x: (x[0], x[1] is not None, x[1])))
    assert {r.source: r.slots for r in plan} == {s: [t for t, x in enumerate(taken) if x == s] for s in units}
    sizes = Counter(s for s, _ in slots)
    for t in range(0, max(slots.values())):
        for s, u in units.items():
            had = sum(v < t for (x, _), v in slots.items() if x == s)
            assert abs(had - u * t / period) < 1 or had == sizes[s]
    clash = table.withColumns({"slot": F.lit("x"), "block": F.lit(1), "m": F.create_map(F.lit("a"), F.lit(1))})
    assert set(mixing.mix(clash, weights).columns) == {*clash.columns, "_slot", "_block", "_row_in_block", "_release", "_deadline"}
    assert mixing.mix(table.limit(0), mixing.tempered_weights(table.limit(0))).collect() == []


def test_pfair_many_sources(spark):
    """More sources than a row holds: every slot is taken once, each source is less than two blocks off."""
    rng = np.random.default_rng(12)
    weights = spark.createDataFrame([(f"s{k}", float(w)) for k, w in enumerate(rng.pareto(1.2, 1200) + 0.01)] + [("none", 0.0), ("bad", float("nan"))], "source string, weight double")
    plan = mixing.period_schedule(mixing.whole_weights(weights, 4000)).collect()
    period = plan[0].period
    assert len(plan) == 1200 and sorted(t for r in plan for t in r.slots) == list(range(period))
    for r in plan:
        at = np.arange(period + 1)
        assert len(r.slots) == r.units and np.abs(np.searchsorted(r.slots, at) - r.units * at / period).max() < 2


def pure_sets(t, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("rule", [jaccard.Rule(4, 85, 100), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 50, 100)])
def test_jaccard_brute_force(spark, rule):
    rng, base = np.random.default_rng(rule.words), texts(12, 4)
    rows = []
    for i in range(150):
        w = base[i % 12].split()
        for _ in range(rng.integers(0, 4)):
            if w:
                w[rng.integers(len(w))] = str(rng.choice(WORDS))
        rows.append((i, " ".join(w), "s"))
    rows += [(900, None, None), (901, "", None), (902, "Two words", None), (903, "two  WORDS", None), (903, "two words", None)]
    sets = {}
    for i, t, _ in rows:
        sets[i] = pure_sets(t, rule.words)
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if k and rule.den * k >= rule.num * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                comp[rb] = ra
    got = jaccard.near_duplicates(docs(spark, [*rows, (None, "no key", None)]), rule).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: root(i) for i in ids}
    assert {r.doc_id: r.n_shingles for r in got if r.doc_id is not None} == {i: len(s) for i, s in sets.items()}


def test_jaccard_texts_of_one_key(spark):
    """Rows of one key have all their links, whatever their texts; copies() takes each text as a document."""
    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    long = " ".join(f"w{k % 5000}" for k in range(120_000))
    rows = [(5, one, "s"), (5, two, "s"), (1, one + " end", "s"), (2, two + " end", "s"), (9, three, "s"), (9, three, "s"), (7, long, "s"), (3, long + " tail", "s"), (None, one, "s"), (8, "", "s"), (8, three, "s")]
    table = docs(spark, rows).withColumns({"id": F.lit("x"), "n": F.lit(1), "a": F.lit(2), "token": F.lit(3)})
    got = {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(table, jaccard.Rule(4, 85, 100)).collect()}
    assert got == {(5, 1), (1, 1), (2, 1), (9, 8), (8, 8), (7, 3), (3, 3), (None, None)}
    gone = jaccard.copies(table, jaccard.Rule(4, 85, 100)).collect()
    assert sorted((r.doc_id, r.h is None) for r in gone) == [(5, False), (5, False), (7, True), (8, False)]
    assert jaccard.near_duplicates(table.limit(0)).collect() == [] and jaccard.copies(table.limit(0)).collect() == []


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (100, 90), (90, 100), (95, 90)], "u long, v long")
    got = {r.node: r.component for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_maxent_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD_WORDS", 5)
    rows = [(i, t, "s") for i, t in enumerate(texts(120, 6))] + [(500, None, None), (501, "", None), (502, "Unseen WORD", None)]
    held = F.col("doc_id") >= 100
    got = {r.doc_id: r for r in maxent.score(docs(spark, rows), ~held, {"doc_id": F.col("doc_id")}).collect()}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for i, t, _ in rows}
    c = Counter(w for i, ws in tokens.items() if i < 100 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs_tol=1e-8)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n) and got[i].score < 0
    empty = maxent.score(docs(spark, rows[:3]), F.lit(False), {"doc_id": F.col("doc_id")}).collect()
    assert all(abs(r.base_score) < 1e-9 and r.train_tokens == 0 for r in empty)


def test_maxent_histories_sum_to_one():
    w = np.random.default_rng(8).normal(0, 1, maxent.WEIGHTS)
    t = maxent.Table(w.astype(np.float32))
    h = np.repeat([5, 77, 9000], maxent.CLASSES)
    p = 10 ** t.get(h, np.tile(np.arange(maxent.CLASSES), 3)).reshape(3, -1)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_maxent_trees():
    """Leaves of a class sum to one for any history, and the gradient is that of the log likelihood, by brute force."""
    rng = np.random.default_rng(41)
    mass = rng.random(maxent.LEAVES) + 0.1
    weights = rng.normal(0, 1, maxent.TREE_WEIGHTS)
    leaves = (np.arange(1 << maxent.DEPTH, dtype=np.uint64) << np.uint64(5)) + np.uint64(7)
    one, two = (np.full(len(leaves), x, np.uint64) for x in (12345, 999))
    assert math.isclose(np.exp(maxent.tree_log(mass, weights, leaves, one, two)).sum(), 1, abs_tol=1e-9)
    plain = np.exp(maxent.tree_log(mass, 0 * weights, leaves, one, two))
    assert np.allclose(plain, mass[leaves.astype(int)] / mass[leaves.astype(int)].sum())
    keys = rng.integers(0, 1 << 40, 50).astype(np.uint64)
    one, two = np.roll(keys, 1), np.roll(keys, 2)
    g, h = maxent.tree_gradient(mass, weights, keys, one, two)
    used = np.flatnonzero(h)
    for k in used[:: max(1, len(used) // 25)]:
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-4
        down[k] -= 1e-4
        a, b, mid = (maxent.tree_log(mass, w, keys, one, two).sum() for w in (up, down, weights))
        assert math.isclose((a - b) / 2e-4, g[k], abs_tol=1e-4) and math.isclose(-(a + b - 2 * mid) / 1e-8, h[k], abs_tol=1e-2)


def test_maxent_learns_word_order(spark):
    """Words of one class are told apart by the words before them; repeated rows, null keys and clashing columns do no harm."""
    rows = [(i, "red river stone " * 20 if i % 2 else "cold water house " * 20, "s") for i in range(60)] + [(900, "red river stone red river", "s"), (901, "red stone river stone river", "s"), (None, "red river", "s"), (900, "red river stone red river", "s")]
    table = docs(spark, rows).withColumns({"h": F.lit("x"), "_row": F.lit(1), "score": F.lit(2)})
    got = maxent.score(table, F.col("doc_id") < 60, {"doc_id": F.col("doc_id")}).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 64 and score[900] > score[901] and {r.score for r in got if r.doc_id == 900} == {score[900]}
    assert maxent.score(table.limit(0), F.lit(True), {"doc_id": F.col("doc_id")}).collect() == []


def test_quality_model(spark):
    rng = np.random.default_rng(9)
    good = [(i, " ".join(rng.choice(WORDS, 40)), "s") for i in range(120)]
    bad = [(1000 + i, " ".join([str(rng.choice(WORDS)) + "$$$"] * 40), "s") for i in range(120)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in good[:80] + bad[:80]], "doc_id long, quality int")
    model = gam.train(table, labels, F.lit(True))
    got = {r.doc_id: r.score for r in gam.score(table, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == (i < 1000) for i in got)
    assert gam.train(table, labels.limit(0), F.lit(True)) is None
    assert len(gam.score(odd(spark), model, ["doc_id", "text", "_rank"]).collect()) == 9
    assert gam.score(odd(spark).limit(0), None, ["doc_id"]).collect() == []


def test_language_model(spark):
    rng = np.random.default_rng(10)
    two = {"en": WORDS, "de": "der die das und nicht mit straße über schön haus wald".split()}
    rows = [(i, " ".join(rng.choice(two[g], 20)), g) for i in range(200) for g in (["en", "de"][i % 2],)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, F.col("doc_id") < 150)
    got = langid.identify(table, model, ["doc_id", "lang"]).where("doc_id >= 150").collect()
    assert all(r.lang == r.lang_pred and r.accepted and 0 <= r.score <= 1 for r in got)
    rest = {r.doc_id: r.lang_pred for r in langid.identify(odd(spark), model, ["doc_id"]).collect()}
    assert rest[1] == rest[2] == rest[6] == "und" and rest[7] != "und"
    assert langid.train(table.limit(0), F.lit(True)) is None


def test_language_rejection(spark):
    """Random letters and scripts that nobody learnt are rejected, right answers stay, and a rare language is learnt."""
    rng = np.random.default_rng(3)
    en, de = WORDS, "der und fluss stein eine wolke zum wind im licht über baum haus straße nacht".split()
    fi = "joki kivi pilvi tuuli valossa yli puu talo tie yö ja että hän".split()
    rows = [(i, " ".join(rng.choice([en, de][i % 2], rng.integers(30, 80))), ["en", "de"][i % 2]) for i in range(1500)]
    rows += [(2000 + i, " ".join(rng.choice(fi, 50)), "fi") for i in range(8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(table, F.col("doc_id") % 3 != 0, settings=langid.Settings(sample_rows=300))
    assert model.labels == ["de", "en", "fi"] and model.threshold > 0.34
    got = langid.identify(table, model, ["doc_id", "lang"]).where("doc_id % 3 = 0").collect()
    assert sum(r.accepted and r.lang == r.lang_pred for r in got) >= 0.99 * len(got)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    odd = [(i, " ".join("".join(rng.choice(letters, rng.integers(3, 9))) for _ in range(100)), None) for i in range(200)]
    odd += [(500 + i, "".join(rng.choice([chr(c) for c in range(0x3B1, 0x3C9)] + [" "], 400)), None) for i in range(100)]
    got = langid.identify(spark.createDataFrame(odd, table.schema), model, ["doc_id"]).collect()
    assert sum(not r.accepted for r in got if r.doc_id < 500) >= 160
    assert sum(not r.accepted for r in got if r.doc_id >= 500) >= 80


def test_licenses(spark):
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore text.", "s"), (2, "Licensed under the Apache License, Version 2.0.", "s"), (3, "Released under the BSD License.", "s"), (4, "the of and river", "s"), (5, "This work is licensed under the GNU General Public License, version 2.", "s")]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert {i: r.license for i, r in got.items()} == {1: "MIT", 2: "Apache-2.0", 5: "GPL-2.0"}
    assert rows[0][1][got[1].start : got[1].end] == "Released under the MIT License."
    assert licenses.scan(odd(spark)).collect() == []


def test_license_wordings_by_brute_force(spark):
    """Each wording alone, with other case and a changed word, is named; the license is the one that says most of it."""
    rows = []
    for k, (name, keys, text) in enumerate(licenses.WORDINGS):
        rows += [(10 * k, text, name), (10 * k + 1, "Header text of a file.\n" + text.upper() + "\nint main() { return 0; }", name)]
        if len(text.split()) > 12:
            w = text.split()
            at = next(i for i, x in enumerate(w) if i > 2 and not set(licenses.plain_words(x)) & set(keys.split()))
            rows.append((10 * k + 2, " ".join([*w[:at], "otherwise", *w[at + 1 :]]), name))
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").withColumns({"start": F.lit(1), "rank": F.lit("x")})
    got = {}
    for r in licenses.scan(table).collect():
        got.setdefault(r.doc_id, []).append(r.license)
    assert {i: sorted(set(got.get(i, []))) for i, _, _ in rows} == {i: [name] for i, _, name in rows}


def tune(notes, d=0.12, rate=8000):
    t = np.arange(int(rate * d)) / rate
    return np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (k / 12) * t) for k in notes])


def played(x):
    return (np.clip(x, -1, 1) * 127 + 128).astype(np.uint8).tobytes()


def test_audio_alignment(spark):
    rng = np.random.default_rng(11)
    songs = [rng.integers(-12, 12, 40) for _ in range(12)]
    rows = [(50 * i, played(tune(s))) for i, s in enumerate(songs)]
    rows += [(50 * i + 1, played(0.6 * tune(s[8:32]) + 0.03 * rng.normal(size=24 * 960))) for i, s in enumerate(songs)]
    rows += [(3, None), (4, b""), (7, rows[0][1])]
    t = spark.createDataFrame(rows, "doc_id long, media binary")
    got = audio.align(t, "pmod(doc_id, 50) = 0", "doc_id", "media").collect()
    listed = {r.id: r.other for r in got if r.kind == "recording"}
    assert len(listed) == len(rows) and listed[7] == 0 == listed[0] and listed[3] == listed[4]
    found = {(r.id, r.other): r.offset for r in got if r.kind == "match"}
    true = [found.get((50 * i, 50 * i + 1)) for i in range(12)]
    assert sum(o is not None and abs(o + 240) <= 1 for o in true) >= 11  # recall over 0.9, at the right place
    assert all(a // 50 == b // 50 for a, b in found)


def test_audio_precision_and_recall(spark):
    """Excerpts at other places and levels, with noise, among other songs; every pair is also judged by brute force."""
    rng = np.random.default_rng(21)
    songs = [tune(rng.integers(-12, 12, 30)) for _ in range(20)]
    rows, true = [(50 * i, played(x)) for i, x in enumerate(songs)], {}
    for i, x in enumerate(songs[:16]):
        start, noise = 32 * int(rng.integers(0, 500)), float(rng.choice([0.0, 0.02, 0.05]))
        part = float(rng.choice([0.4, 0.8])) * x[start : start + 12_000]
        rows.append((50 * i + 1, played(part + noise * rng.normal(size=len(part)))))
        true[50 * i, 50 * i + 1] = -start // 32
    table = spark.createDataFrame(rows, "doc_id long, media binary").withColumns({"id": F.lit("x"), "items": F.lit(1)})
    got = [r for r in audio.align(table, F.col("doc_id") % 50 == 0, "doc_id", "media").collect() if r.kind == "match"]
    right = {(r.id, r.other) for r in got if (r.id, r.other) in true and abs(r.offset - true[r.id, r.other]) <= 1}
    assert len(right) >= 0.9 * len(true) and len(right) >= 0.9 * len({(r.id, r.other) for r in got})
    s, m = audio.Settings(), audio.Match()
    items = {i: audio.fingerprint(x, s) for i, x in rows}
    slow = set()
    for a in range(0, 1000, 50):
        for b in items:
            if a != b:  # every offset, whatever the votes there
                offsets = list(range(-len(items[a]) + 1, len(items[b])))
                slow |= {(a, b, *x) for x in audio.stretches(items[a], items[b], offsets, s, m)}
    assert {(r.id, r.other, r.offset, r.start, r.votes, r.overlap, r.bit_errors) for r in got} == slow


def test_audio_odd_inputs(spark):
    long = np.random.default_rng(22).integers(0, 255, 700_000).astype(np.uint8).tobytes()
    rows = [(0, long), (1, long[320_000:]), (2, long), (3, None), (4, b""), (5, b"abc"), (6, b"abc"), (None, b"x"), (7, b"xyz"), (7, long[:9000])]
    table = spark.createDataFrame(rows, "id long, h binary")
    got = audio.align(table, "id = 0", "id", "h").collect()
    listed = {r.id: r.other for r in got if r.kind == "recording" and r.id != 7}
    assert listed == {0: 0, 1: 1, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5} and sum(r.id == 7 and r.kind == "recording" for r in got) == 2
    assert {(r.other, r.offset) for r in got if r.kind == "match"} == {(1, -10_000), (7, 0)}
    assert audio.align(table.limit(0), "id = 0", "id", "h").collect() == []
    whole = audio.fingerprint(long)
    assert (whole == audio.fingerprint(long, audio.Settings(block=1 << 14))).mean() > 0.999


def test_audio_wav_widths():
    import io
    import wave

    x = tune([0, 4, 7])
    want = audio.samples(played(x), audio.Settings())[0]
    for width in (2, 3, 4):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1), f.setsampwidth(width), f.setframerate(8000)
            f.writeframes(b"".join(int(v * (2 ** (8 * width - 1) - 1)).to_bytes(width, "little", signed=True) for v in x))
        got, rate = audio.samples(out.getvalue(), audio.Settings())
        assert rate == 8000 and np.abs(got - want).max() < 0.02
