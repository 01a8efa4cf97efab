"""Whitening, packing and conversation repair against plain versions, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import common, conversations, graph, license_scan, packing, simhash, suffix_tree_lm, token_counts, whitening

VECTORS = "vec_id long, embedding array<float>, n string, x int, component int, whitened string"
TURNS = "conv_id long, turn long, role string, text string, fault int, part string, _d string"
TEXTS = "doc_id long, text string, length string, part string, rest int, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "n", 1, 2, "w") for i, v in rows], VECTORS)


def exact(rows):
    """(n, centred rows, deviations, singular values, components) by whole numbers and one SVD of the rows."""
    x = np.array([[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    _, sv, v = np.linalg.svd(centred, full_matrices=False)
    return n, centred, [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], sv, v


@pytest.mark.parametrize("case", ["plain", "steep", "flat"])
def test_whitening(spark, case):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 6)) + 5
    wide = {"plain": base, "steep": base * np.array([1e4, 100, 1, 1, 0.5, 0.3]), "flat": np.hstack([base, np.round(base[:, :2]) * 2, np.full((400, 1), 7.0)])}[case]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(wide)]
    width = len(rows[0][1])
    bad = [(900, None), (901, []), (902, [1.0] * (width - 1) + [float("nan")]), (903, [1.0] * (width - 1) + [None]), (904, [1.0]), (905, [float("-inf")] * width)]
    got = whitening.whiten(vectors(spark, rows + bad), most=32).collect()
    n, centred, deviations, sv, v = exact(rows)
    k = int((sv > sv[0] * 1e-12).sum())
    assert {r.component for r in got} == set(range(1, k + 1)) and {r.vec_id for r in got} == {i for i, _ in rows} and len(got) == k * n
    assert {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(deviations)) and {r.n for r in got} == {n}
    white = np.zeros((n, k))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
    want = centred @ v[:k].T / (sv[:k] / np.sqrt(n))
    assert np.abs(white * np.sign((white * want).sum(axis=0)) - want).max() < 1e-7
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[i + 1] for i in range(k)], sv[:k] ** 2 / (sv**2).sum(), rtol=1e-7)
    assert np.abs(white.T @ white / n - np.eye(k)).max() < 1e-7 and {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-7


def test_whitening_of_few_and_odd_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0 and whitening.whiten(vectors(spark, [(1, [2.0, 3.0])] * 5)).count() == 0
    got = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (1, [-3e38, 2.0]), (None, [5.0, 1e-30])])).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r.whitened)].count(1) == 2 and {r.component for r in got} == {1}
    many = [(i % 3, [1.0, 2.0]) for i in range(300)] + [(9, [2.0, 2.0])]  # one vector very often
    assert whitening.whiten(vectors(spark, many)).count() == 301


def test_exact_sums_beyond_64_bits():
    c = whitening.Centre(10**13, (10**13 * 7 + 5, -(10**13) * 2))
    x = np.array([[2**60, -(2**60)], [7, -2]])
    assert c.deviation(x) == [sum((c.n * int(v) - s) ** 2 for v, s in zip(row, c.sums, strict=True)) for row in x]


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    length = rng.choice([8, 64, 1024])
    histogram = {n: rng.choice([1, 2, 3, 50, 4000]) for n in rng.sample(range(1, length), rng.randrange(1, min(40, length)))}
    made, fill, pieces = packing.plan(histogram, length), {}, 0
    for n, count in histogram.items():
        for rank in range(count):
            at = 0
            for start, size, sequence, offset in made.pieces(n, rank):
                assert start == at and size > 0
                at += size
                pieces += 1
                fill.setdefault(sequence, []).append((offset, size))
            assert at == n
    ends = []
    for own in fill.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        ends.append(at)
    short = sorted((e for e in ends if e != length), reverse=True)
    assert sorted(fill) == list(range(made.sequences)) and all(e & (e - 1) == 0 for e in short) and len(set(short)) == len(short)
    # As few sequences as there can be, but for the powers of two; patterns are few, whatever the counts.
    assert sum(e == length for e in ends) == sum(n * c for n, c in histogram.items()) // length and len(made.runs) <= 4 * len(histogram) + 1


def test_shortest_pack_first_is_the_one_by_one_rule():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 33) for _ in range(rng.randrange(1, 60))), reverse=True)
        packs: list[list[int]] = []
        for n in lengths:
            fits = [p for p in packs if sum(p) + n <= 32]
            (min(fits, key=sum) if fits else packs.append([]) or packs[-1]).append(n)
        histogram = {n: lengths.count(n) for n in set(lengths)}
        got = sorted(fill for fill, count, _ in packing.shortest_pack_first(histogram, 32) for _ in range(count))
        assert got == sorted(map(sum, packs))


TRICKY = ["", None, " ", "\n", "a\n\nb", "a\n\n\nb", "x  y", " \n ", "a\n b", "tail\n\n", "t\t\tx", "a \x1cb", "don't <|endoftext|> stop<|endoftext|>", "日本語 😀x 😀", "한국어 기사다.", "\x01 a", "nbsp\xa0 x", "é" * 70 + " " + "1234567 " * 30]


def test_ids_are_the_tokenizers():
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.VOCABULARY)
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice(["a", "B.", " ", " ", "\n", "\t", "7", "é", "'s", " ", "!"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    got = [x.tolist() for x in packing.encode(pa.array(texts))]
    assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pack(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.VOCABULARY)
    rng = random.Random(2)
    texts = TRICKY + [" ".join(rng.choice(["alpha", "of", "x,", "Z"]) for _ in range(rng.randrange(90))) for _ in range(300)] + ["same text here"] * 150 + ["word " * 30_000]
    ids = [None, 5, 5, *range(7, len(texts) + 4)]
    df = spark.createDataFrame([(i, t, "l", "p", 1, "n") for i, t in zip(ids, texts, strict=True)], TEXTS).repartition(5)
    got = packing.pack(df, 64).collect()
    want = sorted(((i if i is not None else -1, len(x := [*whole.encode(t or "", add_special_tokens=False).ids, 0])), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in zip(ids, texts, strict=True))
    for (i, n), _ in want:
        own = [r for r in got if (r.doc_id if r.doc_id is not None else -1) == i and r.doc_tokens == n]
        assert sum(r.length for r in own) in (n, 2 * n)
    single = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(ids, texts, strict=True) if i not in (None, 5)}
    sequences: dict[int, list] = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
        if r.doc_id in single:
            assert zlib.crc32(np.array(single[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    fills = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        fills.append(at)
    assert all(f == 64 or f & (f - 1) == 0 for f in fills) and sum(f != 64 for f in fills) <= 6 and sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(df.limit(0)).count() == 0


BARE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        spaced = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        own = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def cheapest(rows):
    """Every edit of every row and up to four inserts anywhere, with whole strings compared."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BARE)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    steps, state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}, {0: (0, "", ())}

    def put(into, place, way):
        if place not in into or way[:2] < into[place][:2]:
            into[place] = way

    def inserted(state):
        for _ in range(4):
            for place, (cost, edits, out) in list(state.items()):
                role, to = ("assistant", 3) if place == 2 else ("user", 2)
                put(state, to, (cost + 3, edits + "I", (*out, (role, ""))))
        return state

    state = inserted(state)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new: dict = {}
        for place, (cost, edits, out) in state.items():
            put(new, place, (cost + 4, edits + "D", out))
            if fault not in (1, 2):
                cost += 3 if fault == 3 else 0
                if (place, role[:1]) in steps:
                    put(new, steps[place, role[:1]], (cost, edits + "K", (*out, (role, text))))
                to = ("assistant", 3) if place == 2 else ("user", 2)
                put(new, to[1], (cost + 3, edits + "R", (*out, (to[0], text))))
        state = inserted(new)
    cost, edits, out = min((state[p] for p in (0, 3) if p in state), key=lambda w: w[:2])
    turns, initials = [t for t, _, _ in rows if t is not None], [r[:1] for _, r, _ in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "d") for r in rows], TURNS)


@pytest.mark.parametrize("piece", [1 << 20, 40])
def test_conversation_repair(spark, monkeypatch, piece):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rng, rows = random.Random(piece), []
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(0, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, turn * 3]), rng.choice(["system", "user", "assistant", "tool", None, "", "u"]), rng.choice(["a.", "b!", "c", None, "", "same.", "x? \n"])))
    rows += [(77, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"{t}.", f"{t}", "hot."])) for t in range(1500)]  # one conversation in all tasks
    rows += [(78, 0, "user", "hot.")] * 500 + [(79, 0, "user", "long " * 100_000 + ".")]
    rng.shuffle(rows)
    want = {c: cheapest(v) for c, v in damaged(rows).items()}
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = turns(spark, rows)
        repaired = conversations.repair(conversations.damage(t))
        got = conversations.every(conversations.reports(repaired), t).collect()
        assert piece > 40 or conversations.repair(conversations.damage(t)).where("conv_id = 77").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want


def test_conversations_without_rows(spark):
    t = turns(spark, [])
    assert conversations.every(conversations.reports(conversations.repair(t)), t).count() == 0
    lone = turns(spark, [(1, 2, "user", "x.")])
    assert tuple(conversations.every(conversations.reports(conversations.repair(lone.limit(0))), lone).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_survivors_are_few_and_freed():
    """Mostly sound turns: what isn't resolved stays short, and all the rest has gone."""
    rng = random.Random(9)
    tree, emitted, most = conversations.Survivors(), 0, 0
    for k in range(20_000):
        tree.add(k, "ua"[k % 2] if rng.random() < 0.9 else rng.choice("sua"), rng.choice([0] * 8 + [1, 3]))
        emitted += len(tree.take())
        most = max(most, tree.held)
    place = conversations.end(tree.state)
    assert emitted + len(tree.finish(place)) == 20_000 and most < 100


def test_pairs_by_size_are_the_pairs_by_key(spark, monkeypatch):
    """Sets of all sizes under few keys: both ways give the pairs that sizes and places leave, all of 4/5 among them."""
    rng = random.Random(12)
    base, sets = rng.sample(range(1000), 60), []
    for _ in range(250):
        own = set(rng.sample(base, rng.randrange(20, 60))) | {rng.randrange(1000, 10**6) for _ in range(rng.randrange(0, 9))}
        sets.append(own)
    count: dict = {}
    for x in sets:
        for e in x:
            count[e] = count.get(e, 0) + 1
    rows = []
    for sig, x in enumerate(sets):
        order = sorted(x, key=lambda e: (count[e], e))[: len(x) - (4 * len(x) + 4) // 5 + 1]
        rows += [(key, sig, (len(x) << 32) + k, sig // 3) for k, key in enumerate(order)]
    members = spark.createDataFrame(rows, "key long, sig long, at long, class long")
    found = {}
    for banded in (1, 10**9):
        monkeypatch.setattr(simhash, "BANDED", banded)
        monkeypatch.setattr(simhash, "GROUP", 16)
        found[banded] = {(r.a, r.b) for r in simhash._pairs(members).collect()}
    near = {(a, b) for b in range(250) for a in range(b) if a // 3 != b // 3 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert found[1] == found[10**9] >= near and len(near) > 100


def test_texts_of_one_template_form_no_pairs(spark):
    """All words but two are shared, which is a Jaccard of 0.7: no two of them stand under one key."""
    rows = []
    for i in range(3000):
        words = [f"w{k}" for k in range(60)]
        words[20], words[40] = f"a{i}", f"b{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = simhash.written(simhash._sketches(df.select(F.col("doc_id").alias("k"), F.xxhash64("text").alias("digest"), "text"), 5))
    members = simhash._contested(simhash._postings(own, 5)).withColumn("class", F.col("sig"))
    assert members.groupBy("key").count().agg(F.max("count")).first()[0] >= 3000 and simhash._pairs(members).count() == 0
    assert simhash.keep_one(df).count() == 3000


def test_licenses_of_a_family_are_told_apart(spark):
    """Public notices that differ in a word, headers in paragraphs before code, and what several licenses share."""
    s = license_scan
    grant = next(t for n, t in s.TEMPLATES if n == "MIT-0")
    header = "\n\n".join(["Copyright 2020 Foo", s._BSD_GRANT, "1. " + s._BSD_SOURCE, "2. " + s._BSD_BINARY, "3. " + s._BSD_NAMES, s._BSD_WARRANTY, "int main(void) { return 0; }\n" * 40])
    cases = {
        "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation.": "LGPL-2.1-only",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
        "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-SA 3.0.": None, grant: "MIT-0", grant.replace("to do so.", "to do so, subject to the following conditions:"): "MIT", header: "BSD-3-Clause", header.replace("3. " + s._BSD_NAMES, "x"): "BSD-2-Clause",
        "Mozilla Public License Version 2.0": "MPL-2.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0", "Licensed under the GPL version 2.": "GPL-2.0-only",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] * 2, "doc_id long, text string")
    got = df.select("doc_id", s.scan_licenses(df["text"]).alias("l")).select("doc_id", "l.license").collect()
    assert len(got) == 2 * len(cases) and {r.doc_id: r.license for r in got} == dict(enumerate(cases.values()))
    assert df.limit(0).select(s.scan_licenses(df["text"])).count() == 0


def test_cuts_leave_no_shuffle_files(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}

    counts = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    df = counts.join(spark.range(10).withColumnRenamed("id", "k").repartition(3), "k")
    chain = spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    before = shuffles()
    assert common.written(df).count() == common.durable(df).count() == 10
    assert {r.component for r in graph.components(chain).collect()} == {0}
    kept = simhash.keep_one(spark.createDataFrame([(i, " ".join(f"w{j + i % 3 * 50}" for j in range(40))) for i in range(12)], "doc_id long, text string"))
    mine = {f"shuffle_{i}_" for i in {int(f.split("_")[1]) for f in shuffles() - before}}
    assert len(mine) <= 2  # of the test's own counts and components, no more
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]
    assert spark.conf.get(common.CLEANUP) == "false" and df.count() == 10


def test_plain_units_count_as_the_long_way_does():
    rng = random.Random(4)
    pieces = [(p, float(rng.randint(-4, 0))) for p in ("a", "b", "é", "ab", "ba", "aab", "bé", "abab", "▁", "▁a")]
    plain, long = token_counts.Counter(pieces), token_counts.Counter(pieces)
    long.single = frozenset()
    units = ["".join(rng.choices("ab▁éx", (4, 4, 1, 1, 0.2), k=rng.randint(1, 12))) for _ in range(3000)]
    assert [plain.unit(u) for u in units] == [long.unit(u) for u in units]
    assert all(plain.plain(u) == plain.unit(u) for u in units if "x" not in u) and plain.unit("x")[1] == plain.unknown


def test_grams_sort_with_their_places():
    rng = np.random.default_rng(6)
    far = rng.integers(0, 1 << 56, 5000)
    for x in (far, far | 7, far[:0], far[:1], np.zeros(50, np.int64), far % 9, np.concatenate([far, far, far ^ 3, far ^ (1 << 12)]), (1 << 55) + far % 1000):
        rising, order = suffix_tree_lm._sorted(x)
        assert sorted(order.tolist()) == list(range(len(x))) and (rising == np.sort(x)).all() and (x[order] == rising).all()
        grams, at = suffix_tree_lm._distinct([x])
        assert (grams == np.unique(x)).all() and (grams[at] == x).all()
