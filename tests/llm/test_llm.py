"""The training-data operators against brute force, and on nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from broadsheet.llm import decontaminate, license_scan, line_quality, mixing, sharding, simhash, suffix_dedup, suffix_tree_lm, token_counts, url_filter
from broadsheet.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _row string, fp int, host string, row int, key string"


def docs(spark, rows):
    """rows: (doc_id, text, source); further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", 1, "h", 2, "k") for i, t, s in rows], DOCS)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "Alpha", "beta,", "gamma", "delta.", "x", "ünï", "#tag", "end"]
    out = []
    for i in range(n):
        t = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(0, 6)))
        out.append((i, t, rng.choice(["a", "b", None])))
    out += [(n, out[3][1], "a"), (n + 1, None, "a"), (n + 2, "", None), (n + 3, " \t\n", "b"), (None, "no key at all here", "a"), (5, out[5][1], out[5][2])]
    out.append((n + 4, "long " * 40_000, "b"))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_components(spark):
    rng = random.Random(2)
    e = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(None, 1), (7, 7)]
    label = {x: x for p in e for x in p if x is not None}
    for _ in range(200):
        for a, b in e:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    want = {x: label[x] for a, b in e if a is not None and a != b for x in (a, b)}
    assert {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_rules_and_aliases(spark):
    pages = [
        (1, "HTTP://A.ORG/x", '<link rel="canonical" href="http://b.com/de/1">'), (2, "http://b.net/q#f", "<link href=/zz rel=canonical>"), (3, "http://c.net/q", '<META content="0; url=http://b.com/de/9" http-equiv=refresh>'),
        (4, None, None), (5, "http://b.net/zz", ""), (6, "no scheme", "x"), (7, "http://example.org/es/1?a", None), (8, "http://sub.example.org/en/12", None), (9, "http://b.com/de/1", None), (10, "http://d.net?x", None), (10, "http://d.net?x", None),
        (11, "http://e.net/a", '<link rel=canonical href=http://a.org/x>'), (12, "http://notorg/x", None),
    ]
    df = spark.createDataFrame([(*p, "w", "v") for p in pages], "page_id long, url string, html string, verdict string, node string")
    more = spark.createDataFrame([("http://b.net/zz", "http://c.net/q"), ("http://b.com/de/1", "http://f.net/1"), (None, "x")], "src string, dst string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, more).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[9] == ("b.com", "/de/1", "com/de/", "block")
    assert got[2][2:] == got[3][2:] == got[5][2:] == (None, "block")
    assert got[4] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("example.org/es/", "block") and got[8][2:] == ("example.org/en/1", "block")
    assert got[10] == ("d.net", "", None, "allow") and got[11][3] == "allow" and got[12][2] is None
    assert url_filter.judge_urls(df.limit(0)).count() == 0 and url_filter.judge_urls(df).count() == len(pages)


def test_links_of_pages(spark):
    from urllib.parse import urljoin

    links = ["page2", "./x", "../x", "../../../y", "?a=b", "#z", "/q/./r/../s", "//o.org/z", "http://k/l", "d/", "..", ".", "o'brien.html"]
    cases = [(b, x) for b in ("http://h.com/a/b/c?x=1#f", "http://h.com", "http://h.com?q") for x in links]
    got = spark.createDataFrame(cases, "b string, l string").select("b", "l", url_filter._absolute(F.col("b"), F.col("l")).alias("u")).collect()
    assert [r.u for r in got if r.l not in ("?a=b", "#z", "..", ".") or r.b.count("/") > 3] == [urljoin(r.b, r.l) for r in got if r.l not in ("?a=b", "#z", "..", ".") or r.b.count("/") > 3]
    pages = [
        ("http://h.com/d/1", """<link href="http://h/o'brien" rel='canonical'>""", "http://h/o'brien"), ("http://h.com/d/2", """<base href='/e/'><link rel="alternate canonical" href=x.html>""", "http://h.com/e/x.html"),
        ("http://h.com/d/3", """<meta http-equiv="Refresh" content="0; URL='../k?a=1&amp;b=2'">""", "http://h.com/k?a=1&b=2"), ("http://h.com/d/4", "<link rel=stylesheet href=y.css><meta name=refresh content='url=z'>", None), ("http://h.com/d/5", "<link data-rel=canonical rel=next href=n>" + "<p>" * 50_000, None),
    ]
    found = url_filter.page_links(spark.createDataFrame([p[:2] for p in pages], "url string, html string")).collect()
    assert {r.src: r.dst for r in found} == {p[0]: p[2] for p in pages if p[2]}


def test_a_hot_class_of_aliases(spark):
    pages = spark.createDataFrame([(i, f"http://m{i}.net/", "") for i in range(300)] + [(900 + i, None, None) for i in range(50)], "page_id long, url string, html string")
    edges = spark.createDataFrame([(f"http://m{i}.net/", "http://x.com/de/hub") for i in range(0, 300, 2)], "src string, dst string")
    got = {r.page_id: (r.verdict, r.alias_class) for r in url_filter.judge_urls(pages, edges).collect()}
    assert len(got) == 350 and all(got[i] == (("block", "http://m0.net/") if i % 2 == 0 else ("allow", None)) for i in range(300)) and got[900] == ("allow", None)


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.concatenate((np.arange(5000), [-1, 2**62]))
    def plain(key, n):
        key, b, j = key % 2**64, -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
        return b
    for n in (1, 2, 39, 40):
        a, b = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert a.tolist() == [plain(int(k), n) for k in keys] and a.max() < n
        assert (b[a != b] == n).all()
    assert 0.5 / 41 < (sharding.jump_hash(keys, 40) != sharding.jump_hash(keys, 41)).mean() < 2 / 41


def test_shard_slots(spark, rows):
    got = sharding.shard_slots(docs(spark, rows), 7).collect()
    assert len(got) == len(rows)
    slots = Counter()
    for r in got:
        slots[r.shard] += 1
    for s, n in slots.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    text = {i: t for i, t, _ in rows}
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got)
    assert sharding.assign_shards(docs(spark, rows), 7).where("shard < 0 or shard > 6").count() == 0
    assert sharding.shard_slots(docs(spark, []), 7).count() == 0


def test_token_counts_match_a_tokenizer(rows):
    tokenizers = pytest.importorskip("tokenizers")
    pieces = token_counts.read_pieces()
    tk = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *pieces], unk_id=0, byte_fallback=True))
    counter = token_counts.Counter(pieces)
    for t in [t for _, t, _ in rows if t and len(t) < 5000] + ["a", "  ", "日本語 😀x", "\n\n a", "ab  cd   e", "ﬀ　x", "a" * 300]:
        assert counter.text(t)[0] == len(tk.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids), t[:50]
    assert counter.text("") == (0, 0.0)


def test_token_counts_against_brute_force(spark):
    pieces = [("▁", -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("▁a", -5.0), ("ba", -3.5), ("bab", -6.0), ("abab", -7.5)]
    def best(t):
        t = "▁" + t.replace(" ", "▁")
        score, n, at = [0.0], [0], dict(pieces)
        unknown = min(at.values()) - 10
        for e in range(1, len(t) + 1):
            options = [(score[s] + at[t[s:e]], -s, n[s] + 1) for s in range(e) if t[s:e] in at]
            if t[e - 1] not in at:
                options.append((score[e - 1] + unknown, -(e - 1), n[e - 1] + len(t[e - 1].encode())))
            v, _, c = max(options)
            score.append(v)
            n.append(c)
        return n[-1], score[-1]
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None), (999, "")], "doc_id long, text string")
    got = {r.doc_id: tuple(r.t) for r in df.select("doc_id", token_counts.count_tokens(df, pieces).alias("t")).collect()}
    assert all(got[i] == best(t) for i, t in enumerate(texts)) and got[None] == got[999] == (0, 0.0)


def test_token_counts_of_long_units_and_odd_tables(spark, rows, monkeypatch):
    pieces = token_counts.read_pieces()
    whole = token_counts.Counter(pieces)
    texts = ["".join(random.Random(s).choice("abcdefghij") for _ in range(3000)) for s in range(3)]
    want = [whole.text(t) for t in texts]
    monkeypatch.setattr(token_counts, "KEPT", 50)
    assert [token_counts.Counter(pieces).text(t) for t in texts] == want
    tracemalloc.start()
    token_counts.Counter(pieces).unit("ab" * 300_000)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    df = docs(spark, [*rows[:20], *rows[:20], (77, None, "a")])
    got = df.select("doc_id", "text", token_counts.count_tokens(df, pieces).alias("t")).collect()
    assert len(got) == 41 and all(tuple(r.t) == whole.text(r.text or "") for r in got)
    assert df.limit(0).select(token_counts.count_tokens(df, pieces)).count() == 0


def test_decontamination(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    item = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: item(n) for i, n in enumerate([15, 20, 40, 60, 9, 5])}
    fill = lambda: item(30)
    changed = [w if i % 6 else "other" for i, w in enumerate(items[2])]
    cases = {
        0: (fill() + items[0] + fill(), {0}), 1: ([w.upper() + "," for w in items[1]], {1}), 2: (changed, {2}), 3: (fill() + items[3][20:45], {3}), 4: (items[3][:8] + fill(), set()), 5: (fill(), set()), 6: (items[4], {4}),
        7: (items[5], set()), 8: ([], set()), 9: (items[0] + items[1] + items[0], {0, 1}), 10: ([w if i % 2 else "no" for i, w in enumerate(items[3])], set()),
    }
    df = docs(spark, [(i, " ".join(w), "a") for i, (w, _) in cases.items()] + [(50, None, None), (51, "long word " * 30_000 + " ".join(items[0]), "a")])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (None, "x"), (91, "")], "item_id long, text string")
    got = {r.doc_id: {x.item_id for x in r.leaks} for r in decontaminate.with_leaks(df, bench).collect()}
    assert got == {i: want for i, (_, want) in cases.items()} | {50: set(), 51: {0}}
    whole = sorted(map(tuple, decontaminate.with_leaks(df, bench).select("doc_id", "leaks").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)  # several blocks
    assert decontaminate.seed_indexes(bench)[0] > 3 and sorted(map(tuple, decontaminate.with_leaks(df, bench).select("doc_id", "leaks").collect())) == whole
    assert {r.doc_id for r in decontaminate.decontaminated(df, bench).collect()} == {4, 5, 7, 8, 10, 50}
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == df.count() and decontaminate.decontaminated(df.limit(0), bench).count() == 0


def test_seeds_hit_every_accepted_overlap():
    words = [f"w{i}" for i in range(13)]
    for n in range(8, 14):
        index = decontaminate.SeedIndex([7], [" ".join(words[:n])])
        changes = list(combinations(range(n), n - -(-4 * n // 5)))
        texts = [" ".join("no" if i in c else w for i, w in enumerate(words[:n])) for c in changes]
        assert all(index.scan(texts)), n


def test_repeated_words_take_no_room():
    index = decontaminate.SeedIndex([1, 2], ["go " * 500, "go " * 20 + "stop"])
    tracemalloc.start()
    got = index.scan(["go " * 20_000, "Go, go! " * 15 + "stop", "no " * 50])
    assert got == [[(1, 500, 500), (2, 21, 20)], [(1, 31, 30), (2, 21, 21)], []] and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_short_items_match_whole_and_exactly():
    index = decontaminate.SeedIndex([1, 2, 3, 4, 5], ["What is two plus two?", "name it", "", "Yes.", " ".join("abcdefg")], least=1)
    texts = ["so, what is TWO plus two", "what is two plus", "what is one plus two", "name  it; yes", "it name", "", "a b c x e f g", "z a b c d e f g", "a b", "c d e f g"]
    got = [[i for i, _, _ in x] for x in index.scan(texts)]
    assert got == [[1], [], [], [2, 4], [], [], [], [5], [], []]
    assert index.scan(texts[:1]) == [[(1, 5, 5)]]


def brute_dedup(rows, span=50):
    first, out = {}, []
    order = [(float("inf") if i is None else i, (t or "").encode()) for i, t, _ in rows]
    for i, t in order:
        for p in range(len(t) - span + 1):
            s = t[p : p + span]
            first[s] = min(first.get(s, i), i)
    for i, t in order:
        gone = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = b"\1" * span
        runs = sum(1 for p in range(len(t)) if gone[p] and not (p and gone[p - 1]))
        out.append((None if i == float("inf") else i, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeats(seed, n=70):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abç ") for _ in range(300)) for _ in range(5)]
    rows = []
    for i in range(n):
        t = "".join(rng.choice("defgh \n") for _ in range(rng.randrange(0, 150)))
        for _ in range(rng.randrange(0, 3)):
            b = rng.choice(base)
            a = rng.randrange(0, 200)
            t += b[a : a + rng.randrange(30, 100)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 30)))
        rows.append((i, "a" * rng.randrange(40, 200) + t if rng.random() < 0.2 else t, "s"))
    return rows + [(n, rows[4][1], "s"), (n + 1, rows[4][1], "s"), (4, rows[4][1], "s"), (n + 2, None, "s"), (n + 3, "", "s"), (None, rows[6][1] + "tail", "s"), (n + 4, "ab" * 2000, "s"), (n + 5, "ab" * 1900 + "\x00", "s")]


def dedup(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.substring_dedup(df).collect()), key=str)


def test_substring_dedup(spark):
    rows = repeats(3)
    assert dedup(docs(spark, rows)) == brute_dedup(rows)
    assert dedup(docs(spark, [])) == []


def test_substring_dedup_of_crowded_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 3)
    rows = repeats(4, 40)
    assert dedup(docs(spark, rows)) == brute_dedup(rows)


def test_long_runs_are_sorted_in_pieces(monkeypatch):
    rng = random.Random(8)
    stems = [b"the very same gram!!" + "".join(rng.choice("pq") for _ in range(44)).encode() for _ in range(4)]
    parts = [(d, d, 0, None if d % 3 else np.array([100, 300]).tobytes(), 0, rng.choice(stems)[:60]) for d in range(60)] + [(d, d, 0, None, 0, b"quite another gram!!" + stems[0][20:51] + b"z") for d in range(5)]
    frame = pd.DataFrame(parts, columns=["doc", "row", "start", "more", "place", "part"])
    spans = lambda f: sorted(tuple(x) for y in f for x in y.itertuples(index=False))
    whole = spans(suffix_dedup._sort_batches(iter([frame])))
    monkeypatch.setattr(suffix_dedup, "BATCH", 300)
    assert spans(suffix_dedup._sort_batches(frame.iloc[i : i + 4] for i in range(0, len(frame), 4))) == whole and len(whole) > 50


def test_two_stage_order():
    rng = random.Random(6)
    for _ in range(200):
        alphabet = bytes(rng.sample(range(1, 255), rng.choice([1, 2, 4])))
        alphabet = alphabet if rng.random() < 0.8 else alphabet + b"\0\xff"
        s = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 150)))
        t = np.frombuffer(s + suffix_dedup._PAD, np.uint8)
        wanted = np.array(sorted(rng.sample(range(len(s)), rng.randrange(1, len(s) + 1))))
        order = suffix_dedup.two_stage_order(t, wanted)
        keys = [(s[p : p + 50] + b"\0" * 50)[:50] for p in order]
        assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
        shared = suffix_dedup.adjacent_prefixes(t, order)
        for i in range(1, len(order)):
            a, b = t[order[i] : order[i] + 56].tobytes().ljust(56, b"\0"), t[order[i - 1] : order[i - 1] + 56].tobytes().ljust(56, b"\0")
            assert shared[i] == next((k for k in range(56) if a[k] != b[k]), 56)


def brute_quality(rows, share, min_docs):
    texts = {}
    for _, t, s in rows:
        texts.setdefault(s, set()).add(t or "")
    count = Counter()
    norm = lambda x: b" ".join(x.encode().lower().split())
    for s, ts in texts.items():
        for t in ts:
            count.update({(s, norm(x)) for x in t.split("\n")} - {(s, b"")})
    out = []
    for i, t, s in rows:
        lines, words = (t or "").split("\n"), (t or "").encode().split()
        n = len(words)
        grams = [tuple(words[k : k + 5]) for k in range(n - 4)]
        twice = {g for g, c in Counter(grams).items() if c > 1}
        rep = len({k + d for k, g in enumerate(grams) if g in twice for d in range(5)})
        bad = [x for x in lines if norm(x) and count[s, norm(x)] > max(min_docs, share * len(texts[s]))]
        left = n - sum(len(x.encode().split()) for x in bad)
        dup = sum(1 for k, x in enumerate(lines) if norm(x) and x in lines[:k])
        failed = n < 10 or 100 * rep > 20 * n
        out.append((i, n, len([c for c in t or "" if c not in " \t\n\v\f\r"]), sum(c in "#*$%&|<>" for c in t or ""), dup, rep, failed, not failed and left >= 10 and 100 * left >= 30 * n))
    return sorted(out, key=str)


def test_line_quality(spark):
    rows = corpus(1, 50)
    rows += [(100 + i, f"Subscribe NOW\nword{i} " + " ".join(f"u{i}v{k}" for k in range(12)), "a") for i in range(9)]
    rows += [(200 + i, "Subscribe   now\n" + "big banner of many words that is on all of the pages\n" + f"tail{i} and text", "a") for i in range(9)]
    rows = [(i, t if t is None or len(t) < 9999 else t[:9000], s) for i, t, s in rows]
    judged = line_quality.judge_lines(docs(spark, rows), max_share=0.1, min_docs=4)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in judged.collect()), key=str)
    assert got == brute_quality(rows, 0.1, 4)
    kept = {r.doc_id: r for r in line_quality.keep_good(docs(spark, rows), max_share=0.1, min_docs=4).collect()}
    assert kept[100].text.startswith("word0 ") and kept[100].n_chars == len(kept[100].text) and 200 not in kept
    assert kept[100]._row == "z" and line_quality.keep_good(docs(spark, [])).count() == 0


def test_license_scan(spark):
    mit = license_scan.TEMPLATES[4][1]
    of = lambda name: [x for n, x in license_scan.TEMPLATES if n == name]
    bsd = [license_scan._BSD_GRANT, license_scan._BSD_SOURCE, license_scan._BSD_BINARY, license_scan._BSD_NAMES, license_scan._BSD_WARRANTY]
    cases = {
        **{x: n for n, x in license_scan.TEMPLATES if x not in bsd and not n.startswith("BSD")},
        "Copyright 2020 Foo Inc. Released under the MIT License.": "MIT", "See below.\n\n" + "\n".join([*bsd[:3], bsd[4]]): "BSD-2-Clause", "See below.\n\n" + "\n".join(bsd): "BSD-3-Clause",
        "(c) me\n\n" + of("AGPL-3.0-or-later")[0].replace("Affero ", "Affero\n"): "AGPL-3.0-or-later",
        "Released under the MIT License.": "MIT", "x\nThis work is licensed under the GNU General Public License, version 3.\ny": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "prose " * 50: None, "": None, mit.replace(", ", ",\n").replace("Software", "software"): "MIT", "Released under the terms of another license.": None,
    }
    df = docs(spark, [(i, t, "s") for i, t in enumerate(cases)] + [(99, None, "s")])
    got = {r.doc_id: r.l for r in df.select("doc_id", license_scan.scan_licenses(df["text"]).alias("l")).collect()}
    assert [got[i].license for i in range(len(cases))] == list(cases.values()) and got[99].license is None and got[0].dice == 1.0
    assert df.limit(0).select(license_scan.scan_licenses(df["text"])).count() == 0


def test_license_dice_against_brute_force():
    import re

    rng, words = random.Random(3), "licensed under the mit apache license version 2 0 of foo released".split()
    templates = [("A", "licensed under the apache license version 2 0"), ("B", "released under the mit license"), ("C", "licensed under the mit license version 2 of the foo")]
    scanner = license_scan.Scanner(templates)
    grams = lambda x: {tuple(w) for w in zip(*(re.findall(r"[a-z0-9]+", x.lower())[k:] for k in (0, 1)))}
    hits = 0
    for _ in range(3000):
        parts = [[w if rng.random() < 0.9 else rng.choice(words) for w in rng.choice(templates)[1].split()] for _ in range(rng.randrange(1, 4))]
        text = rng.choice([". ", "\n", "\n\n", " x. y\n"]).join(" ".join(p) for p in parts)
        lines = text.split("\n")
        units = lines + [s for x in lines for s in re.split(r"[.!?][ \t]+", x) if len(re.split(r"[.!?][ \t]+", x)) > 1] + [b for b in (x.strip("\n") for x in re.split(r"\n(?:[ \t.]*\n)+", text)) if "\n" in b] + ([text] if len(lines) > 1 else [])
        dice = [max((2 * len(grams(u) & grams(b)) / (len(grams(u)) + len(grams(b))), n) for n, b in templates) for u in units if grams(u)]
        found = [d for d in dice if d[0] >= 0.8]
        name, value, _ = scanner.text(text)
        hits += bool(found)
        assert (name is not None) == bool(found) and (not found or max(found)[0] - license_scan.NEAR <= value <= max(found)[0])
    assert hits > 100


def test_long_license_text():
    name, _, units = license_scan.Scanner().text("many plain words. " * 200_000 + "Released under the MIT License.")
    assert (name, units) == ("MIT", 1)


def plain_print(text, n):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, rows):
    rng, extra = random.Random(3), []
    for i in range(40):
        w = rows[i % 7][1].split(" ") * 8 + [f"q{rng.randrange(99)}"]
        extra.append((1000 + i, " ".join(w), "s"))
    rows = [r for r in rows if r[1] is None or len(r[1]) < 9999] + extra
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [plain_print(t, 4) for _, t, _ in rows]
    label = list(range(len(rows)))
    for _ in range(len(rows)):
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for (i, _, _), x in zip(rows, label):
        least[x] = min((k for k in (least.get(x), i) if k is not None), default=None)
    want = sorted((str(i), p, str(least[x])) for (i, _, _), p, x in zip(rows, prints, label))
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == want
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert len([r for r in kept if r.doc_id is None]) == 1 and len({r.doc_id for r in kept}) == len(kept) < len(rows)


def test_near_copies_at_the_threshold(spark, monkeypatch):
    rng, rows = random.Random(6), []
    word = lambda: f"w{rng.randrange(3000)}"
    for i in range(60):
        base = [word() for _ in range(150)]
        rows.append((10 * i, " ".join(base), "s"))
        for j in range(1, 4):
            w = list(base)
            for _ in range(rng.randrange(1, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append((10 * i + j, " ".join(w), "s"))
    crowd = [word() for _ in range(60)]
    rows += [(1000 + i, " ".join(crowd + [word() for _ in range(i % 40)]), "s") for i in range(200)]
    loop = "one two three four five six seven " * 400  # outweighs the rest in a fingerprint
    rows += [(2000 + i, loop + " ".join(word() for _ in range(80)), "s") for i in range(3)]
    rows += [(3000, "a key of two", "s"), (3000, "A  KEY of two", "s"), (3000, "quite another text of it", "s"), (3001, "quite another text of it", "s"), (3002, "", "s"), (3003, None, "s")]
    sets = []
    for _, t, _ in rows:
        w = (t or "").lower().split()
        sets.append({" ".join(w[x : x + 5]) for x in range(max(len(w) - 4, min(len(w), 1)))})
    label, far = list(range(len(rows))), 0
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(len(rows)):
        before = list(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    prints = [plain_print(t, 5) for _, t, _ in rows]
    far = sum((prints[a] ^ prints[b]).bit_count() > 8 for a, b in near)
    assert far > 20 and all((prints[-8] ^ prints[x]).bit_count() <= 8 for x in (-7, -9))
    want = {}
    for (i, _, _), x in zip(rows, label):
        want[x] = min(want.get(x, i), i)
    df = docs(spark, rows)
    assert Counter(r.doc_id for r in simhash.keep_one(df).collect()) == Counter(want.values())
    monkeypatch.setattr(simhash, "GROUP", 16)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "HOT", 30)
    got = simhash.keep_one(df)
    assert Counter(r.doc_id for r in got.collect()) == Counter(want.values()) and got.columns == df.columns


def test_trie_links_are_complete(spark, monkeypatch):
    rng, vals = np.random.default_rng(0), []
    for b in rng.integers(0, 2**63, 8, dtype=np.uint64):
        for _ in range(150):
            m = np.uint64(0)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                m ^= np.uint64(1) << np.uint64(bit)
            vals.append(b ^ m)
    v = np.unique(np.array(vals, np.uint64))
    near = np.bitwise_count(v[:, None] ^ v[None, :])
    for budget in (0, 4, 8):
        i, j = simhash.trie_links(v, ([0], [len(v)]), ([0], [len(v)]), budget)
        assert len(set(zip(i.tolist(), j.tolist()))) == len(i) == np.triu(near <= budget, 1).sum()
    monkeypatch.setattr(simhash, "GROUP", 64)
    place = {int(x): k for k, x in enumerate(v.view(np.int64))}
    e = [(place[r.a], place[r.b]) for r in simhash.links(spark.createDataFrame([(k,) for k in place], "fp long"), 4).collect()]
    a, b = np.nonzero(near <= 4)
    assert (simhash.least_labels(len(v), *np.array(e).T) == simhash.least_labels(len(v), a, b)).all()


@pytest.mark.parametrize("crowded, budget", [(1e-3, 8), (1e-5, 8), (1e-9, 8), (1e-9, 4)])
def test_links_are_complete_with_more_blocks(spark, monkeypatch, crowded, budget):
    rng, vals = np.random.default_rng(1), []
    for b in rng.integers(0, 2**63, 40, dtype=np.uint64):
        for _ in range(8):
            vals.append(b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 10)).astype(np.uint64)))
    v = np.unique(np.array(vals, np.uint64))
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    place = {int(x): k for k, x in enumerate(v.view(np.int64))}
    e = [(place[r.a], place[r.b]) for r in simhash.links(spark.createDataFrame([(k,) for k in place], "fp long"), budget).collect()]
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= budget)
    assert (simhash.least_labels(len(v), *np.array(e).T) == simhash.least_labels(len(v), a, b)).all()


def brute_tree(rows, depth, least):
    """Scores by plain dictionaries: (n_tokens, n_known, base, score) of each text, the training tokens and the states."""
    toks = lambda t: (t or "").encode().lower().split() + [b" "]
    seen, texts = Counter(), [toks(t) for _, t, _ in rows]
    for (i, *_), t in zip(rows, texts):
        if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1:
            seen.update(tuple(t[a : a + n]) for n in range(1, depth + 2) for a in range(len(t) - n + 1))
    total = sum(c for g, c in seen.items() if len(g) == 1)
    distinct = sum(len(g) == 1 for g in seen)
    root = lambda w: (seen[w,] + 0.5) / (total + 0.5 * (distinct + 1))
    after = {}
    for g in seen:
        after.setdefault(g[:-1], []).append(g[-1])

    def plain(s, w):
        return (seen[*s, w] + 5 * plain(s[1:], w)) / (seen[s] + 5) if s else root(w)

    def passes(s):
        gain = sum(seen[*s, w] * math.log(seen[*s, w] / seen[s] / plain(s[1:], w)) for w in after[s])
        return gain > 0.5 * (len(after[s]) + 1) * math.log(total)

    states = {s for s in after if s and seen[s] >= least and passes(s)}

    def p(history, w):
        own = root(w)
        for n in range(1, depth + 1):
            s = tuple(history[-n:])
            if len(s) == n and s in states:
                own = (seen[*s, w] + 5 * own) / (seen[s] + 5)
        return own

    words = {g[0] for g in seen if len(g) == 1}
    for s in states:  # the probabilities of all words, and of one for all that were never seen, add up to one
        assert sum(p(s, w) for w in [*words, b"never"]) == pytest.approx(1.0)
    out = [(len(t), sum(seen[w,] > 0 for w in t), sum(math.log10(root(w)) for w in t), sum(math.log10(p(t[:i], w)) for i, w in enumerate(t))) for t in texts]
    return out, total, states


@pytest.mark.parametrize("depth, least, chunk", [(1, 5, 1 << 21), (2, 5, 1 << 21), (3, 3, 300)])
def test_language_model(spark, monkeypatch, depth, least, chunk):
    monkeypatch.setattr(suffix_tree_lm, "CHUNK", chunk)
    monkeypatch.setattr(suffix_tree_lm, "CHUNK_CHARS", 20 * chunk)
    monkeypatch.setattr(suffix_tree_lm, "RANGE", max(700, chunk >> 2))
    rng, rows = random.Random(5), []
    for i in range(400):
        w = ["start"]
        while len(w) < 40:  # a word depends on one to three words before it
            free = rng.choice(["start", "alpha", "gamma", f"rare{rng.randrange(300)}"])
            w.append({"start": "alpha", "alpha": "beta", "gamma": "beta", "beta": "delta" if rng.random() < 0.5 else {"alpha": "gamma", "gamma": "start"}.get(w[-2], free) if len(w) > 1 else free, "delta": {"alpha": "omega", "gamma": "start"}.get(w[-3] if len(w) > 2 else "", free)}.get(w[-1], free))
        rows.append((i, " ".join(w).title(), "s"))
    rows += [(1000, None, "s"), (1001, "", "s"), (7, rows[7][1], "s"), (None, "Start alpha", "s"), (1002, "\u00fcn\u00ef\u2003x alpha", None), (1003, "start alpha beta " * 20_000, "s")]
    df, out = docs(spark, rows), suffix_tree_lm.held_out()
    got = suffix_tree_lm.suffix_tree_scores(df, ~out, depth, least).withColumn("out", out).collect()
    want, total, states = brute_tree(rows, depth, least)
    assert {len(s) for s in states} == set(range(1, depth + 1))
    mine = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    theirs = sorted((str(i), *x) for (i, *_), x in zip(rows, want))
    assert [x[:3] for x in mine] == [x[:3] for x in theirs] and all(r.train_tokens == total for r in got)
    np.testing.assert_allclose([x[3:] for x in mine], [x[3:] for x in theirs], rtol=1e-9)
    assert all(r.out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 1) for r in got)
    held = [r for r in got if r.out and r.doc_id is not None and r.doc_id < 400]  # drawn as the training texts were
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_language_model_without_rows(spark):
    df = docs(spark, [(1, "a b a b", "s"), (None, None, "s")])
    got = suffix_tree_lm.suffix_tree_scores(df, F.lit(False)).collect()
    assert len(got) == 2 and all(r.n_known == r.train_tokens == 0 and r.score == r.base_score for r in got)
    assert suffix_tree_lm.suffix_tree_scores(df.limit(0), F.lit(True)).count() == 0


def test_keys_of_grams_round_trip():
    for keys in ([5], [7, 8, 1 << 39], [7, 1 << 50, (1 << 56) - 1]):
        keys = np.array(keys)
        assert (suffix_tree_lm._unpack_keys(suffix_tree_lm._pack_keys(keys, 3), len(keys), 3) == keys).all()


def test_targets(spark):
    sizes = [("a", 100), ("b", 5), ("é", 60), ("Z", 7), (None, 30), ("c", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    order = sorted([s for s, _ in sizes if s is not None]) + [None]
    size, weight = dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full, left = {}, set(), float(sum(size.values()))
    while True:
        free = [s for s in order if s not in full]
        share = {s: (left - sum(3 * size[x] for x in full)) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    want = share | {s: 3.0 * size[s] for s in full}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(202)


def test_fit_budget():
    rng = random.Random(9)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 8))))
        counts = np.array([rng.randrange(1, 6) for _ in lengths])
        budget = rng.randrange(0, int((lengths * counts).sum()) + 5)
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (lengths * take).sum() <= budget
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        assert (lengths * take).sum() == max(s for s in sums if s <= budget)  # the true optimum
        spare = counts - take
        assert not (spare > 0).any() or budget - (lengths * take).sum() < lengths[spare > 0].min()
    assert (mixing.fit_budget(np.array([3, 50_000]), np.array([10**6, 2]), 10**6) * np.array([3, 50_000])).sum() > 10**6 - 3


def test_mix(spark, rows):
    df = docs(spark, rows)
    got, again = (sorted(map(tuple, mixing.mix(df.repartition(n)).collect()), key=str) for n in (1, 5))
    assert got == again and len(got) == len(rows)
    by = {}
    for _, s, size, total, target, passes, taken in got:
        assert taken == passes * size and 0 <= passes <= 3
        by.setdefault(s, [target, 0, total])[1] += taken
    assert set(by) == {"a", "b", None} and all(t <= target + 1 and t > 0.8 * target for target, t, _ in by.values() if target < 9999)
    mixed = mixing.mixed(df)
    assert sum(len((r.text or "").encode().split()) for r in mixed.collect()) == sum(t for _, t, _ in by.values()) and mixed.columns == df.columns
    assert mixing.mix(docs(spark, [])).count() == 0 == mixing.mixed(docs(spark, [])).count()


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng, words = random.Random(11), [f"w{i}" for i in range(500)]
    prose = lambda n=60: " ".join(rng.choice(words) for _ in range(n))
    item = prose(30)
    rows = [(i, prose(), rng.choice("abc")) for i in range(60)]
    rows += [(100 + i, rows[i][1], "a") for i in range(5)] + [(110 + i, rows[i][1] + " x", "b") for i in range(5)] + [(120, "few words", "a"), (121, "same same same same same " * 9, "a"), (122, prose() + " " + item, "c"), (123, None, "a")]
    edited = lambda t, n: " ".join(f"new{rng.randrange(10**6)}" if k in chosen else w for chosen in [set(rng.sample(range(5, 55), n))] for k, w in enumerate(t.split()))
    rows += [(130 + i, edited(rows[i][1], 1 + i % 3), "b") for i in range(20, 50)]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(i, t, s) for i, t, s in rows if i not in (120, 121, 123)]
    sets, label = [{" ".join(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t, _ in kept], list(range(len(kept)))
    for _ in range(3):
        for a in range(len(kept)):
            for b in range(a):
                if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    clean = {kept[x] for x in set(label)} - {kept[[r[0] for r in kept].index(122)]}
    frame, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / f"stage{len(stages)}"))
        frame = spark.read.parquet(str(tmp_path / f"stage{len(stages)}"))
        stages.append(frame)
    assert {r.doc_id for r in stages[0].collect()} == {i for i, _, _ in kept}
    assert {(r.doc_id, r.text, r.source) for r in stages[2].collect()} == clean
    taken = {r.doc_id: r["count"] for r in stages[3].groupBy("doc_id").count().collect()}
    want = {r.doc_id: r.passes for r in mixing.mix(stages[2]).collect() if r.passes}
    assert set(taken) <= {i for i, _, _ in clean} and sum(taken.values()) == sum(want.values()) and max(taken.values()) <= 3
    final = stages[4].collect()
    assert [int(s) for s in sharding.jump_hash(np.array([r.doc_id for r in final]), 40)] == [r.shard for r in final]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(final)
