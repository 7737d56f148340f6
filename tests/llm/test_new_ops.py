"""Mixture packing, filter audit and phrase mining against brute force, and on odd input."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirework.llm import filter_audit, mixture_packing, phrase_bitmaps
from quirework.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, id long, part string, `a b` struct<x:int>, mask int"
LABEL = "doc_id long, quality int, toxic int"
LONG = "Alpha beta, gamma delta. " * 40_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, 1, 5, "z", (1,), 9) for i, t, g, s in rows], DOC)


ODD = [(1, LONG, "en", "s"), (1, LONG, "en", "s"), (0, LONG, None, None), (None, LONG, "", ""), (2, None, "en", "s"), (3, "", "de", None), (None, None, None, "s"), (None, "", "en", "s"), (-5, "a#b c", "en", "t")]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def check_packing(got, rows, tokenizer, capacity=2048):
    """Each id of each row in one piece, gapless sequences, one at most not full. Rows may repeat."""
    want = Counter()
    for key, text in rows:
        want[(key, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    held, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
    short = 0
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        short += at < capacity
    assert short <= 1
    for (key, raw), n in want.items():
        mine = pieces[key, len(raw) // 4]
        cover = Counter()
        for start, length, crc in mine:
            cover.update(range(start, start + length))
        same = sum(m for (k, x), m in want.items() if k == key and len(x) == len(raw))
        assert len(cover) == len(raw) // 4 and set(cover.values()) == {same}
        if same == n:
            assert all(crc == zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m, crc in mine)
    assert sum(len(raw) // 4 * n for (_, raw), n in want.items()) == sum(m for x in held.values() for _, m in x)


def test_op11_against_plain_python(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(mixture_packing.op11_mixture_packing(spark, SF).collect(), rows, tokenizer)


def test_mixture_of_odd_rows_and_an_empty_table(spark, tokenizer):
    got = mixture_packing.sequences(docs(spark, ODD)).collect()
    check_packing(got, [(i, t) for i, t, _, _ in ODD], tokenizer)
    assert mixture_packing.sequences(docs(spark, [])).count() == 0


def test_ids_of_a_sequence_are_those_of_its_documents(spark, tokenizer):
    rows = [(i, f"number {i} of some words " * (i % 7 + 1), "en", f"s{i % 3}") for i in range(60)]
    got = mixture_packing.sequences(docs(spark, rows).repartition(5), capacity=64, window=64, grain=4, with_ids=True).collect()
    whole = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t, _, _ in rows}
    assert all(r["ids"] == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["queue"] == f"s{r['doc_id'] % 3}" for r in got)


def serve(totals, weights, window, grain):
    """Deficit round-robin, round by round, as a scheduler that remembers its deficits does it."""
    whole = sum(weights.values())
    left, deficit, out, k = dict(totals), {q: zlib.crc32(q.encode()) * grain * whole for q in totals}, [], 0
    while any(left.values()):
        for q in sorted(totals):
            deficit[q] += window * weights[q] << 32
            grains = deficit[q] // (grain * whole << 32)
            deficit[q] -= grains * (grain * whole << 32)
            if sent := min(left[q], grains * grain):
                left[q] -= sent
                out.append((k, q, sent))
        k += 1
    return out


def test_rounds_are_those_of_a_scheduler_with_deficits(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaabbcdefgh"), rng.randint(1, 300)) for i in range(400)]
    df = spark.createDataFrame([(i, i % 7, q, n) for i, q, n in rows], "row long, part long, queue string, n long").repartition(3)
    before = defaultdict(int)
    placed = []
    for i, q, n in sorted(rows, key=lambda r: (r[0] % 7, r[0])):
        placed.append((i, i % 7, q, before[q, i % 7], n))
        before[q, i % 7] += n
    df = spark.createDataFrame(placed, "row long, part long, queue string, at long, n long").repartition(3)
    totals = Counter()
    for _, q, n in rows:
        totals[q] += n
    for targets in (None, {"h": 0.4, "b": 0.001, "none": 0.3}):
        weights = {q: max(1, round((targets or {}).get(q, totals[q] / sum(totals.values())) * sum(totals.values()))) for q in totals}
        got = Counter()
        for r in mixture_packing.rounds(df, targets, 128, 8).collect():
            got[r["round"], r["queue"]] += r["length"]
        assert got == Counter({(k, q): n for k, q, n in serve(totals, weights, 128, 8)})


def test_running_sums_by_blocks(spark):
    rng = random.Random(4)
    rows = [(k, at, rng.randint(0, 9)) for k in "ab" for at in rng.sample(range(3000), 90)]
    got = {(r["k"], r["at"]): r["s"] for r in mixture_packing.running(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], "at", "v", "s", span=7).collect()}
    assert got == {(k, at): sum(v for j, a, v in rows if j == k and a < at) for k, at, _ in rows}


def test_windows_hold_the_mixture(spark):
    """While all queues last, each sequence is within two grains and a little of its targets, and what ends early leaves the rest in proportion."""
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["one", "two", "tree", "sun"]) for _ in range(rng.randint(1, 400))), "en", rng.choice(["big"] * 4 + ["mid"] * 2 + ["low"])) for i in range(600)]
    for targets, share in ((None, None), ({"big": 0.25, "mid": 0.25, "low": 0.5}, {"big": 0.25, "mid": 0.25, "low": 0.5})):
        got = mixture_packing.sequences(docs(spark, texts).repartition(6), targets=targets)
        table = {(r["sequence_id"], r["queue"]): r["n"] for r in got.groupBy("sequence_id", "queue").agg(F.sum("length").alias("n")).collect()}
        totals = Counter()
        for (_, q), n in table.items():
            totals[q] += n
        share = share or {q: n / sum(totals.values()) for q, n in totals.items()}
        full = min(int(totals[q] / share[q] / 2048) for q in totals) - 1
        assert full > 5 and all(abs(table.get((k, q), 0) - 2048 * share[q]) <= 5 * mixture_packing.GRAIN for k in range(full) for q in share)


def plain_audit(rows, labels):
    ids = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            ids[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, g in rows:
        t = t or ""
        w = re.findall(r"[^ \t-\r]+", t)
        copy = any(i is None or j < i for j in ids[t])
        fails.append((i, g or "", {c for c, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), re.search(r"[#$%&*|]", t), copy)) if x}))
    out, total = {}, Counter()
    for part in {g for _, g, _ in fails}:
        mine = [(i, f) for i, g, f in fails if g == part]
        for o in map("".join, permutations("ABCDE")):
            gone = set()
            for step, c in enumerate(o, 1):
                removed = [i for n, (i, f) in enumerate(mine) if c in f and n not in gone]
                redundant = sum(c in f for n, (_, f) in enumerate(mine) if n in gone)
                gone |= {n for n, (_, f) in enumerate(mine) if c in f}
                out[part, o, step] = [len(mine) - len(gone), len(removed), redundant, sum(f == {c} for _, f in mine), sum(i in good for i in removed), sum(i in toxic for i in removed)]
                total[part, c] += len(removed)
    return {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_filter_audit_against_plain_python(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["NO", "WAY"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([5, 99, 100, 130]))) + rng.choice(["", " #", "\u000b|", "É"]) for _ in range(40)]
    rows = [(i, rng.choice(texts) if i % 3 else texts[0], rng.choice(["en", "de", None, ""])) for i in range(500)]
    rows += [(None, texts[0], "en"), (None, "own text", "fr"), (None, "own text", "fr"), (7, texts[0], "en"), (7, texts[1], "de"), (600, None, None), (599, "", "x")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 520, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    d = docs(spark, [(i, t, g, "s") for i, t, g in rows])
    known = spark.createDataFrame(labels, LABEL)
    want = plain_audit(rows, labels)
    for n in (1, 5, 40):  # ranges, so that copies of one text span many
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert audited(filter_audit.audit(filter_audit.counters(filter_audit.failures(d.repartition(9)), known))) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_with_one_fingerprint_are_told_apart(spark):
    """Rows of one fingerprint that lie in several ranges, by the texts and ids at their edges."""
    rows = [(i, t, "en", 11, None) for i, t in enumerate(["x", "y", "x", "y", "x", "x", "z"])]
    ranged = [(r[0], "en", 11, s, 0, None, k) for k, part in enumerate((rows[:2], rows[2:4], rows[4:])) for s, r in enumerate(part)]
    assert len(ranged) == 7
    kind = "id long, part string, fp long, slot int, mask int, edge string, range int"
    edges = [(0, None, 11, 0, None, "x", 0), (1, None, 11, 1, None, "y", 0), (2, None, 11, 0, None, "x", 1), (3, None, 11, 1, None, "y", 1), (4, None, 11, 0, None, "x", 2), (6, None, 11, 1, None, "z", 2)]
    body = [(0, "en", 11, 0, 0, None, 0), (1, "en", 11, 1, 0, None, 0), (2, "en", 11, 0, 0, None, 1), (3, "en", 11, 1, 0, None, 1), (4, "en", 11, 0, 0, None, 2), (5, "en", 11, 0, 16, None, 2), (6, "en", 11, 1, 0, None, 2)]
    plain = filter_audit.sorted_rows
    filter_audit.sorted_rows = lambda *_: spark.createDataFrame(body + edges, kind)
    try:
        got = {r["doc_id"]: r["mask"] for r in filter_audit.failures(docs(spark, [])).collect()}
    finally:
        filter_audit.sorted_rows = plain
    assert got == {0: 0, 1: 0, 2: 16, 3: 16, 4: 16, 5: 16, 6: 0}


def test_filter_audit_of_odd_rows_and_empty_tables(spark):
    none = spark.createDataFrame([], LABEL)
    assert filter_audit.audit(filter_audit.counters(filter_audit.failures(docs(spark, [])), none)).count() == 0
    got = audited(filter_audit.audit(filter_audit.counters(filter_audit.failures(docs(spark, ODD)), none)))
    assert got == plain_audit([(i, t, g) for i, t, g, _ in ODD], [])


def plain_phrases(rows, least=30, inside=80, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    best = defaultdict(list)
    for (lang, p), a in cands.items():
        score, cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = max([b for (other, q), b in cands.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))], default=0)
        if 100 * longer < inside * a:
            best[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    return {(lang, i): (p.decode(), -a, left, right, n[lang], -s) for lang, x in best.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1)}


def found(df):
    return {(r["lang"], r["rank"]): tuple(r[c] for c in ("phrase", "a", "l", "r", "n", "score")) for r in df.collect()}


def test_phrases_against_plain_python(spark):
    rng = random.Random(7)
    words = ["the", "cat", "sat", "É", "中文", "on", "\u0085", "x-y", "Mat"]

    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\r\n", "\u000b"]) for _ in range(rng.randint(0, 60)))

    rows = [(rng.choice(["en", "de", None, "und", ""]), text() if i % 9 else "the cat sat on the cat sat on the cat") for i in range(260)] + [("en", None), ("de", ""), (None, " ,;! ")]
    d = docs(spark, [(i % 11, t, g, "s") for i, (g, t) in enumerate(rows)]).repartition(5)
    want = plain_phrases(rows, least=5)
    assert len(want) > 60 and {len(p.split(" ")) for p, *_ in want.values()} == {2, 3, 4}
    assert found(phrase_bitmaps.collocations(d, least=5)) == want
    # shards of a few pieces, a filter so small that it lets nearly all through, and few first
    assert found(phrase_bitmaps.collocations(d, least=5, shard_bytes=64, filter_bits=1 << 15)) == want
    assert found(phrase_bitmaps.collocations(d, least=5, top=3)) == {k: v for k, v in want.items() if k[1] <= 3}


def test_bitmaps_shift_within_pieces():
    words, places = phrase_bitmaps.encode(b"a b a\nb a  b\n\na")
    assert words.to_pylist() == ["a", "b"] and places.tolist() == [0, 1, 0, -1, 1, 0, 1, -1, 0]
    maps = phrase_bitmaps.Bitmaps(places, np.array([True, True]))
    first = next(maps.classes())
    phrase, word, byte, bits = maps.extend(*first)
    counts = Counter()
    for p, w, b in zip(phrase.tolist(), word.tolist(), bits.tolist()):
        counts[p, w] += bin(b).count("1")
    assert counts == {(0, 1): 2, (1, 0): 2}


def test_phrases_of_odd_rows_and_an_empty_table(spark):
    assert phrase_bitmaps.collocations(docs(spark, [])).count() == 0
    assert phrase_bitmaps.collocations(docs(spark, [(1, None, None, None), (2, " .", "en", "s")])).count() == 0
    want = plain_phrases([(g, t) for _, t, g, _ in ODD])
    for shard_bytes in (1 << 20, 1000):
        assert found(phrase_bitmaps.collocations(docs(spark, ODD), shard_bytes=shard_bytes)) == want


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000_000_000
    counted = spark.createDataFrame([("en", "a b", big), ("en", "a", big + 1), ("en", "b", big + 2)], "lang string, phrase string, n long")
    assert phrase_bitmaps.scored(counted).first()["score"] == 2_000_000 * big // (2 * big + 3)


@pytest.mark.parametrize("name", ["op12_filter_audit", "op13_phrase_bitmaps"])
def test_sql_of_new_queries(spark, name):
    from quirework.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name]).select(*columns).fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want))
