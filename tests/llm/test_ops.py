"""Operators against brute force on small tables with nulls, empty texts, repeats and columns that clash."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import compression_bands, language_ftrl, packing_gga, secret_links, simhash_bktree, token_rollup, toxicity_nbsvm, url_trie, warc_index, wu_manber
from quirework.llm.common import fresh_path
from quirework.llm.components import components

DOC = "doc_id long, text string, lang string, source string, n_chars long, __text string, fp long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7) for i, t in rows], DOC)


ODD = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "a b c"), (4, " \t\n"), (5, "é 中文 😀 " * 30)]
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_every_operator_takes_odd_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, None), (None, "a b c"), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None)], "doc_id long, toxic int")
    for rows in (ODD, []):
        d = docs(spark, rows)
        n = len(rows)
        assert compression_bands.judge(d).count() == n
        assert simhash_bktree.near_duplicates(d).count() == n
        assert wu_manber.decontaminate(d, bench).count() == n
        assert secret_links.scan(d).count() == n
        assert secret_links.redact(d).columns == d.columns
        assert packing_gga.sequences(d).count() == n
        assert toxicity_nbsvm.score(d, toxicity_nbsvm.fit(d, labels)).count() == n
        assert language_ftrl.predict(d, language_ftrl.fit(d)).where("lang_pred = 'und'").count() == (3 if n else 0)
        assert compression_bands.keep(d).columns == simhash_bktree.keep_one(d).columns == wu_manber.drop_contaminated(d, bench).columns == d.columns


def test_stages_keep_columns_of_any_name(spark):
    names = ("n_words", "spans", "items", "kept", "component_id", "fingerprint", "root", "low", "block", "length", "piece", "ids", "kind", "first", "cut", "cuts", "__row", "__stay", "a.b")
    d = docs(spark, ODD).select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    bench = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    for out in (compression_bands.keep(d), simhash_bktree.keep_one(d), wu_manber.drop_contaminated(d, bench), secret_links.redact(d)):
        assert out.columns == d.columns
        for row in out.collect():
            assert row[-len(names) :] == tuple(range(len(names)))
    assert packing_gga.sequences(d).count() == len(ODD)


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        rows.append((i, prose(rng, 60)))
    for i in range(120, 240):
        words = rows[rng.randrange(i)][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words)))
    find = re.compile(r"[^ \t-\r]+").findall
    fps = {i: simhash_bktree.simhash(t, find) & (1 << 64) - 1 for i, t in rows}
    root = {i: i for i in fps}
    for i in fps:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = {r["doc_id"]: r for r in simhash_bktree.near_duplicates(docs(spark, rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == root
    assert all(r["fingerprint"] == f"{fps[i]:016x}" for i, r in got.items())


def test_dense_shards_are_dealt_again_without_loss(spark):
    rng = random.Random(2)
    values = {0}
    while len(values) < 300:
        values.add(rng.choice(sorted(values)) ^ 1 << rng.randrange(40))
    nodes = spark.createDataFrame([(simhash_bktree.signed(v),) for v in values], "fp long")
    edges = [tuple(r) for r in simhash_bktree.links(nodes, limit=16).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)
    assert len(components(simhash_bktree.links(nodes, limit=16)).select("root").distinct().collect()) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_wu_manber_against_every_window(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([1, 2, 5, 13, 30]))) for i in range(12)]
    rows = []
    for i in range(60):
        text = prose(rng, 80)
        if i % 2:
            text += ", " + rng.choice(items)[1].upper() + " " + prose(rng, 20)
        rows.append((i, text))
    find = re.compile(wu_manber.WORDS).findall
    want = {}
    for i, text in rows:
        w, hit, found = find(text.lower()), set(), set()
        for k, t in items:
            p = find(t)
            m = min(13, len(p))
            for j in range(len(p) - m + 1):
                for x in range(len(w) - m + 1):
                    if w[x : x + m] == p[j : j + m]:
                        hit |= set(range(x, x + m))
                        found.add(str(k))
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for windows in (wu_manber.SHARD_WINDOWS, 40):
        got = wu_manber.decontaminate(docs(spark, rows), bench, shard_windows=windows).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == want


def test_secret_spans_and_links(spark):
    key, ident = "wJalrXUtnFEMI7K7MDENG9bPxRfiCYEXAMPLEKEY", "AB12CD34EF56GH78"
    texts = ["token: secret:abcdefghijklmn", "API_KEY = 'abc'", f"{ident} and {key}", key, ident, f"{ident}{' ' * 300}{key}", "https://h.example/x password=abcdefghijkl", "AKIAABCDEFGHIJKLMN 0123456789abcdef", f"é😀 {ident} {key}"]
    got = {r["doc_id"]: r["spans"] for r in secret_links.scan(docs(spark, list(enumerate(texts)))).collect()}
    assert got[0] == got[1] == got[3] == got[4] == got[5] == ""  # a short value takes the place of what follows
    assert got[2] == "weak_id:0:16,weak_key:21:61" and got[8] == "weak_id:3:19,weak_key:20:60"
    assert got[6] == "endpoint:0:19,assign:20:41" and got[7] == "access:0:18,hex:19:35"
    clean = {r["doc_id"]: r["text"] for r in secret_links.redact(docs(spark, list(enumerate(texts)))).collect()}
    assert clean[2] == "[SECRET] and [SECRET]" and clean[3] == key and clean[8] == "é😀 [SECRET] [SECRET]"


def test_packing_keeps_every_token(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 50, 400, 2500]))) for i in range(80)] + [(80, None)]
    from tokenizers import Tokenizer

    from quirework.llm.tokens import vocabulary

    tok = Tokenizer.from_file(vocabulary())
    got = packing_gga.sequences(docs(spark, rows)).toPandas()
    for i, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for p in got[got.doc_id == i].itertuples():
            part = ids[p.start : p.start + p.length]
            assert p.start == 4096 * p.piece and len(part) == p.length and zlib.crc32(part.tobytes()) == p.ids_crc32
        assert got[got.doc_id == i].length.sum() == len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_packing_ends_where_nothing_fits_well(spark):
    items = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(2500).cast("long").alias("length"))
    assert packing_gga.pack(items, block=64).select("sequence_id").distinct().count() == 300


def test_repeated_rows_are_dealt_over_blocks(spark):
    items = spark.range(600).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"))
    got = packing_gga.pack(items, block=64)
    assert got.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
    assert got.groupBy("sequence_id").count().agg(F.max("count"), F.sum("count")).first()[1] == 600
    assert packing_gga.pack_blocks(items.withColumn("__row", F.monotonically_increasing_id()), 10, 4096, 0).groupBy("sequence_id").count().agg(F.max("count")).first()[0] < 200


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    from quirework.llm.tokens import encoder, vocabulary

    tok = Tokenizer.from_file(vocabulary())
    texts = ["It's İstanbul ΣΑΣ", "café ² ½ 12a", "<|endoftext|> don't", "a\x1cb\x85c", "ß ŉ x­x", "中文 é", "", "I'D 'S\r\n\tx"]
    assert encoder()(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_archives_and_loser_tree(spark):
    rows = [(i, f"http://h{i % 5}.example/p", "x" * (i % 4)) for i in range(40)] + [(40, None, None), (41, "http://a/\n", "é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = fresh_path(spark, "warc")
    warc_index.write(pages, path)
    lines = warc_index.merge(warc_index.index(spark, path, run_lines=10), range_lines=10, block_lines=2, window=3).collect()
    assert [warc_index.order(tuple(r)) for r in lines] == sorted(warc_index.order(tuple(r)) for r in lines)
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in lines} == {i: (len((h or "").encode()), warc_index.sha1((h or "").encode()), None if first[h or ""] == i else first[h or ""]) for i, _, h in rows}
    rng = random.Random(5)
    runs = [sorted((f"k{rng.randrange(9)}", "t", rng.randrange(99), k, "a", j) for j in range(rng.randrange(20))) for k in range(7)]
    assert list(warc_index.LoserTree([iter(sorted(r, key=warc_index.order)) for r in runs])) == sorted((x for r in runs for x in r), key=warc_index.order)


def test_url_rules_by_trie_and_by_join(spark):
    urls = [None, "no scheme", "http://", "http://org", "http://a.ORG/", "http://example.org/es/x", "http://b.example.org/en/12?q", "http://example.org/en/2", "http://x.com/fr/#a", "http://x.com/de/", "http://y.net/a", "ftp://xexample.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, url_trie.match(pages, url_trie.RULES).collect()))
    assert [r[3] for r in got] == [None, None, None, None, "org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, "org/"]
    assert sorted(map(tuple, url_trie.match(pages, url_trie.RULES, max_chars=0).collect())) == got


def test_rollup_is_idempotent(spark):
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    rows = spark.createDataFrame([("a", "en", 5), ("a", "en", 7), (None, None, None)], "source string, lang string, n long")
    put = token_rollup.change(rows, 1, "v1", F.col("n"))
    assert rollup.commit("one", put) and not rollup.commit("one", put)
    rollup.commit("two", token_rollup.change(rows.where("n = 5"), -1, "v1", F.col("n")))
    want = {("a", "en", "v1", 1, 7), (None, None, "v1", 1, 0)}
    assert set(map(tuple, rollup.totals().collect())) == want
    assert rollup.compact() and not rollup.commit("two", put) and set(map(tuple, rollup.totals().collect())) == want
    assert rollup.commit("three", put) and rollup.compact() and rollup.compact()
    assert set(map(tuple, rollup.totals().collect())) == {("a", "en", "v1", 3, 19), (None, None, "v1", 2, 0)}


def test_word_counts_and_bands():
    find = re.compile(r"[^ \t-\r]+").findall
    assert compression_bands.word_counts("a b c\nx\na b c\n\nx", find) == (8, 8, 0, 2, 8)  # abc and bcx both recur
    assert compression_bands.within(5000, 0.01) == "repetitive" and compression_bands.within(5000, 0.9) == "incompressible" and compression_bands.within(5000, 0.45) is None


@pytest.mark.parametrize("table", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, table):
    documents = spark.read.parquet(f"{table}/documents.parquet")
    got = language_ftrl.op5_language_ftrl(spark, table).join(documents.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    assert got.where("lang = lang_pred").count() / got.count() > 0.97
    toxic = toxicity_nbsvm.op1_toxicity_nbsvm(spark, table)
    assert toxic.where("score < 0 OR score > 1").isEmpty() and toxic.where("predicted = 1").count() < 0.25 * documents.count()
