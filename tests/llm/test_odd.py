"""Odd input for each operator: nulls, empty and very long texts, ties and repeated rows, empty tables, clashing and odd columns."""

import os
import random
import subprocess
import sys
import textwrap
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from quirework.llm import compression_bands, language_ftrl, packing_gga, secret_links, simhash_bktree, token_rollup, toxicity_nbsvm, url_trie, warc_index, wu_manber
from quirework.llm.common import fresh_path, join_unique, shared_dir
from quirework.llm.components import components

LONG = "alpha beta gamma " * 60_000 + "password = abcdefghijkl tail"
ODD_STRUCT = "struct<`a b`:int,`c.d`:array<string>>"
DOC = f"doc_id long, text string, lang string, source string, n_chars long, record {ODD_STRUCT}, `x,y` map<string,int>"
BENCH = "item_id long, text string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), (1, ["z"]), {"k": 2}) for i, t in rows], DOC)


ROWS = [(1, LONG), (1, LONG), (2, None), (None, None), (3, ""), (4, "½ ² ① Ⅷ 12"), (5, "one two three"), (5, "one two three")]


def test_stages_keep_odd_columns_and_repeated_names(spark):
    d = docs(spark, ROWS).select("*", F.lit("again").alias("source"))
    bench = spark.createDataFrame([(1, "one two three")], BENCH)
    for out in (compression_bands.keep(d), simhash_bktree.keep_one(d), wu_manber.drop_contaminated(d, bench), secret_links.redact(d)):
        assert out.columns == d.columns
        for row in out.collect():
            assert tuple(row)[-1] == "again" and tuple(row)[3] is None and tuple(row[5]) == (1, ["z"]) and row[6] == {"k": 2}
    assert {r["doc_id"] for r in wu_manber.drop_contaminated(d, bench).collect()} == {1, 2, 3, 4, None}
    redacted = {r["doc_id"]: r["text"] for r in secret_links.redact(d).collect()}
    assert redacted[1] == LONG.replace("password = abcdefghijkl", "[SECRET]") and redacted[2] is None
    kept = simhash_bktree.keep_one(d).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "4", "5", "None"]  # 2 and 3 share fingerprint zero


def test_very_long_texts_and_repeats_are_judged_each(spark):
    d = docs(spark, ROWS)
    judged = {r["doc_id"]: r for r in compression_bands.judge(d).collect()}
    assert judged[1]["n_words"] == 180_004 and judged[1]["base_failed"] and judged[None]["n_words"] == 0
    scanned = [r["spans"] for r in secret_links.scan(d).where("doc_id = 1").collect()]
    assert scanned == [f"assign:{LONG.index('password')}:{len(LONG) - 5}"] * 2
    pieces = packing_gga.sequences(d.where("doc_id = 1")).collect()
    assert sum(r["length"] for r in pieces) % 2 == 0 and max(r["length"] for r in pieces) == 4096
    found = wu_manber.decontaminate(d, spark.createDataFrame([(9, "one two three"), (None, "two three"), (8, "")], BENCH)).where("doc_id = 5").collect()
    assert [(r["n_hit"], r["n_items"], r["contaminated"]) for r in found] == [(3, 2, True)] * 2  # the item without id counts, unnamed


def test_a_null_item_is_not_the_item_named_null(spark):
    items = [(None, "one two"), ("null", "two three"), ("null", "one two")]
    for windows in (wu_manber.SHARD_WINDOWS, 1):
        got = wu_manber.decontaminate(docs(spark, [(1, "ONE two, three")]), spark.createDataFrame(items, "item_id string, text string"), shard_windows=windows).first()
        assert got["n_items"] == 2 and got["n_hit"] == 3


def test_contaminated_rows_go_by_shards_too(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(10)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)) + (" " + items[i % 10][1] if i % 3 else "")) for i in range(40)]
    d, bench = docs(spark, rows), spark.createDataFrame(items, BENCH)
    whole = {r["doc_id"] for r in wu_manber.drop_contaminated(d, bench).collect()}
    assert whole == {i for i in range(40) if not i % 3} == {r["doc_id"] for r in wu_manber.drop_contaminated(d, bench, shard_windows=30).collect()}


def test_language_without_letters_and_with_many_languages(spark):
    d = docs(spark, ROWS)
    got = {r["doc_id"]: r["lang_pred"] for r in language_ftrl.predict(d, language_ftrl.fit(d)).collect()}
    assert got[2] == got[3] == got[4] == got[None] == "und" and got[1] == "en"
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id").alias("text"), F.concat(F.lit("l"), F.when(F.col("id") < 300, F.col("id")).otherwise(0)).alias("lang"))
    langs = language_ftrl.fit(many, max_langs=16)[0]
    assert len(langs) == 16 and "l0" in langs


def test_training_rows_are_bounded_where_ids_repeat(spark):
    d = spark.range(400).select((F.col("id") % 20).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(20).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    assert 0 < toxicity_nbsvm.training_rows(d, labels, 100).count() <= 100
    busy = d.union(spark.range(1000).select(F.lit(3).cast("long"), F.lit("x"), F.lit("en")))
    assert toxicity_nbsvm.training_rows(busy, labels, 300).where("text = 'x'").isEmpty()


def test_quality_bands_reject_by_themselves(spark):
    rng = random.Random(7)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(80))
    same = " ".join(f"{'lorem' * 12}{i}" for i in range(200))
    prose = " ".join(rng.choice(["the", "river", "stone", "walked", "slowly", "towards", "evening", "light", "and", "bread"]) + str(i % 7) * (i % 3 == 0) for i in range(120))
    got = {r["doc_id"]: r for r in compression_bands.judge(docs(spark, [(1, noise), (2, same), (3, prose)])).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert not got[1]["kept"] and "incompressible" in got[1]["reason"] and not got[2]["kept"] and "repetitive" in got[2]["reason"] and got[3]["kept"]


def test_components_and_joins_with_hubs(spark):
    edges = [(1, i) for i in range(2, 60)] + [(i, 1000) for i in range(100, 160)] + [(1000, 2000), (3000, 3001)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {**{i: 1 for i in range(2, 60)}, **{i: 100 for i in [*range(101, 160), 1000, 2000]}, 3001: 3000}
    for least in (1, 10_000):
        assert {r["node"]: r["root"] for r in components(frame, least_hot=least).collect()} == want
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 7), (3, 8)], "k int, x int")
    right = spark.createDataFrame([(1, "a", 50), (2, "b", 1), (4, "c", 0)], "k int, y string, n long")
    got = join_unique(left, right, "k", "n", 52, share=4, least=2)
    assert sorted(map(tuple, got.select("k", "x", "y").collect())) == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
    rows = [(i, "same words here again") for i in range(40)] + [(i, f"other words {i} {i * i}") for i in range(40, 60)]
    split, plain = (sorted(map(str, simhash_bktree.near_duplicates(docs(spark, rows), least_hot=n).collect())) for n in (1, 10_000))
    assert split == plain


PAGE = "page_id long, url string, html string, host string, `record x` struct<`a b`:int>"


@pytest.mark.parametrize("rows", [[], [(1, None, None), (1, None, None), (None, "", ""), (None, None, "<p>"), (2, "http://a.b/" + "x" * 100_000, "é" * 300_000), (3, "http://a.b/?q=1 2\n", "<p>"), (3, "http://[bad", "<p>")]])
def test_pages(spark, rows):
    pages = spark.createDataFrame([(*r, "h", (1,)) for r in rows], PAGE)
    judged = url_trie.match(pages, url_trie.RULES)
    assert judged.count() == len(rows) and judged.columns == ["page_id", "host", "path", "rule", "verdict"]
    got = warc_index.history(pages).collect()
    assert len(got) == len(rows)
    if rows:
        payloads = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got]
        assert sorted(payloads, key=str) == sorted([(1, "response", None, 0), (1, "revisit", 1, 0), (None, "revisit", 1, 0), (None, "revisit", 3, 3), (2, "response", None, 600_000), (3, "response", None, 3), (3, "revisit", 3, 3)], key=str)


def test_archives_are_bounded_and_ids_may_be_texts(spark):
    rng = random.Random(8)
    rows = [(f"id/{i} %é", f"http://h{i % 3}/", "".join(rng.choice("abcdefgh") for _ in range(rng.choice([10, 30_000])))) for i in range(30)] + [(None, "http://n/", "")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = fresh_path(spark, "warc")
    warc_index.write(pages, path, archive_bytes=70_000)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    assert files.agg(F.max("length")).first()[0] <= 70_000 and files.count() > 5
    got = warc_index.merge(warc_index.index(spark, path, number=False)).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)


def test_merge_keeps_one_hot_url_in_order(spark):
    rows = [(i, "http://hot/" if i % 3 else f"http://h{i}/", str(i)) for i in range(900)]
    path = fresh_path(spark, "warc")
    warc_index.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), path)
    for kw in ({}, {"range_lines": 50, "block_lines": 7, "window": 4}):
        got = [tuple(r) for r in warc_index.merge(warc_index.index(spark, path, run_lines=100), **kw).collect()]
        assert len(got) == 900 and [warc_index.order(r) for r in got] == sorted(warc_index.order(r) for r in got)


def test_many_url_rules_by_trie_and_join(spark):
    rng = random.Random(9)
    rules = {(rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4))), "/" + "/".join(rng.choice(["x", "y", "xy"]) for _ in range(rng.randint(0, 3)))) for _ in range(120)}
    urls = [(i, "http://" + ".".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) + "/" + "/".join(rng.choice(["x", "y", "xyz"]) for _ in range(rng.randint(0, 4)))) for i in range(300)] + [(300, None), (300, None)]
    pages, table = spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(list(rules), "verdict string, host string, path string")

    def best(url):
        at = urlsplit(url or "")
        fits = [(len(h), len(p), v, h + p) for v, h, p in rules if at.hostname and (at.hostname == h or at.hostname.endswith("." + h)) and at.path.startswith(p)]
        return (max(fits)[3], max(fits)[2]) if fits else (None, "allow")

    want = sorted((i, *best(u)) for i, u in urls[:-2])
    for limit in (url_trie.MAX_CHARS, 600, 0):
        got = url_trie.match(pages, table, max_chars=limit)
        assert got.count() == 302 and sorted((r["page_id"], r["rule"], r["verdict"]) for r in got.where("page_id < 300").collect()) == want


def test_rollup_ids_crashes_and_races(spark, monkeypatch):
    rollup = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    rows = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n long")
    put = token_rollup.change(rows, 1, "v1", F.col("n"))
    for batch_id in ("a/b", "../x", "é %2F", ""):
        assert rollup.commit(batch_id, put) and not rollup.commit(batch_id, put)
    total = lambda: [tuple(r)[3:] for r in rollup.totals().collect()]
    assert total() == [(4, 20)]
    monkeypatch.setattr(rollup, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        rollup.compact()
    with pytest.raises(RuntimeError):
        rollup.commit("late", put)
    monkeypatch.undo()
    assert total() == [(4, 20)]
    assert rollup.commit("late", put) and rollup.compact() and total() == [(5, 25)]
    assert rollup.commit("after", put) and rollup.compact() and not rollup.commit("late", put) and total() == [(6, 30)]
    seen = rollup.exists
    monkeypatch.setattr(rollup, "exists", lambda path, first=[True]: False if first and first.pop() else seen(path))
    assert not rollup.commit("after", put) and total() == [(6, 30)]  # the marker came after the first look
    empty = token_rollup.Rollup(spark, fresh_path(spark, "rollup"))
    assert empty.totals().isEmpty() and empty.commit("none", put.limit(0)) and empty.compact() and empty.totals().isEmpty()


def test_token_counts_of_odd_rows(spark):
    got = token_rollup.token_counts(docs(spark, ROWS), ["doc_id", "record", "x,y"]).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (2, 3, None)} == {0}
    assert token_rollup.token_counts(docs(spark, []), ["doc_id"]).isEmpty()


def triplets(rng, n, capacity=1000):
    """3n lengths that fill n bins exactly, where best fit in descending order needs more."""
    out = []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(capacity // 4 + 1, (capacity - a) // 2)
        out += [a, b, capacity - a - b]
    return sorted(out, reverse=True)


def test_crossover_injects_whole_bins(spark):
    rng = random.Random(10)
    lengths = triplets(rng, 20)
    a, b = (packing_gga.Packing(lengths, 1000).best_fit(rng.sample(range(60), 60)) for _ in range(2))
    for _ in range(20):
        child = a.cross(b, rng)
        assert sorted(x for bin_ in child.bins for x in bin_) == list(range(60))
        assert all(sum(lengths[x] for x in bin_) == f <= 1000 for bin_, f in zip(child.bins, child.fill))
        whole = {frozenset(x) for x in b.bins}
        assert sum(frozenset(x) in whole for x in child.bins) >= len(b.bins) // 4


def test_search_finds_what_best_fit_does_not():
    better = 0
    for seed in range(8):
        lengths = triplets(random.Random(seed), 16)
        plain = len(packing_gga.Packing(lengths, 1000).best_fit(list(range(48))).bins)
        found = max(packing_gga.evolve(lengths, 1000, [], random.Random(seed))) + 1
        assert found <= plain
        better += found < plain
    assert better >= 2


def test_an_island_goes_on_from_the_elite_of_its_neighbour():
    lengths = triplets(random.Random(3), 12)
    poor = list(range(36))
    elite = packing_gga.evolve(lengths, 1000, [], random.Random(1))
    assert max(packing_gga.evolve(lengths, 1000, [poor, elite], random.Random(2))) <= max(elite) < max(poor)


def test_shared_folder_is_asked_for_off_a_local_master(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, getConf = "spark://host:7077", staticmethod(lambda: Conf)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)


def test_workers_need_no_copy_of_the_package(tmp_path):
    code = """
        import sys
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
        sys.path.insert(0, ROOT)
        from quirework.llm import url_trie, wu_manber
        d = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
        b = spark.createDataFrame([(1, "two three")], "item_id long, text string")
        print(wu_manber.decontaminate(d, b).first()["n_hit"], url_trie.match(d.selectExpr("doc_id page_id", "'http://a.org/' url"), url_trie.RULES).first()["rule"])
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED") and not k.startswith("PYSPARK_GATEWAY")}
    got = subprocess.run([sys.executable, "-c", textwrap.dedent(code).replace("ROOT", repr(root))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == ["2", "org/"], got.stderr[-2000:]


def test_captures_take_ids_of_the_whole_range(spark):
    ids = [-(2**63), -(2**63) + 1, -1, 0, 1, 2**32, 25 * 10**10, 10**13, 2**63 - 2, 2**63 - 1]
    pages = spark.createDataFrame([(i, f"http://a.org/{i % 2}", "same" if i % 3 else f"own {i}") for i in ids], "page_id long, url string, html string")
    got = warc_index.history(pages).collect()
    assert sorted(r["page_id"] for r in got) == ids and all(len(r["time"]) == 20 and r["time"][:2] in ("20", "21") for r in got)
    assert [(r["url_key"], r["time"], r["page_id"]) for r in got] == sorted((r["url_key"], r["time"], r["page_id"]) for r in got)
    same = [i for i in ids if i % 3]
    assert {r["page_id"]: r["refers_to"] for r in got if r["refers_to"] is not None} == {i: same[0] for i in same[1:]}


def test_rules_that_end_within_a_segment_meet_only_what_they_fit(spark):
    rng = random.Random(8)
    words = [f"{a}{i}" for a in ("a", "ab", "abc", "b/c", "b/cd") for i in range(400)]
    rules = [(rng.choice(["allow", "block"]), "com", "/" + w) for w in words] + [("block", "x.com", ""), ("allow", "com", "/b/"), ("allow", "com", "/")]
    urls = [(i, f"http://{rng.choice(['x.com', 'com', 'y.x.com', 'org'])}/{rng.choice(words)}{rng.choice(['', '/', 'z', '7/q'])}") for i in range(2000)]
    df = spark.createDataFrame(urls, "page_id long, url string")
    by_trie = {tuple(r) for r in url_trie.match(df, rules, id_col="page_id").collect()}
    assert {tuple(r) for r in url_trie.match(df, rules, id_col="page_id", max_chars=40).collect()} == by_trie
    rows = df.select(F.col("page_id").alias("__row"), url_trie.host_of(F.col("url")).alias("host"), url_trie.path_of(F.col("url")).alias("path"))
    assert 2000 < url_trie.fitting(rows, spark.createDataFrame(rules, "verdict string, host string, path string")).count() < 12_000
