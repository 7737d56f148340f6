"""The pipeline, stage by stage, and the secret scan against plain Python over whole tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quirework.llm import compression_bands, secret_links, simhash_bktree, token_rollup
from quirework.llm.common import staged

SF = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^ \t-\r]+")
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
EITHER = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in KEYWORDS)
ASSIGN = re.compile(rf"""({EITHER})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def kept_by_quality(text):
    words = SPACED.findall(text or "")
    if len(words) < 50:
        return False
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    if 100 * len(hit) > 50 * len(words):
        return False
    out = lambda b: not band(len(b))[0] <= len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b) <= band(len(b))[1]
    band = lambda n: [b[1:] for b in compression_bands.BANDS if b[0] <= n][-1]
    raw = text.encode()
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    return not out(raw) and (len(chunks) == 1 or sum(map(out, chunks)) <= 0.5 * len(chunks))


def fingerprint(text):
    words = SPACED.findall(lower(text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def representatives(texts):
    fps = {i: fingerprint(t) for i, t in texts.items()}
    root = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if j < i and root[i] != root[j] and (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return set(root.values())


def is_contaminated(text, windows):
    words, hit = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text)), set()
    for m in {len(w) for w in windows}:
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
    return bool(hit) and 20 * len(hit) >= len(words)


def secret_spans(text):
    """(start, kind number, end) of all reported spans; parts are held against each other one by one."""
    text = text or ""
    parts = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    parts += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    parts += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    base = list(parts)
    for k in (3, 4, 5):
        parts += [(m.start(), k, m.end()) for m in re.finditer(list(secret_links.KINDS.values())[k], text)]
    completed_by = {3: (0, 4), 5: (0, 4), 4: (1, 3, 5)}
    meets = lambda a, b: max(b[0] - a[2], a[0] - b[2]) <= secret_links.SCOPE
    linked = [p for p in parts if p[1] > 2 and any(q[1] in completed_by[p[1]] and meets(p, q) for q in parts) and not any(b[0] <= p[0] < b[2] for b in base)]
    return sorted(base + linked)


def redacted(text):
    if text is None:
        return None
    out, end = "", 0
    for s, _, e in secret_spans(text):
        if s >= end:
            out += text[end:s] + secret_links.MARK
        end = max(end, e)
    return out + text[end:]


def listed(spans):
    return ",".join(f"{secret_links.NAMES[k]}:{s}:{e}" for s, k, e in spans)


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(texts) == docs.count()
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()

    def near(t):
        stay = representatives(t)
        return {i: x for i, x in t.items() if i in stay}

    plain = {
        "quality": lambda t: {i: x for i, x in t.items() if kept_by_quality(x)},
        "near_duplicates": near,
        "decontamination": lambda t: {i: x for i, x in t.items() if not is_contaminated(x, windows)},
        "secrets": lambda t: {i: redacted(x) for i, x in t.items()},
    }
    sizes = [len(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, texts = staged(stage(spark, docs, SF), name), plain[name](texts)
        assert docs.columns == columns
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts, name
        sizes.append(len(texts))
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] == sizes[4]

    from tokenizers import Tokenizer

    from quirework.llm.tokens import vocabulary

    tok = Tokenizer.from_file(vocabulary())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    want = set()
    for i, t in texts.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert set(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(packed) == len(want)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 4096 and list(g.offset) == [0, *g.length.cumsum()[:-1]]
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 4096) + 2


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_secret_scan_against_plain_python(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secret_links.op4_secret_links(spark, sf).collect():
        spans = secret_spans(texts[r["doc_id"]])
        base = [x for x in spans if x[1] <= 2]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[1] == k for x in base) for k in (0, 1, 2))
        assert r["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest() and r["spans"] == listed(spans)


def test_quality_verdicts_against_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r["kept"] for r in compression_bands.op6_compression_bands(spark, SF).collect()}
    assert got == {i: kept_by_quality(t) for i, t in texts.items()}


def test_fingerprints_against_plain_python(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = simhash_bktree.op7_simhash_bktree(spark, SF).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{fingerprint(t):016x}" for i, t in texts.items()}
    assert {r["component_id"] for r in got} == representatives(texts)


def test_token_totals_against_plain_python(spark):
    from tokenizers import Tokenizer

    from quirework.llm.tokens import vocabulary

    tok, want = Tokenizer.from_file(vocabulary()), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r["text"]:
            n = want.setdefault((r["source"], r["lang"], token_rollup.IDS_V2), [0, 0])
            n[0] += 1
            n[1] += len(tok.encode(r["text"], add_special_tokens=False).ids)
    got = token_rollup.op10_token_rollup(spark, SF).select("source", "lang", "tokenizer_version", F.array("n_docs", "n_tokens").alias("n")).collect()
    assert {tuple(r)[:3]: r["n"] for r in got} == want


def test_run_on_odd_rows_and_on_an_empty_table(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = simhash_bktree.keep_one(compression_bands.keep(table)).orderBy("doc_id").limit(30).collect()
    first, second, third, *others = (r["text"] for r in kept)
    rows = [(1, first), (1, first), (2, first), (3, None), (4, ""), (5, "too few"), (None, second), (6, " ".join(others)), (7, third + " password = abcdefghijkl1234")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, record struct<`a b`:int>, row long, piece string"
    for name, made in (("odd", rows), ("empty", [])):
        spark.createDataFrame([(i, t, None, "s", 1, (1,), 3, "p") for i, t in made], schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in got} - {1, 2} == {None, 6, 7} and max(r["piece"] for r in got if r["doc_id"] == 6) > 0
    assert len({r["doc_id"] for r in got} & {1, 2}) == 1  # one of three copies
    empty = corpus_pipeline.run(spark, f"{tmp_path}/empty")
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
