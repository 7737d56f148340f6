"""Phrase collocations by compressed position bitmaps.

Texts are cut at punctuation and line ends into pieces. The pieces of one
language, about SHARD_BYTES at a time, make a shard: the distinct words, and the
numbers of the words place by place, with an empty place after each piece. In a
shard each word has a bitmap of its places, compressed by leaving out the bytes
that are zero. A phrase has the bitmap of the places where it ends: shifted by
one and joined by AND with the bitmap of a word it gives that of the phrase one
word longer, and empty places keep phrases within their piece. The shifted bytes
meet only words that have a bit in the same byte, so no pairs are tried in vain.
Popcounts are a shard's counts; Spark sums them over all shards, within tasks
first.

A phrase is extended only while its parts may be frequent over all shards. So
popcounts are first summed by 40-bit hash, of words, of pairs of words that may
be frequent, and depth-first of longer phrases all of whose pairs may be: a task
sums up its shards and deals sorted blocks of (hash, count) by hash, so that
most phrases, which are rare, cost a few bytes and never become text. At last
the phrases all of whose parts may be frequent are counted as texts, and the
exact limit is held against these counts. What may be frequent reaches the shards
as filters of FILTER_BITS bits, whatever the size of the corpus. Equal hashes
and equal bits let through more, which is counted in vain, and never less.

Results for odd input: null and empty texts, and texts without words, have no
phrases; a null language is `und`, as is that value; very long texts are cut at
a piece's end or, in a piece longer than a shard, counted as a whole in a shard
of their own; repeated rows count each; ties are ordered by count and phrase; an
empty table gives an empty result; other columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirework.llm.common import LOWER, UPPER, load, shared, slices, staged, table

LEAST, WORDS, INSIDE, TOP = 30, 4, 80, 2000
UNKNOWN = "und"
SHARD_BYTES, FILTER_BITS = 2 << 20, 1 << 26
#: Entries that one class of first words may have when it is extended, about.
CLASS = 1 << 16
END, SPACE = b".,;:!?\n\v\f\r", b"\t"
FOLD = bytes.maketrans(UPPER.encode() + END + SPACE, LOWER.encode() + b"\n" * len(END) + b" ")
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SHARD = "lang string, words array<string>, places binary, n_words long"
BLOCK = "bucket int, hashes binary, counts binary"
#: Hashes that a task holds before it gives blocks out, and that a bucket gets from all tasks, about.
HELD, BUCKET = 1 << 19, 1 << 18
COUNTED = "lang string, phrase string, n long"
TEXTS = "bucket int, lang string, phrases binary, counts binary"
#: How far the second word's hash is turned, so that a pair's order matters, and bits of a hash by which is summed.
TURN, KEY_BITS = 17, 40


def encode(raw: bytes) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct words of folded bytes, and their numbers place by place; -1 is an empty place."""
    data = np.frombuffer(raw, np.uint8)
    gap = (data == 0x20) | (data == 0x0A)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = pa.py_buffer(raw.translate(None, b" \n"))
    coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), letters).dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    piece = np.cumsum(data == 0x0A, dtype=np.int32)[starts] if len(starts) else np.empty(0, np.int32)
    shift = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])]).astype(np.int64)[: len(numbers)]
    places = np.full(len(numbers) + (int(shift[-1]) if len(shift) else 0), -1, np.int32)
    places[np.arange(len(numbers)) + shift] = numbers
    return coded.dictionary, places


def shards(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Words and places of shards, each of one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def put(lang: str) -> pa.RecordBatch:
            words, places = encode(b"\n".join(held.pop(lang)))
            del sizes[lang]
            listed = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
            return pa.RecordBatch.from_arrays([pa.array([lang]), listed, pa.array([packed(places, len(words))], pa.binary()), pa.array([int((places >= 0).sum())])], names=["lang", "words", "places", "n_words"])

        for batch in slices(batches):
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
                while raw:
                    cut = len(raw) if len(raw) <= shard_bytes else raw.find(b"\n", shard_bytes) + 1 or len(raw)
                    held.setdefault(lang, []).append(raw[:cut])
                    sizes[lang] = sizes.get(lang, 0) + cut + 1
                    raw = raw[cut:]
                    if sizes[lang] >= shard_bytes:
                        yield put(lang)
            while sum(sizes.values()) > 4 * shard_bytes:  # very many languages: the largest goes
                yield put(max(sizes, key=sizes.get))
        for lang in list(held):
            yield put(lang)

    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN))
    return docs.where(F.col(f"`{text_col}`").isNotNull()).select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SHARD)


def packed(places: np.ndarray, n_words: int) -> bytes:
    """Numbers of words in two bytes each, if they fit."""
    return places.astype("<u2" if n_words < 0xFFFF else "<i4").tobytes()


def unpacked(raw: pa.Buffer, n_words: int) -> np.ndarray:
    if n_words >= 0xFFFF:
        return np.frombuffer(raw, "<i4")
    places = np.frombuffer(raw, "<u2").astype(np.int32)
    places[places == 0xFFFF] = -1
    return places


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: those that hardly vary compress well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def values_of(raw: pa.Buffer, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


class Sums:
    """Counts by hash, summed up in memory and given out in blocks by bucket, each sorted."""

    def __init__(self, buckets: int):
        self.buckets, self.hashes, self.counts, self.held = buckets, [], [], 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.hashes.append(hashes & np.uint64((1 << KEY_BITS) - 1))
        self.counts.append(counts)
        self.held += len(hashes)
        if self.held > 2 * HELD:
            hashes, counts = self.merge()
            if len(hashes) > HELD:
                yield from self.blocks(hashes, counts)
            else:
                self.hashes, self.counts, self.held = [hashes], [counts], len(hashes)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = np.concatenate(self.hashes), np.concatenate(self.counts)
        self.hashes, self.counts, self.held = [], [], 0
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        first = np.flatnonzero(np.diff(hashes) != 0) + 1
        first = np.concatenate([np.zeros(min(1, len(hashes)), np.int64), first])
        return hashes[first], np.add.reduceat(counts, first) if len(first) else counts

    def blocks(self, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A bucket is a range of hashes."""
        bucket = (hashes * np.uint64(self.buckets) >> np.uint64(KEY_BITS)).astype(np.int32)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([planes(hashes[a:b])], pa.binary()), pa.array([planes(counts[a:b].astype(np.int64))], pa.binary())], names=["bucket", "hashes", "counts"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.hashes:
            yield from self.blocks(*self.merge())


def frequent_slots(blocks: DataFrame, least: int, bits: int) -> DataFrame:
    """The places in a filter of hashes whose counts, over all blocks, are at least so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now = Sums(1), None

        def done() -> Iterator[pa.RecordBatch]:
            if sums.hashes:
                hashes, counts = sums.merge()
                at = np.unique(hashes[counts >= least] & np.uint64(bits - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

        for batch in batches:
            for bucket, hashes, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if bucket != now:
                    yield from done()
                    now = bucket
                sums.hashes.append(values_of(hashes.as_buffer(), np.uint64))
                sums.counts.append(values_of(counts.as_buffer(), np.int64))
        yield from done()

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "at long")


def filter_of(slots: DataFrame, bits: int):
    """A broadcast bitmap of bits, in which the given places are set."""
    at = F.col("at") + 1  # bits are numbered from 1, buckets too
    built = slots.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in built.collect():  # each of 32,768 places, so no more than the filter has
        base = (r["bucket"] - 1) * 4096
        out[base : base + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[:4096]
    return shared(slots.sparkSession, (out, bits))


def holds(of: tuple[np.ndarray, int], hashes: np.ndarray) -> np.ndarray:
    table, bits = of
    at = hashes & np.uint64(bits - 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Bitmaps:
    """The compressed position bitmaps of a shard's words that may be frequent, in order of bytes."""

    def __init__(self, places: np.ndarray, wanted: np.ndarray):
        at = np.flatnonzero((places >= 0) & wanted[places])
        word, byte = places[at], at >> 3
        key = byte.astype(np.int64) * max(1, len(wanted)) + word
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        bit = np.left_shift(1, at[order] & 7).astype(np.uint8)
        self.bits = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.byte, self.word = byte[order][first], word[order][first]
        self.starts = np.searchsorted(self.byte, np.arange(len(places) // 8 + 3))
        self.n = len(wanted)

    def classes(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Bitmaps of first words (word, byte, bits), a class of some words at a time."""
        order = np.argsort(self.word, kind="stable")
        word = self.word[order]
        at = 0
        while at < len(word):
            to = int(np.searchsorted(word, word[min(at + CLASS, len(word)) - 1], side="right"))
            yield word[at:to], self.byte[order[at:to]], self.bits[order[at:to]]
            at = to

    def extend(self, phrase: np.ndarray, byte: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, word, byte, bits) of all bitmaps shifted by one place AND the bitmap of any word, where a bit is left."""
        carry = bits >> 7
        over = np.flatnonzero(carry)
        kept = np.flatnonzero(bits & 0x7F)
        phrase = np.concatenate([phrase[kept], phrase[over]])
        byte = np.concatenate([byte[kept], byte[over] + 1])
        shifted = np.concatenate([np.left_shift(bits[kept], 1), carry[over]])
        many = self.starts[byte + 1] - self.starts[byte]
        source = np.repeat(np.arange(len(byte)), many)
        target = np.arange(len(source)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.starts[byte], many)
        both = shifted[source] & self.bits[target]
        left = np.flatnonzero(both)
        source, target = source[left], target[left]
        return phrase[source], self.word[target], byte[source], both[left]


def grouped(phrase: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (phrase, word), as two arrays, and the number of each entry's pair."""
    pairs, which = np.unique(phrase.astype(np.int64) * n + word, return_inverse=True)
    return pairs // n, pairs % n, which


def popcounts(which: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(which, weights=POPCOUNT[bits], minlength=n).astype(np.int64)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of the hashes of two words of one language; which is first matters."""
    mixed = (left ^ (right << np.uint64(TURN) | right >> np.uint64(64 - TURN))) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(32)


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray, np.ndarray]]:
    """The language, the words, their hashes and the places of each shard."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        for i in range(batch.num_rows):
            lang, words, places = (c[i] for c in batch.columns)
            hashes = np.array([xxh64_intdigest(w, 42) for w in words.values.to_pylist()], np.uint64) ^ np.uint64(xxh64_intdigest(lang.as_py(), 42))
            yield lang.as_py(), words.values, hashes, unpacked(places.as_buffer(), len(words.values))


def word_blocks(sharded: DataFrame, buckets: int) -> DataFrame:
    """Popcounts of words, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(buckets)
        for _, words, hashes, places in shard_rows(batches):
            yield from sums.add(hashes, np.bincount(places[places >= 0], minlength=len(words)))
        yield from sums.rest()

    return sharded.mapInArrow(run, BLOCK)


def walk(maps: Bitmaps, hashes: np.ndarray, pairs, longer, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, prefix, last word, hash, popcount) of the phrases of two words and more, depth-first by classes of first words.

    A prefix is the number of a phrase among those one word shorter that came
    before, and for pairs a word. A phrase is gone on from if its last pair is in
    pairs and, beyond two words, its hash in longer; a filter that is None holds all.
    """
    for phrase, byte, bits in maps.classes():
        last, own = np.arange(maps.n), hashes  # last word and hash of each phrase by its number
        for length in range(2, longest + 1):
            phrase, word, byte, bits = maps.extend(phrase, byte, bits)
            head, tail, which = grouped(phrase, word, maps.n)
            ok = np.ones(len(head), bool)
            if pairs:
                ok &= holds(pairs, pair_hash(hashes[last[head]], hashes[tail]))
            if longer and length > 2:
                ok &= holds(longer, pair_hash(own[head], hashes[tail]))
            if not ok.any():
                break
            left = ok[which]
            head, tail, phrase, byte, bits = head[ok], tail[ok], (np.cumsum(ok) - 1)[which[left]], byte[left], bits[left]
            own, last = pair_hash(own[head], hashes[tail]), tail
            yield length, head, tail, own, popcounts(phrase, bits, len(head))


def phrase_blocks(sharded: DataFrame, wanted, pairs, buckets: int, longest: int) -> DataFrame:
    """Popcounts by hash of the pairs of wanted words; with a filter of pairs, of longer phrases made of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, word_filter, pair_filter = Sums(buckets), load(wanted), load(pairs) if pairs else None
        for _, _, hashes, places in shard_rows(batches):
            for length, _, _, own, counts in walk(Bitmaps(places, holds(word_filter, hashes)), hashes, pair_filter, None, longest if pairs else 2):
                if length > 2 or not pairs:
                    yield from sums.add(own, counts)
        yield from sums.rest()

    return sharded.mapInArrow(run, BLOCK)


class Texts:
    """Counts of phrases of one language, summed up in memory."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.held = 0

    def add(self, phrases: pa.Array, counts: np.ndarray, keys: np.ndarray | None = None) -> None:
        self.parts.append(pa.table({"phrase": phrases, "n": pa.array(counts, pa.int64())} | ({} if keys is None else {"key": keys & np.uint64((1 << KEY_BITS) - 1)})))
        self.held += len(phrases)

    def merge(self) -> pa.Table:
        every = pa.concat_tables(self.parts)
        self.parts, self.held = [], 0
        return every.group_by("phrase").aggregate([("n", "sum")] + ([("key", "min")] if "key" in every.column_names else []))

    def blocks(self, lang: str, buckets: int, press) -> Iterator[pa.RecordBatch]:
        """Sorted texts and their counts by bucket."""
        merged = self.merge().sort_by([("key_min", "ascending")])
        bucket = (merged["key_min"].to_numpy() * np.uint64(buckets) >> np.uint64(KEY_BITS)).astype(np.int32)
        edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                part = merged.slice(a, b - a).sort_by([("phrase", "ascending")])
                text = press("\n".join(part["phrase"].to_pylist()).encode())
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([lang]), pa.array([text]), pa.array([planes(part["n_sum"].to_numpy())], pa.binary())], names=["bucket", "lang", "phrases", "counts"])


def phrase_texts(sharded: DataFrame, wanted, pairs, longer, buckets: int, longest: int) -> DataFrame:
    """Counts of the words and phrases that are in the filters with all their parts, in blocks by bucket and language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        word_filter, pair_filter, longer_filter = load(wanted), load(pairs), load(longer)
        press = zstandard.ZstdCompressor(level=3).compress
        sums: dict[str, Texts] = {}
        for lang, words, hashes, places in shard_rows(batches):
            mine = sums.setdefault(lang, Texts())
            sure = holds(word_filter, hashes)
            known = np.flatnonzero(sure)
            mine.add(words.take(pa.array(known)), np.bincount(places[places >= 0], minlength=len(words))[known], hashes[known])
            texts = words
            for length, head, tail, own, counts in walk(Bitmaps(places, sure), hashes, pair_filter, longer_filter, longest):
                texts = pc.binary_join_element_wise((texts if length > 2 else words).take(pa.array(head)), words.take(pa.array(tail)), " ")
                mine.add(texts, counts, own)
            if sum(t.held for t in sums.values()) > HELD:
                most = max(sums, key=lambda x: sums[x].held)
                yield from sums.pop(most).blocks(most, buckets, press)
        for lang, mine in sums.items():
            yield from mine.blocks(lang, buckets, press)

    return sharded.mapInArrow(run, TEXTS)


def summed(blocks: DataFrame, least: int) -> DataFrame:
    """The phrases that occur at least so often over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpress = zstandard.ZstdDecompressor().decompress
        now, sums = None, Texts()

        def done() -> Iterator[pa.RecordBatch]:
            if sums.parts:
                merged = sums.merge()
                for part in merged.filter(pc.greater_equal(merged["n_sum"], least)).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([now[1]] * part.num_rows, pa.string()), part["phrase"], part["n_sum"]], names=["lang", "phrase", "n"])

        for batch in batches:
            for bucket, lang, phrases, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (bucket, lang) != now:
                    yield from done()
                    now = bucket, lang
                text = unpress(phrases.as_buffer()).decode()
                sums.add(pa.array(text.split("\n"), pa.string()), values_of(counts.as_buffer(), np.int64))
        yield from done()

    return blocks.repartition("bucket", "lang").sortWithinPartitions("bucket", "lang").mapInArrow(run, COUNTED)


def count(docs: DataFrame, least: int = LEAST, longest: int = WORDS, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of every phrase of up to longest words that occurs at least so often, and (lang, n), the number of all words."""
    sharded = staged(shards(docs, text_col, lang_col, shard_bytes), "shards")
    totals = staged(sharded.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    sharded = sharded.drop("n_words")
    buckets = min(1 << 23, max(1, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET))

    def may_be(blocks: DataFrame):
        return filter_of(frequent_slots(blocks, least, filter_bits), filter_bits)

    wanted = may_be(word_blocks(sharded, buckets))
    pairs = may_be(phrase_blocks(sharded, wanted, None, buckets, longest))
    longer = may_be(phrase_blocks(sharded, wanted, pairs, buckets, longest))
    return staged(summed(phrase_texts(sharded, wanted, pairs, longer, buckets, longest), least), "phrases"), totals


def scored(counted: DataFrame) -> DataFrame:
    """Candidates with the cut that scores lowest: a, l, r, score."""
    words = F.split("phrase", " ")
    candidates = counted.where(F.size(words) > 1).select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    parts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    heads = counted.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = counted.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    exact = F.expr("cast(2000000 as decimal(18, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    each = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", exact)
    best = F.min(F.struct("score", "k", "l", "r")).alias("b")
    return each.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def covered(counted: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent longer phrase in which a phrase lies."""
    words = F.split("phrase", " ")
    n = F.size("w")
    within = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    longer = counted.select("lang", "n", words.alias("w")).where(n > 2)
    return longer.select("lang", "n", F.explode(F.array_distinct(within)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, top: int = TOP, inside: int = INSIDE, **options) -> DataFrame:
    """The first candidates of each language by score, count and phrase, without those that a longer one nearly always holds."""
    counted, totals = count(docs, **options)
    left = scored(counted).join(covered(counted), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(19, 0)") < inside * F.col("a").cast("decimal(19, 0)")))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(32))
    some = left.withColumn("rank", F.row_number().over(W.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)  # so few go to one task
    first = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(F.broadcast(totals) if totals.count() < 100_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30
), s AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)
  ) GROUP BY lang, phrase
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN o USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 80 * a
QUALIFY rank <= 2000
"""
