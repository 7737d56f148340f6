"""Token ids of whole texts by a public tokenizer, many pieces at a time.

The tokenizer lower-cases, splits at white space and between letters, digits
and other signs, and then merges pairs within each piece alone. A piece's ids
thus depend on the piece only. Texts of plain Latin script are split here with
array operations, each distinct piece of a block is merged once, and all pieces
of one length are merged together, the pair of least rank in each at a time.
All other texts, and pieces of more than LONG bytes, go through the tokenizer
itself. Either way gives the same ids; nothing is kept from block to block.

Results for odd input: null and empty texts, and those of white space alone,
have no ids. A text with any character that plain_letters doesn't have (other
scripts, marks, controls, capitals whose lower case is elsewhere) is left to the
tokenizer whole, as is one that may hold a special token. A very long text makes
a block of its own. The order of texts, and repeats, make no difference.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa

VOCABULARY = "word_bpe_49k.json"
#: Characters in one block, unless a single text is longer, and bytes of the longest piece that is merged here.
BLOCK_CHARS, LONG = 2_000_000, 40
LETTER, NUMBER, SIGN = 1, 2, 3
#: Texts that are encoded together.
ENCODE_ROWS = 2048


def vocabulary(name: str = VOCABULARY, folder: str | None = None) -> str:
    """Where a vocabulary file lies on this machine; executors look for themselves."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ramp(counts: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def kinds() -> np.ndarray:
    """The kind of each character up to U+024F; zero parts pieces.

    Up to there no mark combines, so composing changes nothing, and
    lower-casing acts on each character alone.
    """
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], SIGN) for i in range(0x250)], np.uint8)
    out[[9, 10, 13, 32]] = 0
    return out


def plain_letters() -> str:
    """The characters of U+00A1 to U+024F that lower-casing leaves as one character there."""
    return "".join(c for c in map(chr, range(0xA1, 0x250)) if len(c.lower()) == 1 and ord(c.lower()) < 0x250)


class Merger:
    """Byte-pair merges over many pieces at once, by the tables of a tokenizer with word ends."""

    def __init__(self, tokenizer):
        from tokenizers import Tokenizer, pre_tokenizers

        model = json.loads(tokenizer.to_str())["model"]
        vocab = model["vocab"]
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.inner, self.last = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
        self.letters = {i: spell.pre_tokenize_str(chr(i))[0][0] for i in range(0x21, 0x250)}
        for i, spelled in self.letters.items():
            for byte, letter in zip(chr(i).encode(), spelled):
                self.inner[byte], self.last[byte] = vocab[letter], vocab[letter + "</w>"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.uint32)
        self.none = np.int32(len(merges))
        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, each piece's from its own offset on, and how many each piece has."""
        ids, counts = np.zeros(len(data), np.uint32), np.zeros(len(offsets) - 1, np.int64)
        sizes = np.diff(offsets)
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            if size > LONG:
                for r in rows:
                    word = data[offsets[r] : offsets[r + 1]].tobytes().decode().translate(self.letters)
                    got = self.plain.encode(word, add_special_tokens=False).ids
                    ids[offsets[r] : offsets[r] + len(got)] = got
                    counts[r] = len(got)
            else:
                for i in range(0, len(rows), 65536):
                    self.merge(data, offsets, rows[i : i + 65536], int(size), ids, counts)
        return ids, counts

    def merge(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, size: int, ids: np.ndarray, counts: np.ndarray) -> None:
        """Every row that goes on loses one symbol a round, so that all rows have equally many."""
        raw = data[offsets[rows][:, None] + np.arange(size)]
        now = self.inner[raw]
        now[:, -1] = self.last[raw[:, -1]]
        rank = self.rank(now[:, :-1], now[:, 1:])
        while len(rows):
            width = now.shape[1]
            at = rank.argmin(axis=1) if width > 1 else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), self.none)
            done = least == self.none
            if done.any():
                ids[offsets[rows[done]][:, None] + np.arange(width)] = now[done]
                counts[rows[done]] = width
                more = ~done
                rows, now, rank, at, least = rows[more], now[more], rank[more], at[more], least[more]
                if not len(rows):
                    return
            each, place = np.arange(len(rows)), np.arange(width - 1)
            now = np.where(place <= at[:, None], now[:, :-1], now[:, 1:])
            now[each, at] = self.made[least]
            rank = np.where(place[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
            before, after = each[at > 0], each[at < width - 2]
            a, b = at[before], at[after]
            rank[before, a - 1] = self.rank(now[before, a - 1], now[before, a])
            rank[after, b] = self.rank(now[after, b], now[after, b + 1])


def starts_of(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where a piece starts: at a change of kind, at each number, and around an apostrophe's endings ('s 't 're 've 'm 'll 'd)."""
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == NUMBER
    quote = np.flatnonzero((points == 39) & start)
    if len(quote):
        follow = np.concatenate([points, np.zeros(3, points.dtype)])
        one, two = follow[quote + 1], follow[quote + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        for at in (quote[short] + 2, quote[long] + 3):
            start[at[at < len(start)]] = True
    start &= kind > 0
    return start


def encode_plain(texts: list[str], kind_of: np.ndarray, merger: Merger) -> list[bytes]:
    """The ids of texts of plain Latin script."""
    parts = [t.lower() for t in texts]
    points = np.frombuffer("\n".join(parts).encode("utf-32-le"), np.uint32)
    kind = kind_of[points]
    full = kind > 0
    starts = starts_of(points, kind)
    width = (points >= 0x80).astype(np.int8) + np.int8(1)
    data = np.frombuffer("".join(parts).encode().translate(None, b"\t\n\r "), np.uint8)
    width *= full
    at = np.cumsum(width, dtype=np.int32) - width  # in data, which has no white space
    pieces = np.flatnonzero(starts)
    offsets = np.append(at[pieces], len(data)).astype(np.int32)
    distinct = pa.StringArray.from_buffers(len(pieces), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
    _, edges, raw = distinct.dictionary.buffers()
    bounds = np.frombuffer(edges, np.int32)[: len(distinct.dictionary) + 1].astype(np.int64) if len(pieces) else np.zeros(1, np.int64)
    ids, counts = merger(np.frombuffer(raw, np.uint8)[: bounds[-1]] if len(pieces) else np.empty(0, np.uint8), bounds)
    which = distinct.indices.to_numpy(zero_copy_only=False) if len(pieces) else np.empty(0, np.int64)
    many = counts[which]
    stream = ids[np.repeat(bounds[which], many) + ramp(many)].astype("<u4").tobytes()
    ends = np.cumsum([len(p) + 1 for p in parts])
    upto = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(pieces, ends)].tolist()
    return [stream[4 * a : 4 * b] for a, b in zip([0, *upto], upto)]


def encoder(path: str | None = None) -> Callable[[list[str | None]], list[bytes]]:
    """A function from texts to their ids, each as little-endian unsigned 32-bit integers. A null text has none."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or vocabulary())
    merger, kind_of = Merger(tokenizer), kinds()
    other = re.compile(rf"[^\t\n\r\x20-\x7e{plain_letters()}]")

    def encode(texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        block: list[int] = []
        held = 0

        def flush() -> None:
            for i, raw in zip(block, encode_plain([texts[i] for i in block], kind_of, merger)):
                out[i] = raw
            block.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text or other.search(text):
                out[i] = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            if block and held + len(text) > BLOCK_CHARS:
                flush()
                held = 0
            block.append(i)
            held += len(text)
        if block:
            flush()
        return out

    return encode
