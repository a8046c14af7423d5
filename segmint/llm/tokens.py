"""Token ids of whole texts under ``word_bpe_49k.json``, pre-token by
pre-token.

The vocabulary drops white space and nothing in it reaches across ASCII white
space (NFC, lower case and the split pattern act inside a chunk between white
space; special strings hold none). Plain texts (printable ASCII and the
letters of Latin-1, where NFC and lower case are simple; no "<|", with which
special strings begin) are handled as byte arrays: lower case by table,
pre-tokens by class changes, a 64-bit hash per pre-token, a sorted table of
known pre-tokens, merge rounds for the unknown ones. Other texts go chunk by
chunk through a cache; chunks that are not plain go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .byte_bpe import Merges
from .common import Generations, worker_state
from .pretokens import Runs, Table, ragged, within

WORD_BPE = "word_bpe_49k.json"
#: Chunks whose ids the batched rounds give; "<|" could begin a special string.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's split pattern over the lower-cased characters of PLAIN.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The library's tokenizer, once per worker, without truncation, padding
    or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    state = worker_state()
    if ("tokenizer", path) not in state:
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        state[("tokenizer", path)] = t
    return state[("tokenizer", path)]


class ChunkIds:
    """Ids of white-space chunks: ``encode`` in batches, ``texts`` through a
    bounded cache."""

    def __init__(self, path: str, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        self.path = path
        self.merges = Merges(d["model"]["vocab"], d["model"]["merges"], d["model"]["end_of_word_suffix"])
        self.cache = Generations(limit)

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each chunk."""
        words: list[bytes] = []
        ends, other = [], []
        for k, c in enumerate(chunks):
            s = c.decode("utf-8", "replace")
            if "<|" in s or PLAIN.fullmatch(s) is None:
                other.append((k, s))
            elif s.isascii():
                words += [w.encode() for w in WORD.findall(s.lower())]
            else:
                words += [w.encode("utf-8") for w in WORD.findall(s.lower())]
            ends.append(len(words))
        ids, counts = self.merges.encode_words(words)
        at = (np.r_[0, np.cumsum(counts)] * 4)[ends].tolist()
        data, lo, out = ids.tobytes(), 0, []
        for hi in at:
            out.append(data[lo:hi])
            lo = hi
        if other:
            found = load_tokenizer(self.path).encode_batch([s for _, s in other], add_special_tokens=False)
            for (k, _), e in zip(other, found):
                out[k] = np.array(e.ids, np.uint32).tobytes()
        return out

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        found = self.cache.values([t.split() if t else [] for t in texts], self.encode)
        return [b"".join(v) for v in found]


#: Bytes of plain texts: ASCII white space, printable ASCII, U+00C0-U+00FF.
PLAIN_BYTES = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])


def is_plain(t: bytes) -> bool:
    """× and ÷ (C3 97, C3 B7) are no letters, so texts with them are not."""
    return not t.translate(None, PLAIN_BYTES) and b"<|" not in t and (t.isascii() or (b"\xc3\x97" not in t and b"\xc3\xb7" not in t))


def _classes() -> np.ndarray:
    c = np.full(256, 3, np.uint8)
    c[[0x20, *range(0x09, 0x0E)]] = 0
    c[range(ord("a"), ord("z") + 1)] = 1
    c[0x80:] = 1
    c[range(ord("0"), ord("9") + 1)] = 2
    return c


CLASSES = _classes()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 0x20
#: The contractions that are pre-tokens of their own, after the apostrophe.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


class PreTokens(Runs):
    """The pre-tokens of plain texts, lower-cased."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        data = LOWER[raw]
        after = np.flatnonzero(raw[:-1] == 0xC3) + 1
        after = after[(raw[after] >= 0x80) & (raw[after] <= 0x9E)]
        data[after] += 0x20
        cls = CLASSES[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = (cls[1:] != cls[:-1]) | (cls[1:] == 2)
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            quote = quote[(quote == 0) | (cls[quote - 1] != 3)]
            open_ = np.ones(len(quote), bool)
            for c in CONTRACTIONS:
                n = len(c)
                fits = quote + n < len(data)
                hit = open_ & fits
                for j in range(n):
                    hit &= data[np.minimum(quote + 1 + j, len(data) - 1)] == c[j]
                open_ &= ~hit
                at = quote[hit]
                for j in range(n):
                    cut[at + 1 + j] = False
                cut[at + 1 + n] = True
        pts = np.flatnonzero(cut)
        keep = cls[pts[:-1]] != 0
        super().__init__(data, pts[:-1][keep], pts[1:][keep], np.cumsum([0] + [len(x) + 1 for x in texts]))


class TextIds:
    """Ids of texts, plain ones by arrays, others chunk by chunk."""

    def __init__(self, path: str, batch_bytes: int = 1 << 20):
        self.chunks = ChunkIds(path, 60_000)
        self.table = Table(self.chunks.merges, 1_000_000)
        self.batch_bytes = batch_bytes

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for null."""
        out: list = [np.empty(0, np.uint32)] * len(texts)
        for which in self.plain_batches(texts):
            p = PreTokens([texts[k] for k in which])
            u, at, inverse = np.unique(p.hashes, return_index=True, return_inverse=True)
            rows = self.table.rows(p, u, at)[inverse]
            counts = self.table.counts[rows]
            ids = self.table.pool[ragged(self.table.places[rows], counts)]
            ends = np.r_[0, np.cumsum(counts)][p.first]
            for j, k in enumerate(which):
                out[k] = ids[ends[j] : ends[j + 1]]
        other = [k for k, t in enumerate(texts) if t and not is_plain(t)]
        for k, ids in zip(other, self.chunks.texts([texts[k] for k in other])):
            out[k] = np.frombuffer(ids, np.uint32)
        return out

    def count(self, texts: list[bytes | None], frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Number of ids of each text: ``frequent`` (ascending hashes, numbers
        of ids) is asked first, then the worker's own table."""
        out = np.zeros(len(texts), np.int64)
        for which in self.plain_batches(texts):
            p = PreTokens([texts[k] for k in which])
            u, at, inverse = np.unique(p.hashes, return_index=True, return_inverse=True)
            hit, place = within(frequent[0], u)
            n = np.zeros(len(u), np.int64)
            n[hit] = frequent[1][place[hit]]
            rows = self.table.rows(p, u[~hit], at[~hit])
            n[~hit] = self.table.counts[rows]
            run = np.r_[0, np.cumsum(n[inverse])]
            out[which] = np.diff(run[p.first])
        other = [k for k, t in enumerate(texts) if t and not is_plain(t)]
        out[other] = [len(x) // 4 for x in self.chunks.texts([texts[k] for k in other])]
        return out

    def plain_batches(self, texts: list[bytes | None]):
        """Indices of the plain texts, some megabytes at a time."""
        part, size = [], 0
        for k, t in enumerate(texts):
            if t and is_plain(t):
                part.append(k)
                size += len(t)
                if size > self.batch_bytes:
                    yield part
                    part, size = [], 0
        if part:
            yield part


def load_texts(path: str) -> TextIds:
    state = worker_state()
    if ("texts", path) not in state:
        state[("texts", path)] = TextIds(path)
    return state[("texts", path)]
