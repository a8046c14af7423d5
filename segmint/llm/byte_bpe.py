"""Byte-level BPE encoding and decoding with batched NumPy merge rounds.

The symbols of many words lie in one flat array. Each round looks up adjacent
pairs by binary search over the sorted pair keys, takes the lowest rank of
every word, and merges all its occurrences at once. Ranks are looked up again
only beside a merge; words without a mergeable pair leave the array.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, fresh, lean, worker_state
from .pretokens import Runs, Table, cut_long, ragged

BYTE_BPE = "byte_bpe_50k.json"
NONE = np.int32(np.iinfo(np.int32).max)
#: Texts encoded at once.
ROWS = 256


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes
    that print stand for themselves, the others for U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Merges:
    """Merge rules as arrays: sorted pair keys with rank and resulting id."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, word_end: str = ""):
        letters = byte_letters()
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.end_ids = np.array([vocab.get(c + word_end, -1) for c in letters], np.int32)
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)[order]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        hit = self.keys[at] == k
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_flat`` of a list."""
        return self.encode_flat(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))

    def encode_flat(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word);
        ``data`` holds the words' bytes one after another."""
        sym = self.byte_ids[data]
        filled = sizes > 0
        last = np.cumsum(sizes)[filled] - 1
        if len(last):
            sym[last] = self.end_ids[data[last]]
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        done_sym, done_word = [], []
        rank = np.full(len(sym), NONE, np.int32)
        made = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[:-1][word[:-1] != word[1:]] = NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            if (least == NONE).any():
                over = np.repeat(least == NONE, counts)
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, made = sym[~over], word[~over], rank[~over], made[~over]
                counts, least = counts[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            hit = rank == np.repeat(least, counts)
            # of overlapping pairs (a run of one symbol) every second is merged, from the left
            at = np.flatnonzero(hit)
            first = np.r_[True, at[1:] != at[:-1] + 1]
            begin = np.maximum.accumulate(np.where(first, at, 0))
            at = at[(at - begin) % 2 == 0]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            at = place[at]
            beside = np.zeros(len(sym), bool)
            beside[at] = True
            beside[at[at > 0] - 1] = True
            if beside[-1]:
                rank[-1], made[-1], beside[-1] = NONE, -1, False
            near = np.flatnonzero(beside)
            r, m = self.look_up(sym[near], sym[near + 1])
            r[word[near] != word[near + 1]] = NONE
            rank[near], made[near] = r, m
        if done_sym:
            sym, word = np.concatenate(done_sym), np.concatenate(done_word)
            sym = sym[np.argsort(word, kind="stable")]
        return sym.astype(np.uint32), np.bincount(word, minlength=len(sizes))


#: Bytes of plain texts: ASCII but NUL and the separators 1C-1F, U+00C0-U+00FF.
PLAIN_BYTES = bytes([*range(0x01, 0x1C), *range(0x20, 0x80), *range(0x80, 0xC0), 0xC3])
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def is_plain(t: bytes) -> bool:
    """Texts that ``PlainRuns`` can cut: "<|" could begin a special string; ×
    and ÷ (C3 97, C3 B7) are no letters."""
    return not t.translate(None, PLAIN_BYTES) and b"<|" not in t and (t.isascii() or (b"\xc3\x97" not in t and b"\xc3\xb7" not in t))


def _classes() -> np.ndarray:
    c = np.full(256, 3, np.uint8)  # others
    c[[0x20, *range(0x09, 0x0E)]] = 0  # white space
    c[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1
    c[0x80:] = 1  # letters
    c[range(ord("0"), ord("9") + 1)] = 2
    c[0] = 4  # between texts
    return c


CLASSES = _classes()


class PlainRuns(Runs):
    """The pre-tokens of plain texts: runs of one class, each with a single
    space before it; contractions; of longer white space all but the last."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        cls = CLASSES[data]
        cut = np.ones(len(data) + 1, bool)
        cut[1:-1] = cls[1:] != cls[:-1]
        # the last white space of a run goes on its own, a space to what follows
        last = np.flatnonzero((cls[:-1] == 0) & (cls[1:] != 0) & (cls[1:] != 4))
        cut[last] = True
        cut[last[data[last] == 0x20] + 1] = False
        quote = np.flatnonzero(data == 0x27)
        if len(quote):
            before = np.where(quote > 0, quote - 1, len(data) - 1)
            quote = quote[(cls[before] != 3) & (data[before] != 0x20)]
            open_ = np.ones(len(quote), bool)
            for c in CONTRACTIONS:
                n = len(c)
                hit = open_ & (quote + n < len(data))
                for j in range(n):
                    hit &= data[np.minimum(quote + 1 + j, len(data) - 1)] == c[j]
                open_ &= ~hit
                at = quote[hit]
                for j in range(n):
                    cut[at + 1 + j] = False
                cut[at + 1 + n] = True
        pts = np.flatnonzero(cut)
        keep = cls[pts[:-1]] != 4
        super().__init__(data, pts[:-1][keep], pts[1:][keep], np.cumsum([0] + [len(x) + 1 for x in texts]))


class ByteBpe:
    """A byte-level vocabulary file: pre-tokens by its pattern, ids by
    ``Merges``, bytes of ids. Special strings in a text become their ids."""

    #: The pattern that byte-level pre-tokenisation splits by.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab = d["model"]["vocab"]
        self.merges = Merges(vocab, d["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.pattern = regex.compile(self.PATTERN)
        letters = {c: b for b, c in enumerate(byte_letters())}
        top = max([*vocab.values(), *self.special.values()]) + 1
        of: list[bytes] = [b""] * top
        for t, i in vocab.items():
            of[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        for t, i in self.special.items():
            of[i] = t.encode()
        self.lengths = np.array([len(x) for x in of])
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(of), np.uint8)
        self.table = Table(self.merges)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = os.path.commonprefix([*self.special]) if self.special else "\udfff"
        self.cache = Generations(KNOWN_UNITS)

    def segments(self, text: str) -> list[str]:
        return self.split_special.split(text) if self.split_special else [text]

    def units(self, text: str) -> list[str]:
        """Strings whose ids, one after another, are the text's. Where no two
        white-space characters touch, a space can only begin a pre-token, so
        the text is cut before each space; else by the pattern."""
        if DOUBLE.search(text) is None:
            first, *rest = text.split(" ")
            return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
        out: list[str] = []
        for k, s in enumerate(self.segments(text)):
            if k % 2:
                out.append(s)
            elif s:
                out += self.pattern.findall(s)
        return out

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of ``units``, all in one batch of merge rounds."""
        words: list[bytes] = []
        ends, special = [], []
        for k, u in enumerate(units):
            if self.mark in u:
                special.append(k)
            else:
                words += [p.encode("utf-8") for p in self.pattern.findall(u)]
            ends.append(len(words))
        ids, counts = self.merges.encode_words(words)
        at = (np.r_[0, np.cumsum(counts)] * 4)[ends].tolist()
        data, lo, out = ids.tobytes(), 0, []
        for hi in at:
            out.append(data[lo:hi])
            lo = hi
        for k in special:
            parts = self.segments(units[k])
            plain = iter(self.learn(parts[::2]))
            out[k] = b"".join(np.uint32(self.special[p]).tobytes() if j % 2 else next(plain) for j, p in enumerate(parts))
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """uint32 ids of each text; none for null. Plain texts are handled
        as arrays, some megabytes at a time, others through the cache; long
        texts in pieces."""
        pieces, owner = cut_long([t or b"" for t in texts])
        if len(pieces) == len(texts):
            return self._encode(texts)
        ids = self._encode(pieces)
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [ids[a] if b - a == 1 else np.concatenate(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def _encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        out: list = [np.empty(0, np.uint32)] * len(texts)
        plain, other, size = [], [], 0
        for k, t in enumerate(texts):
            if t and is_plain(t):
                plain.append(k)
                size += len(t)
                if size > 2 << 20:
                    self._plain(texts, plain, out)
                    plain, size = [], 0
            elif t:
                other.append(k)
        if plain:
            self._plain(texts, plain, out)
        found = self.cache.values([self.units(texts[k].decode("utf-8", "replace")) for k in other], self.learn)
        for k, v in zip(other, found):
            out[k] = np.frombuffer(b"".join(v), np.uint32)
        return out

    def _plain(self, texts: list, which: list[int], out: list) -> None:
        p = PlainRuns([texts[k] for k in which])
        u, at, inverse = np.unique(p.hashes, return_index=True, return_inverse=True)
        rows = self.table.rows(p, u, at)[inverse]
        counts = self.table.counts[rows]
        ids = self.table.pool[ragged(self.table.places[rows], counts)]
        ends = np.r_[0, np.cumsum(counts)][p.first]
        for j, k in enumerate(which):
            out[k] = ids[ends[j] : ends[j + 1]]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The library's decode(ids, skip_special_tokens=False): bytes of the
        ids, malformed UTF-8 replaced."""
        return [b"".join(self.bytes_of(x[lo : lo + STEP_IDS]) for lo in range(0, len(x), STEP_IDS)).decode("utf-8", "replace") if len(x) else "" for x in ids]

    def bytes_of(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        return self.bytes[ragged(self.places[ids], sizes)].tobytes()


DOUBLE = re.compile(r"\s\s")
#: Ids whose bytes are gathered at once.
STEP_IDS = 1 << 18
#: Cut texts that a worker remembers, in each of two generations.
KNOWN_UNITS = 100_000


def load(path: str) -> ByteBpe:
    state = worker_state()
    if ("byte_bpe", path) not in state:
        state[("byte_bpe", path)] = ByteBpe(path)
    return state[("byte_bpe", path)]


def vocabulary_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: DDL of columns and the function of (ids, decoded texts) that makes them.
Finish = tuple[str, Callable[[list, list], list]]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", decoded: str | None = None, finish: Finish | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>) and, if ``decoded`` names a column, the text
    decoded from those ids. ``finish`` puts other columns in the place of
    both, computed in the same task, where ids and texts need not leave it.

    Null texts count as empty and have no ids. All other columns and repeated
    rows stay; an empty table gives no rows; an existing output column is a
    ``ValueError``. ``path`` must exist on the executors; None takes the
    installed public file."""
    import pyarrow as pa

    ddl = finish[0] if finish else f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")
    made = [f.split()[0].strip("`") for f in ddl.split(",")]
    if {m.lower() for m in made} & {c.lower() for c in docs.columns}:
        raise ValueError("an output column exists already")
    t = fresh(docs, ["t"])["t"]
    own = docs.columns

    def arrays(found, texts):
        flat = pa.array(np.concatenate([*found, np.empty(0, np.uint32)]).view(np.int32))
        offsets = pa.array(np.cumsum([0] + [len(x) for x in found]).astype(np.int32))
        return [pa.ListArray.from_arrays(offsets, flat), *([pa.array(texts, pa.string())] if decoded else [])]

    columns = finish[1] if finish else arrays

    @lean
    def run(batches):
        bpe = load(path or vocabulary_path())
        for b in batches:
            at = b.schema.get_field_index(t)
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                found = bpe.encode(part.column(at).to_pylist())
                cols = [part.column(part.schema.get_field_index(c)) for c in own]
                yield pa.RecordBatch.from_arrays([*cols, *columns(found, bpe.decode(found) if decoded or finish else [])], names=[*own, *made])

    fields = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema])
    return docs.withColumn(t, F.col(text).cast("string").cast("binary")).mapInArrow(run, f"{fields}, {ddl}")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, finish: Finish | None = None) -> DataFrame:
    """doc_id, ids, decoded (or the columns of ``finish``) of every row.
    Repeated rows and null ids stay."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    return encode(narrow, path, decoded="decoded", finish=finish).drop("text")
