"""BPE encoding and decoding in batched numpy merge rounds.

For tokenizer files with the parts of word_bpe_49k.json: normalisation NFC, white space to one space, lower
case; a split pattern whose matches are the pieces; pieces as byte-level symbols, the last one with a word
end; merges by rank; special tokens found in the raw text.

A text is cut at white space, which no piece crosses, and the result of each such chunk is kept in a bounded
table of the worker. New chunks of a batch are encoded together: the symbols of all their pieces stand in one
flat array. Each round looks up all neighbouring pairs by binary search over the sorted pair keys, finds the
lowest rank of each piece, and merges it, until no piece has a pair left. All places of that lowest rank are
merged at once where no merge of a lower rank can come of it; else the leftmost only, which is the order of
one merge at a time. A piece of over LONG_PIECE characters is merged by itself: its places are kept by rank and linked to their neighbours,
so that a round touches only the places that it merges.

Defined cases: a null text counts as empty and has no tokens (n_tokens 0, both digests of the empty string);
texts of any length are encoded whole; an empty table gives no rows; pairs of equal rank are merged from the left;
null ids stay; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import common

#: Chunks that a worker remembers, and the longest one that it does; characters from which a piece is merged by itself.
REMEMBERED, LONGEST, LONG_PIECE = 400_000, 64, 2000

#: Lower case of letters that are newer than Python's tables: first, last, distance.
NEWER_RUNS = ((0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27))
NEWER_LOWER = {c: c + far for first, last, far in NEWER_RUNS for c in range(first, last + 1)}
_NEWER = regex.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")

#: First and last of runs of letters and numbers that the regex module knows and the library, with older tables, doesn't.
UNKNOWN_RUNS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
_UNKNOWN = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN_RUNS) + "]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], regex.V0)
        shown = byte_symbols()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + end] for c in shown], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(vocab.values()) + 1
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left * self.width + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order, made
        soonest = np.full(self.width, len(pairs))
        np.minimum.at(soonest, left, np.arange(len(pairs)))
        np.minimum.at(soonest, right, np.arange(len(pairs)))
        self.at_once = soonest[made] > np.arange(len(pairs))
        self.id_text = [str(i) for i in range(self.width)]
        self.token_text = [self.tokens.get(i, "") for i in range(self.width)]
        # Of pieces and of chunks: ids and tokens, space-joined.
        self.pieces_known: dict[str, tuple[str, str]] = {}
        self.ids_known: dict[str, str] = {}
        self.tokens_known: dict[str, str] = {}

    def normalize(self, text: str) -> str:
        """NFC, white space to a space, lower case character by character."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if _NEWER.search(text):
                text = text.translate(NEWER_LOWER)
        return text.lower()

    def cut(self, chunk: str) -> list[str]:
        """Pieces of a chunk. Characters that the library doesn't know are neither letters nor numbers."""
        if chunk.isascii() or not _UNKNOWN.search(chunk):
            return self.pieces.findall(chunk)
        return [chunk[m.start() : m.end()] for m in self.pieces.finditer(_UNKNOWN.sub("\ue000", chunk))]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, and the bounds of each piece in it."""
        size = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym, owner = self.inner[raw], np.repeat(np.arange(len(pieces)), size)
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        done_sym, done_owner, none = [], [], len(self.made)
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), count)
            live = best < none
            if not live.all():
                done_sym.append(sym[~live])
                done_owner.append(owner[~live])
                sym, owner, rank, best = sym[live], owner[live], rank[live], best[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            # Of overlapping places of one pair every other one; of ranks that must go one by one the first of a piece.
            new = np.append(True, np.diff(hit) != 1)
            within = np.arange(len(hit)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            first = np.append(True, owner[hit][1:] != owner[hit][:-1])
            hit = hit[np.where(self.at_once[rank[hit]], within % 2 == 0, first)]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, owner = sym[keep], owner[keep]
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        sym = sym[np.argsort(owner, kind="stable")]
        return sym, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(pieces)))])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece: rounds that touch only the places of the lowest rank, kept by rank, and their neighbours.

        A round takes all places of its rank, or the first one where what it makes may be merged sooner; the array is never
        gone through again, so time is nearly in proportion to the piece.
        """
        raw = np.frombuffer(piece, np.uint8)
        sym, n, none = self.inner[raw], len(raw), len(self.made)
        sym[-1] = self.last[raw[-1]]
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)

        def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left * self.width + right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return np.where(self.keys[at] == key, self.ranks[at], none)

        rank = np.append(ranks(sym[:-1], sym[1:]), none)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            own = rank[at]
            at, own = at[own < none], own[own < none]
            if not len(at):
                return
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            bounds = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist()
            for lo, hi, r in zip(bounds, [*bounds[1:], len(at)], own[bounds].tolist(), strict=True):
                if r not in places:
                    heapq.heappush(heap, r)
                places.setdefault(r, []).append(at[lo:hi])

        put(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.at_once[r]:
                # Of overlapping places every other one.
                new = np.append(True, after[at[:-1]] != at[1:])
                within = np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                at = at[within % 2 == 0]
            elif len(at) > 1:
                places[r] = [at[1:]]
                heapq.heappush(heap, r)
                at = at[:1]
            gone = after[at]
            beyond = after[gone]
            sym[at], after[at], alive[gone], rank[gone] = self.made[r], beyond, False, none
            before[beyond[beyond < n]] = at[beyond < n]
            left = before[at]
            changed = np.unique(np.concatenate([at, left[left >= 0]]))
            right = after[changed]
            rank[changed] = np.where(right < n, ranks(sym[changed], sym[np.minimum(right, n - 1)]), none)
            put(changed)
        return sym[alive]

    def learn(self, chunks: list[str]) -> None:
        """Finds ids and tokens of new chunks, by way of those of their new pieces."""
        cut = [self.cut(c) for c in chunks]
        fresh = list({p for pieces in cut for p in pieces if p not in self.pieces_known})
        long = [p for p in fresh if len(p) > LONG_PIECE]
        fresh = [p for p in fresh if len(p) <= LONG_PIECE]
        for p in long:
            sym = self.merge_long(p.encode("utf-8")).tolist()
            self.pieces_known[p] = " ".join([self.id_text[i] for i in sym]), " ".join([self.token_text[i] for i in sym])
        if fresh:
            sym, bounds = self.merge([p.encode("utf-8") for p in fresh])
            sym, bounds = sym.tolist(), bounds.tolist()
            ids, tokens = [self.id_text[i] for i in sym], [self.token_text[i] for i in sym]
            for p, a, b in zip(fresh, bounds, bounds[1:], strict=False):
                self.pieces_known[p] = " ".join(ids[a:b]), " ".join(tokens[a:b])
        for c, pieces in zip(chunks, cut, strict=True):
            got = [self.pieces_known[p] for p in pieces]
            self.ids_known[c], self.tokens_known[c] = " ".join([x[0] for x in got]), " ".join([x[1] for x in got])

    def chunks(self, text: str) -> list[str]:
        """The text's chunks in order; special tokens, which normalised chunks can't be, stand for themselves."""
        if "<" not in text or not self.raw.search(text):
            return split(self.normalize(text))
        out, at = [], 0
        for m in self.raw.finditer(text):
            out += [*split(self.normalize(text[at : m.start()])), _SPECIAL + m[0]]
            at = m.end()
        return out + split(self.normalize(text[at:]))

    def encode_batch(self, texts: list[str], remembered: int | None = None) -> list[tuple[str, str]]:
        """For each text its ids, space-joined, and its decoded text (tokens joined by a space, as there is no decoder)."""
        if max(len(self.ids_known), len(self.pieces_known)) > (remembered or REMEMBERED):
            self.ids_known, self.tokens_known, self.pieces_known = {}, {}, {}
        for t, i in self.special.items():
            self.ids_known[_SPECIAL + t], self.tokens_known[_SPECIAL + t] = str(i), t
        cut = [self.chunks(t) for t in texts]
        fresh = list(set().union(*cut).difference(self.ids_known))
        for at in range(0, len(fresh), 20_000):
            self.learn(fresh[at : at + 20_000])
        ids, tokens = self.ids_known.__getitem__, self.tokens_known.__getitem__
        out = [(" ".join(map(ids, chunks)), " ".join(map(tokens, chunks))) for chunks in cut]
        for c in fresh:
            if len(c) > LONGEST:
                del self.ids_known[c], self.tokens_known[c]
                for p in self.cut(c):
                    if len(p) > LONGEST:
                        self.pieces_known.pop(p, None)
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space; special tokens stay."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def split(text: str) -> list[str]:
    """Runs of other characters than the tokenizer's white space, which leaves out the four ASCII separators that str.split takes."""
    if any(map(text.__contains__, "\x1c\x1d\x1e\x1f")):
        return [x for x in _SPACE.split(text) if x]
    return text.split()


#: Marks a special token among chunks; white space, so no chunk begins with it.
_SPECIAL = " "
_SPACE = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and the text that they decode to."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = load(path).encode_batch([x.as_py() or "" for x in b.column(1)])
        ids = pa.array([[int(i) for i in x.split()] for x, _ in got], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([b.column(0), ids, pa.array([d for _, d in got])], names=["doc_id", "ids", "decoded"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, path: str, remembered: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. remembered bounds the chunks that a worker keeps; fewer take less memory and more time."""

    def sha(x: str) -> str:
        return hashlib.sha256(x.encode("utf-8")).hexdigest()

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        got = load(path).encode_batch([x.as_py() or "" for x in b.column(1)], remembered)
        n = [x.count(" ") + 1 if x else 0 for x, _ in got]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([sha(x) for x, _ in got]), pa.array([sha(d) for _, d in got])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
