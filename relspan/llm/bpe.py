"""Byte-level BPE over ragged numpy arrays, from a vocabulary file.

A file counts if its model is byte-level BPE with the usual splitting pattern,
without normalizer, prefix space or other post-processing; others are refused.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

#: The splitting pattern of byte-level BPE vocabularies of this kind, words first and without backtracking:
#: contractions start with an apostrophe, so trying them after words finds the same.
PATTERN = r""" ?\p{L}++|'(?:[stmd]|re|ve|ll)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""
#: How many code points behind a pre-token's end its end can depend on.
LOOKAHEAD = 3
NO_RANK = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class PairTable:
    """Maps pairs of symbol ids to ranks: open addressing in numpy arrays."""

    BITS = 19
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        size = 1 << self.BITS
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NO_RANK, np.int32)
        keys = (left.astype(np.int64) << 20) | right
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            placed = todo[free][first]
            self.keys[at], self.ranks[at] = keys[placed], placed
            left_over = np.ones(len(todo), bool)
            left_over[np.flatnonzero(free)[first]] = False
            todo, slot = todo[left_over], (slot[left_over] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 20) | right
        slot = self._slot(keys)
        found, at = self.keys[slot], slot
        out = np.where(found == keys, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Bpe:
    """One vocabulary: merging in numpy, special strings, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary ({', '.join(odd) or pre.get('type')})")
        added = spec.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that strip, normalize or want whole words")
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        back = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in added}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.byte_id = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges], np.int32), np.array([vocab[b] for _, b in merges], np.int32))
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.pretokens = regex.compile(PATTERN).findall

    def segments(self, text: str) -> list[tuple[str, int]]:
        """The text between special strings, each with the special id that follows it, or -1."""
        if self.split_special is None:
            return [(text, -1)]
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out.append((text[at : m.start()], self.special[m.group()]))
            at = m.end()
        return [*out, (text[at:], -1)]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and each word's count of ids.

        Rank-synchronous: in each step, every word that still has a known pair
        applies its own lowest-ranked pair at all its places, left to right.
        A pair that holds a new symbol ranks above the pair that made it, so
        this is the order of merging one pair at a time.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        rank = np.full(len(sym), NO_RANK, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(word[:-1] == word[1:], self.pairs(sym[:-1], sym[1:]), NO_RANK)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = lowest == NO_RANK
            if over.any():
                done.append((word[over], sym[over]))
                keep = ~over
                sym, word, rank, lowest = sym[keep], word[keep], rank[keep], lowest[keep]
                if not len(sym):
                    break
            hit = rank == lowest
            if (hit[1:] & hit[:-1]).any():  # x x x: every other place of a run
                at = np.flatnonzero(hit)
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - run) % 2 == 1]] = False
            sym[hit] = self.merged[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[1:] = ~hit[:-1]
            sym, word, rank, hit = sym[keep], word[keep], rank[keep], hit[keep]
            near = hit.copy()
            near[:-1] |= hit[1:]
            near = np.flatnonzero(near)
            inside = near[near + 1 < len(sym)]
            rank[near] = NO_RANK
            inside = inside[word[inside] == word[inside + 1]]
            rank[inside] = self.pairs(sym[inside], sym[inside + 1])
        if not done:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        at, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def resolve(name: str) -> Bpe:
    """A vocabulary by path, or by the name of a public file that each machine has."""
    return load(name if "/" in name else vocabulary_path(name))
