"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a word's prefix is fixed by one token: its last. What precedes that token is the
encoding of a shorter prefix. So distinct words go into a trie, and a walk from its root gives each
node the last token of the encoding of the path to it: the one token of the vocabulary that ends the
path, such that it and the last token of the prefix before it stay apart when they are encoded
together. Words that share a prefix share its nodes, so a prefix is encoded once. A word's ids are
read off from its node towards the root.

The rules are those of the tokenizer's own file: split, merges, added tokens, decoding.

Defined results: null and empty texts have no tokens; repeated rows are encoded each; texts and words
of any length are encoded whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rank of a merge that doesn't exist.
NEVER = 1 << 60
#: The deepest nodes of the trie.
DEEPEST = 256
#: The split pattern that byte-level pre-tokenizers of this kind use.
SPLIT = r"'(?:[stmd]|re|ve|ll)| ?(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the file: printable ones for themselves, the others for
    code points from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}


class Vocabulary:
    """What the file says: the bytes of each id, the rank of each merge, the added tokens."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is expected")
        flags = [f for f in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "byte_fallback") if model.get(f)]
        flags += [f for t in spec.get("added_tokens", []) for f in ("single_word", "lstrip", "rstrip") if t.get(f)]
        if flags:
            raise ValueError(f"what the file asks for is not made here: {sorted(set(flags))}")
        letters = byte_letters()
        raw = lambda token: bytes(letters[ch] for ch in token)
        self.id_of = {raw(token): i for token, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = {token: i for token, i in model["vocab"].items()}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges[ids[a], ids[b]] = rank
            self.parts.setdefault(ids[a + b], (ids[a], ids[b], rank))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.added.items()}
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        #: A trie of the tokens from their ends: at each node, byte -> (next node, token or -1).
        self.ends: list[dict[int, tuple[int, int]]] = [{}]
        for token, i in self.id_of.items():
            node = 0
            for k in range(len(token) - 1, -1, -1):
                down, old = self.ends[node].get(token[k], (0, -1))
                if not down:
                    down = len(self.ends)
                    self.ends.append({})
                self.ends[node][token[k]] = (down, i if k == 0 else old)
                node = down

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at the token's left (0) or right (1) edge while it is put together, from the
        byte up, each with the rank of the merge that makes it part of the next."""
        known = self.edges.get((token, side))
        if known is None:
            known = [(token, NEVER)]
            while (made := self.parts.get(known[-1][0])) is not None:
                known.append((made[side], made[2]))
            known = self.edges[token, side] = known[::-1]
        return known


class Trie:
    """Words' bytes and, at each node, the last token of the encoding of the path to it.

    Node 0 is the root. When the trie has grown to ``most`` nodes it is begun anew.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        self.v, self.most = vocabulary, most
        self.apart: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together gives just these two tokens again.

        Each token grows at the boundary from a byte to its whole, in steps of rising rank. They fail
        to stay apart if the two parts that meet there at some time merge before either grows on;
        of equal merges the left one comes first.
        """
        known = self.apart.get((a, b))
        if known is None:
            right, left = self.v.edge(a, 1), self.v.edge(b, 0)
            i = j = 0
            while True:
                (x, x_grows), (y, y_grows) = right[i], left[j]
                merged = self.v.merges.get((x, y), NEVER)
                if merged < x_grows and merged <= y_grows:
                    known = merged == NEVER
                    break
                if x_grows == y_grows == NEVER:
                    known = True
                    break
                if x_grows <= y_grows:
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= 1_000_000:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def insert(self, word: bytes) -> list[int]:
        """Walk down, making the nodes that are missing; the last token of each node on the path.

        Below ``DEEPEST`` no nodes are made: a path as long as that is hardly another word's prefix.
        """
        node, path = 0, []
        for depth, byte in enumerate(word, 1):
            down = self.child[node].get(byte) if node >= 0 else None
            if down is not None:
                token = self.last[down]
            else:
                token = self.ending(word, depth, path)
                if depth <= DEEPEST:
                    down = self.child[node][byte] = len(self.last)
                    self.child.append({})
                    self.last.append(token)
            node = -1 if down is None else down
            path.append(token)
        return path

    def ending(self, word: bytes, depth: int, path: list[int]) -> int:
        """The last token of the encoding of word[:depth]."""
        at, node, ends = depth, 0, self.v.ends
        found = []
        while at and (step := ends[node].get(word[at - 1])) is not None:
            at -= 1
            node, token = step
            if token >= 0:
                found.append((at, token))
        for start, token in reversed(found):
            if not start or self.stay_apart(path[start - 1], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, word: bytes) -> list[int]:
        if len(self.last) > self.most:
            self.clear()
        path, ids, at = self.insert(word), [], len(word)
        while at:
            ids.append(path[at - 1])
            at -= len(self.v.bytes_of[path[at - 1]])
        return ids[::-1]


class Codec:
    """Texts to ids and back. Distinct new words of a batch go into the trie in order, depth first."""

    def __init__(self, source: str, kept: int = 1_500_000):
        self.v = Vocabulary(source)
        self.trie = Trie(self.v)
        self.split = regex.compile(SPLIT)
        self.marks = regex.compile("|".join(regex.escape(t) for t in sorted(self.v.added, key=len, reverse=True))) if self.v.added else None
        #: Encodings of words met before, in two generations; a generation holds ``kept`` letters at most.
        self.kept, self.letters, self.known, self.older = kept, 0, {}, {}

    def pieces(self, text: str) -> list[str]:
        """Words in order; an added token stands as a word of its own, in a tuple."""
        if not self.marks or not any(t in text for t in self.v.added):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*self.split.findall(text[at : m.start()]), (m[0],)]
            at = m.end()
        return out + self.split.findall(text[at:])

    def learn(self, words: list) -> None:
        """Encodes distinct words in sorted order, which visits the trie depth first."""
        new = []
        for word in words:
            if isinstance(word, tuple):
                self.known[word] = np.array(self.v.added[word[0]], "<u4").tobytes()
            elif (old := self.older.get(word)) is not None:
                self.known[word] = old
            else:
                new.append((word.encode("utf-8", "surrogatepass"), word))
            self.letters += len(word)
        new.sort()
        for raw, word in new:
            self.known[word] = np.array(self.trie.encode(raw), "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        found = self.pieces(text or "")
        self.learn([w for w in set(found) if w not in self.known])
        ids = b"".join(map(self.known.__getitem__, found))
        if self.letters > self.kept:
            self.older, self.known, self.letters = self.known, {}, 0
        return ids

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def codec_of(source: str) -> Codec:
    """A worker process keeps its codec, and the words it knows, from task to task."""
    return Codec(source)


def coded_udf(source: str):
    @F.pandas_udf("n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = codec_of(source)
        for texts in batches:
            rows = []
            for text in texts:
                ids = codec.encode(text)
                back = codec.decode(ids).encode("utf-8", "surrogatepass")
                rows.append((len(ids) // 4, ids, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return coded


def encode(docs: DataFrame, tokenizer: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, and the ids themselves as
    little-endian 32-bit integers. ``tokenizer``: path of the tokenizer's file, read by the driver."""
    coded = coded_udf(Path(tokenizer).read_text(encoding="utf-8"))
    out = docs.select("doc_id", coded("text").alias("c"))
    return out.select("doc_id", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256", *(["c.ids"] if ids else []))
