"""Token ids of every document in a public byte-level BPE vocabulary (problem 6).

Words are cut by the vocabulary's pattern.  Within a word, bytes stand as Latin-1 characters,
so that a trie over the vocabulary gives the longest token at any place; the encoder goes
from longest match to longest match and steps back where two neighbours could not have
come out of the merges side by side.  Whether a pair of tokens can is decided by undoing
their merges and is remembered.  Every place of a word is visited a bounded number of times,
so a word of any length takes linear time, and the ids are exactly those of the merges.
(Backtracking over compatible pairs is published with the Rust crate ``bpe``.)

The vocabulary is read once on the driver from a path that is a parameter, and broadcast:
its size is that of the vocabulary, about 1 MB for 50,000 tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64 << 20
#: Words and pairs a worker remembers.
WORDS, PAIRS = 300_000, 1_000_000

#: Fixed value: the pattern that cuts texts into words before merging, of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file (a line per token: base64 of its bytes, its rank), checked for its size."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return data


class Encoder:
    """Exact encoder for one vocabulary whose ids are the ranks of its merges."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ids = {}
        for line in vocabulary.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ids[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.text = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.trie = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.trie.add_word(t, i)
        self.cut = regex.compile(pattern).findall
        self.words: dict[str, list[int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for t in sorted(self.ids, key=self.ids.get):
            self.parts[self.ids[t]] = self._split(t)
        self.merged = {p: i for i, p in self.parts.items() if p[0] != p[1] or len(self.text[i]) > 1}

    def _split(self, t: str) -> tuple[int, int]:
        """The two tokens whose merge makes ``t``; twice itself for single bytes.

        Merges ``t`` by the ranks below its own until two parts are left."""
        i, parts = self.ids[t], list(t)
        while len(parts) > 2:
            rank, at = min((self.ids.get(a + b, i), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= i:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else (i, i)

    def _can_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: undoes the younger of the two merges step by
        step and looks for a pair that would have merged across the border before."""
        key = (a, b)
        known = self.compatible.get(key)
        if known is not None:
            return known
        limit, fits = 1 << 62, True
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                fits = False
                break
            if a > b:
                limit = a
                a = self.parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.parts[b][0]
                    if b + 1 == limit:
                        break
            else:
                limit = b + 1
                b = self.parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.parts[a][1]
                    if a == limit:
                        break
        if len(self.compatible) >= PAIRS:
            self.compatible.clear()
        self.compatible[key] = fits
        return fits

    def _match(self, s: str, at: int, most: int) -> int:
        """The longest token of at most ``most`` bytes at a place."""
        piece = s[at : at + min(most, self.longest)]
        n = self.trie.longest_prefix(piece)
        while piece[:n] not in self.ids:
            n -= 1
        return self.ids[piece[:n]]

    def _shorter(self, token: int) -> int | None:
        """The longest token that is a true beginning of ``token``."""
        if token not in self.shorter:
            t = self.text[token]
            self.shorter[token] = self._match(t, 0, len(t) - 1) if len(t) > 1 else -1
        return self.shorter[token]

    def encode_word(self, s: str) -> list[int]:
        """Ids of one word, given as Latin-1 characters of its bytes."""
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        open_at = bytearray(b"\1") * (len(s) + 1)  # places not yet found to lead nowhere
        out: list[int] = []
        at, token = 0, self._match(s, 0, len(s))
        while True:
            end = at + len(self.text[token])
            if open_at[end] and (not out or self._can_follow(out[-1], token)):
                out.append(token)
                at = end
                if at == len(s):
                    return out
                token = self._match(s, at, len(s) - at)
                continue
            short = self._shorter(token)
            if short >= 0:
                token = short
                continue
            open_at[at] = 0
            token = out.pop()
            at -= len(self.text[token])

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; none for null and empty texts."""
        out: list[int] = []
        known = self.words
        for w in self.cut(text or ""):
            ids = known.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8").decode("latin-1"))
                if len(w) <= 64:
                    if len(known) >= WORDS:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encode(shared, pattern):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((shared.value, pattern))
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value, pattern)
        encode = _encoders[key].encode
        for b in batches:
            ids = [encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def token_ids(documents: DataFrame, path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids array<int>`` of every row of ``documents(doc_id, text)``.

    Null and empty texts give an empty list, blank texts are encoded as they are; strings of
    special tokens are ordinary text.  Rows are neither dropped nor joined: repeated ids come
    out repeated, a null id stays null.  Texts are encoded whole; an empty table gives no rows; extra columns are
    ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(_encode(shared, pattern), "doc_id bigint, ids array<int>")
