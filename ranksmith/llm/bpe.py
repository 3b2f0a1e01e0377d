"""BPE encoding and decoding (byte-level vocabularies).

Encoding splits a text into pre-tokens and merges each pre-token's symbols: a
priority queue holds the merge ranks of neighbouring symbols, which form a
doubly linked list; entries whose pair has changed meanwhile are stale and
skipped.  Decoding concatenates the vocabulary's strings.

Ids equal those of the ``tokenizers`` library for the same file with
``add_special_tokens=False`` and its default handling of special strings (a
special token's string inside a text becomes its id); decoded texts equal
``decode(ids, skip_special_tokens=False)``.

Defined results: a null text is an empty one; an empty text has no ids and
decodes to the empty string; texts are encoded whole whatever their length; a
null id list decodes to the empty string.  Each row is handled on its own, so
repeated rows and ties need no rule.  Input columns other than those named are
kept; a result column replaces an input column of the same name.
"""

from __future__ import annotations

import gc
import json
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCache, map_texts, per_worker

#: The pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 characters stand for themselves, the other bytes take
    the code points from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and spec.get("normalizer") is None
                 and not model.get("ignore_merges") and not model.get("dropout")
                 and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"))
        if not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        #: left id -> {right id: merge rank}; by rank: the id that the merge makes.
        self.ranks: list[dict[int, int]] = [{}] * (1 + max(vocab.values()))
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.made.append(vocab[a + b])
            if not (right := self.ranks[vocab[a]]):
                right = self.ranks[vocab[a]] = {}
            right.setdefault(vocab[b], rank)
        added = spec.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: added tokens with word or strip rules")
        self.strings = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for token, i in vocab.items():
            self.strings[i] = as_bytes(token)
        self.added = {}
        for t in added:
            self.added[t["content"]] = array("I", [t["id"]]).tobytes()
            self.strings[t["id"]] = t["content"].encode()
        self.added_pattern = (regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None)
        self.pre_token, self.double_space = regex.compile(PRE_TOKEN), regex.compile(r"\s\s")
        self.pieces = WordCache(self.merge)
        self.segments = WordCache(self._segment, 40 << 20)

    def merge(self, piece: str) -> bytes:
        """Ids of one pre-token, packed as little-endian unsigned 32-bit integers."""
        first, ranks, made = self.first, self.ranks, self.made
        ids = [first[b] for b in piece.encode()]
        n = len(ids)
        # rank of the pair that starts at each symbol; None: none
        now = [ranks[a].get(b) for a, b in zip(ids, ids[1:])]
        now.append(None)
        shift = 13 if n < 8192 else 40
        low = (1 << shift) - 1
        queue = [r << shift | i for i, r in enumerate(now) if r is not None]
        if not queue:
            return array("I", ids).tobytes()
        heapify(queue)
        before, after = list(range(-1, n)), list(range(1, n + 1))
        while queue:
            entry = heappop(queue)
            i = entry & low
            rank = entry >> shift
            if now[i] != rank:
                continue  # stale: the pair changed or its symbol was merged away
            j = after[i]
            k = after[i] = after[j]
            before[k] = i
            new = ids[i] = made[rank]
            ids[j] = now[j] = None
            if k < n:
                r = now[i] = ranks[new].get(ids[k])
                if r is not None:
                    heappush(queue, r << shift | i)
            else:
                now[i] = None
            h = before[i]
            if h >= 0:
                r = now[h] = ranks[ids[h]].get(new)
                if r is not None:
                    heappush(queue, r << shift | h)
        return array("I", [i for i in ids if i is not None]).tobytes()

    def _segment(self, segment: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pre_token.findall(segment)))

    def _ordinary(self, text: str) -> bytes:
        if self.double_space.search(text):
            return self._segment(text)
        # A pre-token never crosses a single space between other characters.
        head, *rest = text.split(" ")
        look = self.segments.__getitem__
        out = [look(" " + s) for s in rest]
        return (look(head) if head else b"") + b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.added_pattern and self.added_pattern.search(text):
            return b"".join(self.added.get(s) or self._ordinary(s) for s in self.added_pattern.split(text) if s)
        return self._ordinary(text) if text else b""

    def decode(self, packed: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become U+FFFD."""
        joined = b"".join(map(self.strings.__getitem__, np.frombuffer(packed, "<u4").tolist()))
        return joined if joined.isascii() else joined.decode("utf-8", "replace").encode()


def _codec(path: str) -> ByteBPE:
    def load() -> ByteBPE:
        codec = ByteBPE(path)
        gc.freeze()  # the tables live as long as the worker
        return codec
    return per_worker("words", path, load)


def n_ids(packed: str) -> Column:
    return (F.octet_length(F.coalesce(F.col(packed), F.lit(b""))) / 4).cast("long")


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``: the ids as packed little-endian unsigned 32-bit integers,
    the form in which token files store them."""
    return _with(df, text, lambda codec, t: [codec.encode(t.decode("utf-8", "replace"))], [(out, T.BinaryType())], path)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``: the text of packed ids."""
    return _with(df, ids, lambda codec, p: [codec.decode(p).decode()], [(out, T.StringType())], path)


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids, in one pass over the texts."""
    def both(codec, t):
        packed = codec.encode(t.decode("utf-8", "replace"))
        return [packed, codec.decode(packed).decode()]
    return _with(df, text, both, [(ids, T.BinaryType()), (decoded, T.StringType())], path)


def _with(df: DataFrame, column: str, each, made: list[tuple], path: str) -> DataFrame:
    def make_kernel():
        codec = _codec(path)

        def kernel(values: list) -> list:
            rows = [each(codec, v or b"") for v in values]
            return [[r[i] for r in rows] for i in range(len(made))]
        return kernel

    new = {n for n, _ in made}
    keep = [c for c in df.columns if c not in new and c != column]
    return map_texts(df, column, make_kernel, [T.StructField(n, t) for n, t in made], keep)
