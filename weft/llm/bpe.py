"""Operator 6: byte-level BPE encoding and decoding in linear time.

A token sequence is the result of the merges exactly if each token, and each pair of adjacent
tokens, is the result of merging its own bytes. So a piece is encoded left to right: take the
longest vocabulary entry that starts here (an Aho-Corasick automaton over bytes mapped to Latin-1
reports all of them in one pass), step to shorter ones while the pair with the token before is not
compatible, and go back one token when none is left. An end position from which the rest failed is
never tried again, so the work is linear in the piece. Compatibility of a pair is decided once, by
merging the few bytes of the two tokens, and memoised.

Texts are cut into pieces by the vocabulary's pattern. Where every space of a text stands before a
visible character, a piece never crosses into the next space-led chunk, so chunks are looked up in
a memo bounded in bytes; other texts are cut by the pattern as a whole. Both give the same ids.

Defined results: a null or empty text has no ids; text is encoded whole at any length; special
tokens are ordinary text; a repeated doc_id is one document, its smallest text; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.core import buffer, keyed, remembered, slices, tidied

#: Bytes that each memo (words, chunks, pairs) of a worker may take, as sized below. Words and chunks have two halves: a full
#: one becomes the old one, from which what is asked for again is taken over, and the old one before goes.
MEMO_BYTES = 96 << 20
#: Words and chunks of more characters are not remembered.
LONG = 100
#: Text bytes whose ids are held at a time; a longer text is alone.
BATCH_BYTES = 1 << 20
#: About what CPython takes for an entry: of a dictionary, for its key, and for the tuple of ids that it holds.
ENTRY, PAIR = 160, 190
NONE = 1 << 60


class Memo:
    """Ids of short texts, those used of late, in at most MEMO_BYTES."""

    def __init__(self):
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.room = MEMO_BYTES // 2

    def find(self, text: str) -> tuple[int, ...] | None:
        known = self.young.get(text)
        if known is None and (known := self.old.pop(text, None)) is not None:
            self.keep(text, known)
        return known

    def keep(self, text: str, ids: tuple[int, ...]) -> None:
        if len(text) > LONG:
            return
        self.room -= ENTRY + 2 * len(text) + 8 * len(ids)
        if self.room < 0:
            self.old, self.young, self.room = self.young, {}, MEMO_BYTES // 2
        self.young[text] = ids


class Codec:
    """Encoder and decoder for ranks of byte strings; ranks: {bytes: id}."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import ahocorasick
        import regex

        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.pieces = regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        self.unclean = re.compile(r" (?:\s|$)")
        self.find = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.find.add_word(token.decode("latin-1"), rank)
        self.find.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefix: dict[int, int | None] = {}
        self.words, self.chunks = Memo(), Memo()

    def merged(self, raw: bytes) -> list[int]:
        """Ids by plain merging, lowest rank first; for the few bytes of one or two tokens."""
        rank_of, parts = self.ranks.get, [raw[i : i + 1] for i in range(len(raw))]
        ranks = [rank_of(raw[i : i + 2], NONE) for i in range(len(raw) - 1)]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] + parts[i], NONE)
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay as they are when merged side by side; left -1: nothing before."""
        known = self.pairs.get((left, right))
        if known is None:
            known = self.merged(self.bytes_of.get(left, b"") + self.bytes_of[right]) == ([right] if left < 0 else [left, right])
            if len(self.pairs) * PAIR > MEMO_BYTES:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def shorter(self, token: int) -> int | None:
        """The longest other vocabulary entry that begins token."""
        if token not in self.prefix:
            raw = self.bytes_of[token]
            self.prefix[token] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), None)
        return self.prefix[token]

    def piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None and self.fits(-1, whole):
            return [whole]
        text, pairs, fits, length = raw.decode("latin-1"), self.pairs.get, self.fits, self.length
        ids, before, at = [], -1, 0
        for _, token in self.find.iter_long(text):
            known = pairs((before, token))
            if not (fits(before, token) if known is None else known):
                break
            ids.append(token)
            at += length[token]
            before = token
        else:
            return ids
        n, dead = len(raw), set()
        while at < n:
            if token is None:
                token = next(self.find.iter_long(text, at))[1]
            while token is not None:
                known = pairs((before, token))
                if (fits(before, token) if known is None else known) and at + length[token] not in dead:
                    break
                token = self.shorter(token)
            if token is not None:
                ids.append(token)
                at, before, token = at + length[token], token, None
                continue
            if not ids:
                raise ValueError("the vocabulary lacks single bytes")
            dead.add(at)
            token = ids.pop()
            at -= length[token]
            before = ids[-1] if ids else -1
        return ids

    def cut(self, text: str) -> list[str]:
        """All matches of the pattern."""
        if self.latin and (text.isascii() or max(text) < "\u0100"):
            return self.latin.findall(text)
        return self.pieces.findall(text, concurrent=False)

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one match of the pattern."""
        known = self.words.find(text)
        if known is None:
            known = tuple(self.piece(text.encode("utf-8", "surrogatepass")))
            self.words.keep(text, known)
        return known

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of text that no match crosses."""
        known = self.chunks.find(text)
        if known is None:
            known = tuple(chain.from_iterable(map(self.word, self.cut(text))))
            self.chunks.keep(text, known)
        return known

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.unclean.search(text):
            return list(chain.from_iterable(map(self.word, self.cut(text))))
        parts = text.split(" ")
        ids = list(self.chunk(parts[0]))
        extend, chunks, chunk = ids.extend, self.chunks.young.get, self.chunk
        for part in parts[1:]:
            part = " " + part
            extend(chunks(part) or chunk(part))
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def latin_pattern(pattern: str):
    """The pattern for texts below U+0100, for the faster standard module; None if it uses other classes than \\p{L} \\p{N} \\s \\S."""
    import re

    import regex

    rest = pattern
    for name in (r"\p{L}", r"\p{N}", r"\s", r"\S"):
        rest = rest.replace(name, "")
    if "\\" in rest:
        return None
    classes = {name: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(name, chr(c))) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((x for x in (r"\p{L}", r"\p{N}", r"\s", r"\S") if pattern.startswith(x, at)), pattern[at])
        if name == r"\S" and inside:
            return None
        inside = {"[": True, "]": False}.get(name, inside)
        out += name if len(name) == 1 else f"[^{classes[chr(92) + 's']}]" if name == r"\S" else classes[name] if inside else f"[{classes[name]}]"
        at += len(name)
    return re.compile(out)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the default public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int), one row per document. path: a vocabulary that each executor has.

    A task's codec goes with the task. Beside other operators an executor has more Python workers than cores, any of which may get
    the next task; if each kept its memos, they would stay under whatever runs later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(load_ranks(path), pattern)
        for batch in batches:
            for a, b in slices(buffer(batch.column(1))[1], BATCH_BYTES):
                part = batch.slice(a, b - a)
                counts, flat = np.zeros(b - a + 1, np.int32), array("i")
                for i, text in enumerate(part.column(1)):
                    flat.extend(codec.encode(text.as_py()))
                    counts[i + 1] = len(flat)
                ids = pa.ListArray.from_arrays(pa.array(counts), pa.array(np.frombuffer(flat, np.int32)))
                yield pa.record_batch([part.column(0), ids], ["doc_id", "ids"])

    return keyed(docs, "text").mapInArrow(tidied(run), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (binary) of encoded ids; the inverse of encode_documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in load_ranks(path).items()}
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text binary")


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode and hash each document where it is read; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = remembered(("bpe", path, pattern), lambda: Codec(load_ranks(path), pattern))
        name = codec.name_of.__getitem__
        for batch in batches:
            counts, hashed, decoded = [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py())
                counts.append(len(ids))
                hashed.append(hashlib.sha256(" ".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return keyed(docs, "text").mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: n_tokens, and digests of the ids and of the decoded bytes, of every whole text."""
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())
