"""Byte-level BPE: prefix-table encoding and decoding (op2) and heap-and-list token counting (op7).

Null texts count as empty: no tokens. Texts of any length are handled whole; repeated rows are
encoded each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Memo, claim, ship_code

#: Distinct pieces that one Python worker remembers in each of two generations.
PIECE_BOUND = 300_000
#: Token pairs whose validity one Python worker remembers in each of two generations.
PAIR_BOUND = 150_000


def piece_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with white space as Unicode defines it (this library's \\s also takes U+001C..U+001F)."""
    return regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Splits a text by the pattern. ASCII texts go through the standard library's faster engine, with the
    classes of the pattern written out for ASCII."""
    anything = piece_pattern(pattern).findall
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
    if r"\p" in plain:
        return anything
    ascii_only = re.compile(plain, re.ASCII).findall
    return lambda text: ascii_only(text) if text.isascii() else anything(text)


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


# ---------------------------------------------------------------- op2


class PrefixCoder:
    """Encodes by a table of last tokens: each prefix of a piece has one token that can end its encoding.

    A token fits behind another if merging their joined bytes by rank gives the two back; the
    encoding of a prefix ends with the one token that fits behind the last token of what precedes it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.numbers = list(range(len(self.tokens)))  # one object for each id, whatever remembers it
        self.longest = max(map(len, ranks), default=0)
        self.trie: dict = {}  # byte -> node; -1 -> the token that ends there
        for token, rank in ranks.items():
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.fits = Memo(self._fits, PAIR_BOUND)

    def _merged(self, data: bytes) -> list[bytes]:
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, key: int) -> bool:
        """key: (last token + 1) << 20 | token; 0 stands for the start of the piece."""
        before, token = (key >> 20) - 1, self.tokens[key & 0xFFFFF]
        if before < 0:
            return self._merged(token) == [token]
        return self._merged(self.tokens[before] + token) == [self.tokens[before], token]

    def extend(self, last: list[int], data: bytes) -> None:
        """Fill ``last`` (token + 1 by prefix length, last[0] = 0) from its end up to the whole of ``data``.

        Every place tries the tokens that begin there behind the last token of what precedes it.
        """
        fits, longest, n, known = self.fits, self.longest, len(data), len(last)
        last += [0] * (n + 1 - known)
        for start in range(max(0, known - longest), n):
            before = last[start] << 20
            if start and not before:
                break
            node, end = self.trie, start
            for byte in data[start : start + longest]:
                node = node.get(byte)
                if node is None:
                    break
                end += 1
                token = node.get(-1)
                if token is not None and end >= known and not last[end] and fits[before | token]:
                    last[end] = token + 1
        if n and not last[n]:
            raise ValueError("the vocabulary lacks a byte of the text")

    def read(self, last: list[int]) -> list[int]:
        """The ids that a filled table stands for."""
        out, at = [], len(last) - 1
        while at:
            out.append(self.numbers[last[at] - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece; a piece that is a token as it stands is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = [0]
        self.extend(last, data)
        return self.read(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The table of one piece, kept for exact appends and for encoding again near an edit."""

    def __init__(self, coder: PrefixCoder, data: bytes = b""):
        self.coder, self.data, self.last = coder, b"", [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.coder.extend(self.last, self.data)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` for data[start:end]; returns how many entries were computed anew.

        Entries up to ``start`` stay. Behind the edit, once as many entries as the longest token has
        bytes agree with the old table, all later ones do, and they are taken over.
        """
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, agreed, done = old[: start + 1], 0, 0
        while len(self.last) <= len(self.data):
            at = len(self.last)
            if agreed >= self.coder.longest:
                self.last += old[at - shift :]
                break
            self.coder.extend(self.last, self.data[:at])
            done += 1
            agreed = agreed + 1 if at - shift > end and old[at - shift] == self.last[at] else 0
        return done

    def ids(self) -> list[int]:
        whole = self.coder.ranks.get(self.data)
        return [whole] if whole is not None else self.coder.read(self.last)


class Codec:
    """Whole texts: split, each piece by PrefixCoder."""

    def __init__(self, raw: bytes, pattern: str):
        self.coder = PrefixCoder(parse_ranks(raw))
        self.split = splitter(pattern)
        self.pieces = Memo(lambda piece: tuple(self.coder.piece(piece.encode())), PIECE_BOUND)
        self.names = [str(i) for i in range(len(self.coder.tokens))]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in map(self.pieces.__getitem__, self.split(text)):
            out += ids
        return out


def codec(raw: bytes, pattern: str) -> Codec:
    return claim(("codec", hashlib.sha256(raw).digest(), pattern), lambda: Codec(raw, pattern))


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if ``with_ids``, ids array<int>. The rank file is read by the driver (a vocabulary is bounded) and sent along.
    """
    spark = df.sparkSession
    ship_code(spark)
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, pattern)
        names, decode = c.names.__getitem__, c.coder.decode
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                back = decode(ids)
                rows[0].append(len(ids))
                rows[1].append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                rows[2].append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    rows[3].append(ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
            made = [pa.array(x, k) for x, k in zip(rows[: 3 + with_ids], kinds)]
            cols = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=cols)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and decoded (binary) of each list of ids; a null list decodes to nothing."""
    spark = df.sparkSession
    ship_code(spark)
    with open(ranks_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(raw.value, pattern).coder.decode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or []) for x in batch.column(1)], pa.binary())], names=[id_col, "decoded"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, decoded binary")


# ---------------------------------------------------------------- op7


class HeapCounter:
    """Counts the tokens of a text under a merge list; no ids are made."""

    def __init__(self, raw: bytes, pattern: str):
        spec = json.loads(raw)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab.get(letters[b]) for b in range(256)]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left] << 20 | vocab[right]] = rank, vocab[left + right]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = splitter(pattern)
        self.pieces = Memo(self.piece, PIECE_BOUND)

    def piece(self, piece: str) -> int:
        """Tokens of one piece: its bytes less the merges done, always the lowest-ranked adjacent pair next.

        Symbols are a doubly linked list over byte positions. An entry of the heap counts only while
        both of its symbols are those that it was made for.
        """
        symbols = [s for s in map(self.first.__getitem__, piece.encode()) if s is not None]
        n = len(symbols)
        if n < 2:
            return n
        merges, left, right = self.merges, list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = merges.get(symbols[i] << 20 | symbols[i + 1])
            if found:
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            done += 1
            symbols[i], symbols[j] = new, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                found = merges.get(new << 20 | symbols[k])
                if found:
                    heapq.heappush(heap, (found[0], i, new, symbols[k], found[1]))
            h = left[i]
            if h >= 0:
                found = merges.get(symbols[h] << 20 | new)
                if found:
                    heapq.heappush(heap, (found[0], h, symbols[h], new, found[1]))
        return n - done

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.pieces.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.pieces.__getitem__, self.split(p))) for p in parts)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def counter(raw: bytes, pattern: str) -> HeapCounter:
    return claim(("counter", hashlib.sha256(raw).digest(), pattern), lambda: HeapCounter(raw, pattern))


def count_tokens(df: DataFrame, model_path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""
    spark = df.sparkSession
    ship_code(spark)
    with open(model_path, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(raw.value, pattern)
        for batch in batches:
            sizes, counts = [], []
            for scalar in batch.column(1):
                text = scalar.as_py() or ""
                sizes.append(len(text) if text.isascii() else len(text.encode()))
                counts.append(c.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
