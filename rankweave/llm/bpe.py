"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a string's prefix ends in one certain token, and that token together with the
encoding of what stands before it is the prefix's encoding. So the distinct words of a block of
texts go into a trie; a depth-first walk gives each node the last token of its prefix (the one token
that ends there and follows the last token of the node where it starts), and a word's ids are read
off by stepping back from its last node. Words with a common prefix share the nodes, and so the work.

Spark deals out the texts; a task works through its batches in blocks of bounded size, and keeps the
ids of words it has met in a table of bounded size (a miss only costs time).

Null and empty texts have no tokens (null decodes to the empty text). Whole texts of any length are
encoded. Repeated rows each come back. An empty table gives an empty result. Only doc_id and the text
column are read; `carry` names columns to pass through.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rankweave.llm.memory import give_back

#: The pattern that cuts texts into words, as the vocabulary's authors publish it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern in the standard library's faster matcher, for texts of characters that both class alike.
_PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_COMPARED = 0x3000
BLOCK_CHARS = 1 << 20
KEPT_WORDS = 120_000
KEPT_PAIRS = 250_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, and its byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _unlike() -> re.Pattern:
    """A character that the two patterns may class differently: found by asking both, or not compared."""
    kinds = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    compared = "".join(c for c in map(chr, range(_COMPARED)))
    apart: set[str] = set()
    for exact, plain in kinds:
        apart |= set(regex.findall(exact, compared)) ^ set(re.findall(plain, compared))
    return re.compile("[" + "".join(map(re.escape, sorted(apart))) + f"{chr(_COMPARED)}-\U0010ffff]")


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        vocab = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = {v: k for k, v in vocab.items()} | {v: k.encode() for k, v in self.special.items()}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words, self.plain_words, self.unlike = regex.compile(WORD_PATTERN), re.compile(_PLAIN_PATTERN), _unlike()
        self.numbers = {v: str(v) for v in self.token_bytes}
        # Merges, by the ids of their halves: rank and the id of the whole.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: The rank of the merge that makes a token, below 0 for bytes, and the tokens it joins.
        self.made: dict[int, int] = dict.fromkeys(self.single, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        for (left, right), (rank, whole) in self.merges.items():
            # Tokens that merging their own bytes doesn't lead to are never met.
            if whole not in self.made and left in self.made and right in self.made and self._stay_apart(left, right, rank):
                self.made[whole], self.halves[whole] = rank, (left, right)
        self._build_matcher([(self.token_bytes[number], number) for number in self.made])
        self.pairs: dict[int, bool] = {}
        self.ids_of: dict[str, bytes] = {}  # ids as packed 32-bit numbers
        self.old_ids_of: dict[str, bytes] = {}

    def _stay_apart(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether merging the bytes of two tokens joins nothing across their border by a merge of a rank
        below `limit`. Goes back in time: the merge done last, of equal ones that further right, is
        undone on its side of the border, and what lies at the border then must not have been joined before it."""
        made = self.made
        while True:
            across = self.merges.get((left, right))
            if across is not None and across[0] < limit:
                return False
            own, other = made[left], made[right]
            if own > other:
                limit, left = own, self.halves[left][1]
            elif other >= 0:
                limit, right = other + 1, self.halves[right][0]
            else:
                return True

    def _build_matcher(self, tokens: list[tuple[bytes, int]]) -> None:
        """A suffix automaton over the tokens that encodings can hold: for each state the tokens that
        end there as (id, length), longest first, and the state of its longest proper suffix."""
        self.step: dict[int, int] = {}
        ending: list[tuple[tuple[int, int], ...]] = [()]
        back, parent = [0], [(0, 0)]
        for token, number in tokens:
            state = 0
            for byte in token:
                key = state << 8 | byte
                if (to := self.step.get(key)) is None:
                    to = self.step[key] = len(ending)
                    ending.append(())
                    back.append(0)
                    parent.append((state, byte))
                state = to
            ending[state] = ((number, len(token)),)
        depth = [0] * len(ending)
        for state in range(1, len(ending)):
            depth[state] = depth[parent[state][0]] + 1
        self.ending, self.back = ending, back
        for state in sorted(range(1, len(ending)), key=depth.__getitem__):
            above, byte = parent[state]
            back[state] = self._next(back[above], byte) if above else 0
            ending[state] += ending[back[state]]

    def _next(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        if (to := self.step.get(key)) is None:
            to = self._next(self.back[state], byte) if state else 0
            if len(self.step) < KEPT_PAIRS:
                self.step[key] = to
        return to

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just these two tokens."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 20 | right] = self._stay_apart(left, right)
        return known

    def encode_words(self, words: list[bytes]) -> Iterator[bytes]:
        """Packed ids of sorted distinct words. In sorted order the words are a trie laid out depth first: the
        walk holds the path from the root to the current node, steps back to the last node that the
        next word shares, and works out the last tokens of the new nodes only."""
        known, step, ending = self.pairs.get, self.step.get, self.ending
        size = max(map(len, words), default=0) + 1
        tokens, lengths, states = [-1] * size, [0] * size, [0] * size  # by depth, along the current path
        last = b""
        for word in words:
            shared = 0
            for x, y in zip(last, word, strict=False):
                if x != y:
                    break
                shared += 1
            last, state = word, states[shared]
            for depth, byte in enumerate(word[shared:], shared + 1):
                to = step(state << 8 | byte)
                state = self._next(state, byte) if to is None else to
                for token, length in ending[state]:
                    if length == depth:
                        break
                    left = tokens[depth - length]
                    fits = known(left << 20 | token)
                    if fits or fits is None and self._follows(left, token):
                        break
                else:
                    raise AssertionError("a prefix without an encoding")
                tokens[depth], lengths[depth], states[depth] = token, length, state
            at, ids = len(word), []
            while at:
                ids.append(tokens[at])
                at -= lengths[at]
            ids.reverse()
            yield array("i", ids).tobytes()

    def _pieces(self, text: str) -> list[str]:
        words = self.words if self.unlike.search(text) else self.plain_words
        if self.special_cut is None or not any(s in text for s in self.special):
            return words.findall(text)
        parts = self.special_cut.split(text)
        return list(chain.from_iterable([p] if k % 2 else words.findall(p) for k, p in enumerate(parts)))

    def learn(self, pieces: list[list[str]]) -> None:
        """Puts the ids of all words of a block into the table of known words. A full table becomes the old one, from
        which words that are met again come back; the others go with the next change."""
        if len(self.ids_of) >= KEPT_WORDS:
            self.ids_of, self.old_ids_of = {}, self.ids_of
        new = set().union(*pieces) - self.ids_of.keys()
        again = new & self.old_ids_of.keys()
        self.ids_of.update(zip(again, map(self.old_ids_of.__getitem__, again), strict=True))
        new -= again
        for special in new & self.special.keys():
            self.ids_of[special] = array("i", [self.special[special]]).tobytes()
            new.discard(special)
        ordered = sorted((w.encode("utf-8", "surrogatepass"), w) for w in new)
        self.ids_of.update(zip((w for _, w in ordered), self.encode_words([b for b, _ in ordered]), strict=True))

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces = [self._pieces(t) for t in texts]
        self.learn(pieces)
        return [np.frombuffer(b"".join(map(self.ids_of.__getitem__, words)), dtype=np.int32) for words in pieces]

    def digest(self, ids: list[int]) -> str:
        """SHA-256 of decimal ids joined by commas."""
        return hashlib.sha256(",".join(map(self.numbers.__getitem__, ids)).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def _encoder(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in blocks; only a block's are Python strings at a time."""
    block, chars = [], 0
    for text in texts:
        block.append(text.as_py() or "")
        chars += len(block[-1])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _id_lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """doc_id, the carried columns and ids (array<int>) of each row."""
    kept = ["doc_id", *carry]
    picked = docs.select(*kept, docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text") + ", ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for batch in batches:
            first = 0
            for block in _blocks(batch.column("__text")):
                part = batch.slice(first, len(block))
                first += len(block)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _id_lists(bpe.encode_block(block))], names=[*kept, "ids"])

    return picked.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns and text, from ids; null ids are no ids."""
    kept = ["doc_id", *carry]
    picked = encoded.select(*kept, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "ids") + ", text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array((bpe.decode(x.as_py() or []) for x in batch.column("ids")), pa.string())], names=[*kept, "text"])

    return picked.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, carry: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """The carried columns and n_tokens, ids_sha256, decoded_sha256 (and ids) of each row: encode, then
    decode from the ids, in one pass over the texts."""
    kept = ["doc_id", *carry]
    picked = docs.select(*kept, docs["text"].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text") + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(path)
        for batch in batches:
            first = 0
            for block in _blocks(batch.column("__text")):
                part = batch.slice(first, len(block))
                first += len(block)
                ids = bpe.encode_block(block)
                digests = []
                for own in ids:
                    numbers = own.tolist()
                    digests.append((bpe.digest(numbers), hashlib.sha256(bpe.decode(numbers).encode()).hexdigest()))
                columns = {
                    "n_tokens": pa.array(map(len, ids), pa.int64()),
                    "ids_sha256": pa.array((x for x, _ in digests), pa.string()),
                    "decoded_sha256": pa.array((x for _, x in digests), pa.string()),
                } | ({"ids": _id_lists(ids)} if with_ids else {})
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns.values()], names=[*kept, *columns])
        bpe.ids_of.clear()  # the worker stays for other stages
        bpe.old_ids_of.clear()
        bpe.pairs.clear()
        give_back()

    return picked.mapInArrow(run, schema)
