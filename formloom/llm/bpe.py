"""Byte-level BPE encoding and decoding with a given public vocabulary.

A text is cut at the special tokens, then into words by the vocabulary's pattern. A word keeps its parts and the ranks of
adjacent parts in two contiguous arrays; the smallest rank is looked up by scanning, its boundary goes, and the ranks on
both sides are refreshed. Words of similar length are rows of one matrix, so a step takes all of them together. Words have
numbers, and their ids lie in one flat array, from which a slice of texts is gathered at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from formloom.llm.common import give_back, read_table

# Fixed value: the pattern by which the vocabulary's tokenizer separates words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a worker remembers, and the bytes they have in all; half of them stay when either is full.
REMEMBERED, REMEMBERED_BYTES = 1 << 17, 4 << 20
#: Widths of the matrices in which words are merged, and the elements of one.
WIDTHS, ELEMENTS = (4, 8, 12, 16, 24, 40, 80, 200, 500, 1000), 1 << 19
#: Texts whose words are looked up together, and their characters at most.
SLICE, SLICE_CHARS = 256, 1 << 20
#: Bytes up to which a word's ranks are scanned. Scanning takes time quadratic in the length, so longer words take a heap.
LONG_WORD = WIDTHS[-1]
#: Characters from which a text's words are taken in parts of so many words, to keep memory bounded.
LONG_TEXT, WORDS_AT_ONCE = 2_000_000, 1 << 17
NO_RANK = (1 << 31) - 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself, or the next free one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of one vocabulary file: packed pairs of ids and their ranks, the id a rank gives, and the bytes of each id."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        of = byte_symbols()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            pieces[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.size = len(pieces)
        self.table = pa.array(pieces, pa.large_binary())
        self.decimals = pa.array([b"%d," % i for i in range(self.size)], pa.large_binary())
        self.id_of_byte = np.array([ids[c] for c, _ in sorted(of.items(), key=lambda x: x[1])], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.id_of_rank = np.array([ids[a + b] for a, b in merges], np.int32)
        self.rank_of_bytes = self._ranks_of(np.repeat(self.id_of_byte, 256), np.tile(self.id_of_byte, 256))
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = Words(self)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.rank_of[at], NO_RANK).astype(np.int32)

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        raw = np.frombuffer(b"".join(words), np.uint8)
        found, count = np.empty(len(raw), np.int32), np.zeros(len(words), np.int64)
        low = 0
        for width in WIDTHS:
            some = np.flatnonzero((size > low) & (size <= width))
            for k in range(0, len(some), max(1, ELEMENTS // width)):
                rows = some[k : k + max(1, ELEMENTS // width)]
                self._merge_rows(raw, rows, start[rows], size[rows], found, count)
            low = width
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            ids = self._merge_long(self.id_of_byte[raw[start[k] : start[k] + size[k]]].tolist())
            found[start[k] : start[k] + len(ids)], count[k] = ids, len(ids)
        return found[_ranges(start, count)], count

    def _merge_rows(self, raw: np.ndarray, place: np.ndarray, start: np.ndarray, size: np.ndarray, found: np.ndarray, count: np.ndarray) -> None:
        """Merges the words of one matrix. A row loses a part a step; one without a rank is done and leaves the matrix."""
        column = np.arange(size.max())
        inside = column < size[:, None]
        raw = raw[np.minimum(start[:, None] + column, len(raw) - 1)].astype(np.int32)
        parts = np.where(inside, self.id_of_byte[raw], -1)  # what is no part has no rank
        ranks = np.where(inside[:, 1:], self.rank_of_bytes[raw[:, :-1] << 8 | raw[:, 1:]], NO_RANK)
        while len(place):
            row = np.arange(len(place))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(place), np.int64)
            low = ranks[row, at] if ranks.shape[1] else np.full(len(place), NO_RANK)
            done = low == NO_RANK
            if done.any():
                held = parts[done] >= 0
                n = held.sum(axis=1)
                found[_ranges(start[done], n)], count[place[done]] = parts[done][held], n
                going = ~done
                parts, ranks, place, start, at, low = parts[going], ranks[going], place[going], start[going], at[going], low[going]
                if not len(place):
                    return
                row = np.arange(len(place))
            column = np.arange(parts.shape[1] - 1)
            parts[row, at] = self.id_of_rank[low]
            parts = np.where(column <= at[:, None], parts[:, :-1], parts[:, 1:])
            ranks = np.where(column[:-1] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for shift in (-1, 0):  # the ranks with the part before and after
                i = at + shift
                ok = np.flatnonzero((i >= 0) & (i < ranks.shape[1]))
                ranks[ok, i[ok]] = self._ranks_of(parts[ok, i[ok]], parts[ok, i[ok] + 1])

    @cached_property
    def ranks(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.rank_of.tolist()))

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges in the same order; a heap of (rank, place) finds the smallest, links skip deleted boundaries."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.id_of_rank[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (r := self.ranks.get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def _pieces(self, text: str) -> Iterator[list]:
        """The words of a text in lists; a special token is bytes."""
        for k, piece in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [piece.encode()]
            elif len(piece) < LONG_TEXT:
                yield self.split.findall(piece)
            else:
                found = (m[0] for m in self.split.finditer(piece))
                while part := list(islice(found, WORDS_AT_ONCE)):
                    yield part

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, and how many each has."""
        held, sizes, out, counts = [], [], [], []

        def flush() -> None:
            ids, n = self.words.look_up(held)
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *sizes])]
            out.append(ids)
            counts.extend(np.diff(ends).tolist())
            held.clear()
            sizes.clear()

        for text in texts:
            if len(text) < LONG_TEXT:
                n = len(held)
                for piece in self._pieces(text):
                    held.extend(piece)
                sizes.append(len(held) - n)
                continue
            flush()
            parts = [self.words.look_up(piece)[0] for piece in self._pieces(text)]
            out += parts
            counts.append(sum(map(len, parts)))
        flush()
        return np.concatenate(out), np.array(counts, np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size`` of all ranges one after another."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Words(dict):
    """Numbers of words; their ids lie one after another in ``flat``. Words that have come once go first when it is full."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.fresh: list = []
        self._hold([], np.empty(0, np.int32), np.empty(0, np.int64))

    def _hold(self, words: list, flat: np.ndarray, size: np.ndarray) -> None:
        self.clear()
        self.update(zip(words, range(len(words))))
        self.flat, self.size = flat, size
        self.start, self.uses = np.cumsum(size) - size, np.zeros(len(size), np.int64)

    def __missing__(self, word) -> int:
        self.fresh.append(word)
        self[word] = n = len(self)
        return n

    def look_up(self, words: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and how many each has."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self._learn()
        size = self.size[numbers]
        ids = self.flat[_ranges(self.start[numbers], size)]
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        if len(self) > REMEMBERED or self.flat.nbytes > REMEMBERED_BYTES:
            self._age()
        return ids, size

    def _learn(self) -> None:
        v = self.vocabulary
        flat, size = v.merge_all([w if isinstance(w, bytes) else w.encode() for w in self.fresh])
        special = [k for k, w in enumerate(self.fresh) if isinstance(w, bytes)]
        if special:
            ends = np.cumsum(size)
            parts = np.split(flat, ends[:-1])
            for k in special:
                parts[k] = np.array([v.special[self.fresh[k].decode()]], np.int32)
            flat, size = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        self.fresh = []
        self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        self.start, self.uses = np.cumsum(self.size) - self.size, np.concatenate([self.uses, np.zeros(len(size), np.int64)])

    def _age(self) -> None:
        often = np.flatnonzero(self.uses > 1)
        often = often[np.argsort(-self.uses[often], kind="stable")][: REMEMBERED // 2]
        often = np.sort(often[np.cumsum(self.size[often]) * 4 <= REMEMBERED_BYTES // 2])
        size = self.size[often]
        stay = np.zeros(len(self.size), bool)
        stay[often] = True
        words = [w for w, n in self.items() if stay[n]]  # a dict keeps the order of its numbers
        self._hold(words, self.flat[_ranges(self.start[often], size)], size)


@lru_cache(maxsize=1)
def _vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def encode_batch(v: Vocabulary, texts: list[str | None]) -> pa.Array:
    ids, size = v.encode_all([t or "" for t in texts])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids))


def _joined(table: pa.Array, flat: np.ndarray, ends: np.ndarray) -> Iterator[memoryview | bytes]:
    """The entries of ``table`` at ``flat``, joined between neighbouring ``ends``."""
    taken = table.take(pa.array(flat))
    data = (taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken).buffers()
    at = np.frombuffer(data[1], np.int64)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    whole = memoryview(data[2]) if data[2] is not None else b""
    for a, b in zip(at[ends[:-1]], at[ends[1:]]):
        yield whole[a:b]


def decode_batch(v: Vocabulary, ids: pa.Array) -> pa.Array:
    """Texts of id lists. Bytes that are no UTF-8 become U+FFFD; a null list gives an empty text, null or unknown ids give nothing."""
    flat, ends = _known(v, ids)
    return pa.array([bytes(x).decode("utf-8", "replace") for x in _joined(v.table, flat, ends)], pa.string())


def _known(v: Vocabulary, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of lists one after another and the ends of the lists, without null and unknown ids."""
    ends = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    known = (flat >= 0) & (flat < v.size)
    if not known.all():
        ends = np.concatenate([[0], np.cumsum(known)])[ends]
        flat = flat[known]
    return flat, ends


def _slices(texts: pa.Array) -> Iterator[slice]:
    """Slices of a batch with at most ``SLICE`` texts and about ``SLICE_CHARS`` characters."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_CHARS, side="right"))
        end = min(max(end, at + 1), at + SLICE, len(texts))
        yield slice(at, end)
        at = end


def token_batches(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of batches but the last, which is the text, with ``ids`` and ``decoded``, in small batches."""
    for batch in batches:
        for part in _slices(batch.column(batch.num_columns - 1)):
            rows = batch.slice(part.start, part.stop - part.start)
            ids = encode_batch(v, rows.column(rows.num_columns - 1).to_pylist())
            names = [*batch.schema.names[:-1], "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], ids, decode_batch(v, ids)], names)
        give_back()


def digest_batches(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``token_batches`` with counts and digests in place of ids and texts."""
    for batch in batches:
        ids, decoded = batch.column("ids"), batch.column("decoded")
        flat, ends = _known(v, ids)
        hashed = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(v.decimals, flat, ends)]
        columns = [pa.array(np.diff(ends)), pa.array(hashed), pa.array([hashlib.sha256(x).hexdigest() for x in decoded.cast(pa.binary()).to_pylist()])]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*batch.schema.names[:-2], "n_tokens", "ids_sha256", "decoded_sha256"])


TOKENS = [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]
DIGESTS = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


def _mapped(docs: DataFrame, keep: tuple[str, ...], path: str | None, new: list[StructField], *works: Callable) -> DataFrame:
    # One vocabulary, about 2 MB.
    shared = docs.sparkSession.sparkContext.broadcast(Path(path or default_vocabulary()).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for work in works:
            batches = work(v, batches)
        yield from batches

    rows = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *new]))


def tokenize(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` and ``decoded`` of every row of ``docs``; repeated rows are encoded each, other columns are ignored.

    ``path`` is a tokenizer file that the driver can read; its bytes go to the executors. Special tokens inside a text are
    found as such, as the library does by default. Null and empty texts have no ids and decode to an empty text; an empty
    table gives an empty result.
    """
    return _mapped(docs, keep, path, TOKENS, token_batches)


def digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The rows of ``tokenize`` with the number of ids and the digests of their decimal list and of the decoded text."""
    return _mapped(docs, keep, path, DIGESTS, token_batches, digest_batches)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
