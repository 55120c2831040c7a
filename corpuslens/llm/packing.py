"""Packing by power-of-two decomposition.

A document of T tokens (its ids and one end id) is cut into pieces by the binary form of T: as many
pieces of the full length as fit, then one piece for each set bit of the rest, longest first. Pieces of equal
length share a bucket. A sequence is one piece, so no sequence crosses documents, its length is a
power of two, and there is no padding at all. The sequence ids number the buckets one after the
other, shortest length first, in the order of (document id, start) within spread hash groups.

A null text is an empty one and gives one piece that holds the end id. Rows that repeat a document
id are packed each on its own.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import pairwise
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import kept_in_worker, stored
from corpuslens.session import ship_package

MAX_LENGTH = 2048
END_ID = 1
GROUPS = 4096  # hash groups a bucket is numbered in; the offset table has GROUPS rows per length
BLOCK = 4 << 20  # bytes of text that are encoded at once (one text at least)
PIECES = 10_000  # rows of a batch that goes back to Spark
PUNCTUATION = punctuation.encode()
# byte-level tokenizers write the bytes that do not print as characters from 256 on
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate([*range(33), *range(127, 161), 173])}
CACHE_WORDS = 400_000  # chunks and stems whose ids a worker remembers, twice: in this generation and the last


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def is_plain(word: str) -> bool:
    """Lower-case letters of the scripts up to Cyrillic, composed: the tokenizer leaves them as they are, and as one word."""
    return word.isalpha() and max(word) < "\u0530" and word.lower() == word and is_normalized("NFC", word)


class WordEncoder:
    """Token ids of whole texts, through the ids of their white-space separated chunks.

    The tokenizer drops white space, and none of its normalising or splitting steps looks across
    ASCII white space, so the ids of a text are those of its chunks in order. Chunks repeat far more
    often than texts, hence each is encoded once and remembered. The tokenizer lower-cases too, so chunks that differ in
    the case of A-Z only are one; a text that may hold a special token, in whatever case, is encoded as it is.
    Arrow splits the texts, numbers their distinct chunks and lays the chunks' ids out again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # a special token cuts a text before any other step, so it can part chunks that are encoded together
        self.parting, self.parting_id = min(special.items())
        self.special = re.compile(b"|".join(re.escape(s.lower().encode()) for s in special))
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the last generation of known

    def _recall(self, words: set[bytes]) -> set[bytes]:
        """Take over what the last generation knows of the words; the others are returned."""
        self.known.update((w, self.before[w]) for w in words if w in self.before)
        return words.difference(self.known)

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word; no word holds the parting token."""
        out = []
        for at in range(0, len(words), 1000):
            found = self.tokenizer.encode(self.parting.join(words[at:at + 1000]), add_special_tokens=False).ids
            ids = np.array(found, dtype="<u4")
            cuts = np.flatnonzero(ids == self.parting_id)
            out += [ids[i:j].tobytes() for i, j in zip(np.append(0, cuts + 1), np.append(cuts, len(ids)))]
        return out

    def _plain_ids(self, word: bytes) -> bytes:
        """Ids of a plain word: the merges alone are left to do."""
        found = self.model.tokenize(word.decode() if word.isascii() else word.decode("latin-1").translate(BYTE_ALPHABET))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _learn(self, chunks: set[bytes]) -> None:
        """The tokenizer parts a letter or digit from punctuation after it, so a lower-cased chunk is its
        stem and the ASCII punctuation that ends it; stems repeat more often than chunks."""
        rest, parted = [], []
        pieces: set[bytes] = set()
        for c in chunks:
            if c.isalpha():  # ASCII only
                self.known[c] = self._plain_ids(c)
                continue
            stem = c.rstrip(PUNCTUATION)
            plain = not stem.isascii() and is_plain(stem.decode("utf-8", "replace"))
            if len(stem) < len(c) and (plain or stem[-1:].isalnum()):  # ASCII letters and digits only
                tail = c[len(stem):]
                parted.append((c, stem, tail))
                pieces.update((stem, tail))
            elif plain:
                self.known[c] = self._plain_ids(c)
            else:
                rest.append(c)
        for p in self._recall(pieces.difference(self.known, rest)):
            if p.isalpha() or not p.isascii() and is_plain(p.decode("utf-8", "replace")):
                self.known[p] = self._plain_ids(p)
            else:
                rest.append(p)
        self.known.update(zip(rest, self._ids([p.decode("utf-8", "replace") for p in rest])))
        self.known.update([(c, self.known[stem] + self.known[tail]) for c, stem, tail in parted])

    def _remember(self, chunks: list[bytes]) -> None:
        new = [c for c in chunks if c not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.before, self.known = self.known, {}
            new = chunks
        self._learn(self._recall(set(new)))

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4")

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (large binary, no nulls) one after the other, the end id last in each; ids of each text."""
        low = pc.ascii_lower(texts.view(pa.large_string()))
        whole: list[int] = []
        if (data := low.buffers()[2]) is not None and self.special.search(memoryview(data)):
            whole = [i for i, t in enumerate(low.view(pa.large_binary())) if self.special.search(t.as_py())]
            mask = np.zeros(len(low), dtype=bool)
            mask[whole] = True
            low = pc.if_else(pa.array(mask), pa.scalar("", pa.large_string()), low)
        rows = pc.ascii_split_whitespace(low)
        chunks = rows.flatten().view(pa.large_binary()).dictionary_encode()
        names = chunks.dictionary.to_pylist()
        self._remember(names)
        laid = pa.array([self.known[c] for c in names], pa.large_binary()).take(chunks.indices)
        _, at, data = laid.buffers()
        at = np.frombuffer(at, dtype="<i8")[:len(laid) + 1] // 4 if len(laid) else np.zeros(1, dtype=np.int64)
        ids = np.frombuffer(data, dtype="<u4", count=at[-1]) if at[-1] else np.empty(0, dtype="<u4")
        edges = at[rows.offsets.to_numpy()]
        if whole:
            parts = np.split(ids, edges[1:-1])
            for i in whole:
                parts[i] = self._whole(texts[i].as_py())
            ids, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return np.insert(ids, edges[1:], END_ID), np.diff(edges) + 1

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers, the end id last."""
        ids, totals = self.flat(pa.array(texts, pa.large_binary()))
        return [ids[i:j].tobytes() for i, j in pairwise(np.concatenate([[0], np.cumsum(totals)]))]


def encoder_of(path: str) -> WordEncoder:
    """One encoder per Python worker: the next task it runs finds the words of the last, unless another operator's was between."""
    return kept_in_worker(("packing", path), lambda: WordEncoder(path))


def cut(totals: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces of each total, and the lengths of all pieces: powers of two that add up to their total, full
    lengths first, then the set bits of the rest."""
    bits = np.arange(longest.bit_length() - 2, -1, -1)
    times = np.column_stack([totals // longest, (totals % longest)[:, None] >> bits & 1])
    sizes = np.concatenate([[longest], 1 << bits])
    return times.sum(axis=1), np.repeat(np.tile(sizes, len(totals)), times.ravel())


def piece_lengths(total: int, longest: int = MAX_LENGTH) -> list[int]:
    return cut(np.array([total]), longest)[1].tolist()


def _blocks(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of about ``BLOCK`` bytes with the place of their first row."""
    block = np.cumsum(pc.binary_length(texts).to_numpy()) // BLOCK
    for at, end in pairwise([0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]):
        yield at, texts[at:end]


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
           longest: int = MAX_LENGTH) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids_le``: ``ids_le`` holds the piece's ids as
    little-endian unsigned 32-bit numbers. ``path`` is the tokenizer's file, present on each executor."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path or tokenizer_path())
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, texts in _blocks(pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")):
                ids, totals = encoder.flat(texts)
                counts, lengths = cut(totals, longest)
                of = np.repeat(np.arange(len(totals)), counts)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                start = ends[:-1] - np.repeat(np.cumsum(totals) - totals, counts)
                docs = batch.column(0).slice(at, len(texts)).take(pa.array(of))
                for i in range(0, len(lengths), PIECES):
                    own = ends[i:i + PIECES + 1]
                    offsets = ((own - own[0]) * 4).astype(np.int32)
                    body = pa.Array.from_buffers(pa.binary(), len(own) - 1, [
                        None, pa.py_buffer(offsets), pa.py_buffer(ids[own[0]:own[-1]])])
                    yield pa.RecordBatch.from_arrays(
                        [docs[i:i + PIECES], pa.array(start[i:i + PIECES]), pa.array(lengths[i:i + PIECES]),
                         pa.array(totals[of[i:i + PIECES]]), body], names=["doc_id", "start", "length", "doc_tokens", "ids_le"])

    ship_package(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text")
                       ).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids_le binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None,
         longest: int = MAX_LENGTH) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset`` (always 0: a sequence is one piece)."""
    cut = stored(pieces(docs, id_col, text, path, longest)
                 .withColumn("_group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)).cast("int")), "pieces")
    counts = cut.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))  # bounded by lengths * GROUPS
    before = Window.orderBy("length", "_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "start", "ids_le")
    return (cut.withColumn("_rank", F.row_number().over(inside)).join(first, ["length", "_group"])
            .select("doc_id", "start", "length", "doc_tokens",
                    (F.col("_first") + F.col("_rank") - 1).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), "ids_le"))


def pack_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: ids as their CRC-32."""
    return pack(docs, path=path).select("doc_id", "start", "length", F.crc32("ids_le").alias("ids_crc32"),
                                        "doc_tokens", "sequence_id", "offset")
