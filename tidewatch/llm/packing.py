"""Packing by concatenate and cut.

First pass: every text is tokenised once, its ids are staged as 16-bit
integers, and a running token count is kept inside each stored run of rows.
The totals of the runs, one number per input split, give every run its global
offset.  Second pass: each document is cut at the multiples of the sequence
length, which yields its pieces with their sequence and offset; a document
that crosses a boundary leaves one piece on each side.  No row is shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from tidewatch.session import stage

SEQUENCE, END_ID = 4096, 2
CHUNK_CHARS = 1 << 18
CACHE_WORDS, CACHE_PIECES = 400_000, 600_000
BATCH_ROWS = "1000"


# How the tokenizer cuts a lower-cased chunk of Latin-1 text: contractions, letters, single digits, other marks.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: byte for byte in printable} | {byte: 256 + k for k, byte in enumerate(others)}


class WordEncoder:
    """Ids of the lower-casing word BPE, equal to the tokenizer's own and faster.

    This vocabulary never joins text across white space.  A text whose
    characters are all Latin-1 (where lower case and composition need no
    context) is cut at white space, and the ids of each chunk are looked up in
    a bounded cache.  A new chunk is cut into pieces as the tokenizer does,
    and only new pieces go through its merges.  Any other text, and one with
    special-token marks or separators that Python alone takes for white space,
    goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def plain(text: str) -> bool:
        if "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            known = array("H", [token.id for token in self.merges.tokenize(spelled)]).tobytes()
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces.clear()
            self.pieces[piece] = known
        return known

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        cut = [text.lower().split() if self.plain(text) else None for text in texts]
        seen = set().union(*(chunks for chunks in cut if chunks))
        missing = seen.difference(self.chunks)
        if len(self.chunks) + len(missing) > CACHE_WORDS:
            self.chunks.clear()
            missing = seen
        for chunk in missing:
            self.chunks[chunk] = b"".join(map(self._piece, _PIECES.findall(chunk)))
        for text, chunks in zip(texts, cut, strict=True):
            if chunks is None:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                yield array("H", ids).tobytes()
            else:
                yield b"".join(map(self.chunks.__getitem__, chunks))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _batches(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size > CHUNK_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _tokenise(tokenizer: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        end = np.array([END_ID], np.uint16).tobytes()
        name, row, first, before = None, None, None, 0
        for batch in batches:
            ids = [piece + end for group in _batches(list(batch.text)) for piece in encoder.encode(group)]
            sizes = [len(piece) // 2 for piece in ids]
            run_first, run_before = [], []
            for file, at, size in zip(batch["file"], batch["row"], sizes, strict=True):
                if file != name or row is None or at != row + 1:
                    name, first, before = file, at, 0
                row = at
                run_first.append(first)
                run_before.append(before)
                before += size
            yield pd.DataFrame({"doc_id": batch.doc_id, "ids": ids, "doc_tokens": sizes, "file": batch["file"],
                                "first": run_first, "before": run_before})
    return run


def _cut(sequence: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, packed, begin in zip(batch.doc_id, batch.ids, batch.begin, strict=True):
                ids = np.frombuffer(packed, np.uint16)
                start = 0
                while start < len(ids):
                    number, offset = divmod(begin + start, sequence)
                    length = min(len(ids) - start, sequence - offset)
                    crc = zlib.crc32(ids[start:start + length].astype("<u4").tobytes())
                    rows.append((doc, start, length, crc, len(ids), number, offset))
                    start += length
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                              "sequence_id", "offset"]).astype({"doc_id": "Int64"})
    return run


def stored_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_file`` and ``_at``: where a row is stored, or its partition and rank if it is not."""
    try:
        return docs.withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return docs.withColumns({"_file": F.lit(""), "_at": F.monotonically_increasing_id()})


def packed(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of a document, with its place in the sequences.

    Documents follow each other in stored order (file name, then row).  A null
    text counts as empty and still has its end token, so every document has at
    least one piece; a null ``doc_id`` stays null.  Only the last sequence can
    be shorter than ``sequence``; it is padded up.  Repeated rows are packed
    as often as they occur, an empty table gives no rows, other columns are
    ignored.  ``tokenizer`` is a file path that every executor can read.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    rows = stored_order(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("_file").alias("file"), F.col("_at").alias("row"))
    tokens = stage(rows.mapInPandas(_tokenise(tokenizer), "doc_id long, ids binary, doc_tokens long, file string, "
                                                          "first long, before long"), "tokens")
    runs = (tokens.groupBy("file", "first").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("n"))
            .orderBy("file", "first").collect())  # a row per input split
    bases, total = [], 0
    for run in runs:
        bases.append((run["file"], run["first"], total))
        total += run["n"]
    base = spark.createDataFrame(bases, "file string, first long, base long")
    begun = tokens.join(F.broadcast(base), ["file", "first"]).select(
        "doc_id", "ids", (F.col("base") + F.col("before")).alias("begin"))
    return begun.mapInPandas(_cut(sequence), "doc_id long, start long, length long, ids_crc32 long, "
                                             "doc_tokens long, sequence_id long, offset long")
