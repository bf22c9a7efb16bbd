"""Operator 13, SentencePiece encoding and decoding through a table of distinct chunks.

A normalised text is a row of chunks: one or more whitespace markers and what follows up to the next marker.  Where no
piece of a model holds a marker behind another character, no merge can cross from one chunk into the next, so a
text's ids are those of its chunks in turn.  A task keeps a table of the distinct chunks that it has met: each is
segmented and decoded once by the library, and ids and decoded parts are joined back by position.  Texts stay where
they are read: nothing is shuffled, and the table is emptied when full.  ``Pieces`` checks the model; one whose pieces
could cross a marker, or whose normaliser does more than mark white space, has its texts encoded whole.

The model's file is read on the driver, checked to be at most ``MODEL_BYTES``, and sent to each executor once.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; rows that repeat, and
null or repeated doc_ids, each give a row; texts and words of any length are encoded whole; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: chunks that a table holds, and the longest it keeps (longer ones are segmented where they stand)
CHUNKS, LONGEST = 1 << 18, 64
MODEL_BYTES = 64 << 20
BPE, BYTES, USER_DEFINED = 2, 6, 4
_CHUNK = re.compile(" +[^ ]*")


def crossing(model: bytes) -> bool:
    """Whether chunks of this model's texts could not be segmented one by one."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm, trainer = proto.normalizer_spec, proto.trainer_spec
    marks = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    back = proto.denormalizer_spec.precompiled_charsmap
    if trainer.model_type != BPE or trainer.treat_whitespace_as_suffix or not marks or back:
        return True
    return all(p.piece != MARK for p in proto.pieces) or any(p.type == USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in proto.pieces)


class Pieces:
    """A model with its table of distinct chunks: (ids, ids as decimals joined by commas, decoded text) of each."""

    def __init__(self, model: bytes, most: int = CHUNKS, whole: bool | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.whole = crossing(model) if whole is None else whole
        self.most, self.table, self.segmented = most, {}, 0

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text that is not empty, each with a space for each marker."""
        return _CHUNK.findall(" " + text.replace(MARK, " "))

    def segment(self, new: list[str]) -> dict[str, tuple[list[int], str, str]]:
        """What the table says of chunks: the library marks each text's start itself, so one marker is left to it."""
        self.segmented += len(new)
        alone = self.library.piece_to_id(MARK)
        ids = [x or [alone] for x in self.library.encode([c[1:] for c in new], num_threads=1)]
        back = self.library.decode(ids, num_threads=1)
        return {c: (x, ",".join(map(str, x)), " " + t) for c, x, t in zip(new, ids, back, strict=True)}

    def look_up(self, text: str) -> list[tuple[list[int], str, str]]:
        """The chunks' entries, in the text's order."""
        chunks = self.chunks(text)
        new = list(set(chunks).difference(self.table))
        if not new:
            return list(map(self.table.__getitem__, chunks))
        found = self.segment(new)
        if len(self.table) + len(found) > self.most:
            known = {c: self.table[c] for c in set(chunks).difference(found)}
            self.table.clear()
        else:
            known = self.table
        out = [found[c] if c in found else known[c] for c in chunks]
        if len(found) <= self.most:
            self.table.update((c, x) for c, x in found.items() if len(c) <= LONGEST)
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.whole:
            return self.library.encode(text)
        return [i for ids, _, _ in self.look_up(text) for i in ids]

    def round_trip(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, ids as decimals joined by commas, the text that they decode to)."""
        if not text:
            return 0, "", ""
        if self.whole:
            ids = self.library.encode(text)
            return len(ids), ",".join(map(str, ids)), self.library.decode(ids)
        found = self.look_up(text)
        return sum(len(x) for x, _, _ in found), ",".join([s for _, s, _ in found]), "".join([t for _, _, t in found])[1:]


def read_model(path: str) -> bytes:
    if (size := Path(path).stat().st_size) > MODEL_BYTES:
        raise ValueError(f"a model of {size} bytes is not sent to executors")
    return Path(path).read_bytes()


def _each(docs: DataFrame, path: str, row: Callable[[Pieces, str | None], tuple], columns: dict[str, pa.DataType], out: str) -> DataFrame:
    """doc_id and what ``row`` makes of each text, under one table a task."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model.value)
        for b in batches:
            rows = [row(pieces, t.as_py()) for t in b.column(1)]
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * len(columns), columns.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(work, out)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of whole texts, exactly as the library encodes them without begin or end ids."""
    return _each(docs, path, lambda p, t: (p.encode(t),), {"ids": pa.list_(pa.int32())}, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids are none."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Pieces(model.value).library
        for b in batches:
            texts = [library.decode(x) if x else "" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(work, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """A row a document: the number of its ids, and digests of the ids and of the text that they decode to."""

    def row(p: Pieces, text: str | None) -> tuple[int, str, str]:
        n, ids, back = p.round_trip(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()

    kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _each(docs, path, row, kinds, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
