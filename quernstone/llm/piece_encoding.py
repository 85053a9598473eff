"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at each place the
longest key of its trie that fits is replaced, other characters stay. Every
normalised character records the byte of the source it came from. The library
segments the normalised text, with its own normalising switched off, and the cuts
between pieces are carried back through that record, so each piece has the span of
source bytes it stands for. Spans follow one another without gap from the first byte
to the last. A character that the vocabulary lacks becomes one piece a byte, of which
the last has the character's span and the others are empty before it.

Models without byte fallback are refused. Defined results: a null text is empty and has the begin
and end ids alone. Rows that repeat an id are encoded each for itself. Texts are
encoded whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table

SPACE = "▁"
#: Kinds of pieces, as model files number them.
CONTROL, BYTE = 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# -- normalising ------------------------------------------------------------------


class CharacterMap:
    """A compiled map: the size of a double-array trie, its units, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def _child(self, unit: int, at: int) -> int:
        """Where the children of a unit begin."""
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def longest(self, data: bytes, start: int) -> tuple[int, str] | None:
        """The length of the longest key at ``start``, and what replaces it."""
        at, found = self._child(self.units[0], 0), None
        for i in range(start, len(data)):
            at ^= data[i]
            if at >= len(self.units) or self.units[at] & 0x800000FF != data[i]:
                break
            unit = self.units[at]
            at = self._child(unit, at)
            if unit & 0x100:
                found = i + 1 - start, self.units[at] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])].decode()


class Normaliser:
    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool, escape: bool) -> None:
        self.map, self.prefix, self.squeeze = CharacterMap(charsmap), prefix, squeeze
        self.space = SPACE if escape else " "

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its characters and of its end."""
        if not self.map and not self.squeeze:
            lead = np.flatnonzero(np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0 != 0x80)
            first = [0] if self.prefix and text else []
            return self.space * len(first) + text.replace(" ", self.space), np.concatenate([first, lead, [len(text.encode())]]).astype(np.int64)
        return self._mapped(text)

    def _replaced(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Replacement, first source byte and the byte after, from left to right."""
        data, at = text.encode(), 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, data[at : at + n].decode()
            yield hit[1], at, at + hit[0]
            at += hit[0]

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        out, origin, end = [], [], 0
        blank = self.squeeze  # whether a space now would be dropped
        for new, start, stop in self._replaced(text):
            if self.squeeze and blank:
                new = new.lstrip(" ")
            if new or not self.squeeze:
                if self.prefix and not out:
                    out.append(self.space)
                    origin.append(start if self.squeeze else 0)
                out += new.replace(" ", self.space)
                origin += [start] * len(new)
                blank = self.squeeze and new.endswith(" ")
            end = stop
        while self.squeeze and out and out[-1] == self.space:
            out.pop()
            end = origin.pop()
        return "".join(out), np.array([*origin, end if out else 0], dtype=np.int64)


# -- segmenting ---------------------------------------------------------------------


class Encoder:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        rules = model.normalizer_spec
        if not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} has no byte fallback, or spaces at the ends of its pieces")
        self.normalise = Normaliser(rules.precompiled_charsmap, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces)
        # The model's pieces and merges over text that is normalised already.
        rules.Clear()
        rules.name, rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces = "identity", False, False, False
        self.segments = SentencePieceProcessor(model_proto=model.SerializeToString())
        unit = [int(p.piece[1:-1], 16) if p.type == BYTE else -1 for p in model.pieces]
        self.is_byte = np.array([u >= 0 for u in unit])
        self.is_later = np.array([u >= 0 and u & 0xC0 == 0x80 for u in unit])  # a byte that goes on with a character
        self.letters = np.array([0 if p.type in (BYTE, CONTROL) else len(p.piece) for p in model.pieces], dtype=np.int64)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()

    def widths(self, ids: np.ndarray) -> np.ndarray:
        """How many normalised characters each piece stands for."""
        ends = self.is_byte[ids].copy()
        ends[:-1] &= ~self.is_later[ids[1:]]
        return self.letters[ids] + ends

    def __call__(self, text: str | None, begin: bool = True, end: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first source byte of each and the byte after its last."""
        normal, origin = self.normalise(text or "")
        ids = np.array([*[self.begin] * begin, *self.segments.encode(normal), *[self.end] * end], dtype=np.int64)
        widths = self.widths(ids)
        stops = np.cumsum(widths)
        if len(ids) and stops[-1] != len(normal):
            raise ValueError("the pieces don't cover the text")
        return ids, origin[stops - widths], origin[stops]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """A worker's encoder, which outlives a task."""
    return Encoder(path)


# -- tables -------------------------------------------------------------------------


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def encode(docs: DataFrame, model: str | None = None, begin: bool = True, end: bool = True) -> DataFrame:
    """``doc_id, ids, starts, ends``: pieces and the source bytes from ``starts`` to before ``ends`` of each."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # arrays of a few texts at a time
                part = batch.slice(at, 64)
                rows = [encoder(path)(t, begin, end) for t in part["text"].to_pylist()]
                columns = [_lists([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *columns], ["doc_id", "ids", "starts", "ends"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {key}, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; marks have no text, null ids give a null text."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else encoder(path).library.decode(ids) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what ``encode`` and then
    ``decode`` give, without the arrays leaving the worker."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts = [], [], []
            for text in batch["text"]:
                ids, _, _ = encoder(path)(text.as_py())
                counts.append(len(ids))
                digests.append(sha256(ids.astype("<u4").tobytes()).hexdigest())
                texts.append(sha256(encoder(path).library.decode(ids.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_piece_encoding(spark, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
