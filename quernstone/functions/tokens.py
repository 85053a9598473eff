"""Texts as ids of a tokenizer file; marks are ids of their own behind its vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = ("bos", "eos", "prompt", "thought", "poem", "system", "user", "assistant")
#: What stands before the words of a system message, after its mark.
SYSTEM = "System:\n"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def loaded(path: str):
    """A worker's tokenizer, which outlives a task. Names of special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


def reserved(path: str) -> set[int]:
    """Ids of a file that no text may have: its special tokens."""
    import json

    with open(path, encoding="utf-8") as f:
        return {t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


def marks(path: str) -> dict[str, int]:
    """An id for each mark, from the first that the vocabulary leaves free."""
    size = loaded(path).get_vocab_size(with_added_tokens=True)
    return {name: size + i for i, name in enumerate(MARKS)}


def encode(rows: DataFrame, columns: dict[str, str], tokenizer: str | None = None) -> DataFrame:
    """Replaces text columns by arrays of ids under the names given (``{text: ids}``), without
    special tokens; a null text has null ids. Texts are encoded whole, a column of a batch at a time."""
    path = tokenizer or default_tokenizer()
    kept = [f for f in rows.schema.fields if f.name not in columns]
    schema = T.StructType([*kept, *(T.StructField(ids, T.ArrayType(T.IntegerType())) for ids in columns.values())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = []
                for text in columns:
                    values = part[text].to_pylist()
                    found = iter(loaded(path).encode_batch([v for v in values if v is not None], add_special_tokens=False))
                    made.append(pa.array([None if v is None else next(found).ids for v in values], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(part[f.name] for f in kept), *made], [f.name for f in schema.fields])

    return rows.select(*[f.name for f in kept], *columns).mapInArrow(run, schema)


def vocabulary_faults(rows: DataFrame, ids: str, key: str, tokenizer: str | None = None) -> DataFrame:
    """``key, fault`` of rows with an id that neither the vocabulary nor a mark has, or a reserved one."""
    path = tokenizer or default_tokenizer()
    top, banned = max(marks(path).values()), sorted(reserved(path))
    beyond = F.exists(F.col(ids), lambda i: (i < 0) | (i > top))
    held = F.exists(F.col(ids), lambda i: i.isin(banned)) if banned else F.lit(False)
    return rows.select(key, F.explode(F.array_compact(F.array(F.when(beyond, "beyond_vocabulary"), F.when(held, "reserved")))).alias("fault"))
