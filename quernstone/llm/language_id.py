"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of its own, drawn from a seed and its
code point. A trigram is bound by multiplying its letters' vectors, the first rolled
by two places and the second by one; a text bundles (adds) its trigrams' vectors by
count. A language's prototype bundles the unit vectors of its training texts. The
prediction is the prototype of highest cosine, and the cosine is the score.

Training reads at most about ``SAMPLE`` texts of each language, chosen by a hash of
doc_id; each is read whole. Vectors are summed where the texts are, and only
prototypes reach the driver.

Defined results: texts that are null or have no letter get ``und`` and score 0.
Letters of any script count. With no training rows everything is ``und``, and
``with_known_language`` keeps the texts that have a letter. Each row is judged for
itself; other columns pass through ``identify`` untouched, and the two it adds take
names that the input does not have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read_table

WIDTH, SEED = 512, 20240607
#: Training texts of a language, about, at most.
SAMPLE = 400
UNKNOWN = "und"
#: Trigrams of the first so many letters that a worker meets are remembered.
_COMMON = 128
#: Trigram vectors a worker holds at once, and binds at once.
_HELD, _BOUND = 30_000, 2_000


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(p).isalpha() for p in range(0x110000)), dtype=bool, count=0x110000)


class Space:
    """Vectors of letters and of trigrams, made when first met. Which number a letter
    has depends on the texts met before; its vector does not."""

    def __init__(self) -> None:
        self.number = np.zeros(0x110000, dtype=np.int64)
        self.letters = self._drawn([0])  # number 0 is the gap between words
        self.clear()

    @staticmethod
    def _drawn(points: list[int]) -> np.ndarray:
        signs = np.array([-1, 1], dtype=np.int8)
        return np.stack([np.random.default_rng([SEED, p]).choice(signs, size=WIDTH) for p in points])

    def clear(self) -> None:
        self.row = np.full(_COMMON**3, -1, dtype=np.int32)
        self.vectors, self.used = np.zeros((1024, WIDTH), dtype=np.float32), 0

    def numbers(self, points: np.ndarray) -> np.ndarray:
        letter = _is_letter()[points]
        new = np.unique(points[letter & (self.number[points] == 0)])
        if len(new):
            self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
            self.letters = np.concatenate([self.letters, self._drawn(new.tolist())])
        return np.where(letter, self.number[points], 0)

    def bound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        v = self.letters
        return (np.roll(v[a], 2, axis=1) * np.roll(v[b], 1, axis=1) * v[c]).astype(np.float32)

    def of(self, grams: np.ndarray, parts: tuple[np.ndarray, ...]) -> np.ndarray:
        """Vectors of distinct trigrams of common letters."""
        fresh_ones = self.row[grams] < 0
        if self.used + fresh_ones.sum() > _HELD and self.used:
            self.clear()
            fresh_ones = np.ones(len(grams), dtype=bool)
        if fresh_ones.any():
            need = self.used + int(fresh_ones.sum())
            if need > len(self.vectors):
                grown = np.zeros((max(need, 2 * len(self.vectors)), WIDTH), dtype=np.float32)
                grown[: self.used] = self.vectors[: self.used]
                self.vectors = grown
            self.vectors[self.used : need] = self.bound(*[p[fresh_ones] for p in parts])
            self.row[grams[fresh_ones]] = np.arange(self.used, need)
            self.used = need
        return self.vectors[self.row[grams]]

    def bundle(self, text: str | None) -> np.ndarray | None:
        """The text's vector, or None without a letter."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = self.numbers(points)
        if not codes.any():
            return None
        codes = np.concatenate([[0], codes, [0]])
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]  # one gap between words
        grams, counts = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        parts = grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF
        common = np.maximum(np.maximum(*parts[:2]), parts[2]) < _COMMON
        a, b, c = (p[common] for p in parts)
        out = counts[common].astype(np.float32) @ self.of((a * _COMMON + b) * _COMMON + c, (a, b, c))
        rare = np.flatnonzero(~common)
        for at in range(0, len(rare), _BOUND):
            some = rare[at : at + _BOUND]
            out = out + counts[some].astype(np.float32) @ self.bound(*[p[some] for p in parts])
        return out


@lru_cache(1)
def _space() -> Space:
    """A worker's vectors outlive a task; they depend on the letters alone."""
    return Space()


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt((v * v).sum())), 1e-12)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, sums = _space(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            v = space.bundle(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + _unit(v)
    if sums:
        values = [np.asarray(v, dtype=np.float64).tolist() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(values, pa.list_(pa.float64()))], names=["lang", "profile"])


def held_out(doc_id: F.Column, parts: int, part: int) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Unit prototypes by language, from a bounded sample of labelled rows."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "lang", "text")
    counts = rows.groupBy("lang").count().collect()  # one row a language
    if not counts:
        return {}
    share = docs.sparkSession.createDataFrame([(r["lang"], sample / r["count"]) for r in counts], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(SEED)), F.lit(1 << 20)) / F.lit(1 << 20)
    chosen = rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("lang", "text")
    found: dict[str, np.ndarray] = {}
    for r in chosen.mapInArrow(_profiles, "lang string, profile array<double>").collect():  # languages x tasks rows
        found[r["lang"]] = found.get(r["lang"], 0) + np.array(r["profile"])
    return {k: _unit(v).astype(np.float32) for k, v in sorted(found.items())}


def _judge(names: list[str], prototypes: np.ndarray, text_at: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = _space()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(text_at).to_pylist():
                v = space.bundle(text) if names else None
                if v is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = prototypes @ _unit(v)
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    return run


def identify(docs: DataFrame, model: dict[str, np.ndarray]) -> tuple[DataFrame, str, str]:
    """``docs`` with two columns added, and their names: the language and its score."""
    names = list(model)
    prototypes = np.stack([model[n] for n in names]) if names else np.zeros((0, WIDTH), dtype=np.float32)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)])
    schema = T.StructType([*plain.fields, T.StructField(f"c{len(docs.columns)}", T.StringType()), T.StructField(f"c{len(docs.columns) + 1}", T.DoubleType())])
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    judged = docs.mapInArrow(_judge(names, prototypes, docs.columns.index("text")), schema)
    return judged.toDF(*docs.columns, lang, score), lang, score


def with_known_language(docs: DataFrame, languages: set[str] | None = None, least: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose language can be told with a score of ``least`` or more, and is one
    of ``languages`` if those are given. Texts without a letter have no language. By default
    nothing else is rejected. Without labelled rows there are no prototypes, so no language but
    ``und``: then letters decide, and asking for languages is an error."""
    model = train(docs)
    if not model:
        if languages is not None:
            raise ValueError("no labelled text to learn languages from")
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged, lang, score = identify(docs, model)
    kept = (F.col(lang) != UNKNOWN) & (F.col(score) >= least)
    if languages is not None:
        kept &= F.col(lang).isin(sorted(languages))
    return judged.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    judged, lang, score = identify(docs.select("doc_id", "text"), train(docs))
    return judged.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))
