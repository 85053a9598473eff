"""Constructors of records and the gates they pass: documents, blocks, reasons, hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rights that need evidence; others pass without.
PROVEN = ("public_domain", "licensed", "permission")


def slug(name: Column) -> Column:
    """Lower case with runs of anything but a-z, 0-9 and hyphen as one hyphen; a hash where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9-]+", "-"), r"^-+|-+$", "")
    return F.when(plain != "", plain).otherwise(F.substring(F.sha2(name, 256), 1, 16))


def titled_prompt(title: Column, author: Column) -> Column:
    """A prompt by title, or by author where there is none."""
    bare = F.trim(F.coalesce(title, F.lit("")))
    return F.when(bare != "", F.concat(F.lit('Write a poem called "'), bare, F.lit('".'))).otherwise(F.concat(F.lit("Write a poem in the style of "), author, F.lit(".")))


def provenance(source: Column, locator: Column, rights: Column, evidence: Column) -> Column:
    return F.struct(source.alias("source"), F.concat_ws("#", source, locator).alias("locator"), rights.alias("rights"), evidence.alias("evidence"))


def rights_fault(rights: Column, evidence: Column, allow_synthetic: bool) -> Column:
    """Why a row may not be used, or null: denied, synthetic where that isn't allowed, or claimed without evidence."""
    return (
        F.when(rights == "denied", "denied").when((rights == "synthetic") & ~F.lit(allow_synthetic), "synthetic")
        .when(rights.isin(*PROVEN) & (F.trim(F.coalesce(evidence, F.lit(""))) == ""), "no_evidence")
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _starts(lengths: pd.Series) -> pd.Series:
    """Where each of consecutive runs begins."""
    return lengths.map(lambda n: None if n is None else (np.cumsum(n, dtype=np.int32) - n).astype(np.int32))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, index, start_char, end_char, block``: runs of lines without a blank one, with their
    places (0-based code points); a text without any is one block."""
    spans = F.regexp_extract_all(F.col(text), F.lit(r"(?s)((?:[^\n]*\S[^\n]*(?:\n|\z))+|(?:[^\n\S]*\n)+|[^\n\S]+\z)"), F.lit(1))
    # Places are added up once along a text's runs, which share no row with it.
    runs = docs.select(key, F.explode(F.array(spans)).alias("spans_"))
    starts = _starts(F.transform("spans_", F.length))
    rows = runs.select(key, F.explode(F.arrays_zip(F.col("spans_").alias("span"), starts.alias("start"))).alias("r"))
    body = F.regexp_replace("r.span", r"\n\z", "")
    rows = rows.select(key, F.col("r.start").alias("start_char"), body.alias("block")).where(F.trim(F.regexp_replace("block", r"\s+", " ")) != "")
    return rows.withColumn("end_char", F.col("start_char") + F.length("block"))


def span_faults(blocks: DataFrame, text: str) -> DataFrame:
    """Blocks that are not what their document holds between their ends."""
    return blocks.where(F.substring(F.col(text), F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("block"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _wrong(texts: pd.Series, starts: pd.Series, ends: pd.Series, blocks: pd.Series) -> pd.Series:
    """Which blocks a text doesn't hold at their places: slices by code point, each as long as its block."""
    return pd.Series([[t[i:j] != b for i, j, b in zip(*at, strict=True)] for t, *at in zip(texts, starts, ends, blocks, strict=True)], dtype=object)


def misplaced(blocks: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``span_faults`` of blocks by their documents: a document's blocks meet its text in one row, not a copy of it each."""
    places = blocks.groupBy(key).agg(F.collect_list(F.struct("start_char", "end_char", "block")).alias("b"))
    rows = places.join(docs.where(F.col(text).isNotNull()).select(key, text), key)
    rows = rows.select(key, F.explode(F.arrays_zip("b", _wrong(F.col(text), F.col("b.start_char"), F.col("b.end_char"), F.col("b.block")).alias("wrong"))).alias("r"))
    return rows.where("r.wrong").select(key, "r.b.*")


def mean_in_order(values: Column) -> Column:
    """The mean of an array's doubles, added from its front; nulls don't count."""
    told = F.filter(values, lambda v: v.isNotNull())
    return F.aggregate(told, F.lit(0.0), lambda acc, v: acc + v) / F.nullif(F.size(told), F.lit(0))


def document_hashes(key: Column, work: Column, text: Column) -> Column:
    return F.struct(F.sha2(F.concat_ws("\0", key, work, text), 256).alias("document"), F.sha2(text, 256).alias("raw"), F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256).alias("cleaned"))


def phrase_count(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def safe_path(path: Column) -> Column:
    """A relative path with forward slashes and without a step upwards, an empty one or a drive."""
    return F.coalesce(path.rlike(r"^(?!/)(?!.*(?:^|/)\.{0,2}(?:/|\z))[^\\:\x00]+\z"), F.lit(False))


_BASE, _SPREAD = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


def _repeats(codes: np.ndarray, sums: np.ndarray, powers: np.ndarray, n: int) -> bool:
    """Whether some run of n words comes twice: runs of equal hashes are compared word by word."""
    hashes = (sums[n:] - sums[:-n]) * powers[: len(sums) - n][::-1]
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    alike = np.flatnonzero(ranked[1:] == ranked[:-1])
    for i in alike:
        if (codes[order[i] : order[i] + n] == codes[order[i + 1] : order[i + 1] + n]).all():
            return True
    # Unequal runs of one hash may stand between equal ones.
    return len(alike) > 0 and len({codes[i : i + n].tobytes() for i in range(len(codes) - n + 1)}) <= len(codes) - n


def longest_run(words: list[str]) -> int:
    """The largest n up to half the words with a run of n words that comes twice: 0 if none.
    A repeat of n words holds one of n - 1, so n is found by halving."""
    if len(words) < 2:
        return 0
    numbers = {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.uint64)
    powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(len(words), _BASE, dtype=np.uint64)]), dtype=np.uint64)
    mixed = (codes + np.uint64(1)) * _SPREAD
    mixed ^= mixed >> np.uint64(31)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed * powers[: len(words)], dtype=np.uint64)])
    low, high = 0, len(words) // 2
    while low < high:
        n = (low + high + 1) // 2
        low, high = (n, high) if _repeats(codes, sums, powers, n) else (low, n - 1)
    return low


def longest_repeats(rows: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the length of the longest run of words that comes twice in its row, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if w is None else longest_run(w) for w in batch[words].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(found, pa.int64())], [*kept, out])

    kept = [c for c in rows.columns if c != words]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, T.LongType())])
    return rows.mapInArrow(run, schema)


def critique_reasons(row: dict[str, Column], least: dict[str, int]) -> Column:
    """Every reason a critique gives, in order: its decision, scores below their least, its flags."""
    scores = [F.when(row[name] < n, F.concat(F.lit(f"{name}="), row[name].cast("string"))) for name, n in least.items()]
    flags = [F.when(row[f], F.lit(reason)) for f, reason in (("degeneration", "critic_detected_degeneration"), ("named_author_imitation", "critic_detected_named_author_imitation"), ("suspected_quote", "critic_suspected_quote"))]
    return F.array_compact(F.array(F.when(row["decision"] != "accept", "critic_rejected"), *scores, *flags))


#: Every character that ends no line, as ranges with the commonest first, and the same without the space.
_SPACED = r"\x20-\x84\x00-\x09\x0E-\x1B\x1F\x86-\x{2027}\x{202A}-\x{10FFFF}"
_SOLID = _SPACED.replace(r"\x20", r"\x21", 1)


def response_reasons(text: Column, least: Column, most: Column, refusals: tuple[str, ...], quotations: tuple[str, ...]) -> Column:
    """Every reason against an answer, in order: lines, words, fence, control characters, refusal, quotation, separators.
    What the reasons are told from is bound to a name of its own, as each mention of a column may read the text anew."""
    facts = F.struct(
        F.regexp_count(text, F.lit(f"[{_SOLID}][{_SPACED}]*+")).alias("lines"), F.regexp_count(text, F.lit(r"[\p{L}\p{N}_']+")).alias("words"), F.lower(text).alias("low"),
        F.when(text.contains("---") | text.contains("***"), F.regexp_count(text, F.lit(rf"(?<![{_SPACED}]) *+(?:---|\*\*\*) *+(?![{_SPACED}])"))).alias("rules"),
    )

    def reasons(f: Column) -> Column:
        n, words = f["lines"], f["words"]
        has = lambda marks: reduce(Column.__or__, [f["low"].contains(m) for m in marks], F.lit(False))
        return F.array_compact(F.array(
            F.when((n < least) | (n > most), F.concat(F.lit("line_count="), n.cast("string"), F.lit("_expected="), least.cast("string"), F.lit("-"), most.cast("string"))),
            F.when((words < n) | (words > 600), F.concat(F.lit("word_count="), words.cast("string"))),
            F.when(text.contains("```"), "markdown_fence"), F.when(text.rlike(r"[\p{Cc}&&[^\t\n\r]]"), "control_character"),
            F.when(has(refusals), "refusal_boilerplate"), F.when(has(quotations), "disallowed_quotation"), F.when(f["rules"] > 1, "multiple_poem_separator"),
        ))

    return F.transform(F.array(facts), reasons)[0]


def stanza_counts(text: Column) -> Column:
    """Non-empty lines of each stanza."""
    parts = F.filter(F.split(F.trim(text), r"\n\s*\n"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.size(F.filter(F.split(p, "\n"), lambda x: F.trim(x) != "")))


def structural_mismatch(form: Column, counts: Column) -> Column:
    """Whether stanzas differ from what the form asks: three of three lines, or two unequal ones about a single line."""
    turn = (F.size(counts) == 3) & (F.element_at(counts, 2) == 1) & (F.element_at(counts, 1) != F.element_at(counts, 3))
    return F.when(form == "tercets", counts != F.array(F.lit(3), F.lit(3), F.lit(3))).when(form == "turn", ~F.when(F.size(counts) == 3, turn).otherwise(False)).otherwise(False)


def retry_reason(found: Column, body: Column) -> Column:
    """Why a request must be sent again, or null: no result, no single choice, no content, cut at its limit."""
    content, finish = F.get_json_object(body, "$.choices[0].message.content"), F.get_json_object(body, "$.choices[0].finish_reason")
    one = F.get_json_object(body, "$.choices[0]").isNotNull() & F.get_json_object(body, "$.choices[1]").isNull()
    return (
        F.when(found.isNull(), "missing_result").when(~F.coalesce(one, F.lit(False)), "invalid_response")
        .when(F.trim(F.coalesce(content, F.lit(""))) == "", "missing_message_content").when(finish == "length", "completion_limit")
    )


def without_markdown(text: Column) -> Column:
    """``clean`` text and counts of what was taken out: rules, pairs of asterisks, single ones."""
    # Possessive: giving back never helps, and a long rule takes no stack.
    rule = r"(?m)^[ \t]*+(?:(?:\*[ \t]*+){3,}+|(?:-[ \t]*+){3,}+|(?:_[ \t]*+){3,}+)$"
    italic = r"\*([^*\n]+)\*"
    unruled = F.regexp_replace(text, rule, "")
    plain = F.regexp_replace(unruled, italic, "$1")
    stars = F.length(plain) - F.length(F.replace(plain, F.lit("*"), F.lit("")))
    return F.struct(F.trim(F.replace(plain, F.lit("*"), F.lit(""))).alias("clean"), F.regexp_count(text, F.lit(rule)).alias("rules"), F.regexp_count(unruled, F.lit(italic)).alias("italics"), stars.alias("asterisks"))


def lineage_faults(rows: DataFrame, level: Column, equal: dict[str, list[str]], unequal: dict[str, list[str]]) -> DataFrame:
    """``id, fault`` of experiments whose source and target columns (``s_x``, ``t_x``) break their level's rules."""
    faults = [F.when((level == lv) & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), f"{c} differs") for lv, cs in equal.items() for c in cs]
    faults += [F.when((level == lv) & F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")), f"{c} is shared") for lv, cs in unequal.items() for c in cs]
    return rows.select("id", F.explode(F.array_compact(F.array(*faults))).alias("fault"))


def gate_reasons(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail or can't be told, in order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
