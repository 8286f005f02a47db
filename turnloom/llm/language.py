"""Language identification by language-bitmask n-gram filters.

One Bloom filter per language, stored bit-sliced: slot ``s`` of the table is a
word whose bit ``l`` belongs to the filter of language ``l``. A lookup ANDs the
words of an n-gram's slots and gets all languages that contain the n-gram at
once. A document's hits per language are popcounts over its n-grams, corrected
for the false positives that the fill of each filter makes likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm.common import as_named, as_numbered, byte_blocks, crc_class, kept_columns, numbered_fields, query, table, utf8

UNDETERMINED = "und"
GRAM = 5            # bytes of an n-gram
SLOT_BITS = 22
HASHES = 2
WINDOW = 1 << 20    # bytes worked on at a time
MAX_LANGUAGES = 64

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32     # controls, blanks, signs and digits say nothing about a language
_FOLD[91:97] = 32
_FOLD[123:128] = 32


@dataclass(frozen=True)
class LanguageFilter:
    """``slots[s]`` holds one bit per language of ``languages``."""

    languages: tuple[str, ...]
    slots: np.ndarray

    @property
    def false_positive_rates(self) -> np.ndarray:
        one = self.slots.dtype.type(1)
        fill = [np.mean((self.slots >> self.slots.dtype.type(i)) & one) for i in range(len(self.languages))]
        return np.array(fill) ** HASHES


def gram_keys(data: np.ndarray) -> np.ndarray:
    """A 64-bit key for the n-gram that starts at each byte (the last GRAM - 1 have none)."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    folded = _FOLD[data].astype(np.uint64)
    key = folded[:n].copy()
    for i in range(1, GRAM):
        key <<= np.uint64(8)
        key |= folded[i : n + i]
    return key


def slot_numbers(keys: np.ndarray) -> list[np.ndarray]:
    return [((keys * m) >> np.uint64(64 - SLOT_BITS)).astype(np.int32) for m in _MULTIPLIERS[:HASHES]]


def fit_filter(texts: list[str | None], langs: list[str]) -> LanguageFilter:
    """Filters over the n-grams that occur at least twice in a language's sample (once if it is tiny)."""
    names = tuple(sorted(set(langs)))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"at most {MAX_LANGUAGES} languages fit into one word, got {len(names)}")
    word = np.dtype(next(t for b, t in ((8, "u1"), (16, "u2"), (32, "u4"), (64, "u8")) if len(names) <= b)).type
    slots = np.zeros(1 << SLOT_BITS, word)
    for i, name in enumerate(names):
        own = "\n\n\n\n\n".join(t or "" for t, lang in zip(texts, langs) if lang == name)
        keys, counts = np.unique(gram_keys(np.frombuffer(own.encode("utf-8", "replace"), np.uint8)), return_counts=True)
        if len(own) > 100_000:
            keys = keys[counts > 1]
        for s in slot_numbers(keys):
            slots[s] |= word(1 << i)
    return LanguageFilter(names, slots)


def hits(model: LanguageFilter, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: n-grams looked up, and hits of each language."""
    n_texts, n_langs = len(offsets) - 1, len(model.languages)
    total, found = np.zeros(n_texts, np.int64), np.zeros((n_texts, n_langs), np.int64)
    ends = offsets[1:]
    for a in range(0, len(data), WINDOW):
        keys = gram_keys(data[a : a + WINDOW + GRAM - 1])
        if not len(keys):
            break
        b = a + len(keys)
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(offsets[:-1], b, "left")
        starts = np.clip(offsets[first:last], a, b) - a
        inside = np.ones(len(keys), bool)
        for e in ends[first:last]:  # n-grams that run over the end of a text
            inside[max(0, e - GRAM + 1 - a) : max(0, e - a)] = False
        mask = None
        for s in slot_numbers(keys):
            mask = model.slots[s] if mask is None else mask & model.slots[s]
        mask = np.where(inside, mask, mask.dtype.type(0))
        texts = np.arange(first, last)
        full = np.diff(np.append(starts, len(keys))) > 0
        starts, texts = starts[full], texts[full]
        if not len(starts):
            continue
        total[texts] += np.add.reduceat(inside, starts, dtype=np.int64)
        for i in range(n_langs):
            bit = (mask >> mask.dtype.type(i)) & mask.dtype.type(1)
            found[texts, i] += np.add.reduceat(bit, starts, dtype=np.int64)
    return total, found


@dataclass(frozen=True)
class LanguageFilters:
    """Filters of any number of languages, MAX_LANGUAGES at most in each part."""

    parts: tuple[LanguageFilter, ...]

    @property
    def languages(self) -> tuple[str, ...]:
        return tuple(name for p in self.parts for name in p.languages)

    @property
    def false_positive_rates(self) -> np.ndarray:
        return np.concatenate([p.false_positive_rates for p in self.parts])

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        each = [hits(p, data, offsets) for p in self.parts]
        return each[0][0], np.concatenate([found for _, found in each], axis=1)


def decide(model: LanguageFilter | LanguageFilters, total: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with most corrected hits, and its share of the n-grams.

    With filter ``l`` wrong at rate ``f`` for an absent n-gram, ``h`` hits among
    ``n`` n-grams stand for ``(h - n f) / (1 - f)`` present ones.
    """
    rate = model.false_positive_rates
    present = np.clip((found - total[:, None] * rate) / np.maximum(1 - rate, 0.01), 0, None)    # a filter that is nearly full tells nothing
    best = present.argmax(1) if present.size else np.zeros(len(total), np.int64)
    share = present[np.arange(len(total)), best] / np.maximum(total, 1) if present.size else np.zeros(len(total))
    return best, np.clip(share, 0.0, 1.0)


def training_samples(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int, held_out: int,
                     docs_per_language: int, max_bytes: int) -> Iterator[tuple[list, list]]:
    """About ``docs_per_language`` rows of each language, spread over the whole table by a hash of the id.

    One sample, and one pass over the table, for each MAX_LANGUAGES languages in
    order of name.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("l").isNotNull() & F.coalesce(crc_class(F.col("i"), folds) != held_out, F.lit(True)))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    names = sorted(counts)
    spread = F.pmod(F.xxhash64(F.lit("language sample"), F.col("i")), F.lit(1 << 30)) / (1 << 30)
    for a in range(0, len(names), MAX_LANGUAGES):
        # Of a language that is not in the map the share is null.
        share = F.create_map(*[F.lit(x) for k in names[a : a + MAX_LANGUAGES] for x in (k, min(1.0, docs_per_language / counts[k]))])
        sample = rows.where((spread < F.try_element_at(share, F.col("l"))) & (F.octet_length("t") <= max_bytes)).select("t", "l").toArrow()
        yield sample["t"].to_pylist(), sample["l"].to_pylist()


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
             held_out: int = 0, docs_per_language: int = 1500, max_bytes: int = 1 << 20,
             keep: list[str] | None = None) -> DataFrame:
    """Language of every whole text: ``held_out, lang_pred, score, n_grams`` after the columns ``keep`` (the id alone if not given).

    Learns from rows with a language whose ``crc32(id) % folds`` is not
    ``held_out``: about ``docs_per_language`` whole texts of each language, of at
    most ``max_bytes`` bytes each. Both bounds limit the fit only; every text is
    looked up whole.

    A null or empty text, or one without a letter, is ``und`` with score 0, and
    so is every text if there is nothing to learn from. Texts shorter than an
    n-gram have no hits: the first language with score 0. A null id stays null
    and is not held out. Repeated rows are judged alike. Other columns are not
    looked at; a kept one named like a result is replaced by it.
    """
    kept = kept_columns(docs, [id_col] if keep is None else keep, ["held_out", "lang_pred", "score", "n_grams"])
    samples = training_samples(docs, id_col, text_col, lang_col, folds, held_out, docs_per_language, max_bytes)
    model = LanguageFilters(tuple(fit_filter(*s) for s in samples) or (fit_filter([], []),))
    added = [F.coalesce(crc_class(F.col(id_col), folds) == held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("__text")]
    rows = docs.select(*as_numbered(kept), *added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**SLOT_BITS words for each MAX_LANGUAGES languages

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in byte_blocks(batches, "__text"):
            text = batch.column(len(kept) + 1)
            data, offsets = utf8(text)
            total, found = model.hits(data, offsets)
            best, score = decide(model, total, found)
            lettered = np.fromiter((t is not None and has_letter(t) for t in text.to_pylist()), bool, len(text))
            best = np.where(lettered & bool(model.languages), best, len(model.languages))
            score = np.where(best < len(model.languages), score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept) + 1], pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(total)],
                schema.names)

    schema = T.StructType([*numbered_fields(docs, kept), *T.StructType.fromDDL(
        "held_out boolean, lang_pred string, score double, n_grams bigint").fields])
    return rows.mapInArrow(judge, schema).select(*as_named(kept), *schema.names[len(kept):])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@query("op9_language")
def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))
