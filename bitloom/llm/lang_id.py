"""Language of a text by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, the first permuted twice and the
second once; a text is the sum of its trigrams, a language the sum of its training texts. The prediction is the language whose
sum has the largest cosine with the text.

Sums are linear, so a task counts trigrams per language first and multiplies by the vectors once; one row of ``DIM``
integers per language and task is shuffled, and one per language reaches the driver.

Defined results: a null text and one without a letter give ``und`` with score 0; so does every text if there is no training row;
a tie goes to the language that sorts first; a null id counts as the empty string when rows are drawn; repeated rows
give repeated rows; long texts are read in slices, as a whole; other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
SEED = 20
SYMBOLS = 40  # 0: no letter, 1 to 26: a to z, above: classes of other letters
CODES = SYMBOLS**3
SLICE = 1 << 20
MAX_LANGS = 64  # counts of so many languages are held by a task before they are summed and sent


def _symbols() -> np.ndarray:
    """Symbol of each code point."""
    out = np.zeros(0x110000, np.uint8)
    others = SYMBOLS - 27
    for i in range(0x110000):
        if chr(i).isalpha():
            out[i] = 27 + i % others
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


_CACHE: dict[str, np.ndarray] = {}


def _cached(name: str, make) -> np.ndarray:
    if name not in _CACHE:
        _CACHE[name] = make()
    return _CACHE[name]


def letters() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SYMBOLS, DIM)).astype(np.int8) * 2 - 1


def bound(codes: np.ndarray) -> np.ndarray:
    """Vectors of trigrams."""
    vec = _cached("letters", letters)
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(vec, 2, 1)[a] * np.roll(vec, 1, 1)[b] * vec[c]


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the trigrams of letters; what is no letter counts as one space between words."""
    table = _cached("symbols", _symbols)
    counts, tail = np.zeros(CODES, np.int64), np.zeros(1, np.int64)
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "replace"), np.uint32)
        sym = np.concatenate([tail, table[points]])
        if at + SLICE >= len(text):
            sym = np.append(sym, 0)
        sym = sym[np.concatenate([[True], (sym[1:] != 0) | (sym[:-1] != 0)])]
        if len(sym) > 2:
            counts += np.bincount((sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:], minlength=CODES)
        tail = sym[-2:]
    return counts


def _sum_of(counts: np.ndarray) -> np.ndarray:
    used = np.flatnonzero(counts)
    total = np.zeros(DIM)
    for at in range(0, len(used), 4096):
        part = used[at : at + 4096]
        total += counts[part].astype(np.float32 if counts.max() < 1 << 12 else np.float64) @ bound(part)
    return total


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == 0


def _profile_sums(batches) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}

    def flush():
        rows = [(lang, _sum_of(c).astype(np.int64)) for lang, c in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.int64()))], ["lang", "total"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in counts:
                if len(counts) == MAX_LANGS:
                    yield flush()
                counts[lang] = np.zeros(CODES, np.int64)
            counts[lang] += trigram_counts(text.as_py())
    if counts:
        yield flush()


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and the unit vector of each. Every given row with a text and a language is read."""
    rows = rows.select(rows[lang_col].alias("lang"), rows[text_col].alias("t")).dropna()
    sums = rows.mapInArrow(_profile_sums, "lang string, total array<bigint>")
    sums = sums.select("lang", F.posexplode("total").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))
    found = {r["lang"]: np.array(r["total"], float) for r in sums.collect()}
    langs = sorted(k for k, v in found.items() if np.any(v))
    unit = [found[k] / np.linalg.norm(found[k]) for k in langs]
    return langs, np.array(unit).reshape(len(langs), DIM)


def predict(
    docs: DataFrame, profiles: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, lang_pred, score: the cosine, 0 where it is negative. profiles are DIM numbers per language."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"))
    out = rows.mapInArrow(_predictor(*profiles), f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def judged(text: str | None, langs: list[str], unit: np.ndarray) -> tuple[str, float]:
    if not text or not langs or not any(map(str.isalpha, text)):
        return "und", 0.0
    total = _sum_of(trigram_counts(text))
    norm = np.linalg.norm(total)
    if not norm:
        return "und", 0.0
    cos = unit @ total / norm
    best = int(np.argmax(cos))
    return langs[best], float(min(1.0, max(0.0, cos[best])))


def _predictor(langs: list[str], unit: np.ndarray):
    def run(batches):
        for batch in batches:
            found = [judged(t.as_py(), langs, unit) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["id", "lang_pred", "score"])

    return run


def identified(
    docs: DataFrame, profiles: tuple[list[str], np.ndarray], text_col: str = "text", min_score: float = 0.0
) -> DataFrame:
    """The rows, with all their columns, whose text has a language with at least ``min_score``."""
    langs, unit = profiles

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        found = [judged(t, langs, unit) for t in texts]
        return pd.Series([lang != "und" and score >= min_score for lang, score in found], dtype=bool)

    return docs.filter(accepted(docs[text_col]))
