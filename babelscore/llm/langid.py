"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and turned into code points; runs of characters that are no letters become one
gap. Its character 1- to 3-grams (gaps included, so word ends count) are hashed into ``BINS`` bins.
Training counts bins per language over a bounded, documented sample of labelled documents: at most
about ``per_language`` documents of each language, chosen by a hash of the document id, the same at
every size. The log-probability matrix (languages x bins, so its size is bounded) is broadcast, and
each slice of texts is scored in numpy: its grams' log-probabilities are summed per document.

``score`` is the posterior of the predicted language, with the evidence of long texts scaled down to
``EVIDENCE`` grams so that it stays informative. ``und`` with score 0 if a text is null or has no
letter, or if there was nothing to learn from. Rows with a null language are not learnt from; a null
document id is never held out and never learnt from. Ties go to the language first in code order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

BITS = 14
BINS = 1 << BITS
ORDERS = (1, 2, 3)
EVIDENCE = 100
SMOOTHING = 0.5
PER_LANGUAGE = 10_000
MAX_LANGUAGES = 256
UNKNOWN = "und"
GAP = 0x20


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letter_table() -> np.ndarray:
    """Whether each code point is a letter, by Python's Unicode tables."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


_LETTERS: list[np.ndarray] = []


def letters(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    return _LETTERS[0][codes]


def grams(texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order, the bins of all grams and the document of each (in document order); and whether
    a document has a letter."""
    low = [f" {t.lower()} " if t else " " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    is_letter = letters(codes)
    has = np.bincount(doc[is_letter], minlength=len(low)) > 0
    # One gap for each run without letters.
    keep = is_letter.copy()
    keep[1:] |= ~is_letter[1:] & (is_letter[:-1] | (doc[1:] != doc[:-1]))
    keep[:1] = True
    codes, doc = np.where(is_letter, codes, GAP)[keep].astype(np.uint32), doc[keep]
    out = []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            out.append((np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)))
            continue
        h = np.full(m, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i:i + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        inside = doc[:m] == doc[n - 1:]
        if n == 1:
            inside &= codes != GAP
        out.append(((h[inside] >> np.uint32(32 - BITS)).astype(np.int32), doc[:m][inside]))
    return out, has


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in code order, and the log-probability matrix (languages x bins, float32)."""
    labelled = (documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                                 F.col(lang).cast("string").alias("lang"))
                .filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
             .limit(max_languages + 1).collect()}
    if len(sizes) > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((0, BINS), dtype=np.float32)
    # Of n documents a share of per_language / n, by a hash of the id.
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    picked = labelled.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0) < share[F.col("lang")])
    index = {k: i for i, k in enumerate(langs)}

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        which = np.array([index[x] for x in part.column(2).to_pylist()], dtype=np.int64)
        table = np.zeros(len(langs) * BINS, dtype=np.int64)
        for bins, owner in grams(part.column(1).to_pylist())[0]:
            table += np.bincount(which[owner] * BINS + bins, minlength=len(langs) * BINS)
        at = np.flatnonzero(table)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["cell", "n"])

    cells = map_texts(picked, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = cells.toPandas()  # at most languages x bins rows
    counts = np.zeros(len(langs) * BINS)
    counts[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.float64)
    counts = counts.reshape(len(langs), BINS) + SMOOTHING
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def score(texts: list[str | None], langs: list[str], weights: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    orders, has = grams(texts)
    n = np.zeros(len(texts), dtype=np.int64)
    total = np.zeros((len(texts), len(langs)))
    for bins, owner in orders:
        if len(bins):
            n += np.bincount(owner, minlength=len(texts))
            cut = np.flatnonzero(np.diff(owner, prepend=-1))
            for k in range(len(langs)):
                total[owner[cut], k] += np.add.reduceat(weights[k][bins], cut)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    scaled = total * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
    p = np.exp(scaled - scaled.max(axis=1, keepdims=True))
    p = p.max(axis=1) / p.sum(axis=1)
    known = has & (n > 0)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, p, 0.0)


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray] | None = None, doc_id: str = "doc_id",
             text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, all columns and rows, with ``lang_pred`` and ``lang_score`` (columns of these names
    are replaced)."""
    documents = documents.drop("lang_pred", "lang_score")
    langs, weights = model if model is not None else train(documents, doc_id, text, lang)
    held = documents.sparkSession.sparkContext.broadcast((langs, weights))
    names = documents.columns

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        found, p = score(part.column(names.index(text)).to_pylist(), *held.value)
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(p)],
                                          [*names, "lang_pred", "lang_score"])
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return map_texts(documents, fn, schema, text=text)


def recognised(documents: DataFrame, model: tuple[list[str], np.ndarray] | None = None, least: float = 0.5, text: str = "text",
               **columns) -> DataFrame:
    """The documents, with all their columns, that are in a learned language with at least that score."""
    model = model if model is not None else train(documents, text=text, **columns)
    found = identify(documents.select(F.struct("*").alias("row"), F.col(text).alias("text")), model)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)).select("row.*")
