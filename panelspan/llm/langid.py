"""Language identification by rank-order profiles of character n-grams.

Text is lower-cased, every stretch of non-letters becomes one space, and the n-grams of one to three code points are
counted (the lone space is left out).  A profile is the list of the ``size`` most frequent n-grams, by count and then
by n-gram.  Language profiles come from all training documents: each task counts its own share, Spark adds up.  A
document takes the language with the smallest out-of-place distance: per n-gram of its profile the difference of the
two ranks, or ``size`` where the language lacks it.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any training document every
text is ``und``; ties between languages go to the smaller name, also for a text that shares no n-gram with any of them
(score 0), which ``keep_known`` rejects; a null doc_id counts as the empty text; repeated rows
are judged one by one; whole texts are counted however long; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspan.llm import common

UNKNOWN = "und"
PROFILE_SIZE = 300
_LIMIT = 0x34000            # beyond the last letter of Unicode, within 18 bits
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to the space for everything else."""
    if not _TABLE:
        table = np.full(_LIMIT + 1, 32, np.uint32)
        for i in range(_LIMIT):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 and ord(low) < _LIMIT else i
        _TABLE.append(table)
    return _TABLE[0]


def owner_of(heads: np.ndarray) -> np.ndarray:
    """Text number of each character, from the texts' first characters and the end."""
    return np.repeat(np.arange(len(heads) - 1), np.diff(heads))


def counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, count) of all n-grams of the texts; at most 1023 texts.

    An n-gram is up to three code points of 18 bits, the first in the highest bits, the missing ones zero.
    """
    n = len(offsets) - 1
    text = data[offsets[0]: offsets[-1]].tobytes().decode("utf-8")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    part = data[offsets[0]: offsets[-1]]
    heads = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets - offsets[0]]
    # a space before the first and after the last character of every text, then two zeros
    owner = np.repeat(np.arange(n), np.diff(heads) + 4)
    padded = np.zeros(len(owner), np.uint64)
    padded[np.arange(len(points)) + 4 * owner_of(heads) + 1] = _letters()[np.minimum(points, _LIMIT)]
    ends = heads[1:] + 4 * np.arange(n)
    padded[ends + 1] = 32
    padded[heads[:-1] + 4 * np.arange(n)] = 32
    keep = ~((padded == 32) & np.concatenate([[False], padded[:-1] == 32]))
    points, owner = padded[keep], owner[keep].astype(np.uint64) << np.uint64(54)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    # one sort of the three-grams; the shorter n-grams are their prefixes
    three = owner[:-2] | points[:-2] << np.uint64(36) | points[1:-1] << np.uint64(18) | points[2:]
    three = np.sort(three[points[:-2] != 0])
    first = np.flatnonzero(np.concatenate([[True], three[1:] != three[:-1]]))
    total = np.diff(np.append(first, len(three)))
    three = three[first]
    keys, sums = [], []
    for bits in (0, 18, 36):
        prefix = three >> np.uint64(bits)
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        key = prefix[first] << np.uint64(bits)
        own = (prefix[first] & np.uint64((1 << 18) - 1)) != 0        # the last code point of the n-gram
        if bits == 36:
            own &= (prefix[first] & np.uint64((1 << 18) - 1)) != 32  # not the lone space
        keys.append(key[own])
        sums.append(np.add.reduceat(total, first)[own])
    keys, sums = np.concatenate(keys), np.concatenate(sums)
    return (keys >> np.uint64(54)).astype(np.int64), (keys & np.uint64((1 << 54) - 1)).astype(np.int64), sums


def _pieces(batch, column: int):
    offsets, data = common.utf8(batch.column(column))
    for low, high in common.slices(offsets, 1 << 20):
        for a in range(low, high, 1000):
            b = min(a + 1000, high)
            yield a, b, data, offsets[a: b + 1]


def profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> dict[str, np.ndarray]:
    """Language to its ``size`` most frequent n-grams, learned from all rows (text, lang)."""
    common.ship(docs.sparkSession)

    def run(batches):
        held: dict[str, list] = {}
        rows = 0

        def merged(name):
            gram = np.concatenate([g for g, _ in held[name]])
            total = np.concatenate([c for _, c in held[name]])
            gram, at = np.unique(gram, return_inverse=True)
            return gram, np.bincount(at, weights=total).astype(np.int64)

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for a, b, data, offsets in _pieces(batch, 0):
                number, gram, total = counts(data, offsets)
                names = np.array(langs[a:b], dtype=object)
                for name in set(langs[a:b]):
                    mine = (names == name)[number]
                    held.setdefault(name, []).append((gram[mine], total[mine]))
                rows += len(gram)
                if rows > 2_000_000:
                    held = {name: [merged(name)] for name in held}
                    rows = 0
        for name in held:
            gram, total = merged(name)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(total)], ["lang", "gram", "n"])

    usable = docs.where("lang is not null and text is not null").select("text", F.col("lang").cast("string"))
    summed = usable.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = summed.withColumn("place", F.row_number().over(best)).where(F.col("place") <= size)
    out: dict[str, list] = {}
    for lang, gram in top.orderBy("lang", "place").select("lang", "gram").collect():   # size rows per language
        out.setdefault(lang, []).append(gram)
    return {lang: np.array(grams, np.int64) for lang, grams in out.items()}


def nearest(data: np.ndarray, offsets: np.ndarray, known: dict[str, np.ndarray], size: int = PROFILE_SIZE):
    """Index into ``sorted(known)`` (-1: no letter or no language) and closeness from 0 to 1 of each text."""
    n, names = len(offsets) - 1, sorted(known)
    best, score = np.full(n, -1), np.zeros(n)
    number, gram, total = counts(data, offsets)
    if not len(gram) or not names:
        return best, score
    grams = np.unique(np.concatenate(list(known.values())))
    ranks = np.full((len(grams) + 1, len(names)), -1, np.int64)
    for k, name in enumerate(names):
        ranks[np.searchsorted(grams, known[name]), k] = np.arange(len(known[name]))
    order = np.lexsort((gram, -total, number))
    number, gram = number[order], gram[order]
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    place = np.arange(len(number)) - np.repeat(first, np.diff(np.append(first, len(number))))
    keep = place < size
    number, gram, place = number[keep], gram[keep], place[keep]
    at = np.searchsorted(grams, gram)
    at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != gram)] = len(grams)
    theirs = ranks[at]
    distance = np.where(theirs < 0, size, np.abs(theirs - place[:, None]))
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    total = np.add.reduceat(distance, first, axis=0)
    length = np.diff(np.append(first, len(number)))
    best[number[first]] = total.argmin(axis=1)
    score[number[first]] = 1 - total.min(axis=1) / (length * size)
    return best, score


def identify(docs: DataFrame, known: dict[str, np.ndarray], size: int = PROFILE_SIZE) -> DataFrame:
    """doc_id, lang_pred and score (1: same ranks, 0: nothing in common) of every row."""
    common.ship(docs.sparkSession)
    names = sorted(known)

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in _pieces(batch, 1):
                best, score = nearest(data, offsets, known, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([names[k] if k >= 0 else UNKNOWN for k in best], pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5


def predict(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """Profiles from the folds 1 to 4, predictions for all rows: doc_id, held_out, lang_pred, score."""
    known = profiles(docs.where(fold() != 0), size)
    return identify(docs, known, size).select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, size: int = PROFILE_SIZE, least: float = 0.0) -> DataFrame:
    """The rows whose text shares an n-gram with its language (and has at least this score); all columns stay as they are."""
    common.ship(docs.sparkSession)
    known = profiles(docs.where(fold() != 0), size)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in _pieces(batch, at):
                best, score = nearest(data, offsets, known, size)
                yield batch.slice(a, b - a).filter(pa.array((best >= 0) & (score > 0) & (score >= least)))

    return docs.mapInArrow(run, schema)
