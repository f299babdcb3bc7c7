"""Removal of lines that resemble an earlier line: an exact set-similarity join in DataFrame operations only.

A line is the set of its words (white space between, lower case).  It goes if an earlier line of the corpus, by
(doc_id, line number), has a Jaccard similarity of ``4/5`` or more with it, be that line kept or not.  Only blank lines,
which have no words, are not compared and stay.

Equal lines are one class with the place of its first occurrence; later occurrences go.  For different lines the words
are ordered by rarity (a table of 262,144 hashed counts over all distinct lines, so its size is fixed).  Lines that match
share a word among their rarest ``n - ceil(4n/5) + 1``, have lengths within a factor of 4/5, and share that word at
positions that leave room for the needed overlap: both conditions are one number per entry, the longest partner that it
allows.  A parity bitmap of each line's words bounds how many differ.  Lines of up to
three different words can only match an equal set, so they share the hash of the whole set in place of a word.  Candidates come in two rounds, so that groups of copies do not pair up:
first each line against the earliest line of every shared word, then only lines without a match so far against the
other earlier lines, both from one shuffle of the entries.  Every candidate is verified on the whole sets, in which 64-bit
hashes stand for the words.

Defined results: null texts stay null, empty texts have no lines; a null doc_id comes before all others; repeated rows
are judged alike, and of lines at the same place (same doc_id and number) none is earlier than another, so such lines
stay unless an earlier place has a similar one; lines of any length are compared whole; an empty table stays empty; other columns are kept as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelspan.llm import common

CELLS = 1 << 18
PARTS = 2                   # shares of the words whose entries are shuffled one after the other in the second round

_LINES = r"split(text, '\n')"
_BLANKS = [r"'\t'", r"'\r'", "char(11)", "char(12)"]               # besides the space; splitting at one letter is the cheap case
_SPACED = f"if({' or '.join(f'contains(line, {b})' for b in _BLANKS)}, translate(line, concat({', '.join(_BLANKS)}), '    '), line)"
_WORDS = f"array_except(transform(split(lower({_SPACED}), ' '), w -> xxhash64(w)), array(xxhash64('')))"      # distinct ones
# parity bits: each word flips one of 64; of longer lines b0 has the flips by one half of all words, so that b0 and b0 ^ b1
# are 128 bits, as lines of some hundred words differ in about half of 64 bits whatever their words are
LONG = 64
_FLIPS = "aggregate(words, 0L, (x, w) -> x ^ shiftleft({}, cast(shiftrightunsigned(w, 58) as int)))"
_BITS = [f"if(size(words) > {LONG}, {_FLIPS.format('w & 1L')}, 0L) b0", f"{_FLIPS.format('1L')} b1"]
_BANKS = ["b0", "b1"]
_OVERLAP = "9 * overlap >= 4 * (n_a + n_b)"                      # Jaccard >= 4/5, in integers
# cells give a byte per word, whose number crc32 reads back at the least cost; by this order of bytes it grows with the level
_LEVELS = np.array(sorted(range(256), key=lambda b: zlib.crc32(bytes([b]))), dtype=np.uint8)


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """Lines of all documents: row (hash of id and text), id (of the document), number, line, class (hash of the line)."""
    rows = docs.selectExpr("xxhash64(doc_id, text) row", "coalesce(cast(doc_id as long), -9223372036854775808) id", "cast(text as string) text").where("text <> ''")
    return rows.selectExpr("row", "id", f"posexplode({_LINES}) as (number, line)").selectExpr("row", "id", "number", *more, "xxhash64(trim(line)) class")


def _cell(word: Column) -> Column:
    return F.shiftrightunsigned(word, 64 - CELLS.bit_length() + 1).cast("int")


def _rarity(classes: DataFrame) -> bytes:
    """One byte per cell of hashed words (from the second cell on; the first has the second one's): how common its words are, on a logarithmic scale."""
    cells = classes.selectExpr("explode(words) word").groupBy(_cell(F.col("word")).alias("cell")).agg(F.count("*").cast("int").alias("n"))
    cells = cells.toArrow()                                        # CELLS rows at most
    counts = np.zeros(CELLS)
    counts[np.array(cells.column("cell"))] = np.array(cells.column("n"))
    return _LEVELS[np.minimum(4 * np.log2(counts[1:] + 1), 126).astype(np.uint8)].tobytes()


def _prefixes(classes: DataFrame, rarity: bytes) -> DataFrame:
    """Per class: its document, n (its words), b0 and b1 (parity bits) and rare (its rarest words, rarest first, as integers)."""
    # rarity in the high bits, the hash in the others; this runs for every word of the corpus, so it has few steps
    table = F.lit(bytearray(rarity))
    # never null, and said so, as only then the numbers are sorted as such
    key = lambda w: F.coalesce(F.shiftleft(F.crc32(F.substring(table, _cell(w), F.lit(1))), 31).bitwiseOR(F.shiftrightunsigned(w, 33)), F.lit(0))
    rows = classes.selectExpr("class", "place.id", "words", "size(words) n", *_BITS)
    rows = rows.select("class", "id", "n", *_BANKS, F.sort_array(F.transform("words", key)).alias("ordered"))
    rare = "if(n <= 3, array(hash(ordered)), transform(slice(ordered, 1, n - (4 * n + 4) div 5 + 1), w -> hash(w)))"     # 3/4 is less than 4/5
    return common.staged(rows.selectExpr("class", "id", "n", *_BANKS, f"{rare} rare"), "line-prefixes")


def _entries(prefixes: DataFrame, *more: str) -> DataFrame:
    """Per word of the prefixes: word, class, id, n, reach (the longest line that can match by this word), b0, b1.

    A word at position i leaves n - i words to share, and 9 (n - i) >= 4 (n + m) is needed for a line of m words.
    """
    rows = prefixes.selectExpr("class", "id", "n", *_BANKS, *more, "posexplode(rare) as (position, word)")
    rows = rows.selectExpr("word", "class", "id", "n", "cast((5 * n - 9 * position) div 4 as int) reach", *_BANKS, *more)
    # nothing is null: said here, so that the join's condition, which runs for every pair, need not look
    return rows.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns))


def _verified(parts: list[DataFrame], classes: DataFrame) -> DataFrame:
    """The later class of each pair (a, b) that is similar; of lines at the same place (of repeated doc_ids) neither is later."""
    # written first, so that its measured size decides how the words are fetched, once for both sides of the pairs
    pairs = common.staged(reduce(DataFrame.unionByName, parts).distinct(), "line-candidates")
    common.drop(*parts)
    wanted = common.staged(pairs.selectExpr("inline(array(struct(a as class), struct(b as class)))").distinct(), "line-wanted")
    lines = common.staged(classes.select("class", "place", "words").join(wanted.hint("shuffle_hash"), "class", "left_semi"), "line-words")
    common.drop(wanted)
    # one form of join whatever the sizes, here and elsewhere, so that a small table shows what a large one needs: hashed where
    # one side has a short row per key at most (its share of a partition is held), else merged
    pairs = pairs.join(lines.withColumnsRenamed({"class": "a", "place": "place_a", "words": "words_a"}).hint("merge"), "a") \
        .join(lines.withColumnsRenamed({"class": "b", "place": "place_b", "words": "words_b"}).hint("merge"), "b")
    counted = pairs.where("place_a <> place_b").selectExpr("if(place_a > place_b, a, b) a", "size(words_a) n_a", "size(words_b) n_b", "size(array_intersect(words_a, words_b)) overlap")
    return counted.where(_OVERLAP).select("a").distinct()


def _by_parts(pairs: Callable[[str], DataFrame], parts: int) -> list[DataFrame]:
    """Pairs (a, b) over all words, a share of the words at a time, so that only that share's shuffles lie on disk."""
    return [common.staged(pairs(f"pmod(word, {parts}) = {i}").select("a", "b").distinct(), "line-pairs") for i in range(parts)]


#: Length, position and bitmap filters: no pair that they drop can be similar, as similar lines differ in a ninth of their
#: words at most.  Words in only one of two lines are at least as many as the bits in which they differ.
_FITS = "n_b <= reach_a and n_a <= reach_b and 9 * bit_count(b1_a ^ b1_b) <= n_a + n_b"
_FITS_LONG = f"(n_a <= {LONG} or n_b <= {LONG} or 9 * (bit_count(b0_a ^ b0_b) + bit_count(b0_a ^ b1_a ^ b0_b ^ b1_b)) <= n_a + n_b)"


def similar_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All classes of lines that are not blank (class, place of the first occurrence, occurrences, hashes of the words), and those that resemble an earlier class."""
    place = F.struct("id", "number")
    classes = _lines(docs, "line").groupBy("class").agg(F.min(place).alias("place"), F.count("*").alias("occurrences"), F.first("line").alias("line"))
    # the generator keeps the words from being computed again for the filter
    classes = classes.selectExpr("class", "place", "occurrences", f"inline(array(struct({_WORDS} as words)))").where("size(words) > 0")
    classes = common.staged(classes, "line-classes")
    prefixes = _prefixes(classes, _rarity(classes))
    word = Window.partitionBy("word")

    def stars(part: str) -> DataFrame:
        # only words that may match a line of equal length or more: no similar pair is without one in the shorter line,
        # and what this round does not see is left to the next
        centered = _entries(prefixes).where(f"reach >= n and {part}").withColumn("center", F.min(F.struct("id", "class", "n", "reach", *_BANKS)).over(word))
        sides = [f"{c} {c}_a" for c in ("n", "reach", *_BANKS)] + [f"center.{c} {c}_b" for c in ("n", "reach", *_BANKS)]
        return centered.selectExpr("class a", "center.class b", *sides).where(f"a <> b and {_FITS} and {_FITS_LONG}")

    first = common.staged(_verified(_by_parts(stars, 1), classes), "line-matches")
    flagged = prefixes.join(first.selectExpr("a class", "1 matched").hint("shuffle_hash"), "class", "left").withColumn("matched", F.expr("coalesce(matched, 0)"))
    flagged = common.staged(flagged, "line-flagged")
    common.drop(prefixes)

    def others(part: str) -> DataFrame:
        entries = _entries(flagged, "matched").where(part).repartition("word")
        # one shuffle serves both sides: the shorter line (or one of the same length) needs only the words that reach its
        # own length, which are dropped by a generator, as a filter would be moved before the shuffle and make it two
        shorter = entries.select("*", F.explode(F.expr("if(reach >= n, array(0), array())")).alias("kept"))
        x, y = (side.select("word", *(F.col(c).alias(f"{c}_{name}") for c in entries.columns[1:])) for side, name in ((shorter, "a"), (entries, "b")))
        once = "(n_a < n_b or class_a < class_b)"
        later = "(id_a >= id_b and matched_a = 0 or id_b >= id_a and matched_b = 0)"                # the later one is not matched yet
        pairs = x.join(y.hint("merge"), "word").where(f"n_a <= n_b and {_FITS}")
        # few pairs come so far: the other conditions stay out of the join, which reads all columns of its condition per pair
        return pairs.selectExpr("class_a a", "class_b b", f"explode(if({_FITS_LONG} and {once} and {later}, array(0), array())) as kept")

    # of two lines the later one is matched, whichever of them was looked for
    second = _verified(_by_parts(others, PARTS), classes)
    return classes, common.staged(first.unionByName(second).distinct(), "line-matches")


def removals(docs: DataFrame) -> DataFrame:
    """row (hash of a document's id and text) and numbers (its lines to remove), for documents that lose lines."""
    classes, similar = similar_classes(docs)
    rules = classes.join(similar.withColumnRenamed("a", "class").withColumn("similar", F.lit(True)).hint("shuffle_hash"), "class", "left") \
        .where("similar or occurrences > 1").selectExpr("class", "place", "coalesce(similar, false) similar")
    gone = _lines(docs).join(rules.hint("shuffle_hash"), "class").where("similar or place.id <> id or place.number <> number")
    return gone.groupBy("row").agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without the lines to remove; all rows and columns stay."""
    gone = _removed_lines(docs)
    # the document travels as one struct, whatever its columns are called
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"), F.expr("xxhash64(doc_id, text)").alias("row"))
    kept = F.expr(r"case when numbers is null then doc.text else array_join(filter(split(doc.text, '\n'), (line, i) -> not array_contains(numbers, i)), '\n') end")
    return keyed.join(gone.hint("shuffle_hash"), "row", "left").select(*(kept.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))


def _removed_lines(docs: DataFrame) -> DataFrame:
    with common.scratch():
        return common.staged(removals(docs), "line-removals", keep=True)


def summary(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 (of the remaining text)."""
    gone = _removed_lines(docs)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text", "xxhash64(doc_id, text) row")
    left = r"array_join(filter(split(text, '\n'), (line, i) -> not array_contains(numbers, i)), '\n')"
    return rows.join(gone.hint("shuffle_hash"), "row", "left").selectExpr(
        "doc_id", r"cast(if(text = '', 0, octet_length(text) - octet_length(replace(text, '\n', '')) + 1) as long) n_lines", "cast(coalesce(size(numbers), 0) as long) n_removed",
        f"sha2(if(numbers is null, text, {left}), 256) kept_sha256")
