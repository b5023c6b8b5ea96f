"""Benchmark decontamination by canonical templates.

Numbers, names and units become typed placeholders, so a question that was asked again with other values gives the
same windows. Windows of documents and benchmark are joined on their hash; where they line up, the values that
stand in the placeholders must be renamed consistently (one value always to the same one, no two to one).
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratergrid.llm.common import WordCache, quoted, text_hash, whole_text
from ratergrid.llm.shingles import mix64
from ratergrid.session import stored

#: Words of a window, plain words it needs for placeholders to be used, and the share of an item's windows.
WIDTH, PLAIN, COVERAGE = 5, 2, 0.75
#: An item of fewer words says too little to be looked for inside a longer text.
SHORT = 3
#: Bits of the filter that goes to the tasks: its size is fixed, whatever the size of the benchmark.
FILTER_BITS = 27
_NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
            "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand "
            "million billion half third quarter dozen".split())
_UNITS = set("mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons "
          "oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min "
          "minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro "
          "euros usd eur percent degree degrees mph kmh kph".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d+(?:[.,:/]\d+)*(?:st|nd|rd|th)?[%$€£]?")
_FACE = re.compile(r"^[^\w$€£+-]+|[^\w%$€£]+$")
_IS_NUMBER, _IS_UNIT, _IS_CAPITAL, _ENDS = 1 << 32, 1 << 33, 1 << 34, 1 << 35
_HOLDERS = {name: xxhash.xxh64_intdigest(name) for name in ("<number>", "<unit>", "<name>")}
_MIX = np.random.default_rng(9).integers(1, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_code(word: str) -> int:
    """Hash (32 bits) and kinds of a word; -1 for a word of punctuation only."""
    face = word if word.isalnum() else _FACE.sub("", word)
    low = face.lower()
    if not face:
        return -1
    value = xxhash.xxh32_intdigest(low.encode("utf-8", "surrogatepass"))
    if low in _NUMBERS or not face[0].isalpha() and _NUMBER.fullmatch(face):
        value |= _IS_NUMBER
    elif face[0].isupper():
        value |= _IS_CAPITAL
    if low in _UNITS:
        value |= _IS_UNIT
    if word[-1] in ".!?:;|":
        value |= _ENDS
    return value


def _hashes(tokens: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows of ``width`` words that begin at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for i in range(width):
        out += tokens[at + i] * _MIX[i]
    return mix64(out + np.uint64(width))


def windows(text: str, words: WordCache) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """Word-for-word hashes of all windows, the words' hashes, which words may stand in a placeholder, and templates.

    A template is (places, hashes, words in placeholders). There are two: in one a capital counts as a name unless a
    sentence begins there, in the other each capital does, which does not depend on the words before. The second
    has only windows that differ from the first. A unit counts only after a number. A window with fewer than ``PLAIN``
    plain words has no template. A text of fewer than ``WIDTH`` words is one window of its own length.
    """
    code = np.fromiter(map(words.__getitem__, text.split()), np.int64)
    code = code[code >= 0]
    n = len(code)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), []
    value = (code & 0xFFFFFFFF).astype(np.uint64)
    number = code & _IS_NUMBER != 0
    begins = np.concatenate([[True], code[:-1] & _ENDS != 0])
    unit = (code & _IS_UNIT != 0) & np.concatenate([[False], number[:-1]])
    capital = (code & _IS_CAPITAL != 0) & ~unit
    plain = mix64(value)
    width = min(n, WIDTH)
    before, templates = np.zeros(n - width + 1, np.int64), []
    for name in (capital & ~begins, capital):
        held = number | unit | name
        total = np.concatenate([[0], np.cumsum(held)])
        held_words = total[width:] - total[:-width]
        at = np.flatnonzero((held_words > before) & (width - held_words >= PLAIN))
        token = np.where(number, np.uint64(_HOLDERS["<number>"]), np.where(
            unit, np.uint64(_HOLDERS["<unit>"]), np.where(name, np.uint64(_HOLDERS["<name>"]), plain)))
        templates.append((at, _hashes(token, width, at), held))
        before = held_words
    return _hashes(plain, width, np.arange(n - width + 1)), value, held, templates


def _rows(batches: Iterator[pa.RecordBatch], marks) -> Iterator[pa.RecordBatch]:
    """Windows of texts (id, row, text hash, text), those that the filter lets through if there is one.

    With a filter, texts also have word-for-word windows of the lengths that items of three and four words have.
    """
    words, bits, widths = WordCache(word_code), None, []
    if marks is not None:
        places, sets, widths = marks.value
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        bits[places] = sets
    for batch in batches:
        ids, rows, hashes, texts = (batch.column(i) for i in range(4))
        owner, at, total, found, slots, exact, width = [], [], [], [], [], [], []
        for i, text in enumerate(texts):
            keys, value, held, templates = windows(text.as_py(), words)
            n, plain = len(value), mix64(value)
            own = min(n, WIDTH)
            forms = [(np.arange(len(keys)), keys, held, own, True)]
            forms += [(places, keys_, held_, own, False) for places, keys_, held_ in templates]
            for w in widths:
                if w < own:
                    all_places = np.arange(n - w + 1)
                    forms.append((all_places, _hashes(plain, w, all_places), held, w, True))
            for places, form_keys, form_held, w, verbatim in forms:
                if bits is not None and len(places):
                    low = form_keys & np.uint64((1 << FILTER_BITS) - 1)
                    hit = np.flatnonzero(
                        bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1))
                    places, form_keys = places[hit], form_keys[hit]
                if not len(places):
                    continue
                owner.append(np.full(len(places), i))
                at.append(places)
                total.append(np.full(len(places), len(keys)))
                found.append(form_keys.view(np.int64))
                exact.append(np.full(len(places), verbatim))
                width.append(np.full(len(places), w))
                for h in places.tolist():
                    part = slice(h, h + w)
                    slots.append(value[part][form_held[part]].astype(np.int64).tolist())
        join = lambda parts, kind=np.int64: np.concatenate([np.zeros(0, kind), *parts])
        owner = pa.array(join(owner), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids.take(owner), rows.take(owner), hashes.take(owner), pa.array(join(at)), pa.array(join(total)), pa.array(join(found)),
             pa.array(slots, pa.list_(pa.int64())), pa.array(join(exact, bool)), pa.array(join(width))],
            names=["_id", "_row", "_hash", "_at", "_total", "_key", "_slots", "_exact", "_width"])


def _windows_of(df: DataFrame, id_col: str, text_col: str, marks=None) -> DataFrame:
    source = df.select(F.col(quoted(id_col)).alias("_id"), F.monotonically_increasing_id().alias("_row"),
                       text_hash(text_col).alias("_hash"), whole_text(text_col).alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(functools.partial(_rows, marks=marks),
                             f"_id {kind}, _row long, _hash long, _at long, _total long, _key long, _slots array<long>, "
                             "_exact boolean, _width long")


def _filter_bits(spark: SparkSession, items: DataFrame):
    """A bit for each window of the benchmark: at most 2^FILTER_BITS bits, however many windows there are; and the
    lengths of its items that are shorter than a window, from ``SHORT`` words on.

    More windows than bits let more documents' windows through to the join; the result is the same.
    """
    low = F.col("_key").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = items.select(F.shiftright(low, 6).alias("_w"), F.expr("shiftleft(1L, CAST(_key & 63 AS INT))").alias(
        "_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b")).toPandas()
    widths = sorted(r["_width"] for r in items.where(F.col("_width").between(SHORT, WIDTH - 1)).select("_width").distinct().collect())
    return spark.sparkContext.broadcast(
        (words["_w"].to_numpy(np.int64), words["_b"].to_numpy(np.int64).view(np.uint64), widths))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated row of ``docs`` and benchmark item: doc_id, item_id, matched_windows, item_windows,
    coverage, verbatim (no value was changed), text_hash.

    An item is found when at least ``coverage`` of its windows occur in the document, word for word or with values that
    are renamed consistently within each alignment. NULL, empty and blank texts on either side match nothing; an item
    of three or four words is found wherever just these words stand, and with other values only where a document
    has no more words; one of one or two words only where it is the whole document, since such words stand in many
    texts that have nothing to do with it. Rows that repeat are reported again for each
    row; NULL ids are reported as NULL. If either table is empty the result is. Other columns are not read.
    """
    spark = docs.sparkSession
    items = stored(_windows_of(benchmark, item_col, item_text_col), "items")
    found = stored(_windows_of(docs, id_col, text_col, _filter_bits(spark, items)), "found")
    known = items.select(F.col("_id").alias("item_id"), F.col("_row").alias("_item"), F.col("_at").alias("_item_at"),
                        F.col("_total").alias("item_windows"), "_key", F.col("_slots").alias("_item_slots"), "_exact")
    met = found.drop("_exact").join(known, "_key").where(F.col("_exact") | (F.size("_slots") == F.size("_item_slots")))
    # Word for word the values are the item's; which of them count as names may differ with the words before.
    pairs = F.transform(F.arrays_zip("_item_slots", F.when(F.col("_exact"), F.col("_item_slots")).otherwise(
        F.col("_slots")).alias("_slots")), lambda z: F.struct(z["_item_slots"].alias("a"), z["_slots"].alias("b")))
    doc = [F.first(c, True).alias(n) for c, n in (("_id", "doc_id"), ("_hash", "text_hash"))]
    item = [F.first(c, True).alias(c) for c in ("item_id", "item_windows")]
    lines = met.groupBy("_row", "_item", (F.col("_at") - F.col("_item_at")).alias("_line")).agg(
        *doc, *item, F.collect_set(F.struct(F.col("_item_at").alias("place"), pairs.alias("names"))).alias("_places"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("_names"))
    distinct = lambda field: F.size(F.array_distinct(F.transform("_names", lambda z: z[field])))
    same = (distinct("a") == F.size("_names")) & (distinct("b") == F.size("_names"))
    torn = F.filter("_names", lambda p: (p["a"] != p["b"]) & (F.size(F.filter(
        "_names", lambda q: (q["a"] == p["a"]) | (q["b"] == p["b"]))) > 1))
    lines = lines.withColumn("_torn", F.when(~same, torn)).withColumn("_places", F.when(same, F.col("_places")).otherwise(
        F.filter("_places", lambda z: ~F.arrays_overlap(z["names"], F.col("_torn")))))
    places = lines.select(
        "_row", "_item", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "item_id", "item_windows",
        F.explode("_places").alias("_one")).withColumns({
            "_place": F.col("_one.place"), "_verbatim": F.forall("_one.names", lambda z: z["a"] == z["b"])})
    each = places.groupBy("_row", "_item", "_place").agg(*doc, *item, F.max("_verbatim").alias("_verbatim"))
    found = each.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"}).groupBy("_row", "_item").agg(
        *doc, *item, F.count("*").alias("matched_windows"), F.min("_verbatim").alias("verbatim"))
    return found.where(F.col("matched_windows") >= coverage * F.col("item_windows")).select(
        "doc_id", "item_id", "matched_windows", "item_windows",
        (F.col("matched_windows") / F.col("item_windows")).alias("coverage"), "verbatim", "text_hash")
