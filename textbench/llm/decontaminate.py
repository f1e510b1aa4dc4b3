"""Operator 7: benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, units after a number, and names (capital
words) become typed placeholders; all others lower case without outer
punctuation.  A capital word at the start of a text, sentence or line may be a
name or not, so its windows are made in every form, with it as a literal and as a
name; where a text is wrapped or a sentence begins thus loses no match.  Windows of ``window`` template tokens of documents
and benchmark items meet in a hash join.  Windows of one document, item and
offset form an alignment; an alignment whose item slots do not map to document
slots as a function is inconsistent, and only its windows with equal slots
count, and those without doubtful names if their slots alone map.  A document is contaminated by an item when its good windows cover
``min_cover`` of the item's windows; the same question with other numbers, names
or units is caught, too.

Items shorter than a window are one window.  A template window needs
``min_literal`` literal tokens (or all of a shorter item's), so that placeholders
alone never match.  An item's windows under that minimum are raw windows: they
meet windows of the same words, slot values included, so a verbatim copy is found
however few literals it has.  Cover is the larger share of the item's template
windows and of all its windows.  Windows that no item has are dropped before the join where the
benchmark's window hashes are few enough to ship (``MOST_SHIPPED``, counted
first); beyond that all windows are joined.

Null text or item: no windows.  Null ``doc_id`` or ``item_id``: left out of the
pairs.  Repeated rows give the pair once.  Empty tables give no pairs.  Other
columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, _tables, documents, mix, pieces, ragged, span_hashes, text_bytes, written

WINDOW = 8
MIN_LITERAL = 4
MIN_COVER = 0.5
#: Benchmark window hashes shipped to every task (8 bytes each).
MOST_SHIPPED = 1_000_000

#: Units recognised after a number.
UNITS = frozenset("""
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres
kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml litre
litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month
months year years cent cents dollar dollars euro euros percent degree degrees mph kmh km/h m/s
""".split())
_NUMBER = re.compile(r"[$€£¥]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%|°)?$")
_EDGE = ".,;:!?\"'()[]{}«»“”‘’¿¡…"
LITERAL, NUMBER, NAME, UNIT = range(4)
_RAW = U64(0xD6E8FEB86659FD93)


def _types(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, template hash and value hash of each word, and whether a literal may
    be a name (a capital word where any word has a capital)."""
    distinct, first, entry = np.unique(words.hashes(), return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    n = len(distinct)
    number, unit, capital, stop = (np.zeros(n, bool) for _ in range(4))
    plain = []
    for i, at in enumerate(first):
        word = raw[words.starts[at]:words.ends[at]].decode("utf-8", "replace")
        bare = word.strip(_EDGE)
        low = bare.lower()
        stop[i] = word[-1] in ".!?:…\"”»" or not bare
        if _NUMBER.match(bare):
            number[i] = True
        elif low in UNITS:
            unit[i] = True
        else:
            capital[i] = len(bare) > 1 and bare[0].isupper() and not bare.isupper()
        plain.append(low.encode())
    ends = np.cumsum([0] + [len(p) for p in plain])
    value = span_hashes(np.frombuffer(b"".join(plain), np.uint8), ends[:-1], ends[1:]) if n else distinct
    kind = np.where(number[entry], NUMBER, LITERAL)
    before = np.zeros(len(entry), bool)
    before[1:] = number[entry][:-1]
    starts = words.first[:-1][words.counts > 0]
    before[starts] = False
    kind[unit[entry] & before] = UNIT
    inside = np.ones(len(entry), bool)
    inside[1:] = ~stop[entry][:-1]
    inside[starts] = False
    lines = np.flatnonzero(words.data == 10)
    inside[np.searchsorted(words.starts, lines)[np.searchsorted(words.starts, lines) < len(entry)]] = False
    kind[capital[entry] & inside] = NAME
    value = value[entry]
    doubtful = capital[entry] & (kind == LITERAL)
    return kind, np.where(kind == LITERAL, value, mix(kind.astype(U64))), value, doubtful


def _forms(template: np.ndarray, doubtful: np.ndarray, at: np.ndarray, literals: np.ndarray, size: int, least: int):
    """(window, hash, names) of each form of the windows at ``at`` that keeps
    ``least`` literals; ``names`` has a bit for each doubtful word taken as a name."""
    power, inverse = _tables(len(template) + 1)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(template * power[:len(template)], dtype=U64)])
    total = (sums[at + size] - sums[at]) * inverse[at]
    where = np.flatnonzero(doubtful)
    before = np.concatenate([[0], np.cumsum(doubtful)])
    first, count = before[at], before[at + size] - before[at]
    change = mix(np.array([NAME], U64))[0] - template
    held = np.flatnonzero(literals >= least)
    for form in range(1 << int(count.max(initial=0))):
        if form.bit_count() == 1:  # the first form with so many doubtful words
            held = held[count[held] >= form.bit_length()]
        chosen = held[literals[held] - form.bit_count() >= least]
        if not len(chosen):
            continue
        hashes, names = total[chosen] + U64(size), np.zeros(len(chosen), U64)
        for i in range(form.bit_length()):
            if form >> i & 1:
                word = where[first[chosen] + i]
                offset = word - at[chosen]
                hashes += change[word] * power[offset]
                names |= U64(1) << offset.astype(U64)
        yield chosen, mix(hashes), names


def _sieve(wanted: np.ndarray) -> np.ndarray:
    """A table by leading bits of a hash: whether any of ``wanted`` begins with them."""
    bits = max(16, len(wanted).bit_length() + 4)
    table = np.zeros(1 << bits, bool)
    table[wanted >> U64(64 - bits)] = True
    return table


def _windows(batch, name: str, window: int, min_literal: int, sizes, wanted: np.ndarray | None,
             sieve: np.ndarray | None):
    """Template windows of a batch, and raw ones.  ``sizes`` has (size, raw) of the
    windows to make; None: a benchmark's, each item by windows of its own size,
    min(window, words), raw where literals are too few."""
    words = Words(*text_bytes(batch.column("text")))
    kind, template, value, doubtful = _types(words)
    document = words.document()
    slot = np.concatenate([[0], np.cumsum(kind != LITERAL)])
    may = np.concatenate([[0], np.cumsum(doubtful)])
    out = []
    for size, raw in sizes if sizes is not None else [(n, r) for n in range(1, window + 1) for r in (False, True)]:
        at = words.windows(size)
        if sizes is None and size < window:
            at = at[words.counts[document[at]] == size]
        literals, least = size - (slot[at + size] - slot[at]), min(min_literal, size)
        if raw:
            if sizes is None:  # those that some form of theirs leaves with too few literals
                at = at[literals - (may[at + size] - may[at]) < least]
            forms = [(np.arange(len(at)), span_hashes(value, at, at + size) ^ _RAW, np.zeros(len(at), U64))]
        else:
            forms = _forms(template, doubtful, at, literals, size, least)
        for chosen, hashes, names in forms:
            if wanted is not None:
                hit = np.flatnonzero(sieve[hashes >> U64(65 - len(sieve).bit_length())])
                hit = hit[wanted[np.minimum(np.searchsorted(wanted, hashes[hit]), len(wanted) - 1)] == hashes[hit]]
                chosen, hashes, names = chosen[hit], hashes[hit], names[hit]
            begin = at[chosen]
            slots = np.zeros((len(begin), size), bool)
            if not raw:
                for k in range(size):
                    slots[:, k] = (kind[begin + k] != LITERAL) | (names >> U64(k) & U64(1)).astype(bool)
            row, k = np.nonzero(slots)
            out.append((begin, hashes, np.full(len(begin), size), np.full(len(begin), raw), names > 0, slots.sum(1),
                        value[begin[row] + k]))
    none = np.zeros(0, np.int64)
    at, hashes, size, raw, named, count, values = (
        (np.concatenate(x) for x in zip(*out)) if out else (none, none, none, none > 0, none > 0, none, none))
    ends = np.concatenate([[0], np.cumsum(count)])
    of = document[at]
    return pa.RecordBatch.from_arrays(
        [batch.column(name).take(pa.array(of)), pa.array(hashes.view(np.int64)),
         pa.array((at - words.first[of]).astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(raw),
         pa.array(named), ragged(ends, values.view(np.int64), pa.int64())],
        [name, "template", "place", "size", "raw", "named", "slots"])


def template_windows(texts: DataFrame, name: str, window: int = WINDOW, min_literal: int = MIN_LITERAL,
                     sizes=None, wanted: np.ndarray | None = None) -> DataFrame:
    """(name, template, place, size, raw, named, slots) of each form of each window of
    ``texts`` (name, text); ``named``: with a doubtful word taken as a name."""
    def run(batches):
        sieve = None if wanted is None else _sieve(wanted)
        for whole in batches:
            for batch in pieces(whole):
                yield _windows(batch, name, window, min_literal, sizes, wanted, sieve)
    return texts.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias(name), "text").mapInArrow(
        run, f"{name} long, template long, place long, size int, raw boolean, named boolean, slots array<long>")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_literal: int = MIN_LITERAL,
                       min_cover: float = MIN_COVER) -> DataFrame:
    """(doc_id, item_id, n_windows, cover, exact): the items that each document
    holds, ``exact`` false where slots were given other values; ``n_windows`` counts
    template and raw windows."""
    items = written(template_windows(benchmark, "item_id", window, min_literal), "benchmark-windows")
    sizes = sorted(map(tuple, items.select("size", "raw").distinct().collect()))  # at most 2 * ``window``
    hashes = items.select("template").distinct()
    few = hashes.limit(MOST_SHIPPED + 1).count() <= MOST_SHIPPED
    wanted = None
    if few:
        wanted = np.sort(np.array([r["template"] for r in hashes.collect()], np.int64).view(U64))
    held = template_windows(docs, "doc_id", window, min_literal, sizes, wanted)
    of_item = items.select("item_id", "template", F.col("place").alias("item_place"), F.col("slots").alias("item_slots"),
                           F.struct("place", "raw").alias("spot"), F.col("named").alias("item_named"))
    met = held.drop("raw").join(F.broadcast(of_item) if few else of_item, "template")
    good = (met.withColumn("offset", F.col("place") - F.col("item_place"))
            .withColumn("same", F.col("slots") == F.col("item_slots"))
            .withColumn("pairs", F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    # one row for each alignment; an alignment holds no more rows than its item has window forms
    plain = ~F.col("named") & ~F.col("item_named")

    def all_pairs(column):
        return F.array_distinct(F.flatten(F.collect_set(column)))

    def consistent(pairs):
        return F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"]))) == F.size(pairs)

    aligned = good.groupBy("doc_id", "item_id", "offset").agg(
        F.collect_set("spot").alias("places"), F.collect_set(F.when(plain, F.col("spot"))).alias("plain_places"),
        F.collect_set(F.when(F.col("same"), F.col("spot"))).alias("same_places"), F.min("same").alias("exact"),
        all_pairs("pairs").alias("pairs"), all_pairs(F.when(plain, F.col("pairs"))).alias("plain_pairs"))
    aligned = aligned.withColumn("places", F.when(consistent("pairs"), F.col("places"))
                                 .when(consistent("plain_pairs"), F.array_union("plain_places", "same_places"))
                                 .otherwise(F.col("same_places")))
    typed = F.count_distinct(F.when(~F.col("raw"), F.col("place")))
    total = items.groupBy("item_id").agg(F.count_distinct("place").alias("total"), typed.alias("total_typed"))
    share = F.greatest(F.col("n_windows") / F.col("total"), F.col("n_typed") / F.nullif("total_typed", F.lit(0)))
    found = (aligned.select("doc_id", "item_id", "exact", F.explode("places").alias("spot"))
             .select("doc_id", "item_id", "exact", "spot.place", "spot.raw")
             .groupBy("doc_id", "item_id").agg(F.count_distinct("place").alias("n_windows"), typed.alias("n_typed"),
                                               F.min("exact").alias("exact"))
             .join(total, "item_id").withColumn("cover", share))
    return found.where(F.col("cover") >= min_cover).select("doc_id", "item_id", "n_windows", "cover", "exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = contaminated_pairs(docs, benchmark).select(F.col("doc_id").alias("__doc_id")).distinct()
    return docs.join(found, docs["doc_id"] == found["__doc_id"], "left_anti")


def op7_decontaminate(spark, sf_dir):
    return contaminated_pairs(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
