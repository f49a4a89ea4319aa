"""Benchmark decontamination by template canonicalisation.

Text becomes a sequence of template tokens: runs of letters or of digits, A-Z lower-cased; a number
(with its separators) becomes the slot <num>, a unit after a number <unit>, and a run of capitalised
words <name>. Whether a capitalised word that begins a sentence is a name cannot be seen from the
text, so each text has two template sequences, without and with such names, and windows, copies and
shares are those of one sequence. Windows of `WINDOW` template tokens with at least `LITERALS` plain
words are hashed together with the pattern of equal and different slot values, so a question with
other numbers, names and units hashes alike and one whose slots are mixed up does not.

A fixed-size bitmap of the benchmark's window hashes is broadcast and thins out the documents'
windows; a hash join with the benchmark's windows decides. A window that several items share belongs to
the one with the fewest windows (of these, the smallest item_id), so an excerpt that is an item of its own keeps its
windows and a phrase common to a whole benchmark is one row a match. Matches of a document and item at
one offset are a copy; within a copy every slot value of the item must have one value in the
document, or the copy does not count. A document is contaminated by an item if one consistent copy
matches a passage of RUN template tokens without a gap, however long the item is, or if consistent
copies cover at least `coverage` of the item's own windows and at least LEAST of them (all, if the
item has fewer).

Defined cases: null or empty texts and items match nothing; an item with fewer than WINDOW tokens
is matched whole if it has at least SHORTEST, and one without a window of LITERALS plain words never; repeated rows of a doc_id
are one document; items of equal text are found together (item_id is the smallest, n_items counts
each); a null doc_id or item_id is left out (and in `clean` such rows stay); extra columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc

_U = np.uint64
WINDOW = 8
LITERALS = 3
SHORTEST = 5
LEAST = 4
RUN = 13  # template tokens of a passage that counts by itself
MAP_BITS = 24  # bits of the broadcast bitmap: 2 MB whatever the benchmark
MAX_SLOTS = 8

# Fixed list of units.
UNITS = "mm cm dm m km in ft yd mi mile miles meter meters metre metres inch inches foot feet g mg kg lb lbs oz ton tons gram grams ml cl l liter liters litre litres s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents kb mb gb tb hz khz mhz w kw kwh v a degrees percent".split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDER = np.zeros(256, bool)
_ENDER[list(b".!?\n:;")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
NUM, UNIT, NAME = (tc.seeded(41, 3)[i] for i in range(3))
KINDS = np.array([0, tc.seeded(42, 1)[0]], np.uint64)  # tells windows of the two sequences apart


def _unit_hashes() -> np.ndarray:
    _, _, data, off = next(tc.chunks(pa.array(UNITS, pa.large_string())))
    return np.sort(tc.span_hash(tc.prefix_hash(data, lower=True), off[:-1], off[1:]))


_UNIT_SET = _unit_hashes()


def template(data: np.ndarray, off: np.ndarray, initial: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, slot value hashes, offsets by document); the slot value of a plain word is 0.

    initial: capitalised words that begin a sentence are names too.
    """
    kind = _LETTER[data].astype(np.uint8) + 2 * _DIGIT[data].astype(np.uint8)
    n = len(data)
    brk = np.zeros(n + 1, bool)
    brk[off] = True
    first = kind > 0
    if n:
        first[1:] &= (kind[1:] != kind[:-1]) | brk[1:n]
    starts = np.flatnonzero(first)
    last = kind > 0
    if n:
        last[:-1] &= (kind[1:] != kind[:-1]) | brk[1:n]
    ends = np.flatnonzero(last) + 1
    m = len(starts)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    h = tc.span_hash(tc.prefix_hash(data, lower=True), starts, ends)
    number = _DIGIT[data[starts]]
    doc_first = brk[starts]
    ptr = np.searchsorted(starts, off)
    doc_first[ptr[:-1][np.diff(ptr) > 0]] = True
    # Capitalised (first letter capital, second not) inside a sentence, or at its beginning too.
    head = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (ends - starts > 1) & (data[np.minimum(starts + 1, n - 1)] < 0x9F))
    second = np.minimum(starts + np.where(data[starts] == 0xC3, 2, 1), n - 1)
    low = (ends - starts > 1) & ~_UPPER[data[second]] & ~((data[second] == 0xC3) & (data[np.minimum(second + 1, n - 1)] < 0x9F) & (second < ends))
    stop = np.zeros(n + 1, np.int64)
    np.cumsum(_ENDER[data], out=stop[1:])
    begins = np.ones(m, bool)
    begins[1:] = stop[starts[1:]] > stop[ends[:-1]]
    begins |= doc_first
    name = head & low & ~number & (initial | ~begins)
    unit = np.zeros(m, bool)
    unit[1:] = number[:-1] & ~doc_first[1:] & ~number[1:]
    if unit.any():
        at = np.flatnonzero(unit)
        place = np.minimum(np.searchsorted(_UNIT_SET, h[at]), len(_UNIT_SET) - 1)
        unit[at] = _UNIT_SET[place] == h[at]
    # A number goes on over separators without space; a name goes on over following names of its sentence.
    on = np.zeros(m, bool)
    gap = starts[1:] - ends[:-1]
    sep = data[np.minimum(ends[:-1], n - 1)]
    on[1:] = ~doc_first[1:] & ((number[1:] & number[:-1] & (gap == 1) & ((sep == 44) | (sep == 46))) | (name[1:] & name[:-1] & ~begins[1:]))
    lead = np.flatnonzero(~on)
    # A run's value is the sum of its parts' hashes.
    with np.errstate(over="ignore"):
        value = np.add.reduceat(np.where(number | name | unit, h, _U(0)), lead)
    t = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, h)))[lead]
    slot = (number | unit | name)[lead]
    return t, np.where(slot, value | _U(1), _U(0)), np.searchsorted(lead, ptr)


def windows(t: np.ndarray, v: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window with enough plain words, its hash with the slot pattern)."""
    idx, _ = tc.gram_ptr(ptr, size)
    if not len(idx):
        return idx, np.zeros(0, np.uint64)
    h = tc.grams(t, size)[idx]
    slots = np.cumsum(np.append(0, v != 0))
    n_slots = slots[idx + size] - slots[idx]
    ok = size - n_slots >= LITERALS
    idx, h, n_slots = idx[ok], h[ok], n_slots[ok]
    many = np.flatnonzero(n_slots > 1)  # which slots hold equal values
    own = [v[idx[many] + j] for j in range(size)]
    pattern, count, names = np.zeros(len(many), np.uint64), np.zeros(len(many), np.uint64), []
    for j in range(size):
        slot, name = own[j] != 0, count.copy()
        for i in range(j):
            name = np.where(own[i] == own[j], names[i], name)
        names.append(name)
        count += slot & (name == count)
        pattern = np.where(slot, pattern * _U(MAX_SLOTS) + name, pattern)
    with np.errstate(over="ignore"):
        h[many] = tc.mix(h[many] + (pattern + _U(1)) * _U(0x9E3779B97F4A7C15))
    return idx, h


def _benchmark_windows(batches):
    for b in batches:
        cols = {"item_id": [], "kind": [], "at": [], "size": [], "win": [], "slots": [], "n": []}
        for a, _, data, off in tc.chunks(b.column("text")):
            items = b.column("item_id").to_numpy()[a:]
            for kind in (0, 1):
                t, v, ptr = template(data, off, kind == 1)
                for i in range(len(off) - 1):
                    n = ptr[i + 1] - ptr[i]
                    size = WINDOW if n >= WINDOW else n
                    if size < SHORTEST:
                        continue
                    own = slice(ptr[i], ptr[i + 1])
                    idx, h = windows(t[own], v[own], np.array([0, n]), int(size))
                    for at, x in zip(idx, h ^ KINDS[kind], strict=True):
                        cols["item_id"].append(int(items[i]))
                        cols["kind"].append(kind)
                        cols["at"].append(int(at))
                        cols["size"].append(int(size))
                        cols["win"].append(int(x.view(np.int64)))
                        cols["n"].append(len(idx))
                        cols["slots"].append([int(s) for s in tc.unhex(v[own][at : at + size])])
        yield pa.RecordBatch.from_arrays([pa.array(cols["item_id"], pa.int64()), pa.array(cols["kind"], pa.int32()), pa.array(cols["at"], pa.int64()), pa.array(cols["size"], pa.int32()), pa.array(cols["win"], pa.int64()), pa.array(cols["slots"], pa.list_(pa.int64())), pa.array(cols["n"], pa.int32())], list(cols))


def _bitmap(batches):
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for b in batches:
        h = b.column("win").to_numpy().view(np.uint64)
        at = h >> _U(64 - MAP_BITS)
        np.bitwise_or.at(bits, (at >> _U(3)).astype(np.int64), (1 << (at & _U(7))).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])


def _thinned(shared):
    def run(batches):
        bits, sizes = shared.value
        for b in batches:
            rows = {"doc_id": [], "at": [], "win": [], "slots": []}
            for a, _, data, off in tc.chunks(b.column("text")):
                ids = b.column("doc_id").to_numpy()[a:]
                made = [template(data, off, kind == 1) for kind in (0, 1)]
                for kind, size in sizes:
                    t, v, ptr = made[kind]
                    idx, h = windows(t, v, ptr, size)
                    h = h ^ KINDS[kind]
                    at = h >> _U(64 - MAP_BITS)
                    hit = np.flatnonzero((bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1)
                    if len(hit):
                        doc = np.searchsorted(ptr, idx[hit], side="right") - 1
                        rows["doc_id"] += ids[doc].tolist()
                        rows["at"] += (idx[hit] - ptr[doc]).tolist()
                        rows["win"] += tc.unhex(h[hit]).tolist()
                        rows["slots"] += [tc.unhex(v[i : i + size]).tolist() for i in idx[hit]]
            yield pa.RecordBatch.from_arrays([pa.array(rows["doc_id"], pa.int64()), pa.array(rows["at"], pa.int64()), pa.array(rows["win"], pa.int64()), pa.array(rows["slots"], pa.list_(pa.int64()))], list(rows))

    return run


def _longest(places: str):
    """Tokens of the longest passage that windows at these places cover without a gap."""
    start = F.struct(F.lit(-2 * WINDOW).cast("long").alias("first"), F.lit(-2 * WINDOW).cast("long").alias("last"), F.lit(0).cast("long").alias("best"))

    def one(acc, at):
        first = F.when(at - acc["last"] <= WINDOW, acc["first"]).otherwise(at)
        return F.struct(first.alias("first"), at.alias("last"), F.greatest(acc["best"], at - first + WINDOW).alias("best"))

    return F.aggregate(F.array_sort(places), start, one, lambda acc: acc["best"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_items) of contaminated documents; item_id is the best covered."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    # Items of one text are one item to the search; the smallest id stands for them and n_items counts them all.
    alike = common.kept(items.groupBy("text").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("alike")))
    items = alike.select("item_id", "text")
    made = items.mapInArrow(_benchmark_windows, "item_id long, kind int, at long, size int, win long, slots array<long>, n int")
    # The item with the fewest windows owns a window; a window repeated in an item stands for its first place.
    owned = made.groupBy("win").agg(F.min(F.struct("n", "item_id", "at", "size", "slots", "kind")).alias("o")).select("win", "o.item_id", "o.kind", F.col("o.at").alias("item_at"), F.col("o.size").alias("size"), F.col("o.slots").alias("item_slots"))
    bits = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for r in owned.select("win").coalesce(8).mapInArrow(_bitmap, "bits binary").collect():
        bits |= np.frombuffer(r["bits"], np.uint8)
    sizes = sorted((r["kind"], r["size"]) for r in owned.select("kind", "size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast((bits, sizes))
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = texts.mapInArrow(_thinned(shared), "doc_id long, at long, win long, slots array<long>")
    totals = owned.groupBy("item_id", "kind").agg(F.count(F.lit(1)).alias("own"))
    matches = seen.join(owned, "win").select("doc_id", "item_id", "kind", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != 0).alias("pairs"))
    copies = matches.groupBy("doc_id", "item_id", "kind", "shift").agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = copies.where(F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))))
    covered = consistent.withColumn("run", _longest("places")).groupBy("doc_id", "item_id", "kind").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_windows"), F.max("run").alias("run"))
    share = (F.col("n_windows") >= coverage * F.col("own")) & (F.col("n_windows") >= F.least(F.lit(LEAST), F.col("own")))
    judged = covered.join(totals, ["item_id", "kind"]).where(share | (F.col("run") >= RUN))
    judged = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_windows") / F.col("own")).alias("coverage"), "n_windows")).alias("m")).join(alike.groupBy("item_id").agg(F.max("alike").alias("alike")), "item_id")
    best = judged.groupBy("doc_id").agg(F.max(F.struct("m.coverage", "m.n_windows", (-F.col("item_id")).alias("neg"))).alias("m"), F.sum("alike").alias("n_items"))
    return best.select("doc_id", (-F.col("m.neg")).alias("item_id"), F.col("m.n_windows").cast("long").alias("n_windows"), F.col("m.coverage").alias("coverage"), "n_items")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """docs without the contaminated ones."""
    mark = common.fresh(docs, "bad")
    bad = contaminated(docs, benchmark, coverage).select(F.col("doc_id").alias(mark))
    return docs.join(bad, F.col("doc_id") == F.col(mark), "left_anti")
