"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; a text of
one to four words has one shingle of all its words). Texts with equal sets form a class of copies with
the smallest doc_id as its representative; only representatives are joined.

Chosen paths (Christiani and Pagh 2017; Christiani, Pagh and Sivertsen 2018). A set is embedded as
`COORDS` min-wise tokens. A run sends each set to the bucket of one sampled token; a bucket above
`SMALL` members splits again, each member following `BRANCH` tokens that its path samples, until
buckets are small, half of their members agree on a sampled token, or all levels are used. A pair with
similarity s shares the first bucket of a run with chance s, and each further split with
1-(1-s)^BRANCH, so at s = 0.8 a run whose buckets split all LEVELS times finds it with
0.8 * 0.96^6 = 0.63; `runs_for` repeats runs until the miss of all runs is below 1 - recall.

Exact join. Equal small buckets are one group; large buckets with one leader (their member of smallest
hash) are one group too, cut into blocks by size, whose pairs are tasks of their own. A pair of texts
that meets in several groups is compared only in the first of them, large groups coming first, so a
crowd of near copies that fills a bucket of every run is compared once. A task gives each member the
number of its links and one edge to the smallest member of its linked part; no pair becomes a row.

Result: one row a document with class_id (smallest doc_id of its connected group), copy_of (its class
representative) and n_links (other documents with similarity >= threshold, copies included).

Defined cases: a null or wordless text and a null doc_id have no links and are their own class (copy_of
and class_id equal doc_id); repeated rows of a doc_id with one text are copies of each other, with
other texts they are of one group if either has links; an empty table gives an empty result; extra
columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from . import textcore as tc

_U = np.uint64
WORDS = 5
COORDS = 48
SMALL = 64
BLOCK = 1024
BRANCH = 2
LEVELS = 6
BLOCK_SHINGLES = 1 << 20  # of a block, so that long texts make smaller blocks
PACK_SHINGLES = 2 << 20  # of the texts that one task of the exact join holds, on average
_MUL = tc.seeded(21, COORDS) | _U(1)
_ADD = tc.seeded(22, COORDS)


def runs_for(threshold: float, recall: float, splits: int = LEVELS) -> int:
    """Runs until a pair at the threshold is missed by all of them with a chance of at most 1 - recall."""
    found = threshold * (1 - (1 - threshold) ** BRANCH) ** splits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


# ---- sets --------------------------------------------------------------------------------------
def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, with offsets."""
    starts, ends, ptr = tc.words(data, off)
    h = tc.span_hash(tc.prefix_hash(data, lower=True), starts, ends)
    g = tc.grams(h, k)
    out, size = [], np.zeros(len(off), np.int64)
    for i in range(len(off) - 1):
        a, b = ptr[i], ptr[i + 1]
        if b - a >= k:
            s = np.unique(g[a : b - k + 1])
        elif b > a:
            s = tc.grams(h[a:b], b - a) ^ _U(b - a)
        else:
            continue
        out.append(s)
        size[i + 1] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.cumsum(size)


def _sketch(k: int):
    def run(batches):
        for b in batches:
            n = np.zeros(len(b), np.int64)
            one, two = np.zeros(len(b), np.uint64), np.zeros(len(b), np.uint64)
            sig = np.zeros((len(b), COORDS), np.uint32)
            for a, z, data, off in tc.chunks(b.column("text")):
                s, ptr = shingle_sets(data, off, k)
                n[a:z] = np.diff(ptr)
                full = np.flatnonzero(np.diff(ptr))
                if not len(full):
                    continue
                at = ptr[full]
                with np.errstate(over="ignore"):
                    one[a + full] = np.add.reduceat(tc.mix(s ^ _U(0x51)), at)
                    two[a + full] = np.add.reduceat(tc.mix(s ^ _U(0x52_0000_0000)), at)
                    for c in range(COORDS):
                        sig[a + full, c] = np.minimum.reduceat(((s * _MUL[c] + _ADD[c]) >> _U(32)).astype(np.uint32), at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(n), pa.array(tc.unhex(one)), pa.array(tc.unhex(two)), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc_id", "h", "n", "s1", "s2", "sig"])

    return run


# ---- paths -------------------------------------------------------------------------------------
def _token(c: Column) -> Column:
    """Coordinate c of a sketch."""
    return F.col("sig").substr((c * 4 + 1).cast("int"), F.lit(4))


def _child(j: int, runs: int) -> Column:
    """The path that goes on by the j-th sampled token: which coordinate is decided by the path alone."""
    first = runs if runs + 8 <= COORDS else 0
    pick = F.pmod(F.xxhash64(F.lit("pick"), F.lit(j), "path"), F.lit(COORDS - first)) + first
    return F.xxhash64("path", F.lit(j), _token(pick))


def _buckets(reps: DataFrame, runs: int) -> DataFrame:
    """(path, cls, dense) of the members of the final buckets; dense: above SMALL, to be joined in blocks."""
    done = None
    rows = reps.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("r")).select(F.xxhash64(F.lit("root"), "r", _token(F.col("r"))).alias("path"), "cls")
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        shared = common.kept(rows.join(sizes, "path"))
        large = F.col("size") > SMALL
        ready = shared if level == LEVELS else shared.where(~large)
        ready = ready.select("path", "cls", large.alias("dense"))
        done = ready if done is None else done.unionByName(ready)
        many = shared.where(large)
        if level == LEVELS or many.isEmpty():
            return done
        next_ = common.kept(many.join(reps.select("cls", "sig"), "cls").select("path", "cls", "size", *[_child(j, runs).alias(f"to{j}") for j in range(BRANCH)]))
        most = next_.groupBy("path", "to0").agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg(F.max("c").alias("most"))
        judged = common.kept(next_.join(most, "path").withColumn("dense", F.col("most") * 2 >= F.col("size")))
        done = done.unionByName(judged.where("dense").select("path", "cls", "dense"))
        rows = judged.where("not dense").select(F.explode(F.array(*[f"to{j}" for j in range(BRANCH)])).alias("path"), "cls")


# ---- exact join of buckets ---------------------------------------------------------------------
def _groups(members: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of small groups: grp, cls, leader; members of dense groups: grp, cls, n); dense ids are below small ones."""
    lists = members.where("not dense").groupBy("path").agg(F.sort_array(F.collect_list("cls")).alias("all")).select("all").distinct()
    small = lists.select(F.xxhash64("all").bitwiseAND(F.lit((1 << 62) - 1)).alias("grp"), F.col("all")[0].alias("leader"), F.explode("all").alias("cls"))
    large = members.where("dense")
    lead = large.groupBy("path").agg(F.min(F.xxhash64(F.lit("lead"), "cls")).alias("grp"))
    dense = large.join(lead, "path").select((-F.col("grp").bitwiseAND(F.lit((1 << 62) - 1)) - 1).alias("grp"), "cls").distinct()
    return small, dense.join(reps.select("cls", "n"), "cls")


def _block_pairs(dense: DataFrame) -> DataFrame:
    """(grp, cls, task, side): each pair of blocks of a dense group is a task; side 2: pairs inside the block count too."""
    parts = dense.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    cut = dense.join(parts, "grp").withColumn("mine", F.pmod(F.xxhash64("cls", "grp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).otherwise((F.col("mine") > F.col("other")).cast("int"))
    return cut.select("grp", "cls", F.xxhash64("grp", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), side.cast("int").alias("side"))


def _cover(need: np.ndarray) -> np.ndarray:
    """Rows of a symmetric boolean matrix so that each true cell has its row or its column among them."""
    heavy = need.sum(axis=1) * 2 > len(need)
    rest = need & ~heavy[:, None] & ~heavy[None, :]
    return np.flatnonzero(heavy | rest.any(axis=1))


def _linked(sets: list[np.ndarray], need: np.ndarray, num: int, den: int) -> np.ndarray:
    """Boolean matrix of the needed pairs with Jaccard >= num/den."""
    g = len(sets)
    rows = _cover(need)
    out = np.zeros((g, g), bool)
    if not len(rows):
        return out
    size = np.array([len(s) for s in sets], np.int64)
    cat = np.concatenate(sets)
    owner = np.repeat(np.arange(g), size)
    order = np.argsort(cat, kind="stable")
    cat, owner = cat[order], owner[order]
    same = cat[1:] == cat[:-1]
    col = np.concatenate([[0], np.cumsum(~same)]) if len(cat) else np.zeros(0, np.int64)
    both = np.zeros(len(cat), bool)
    both[1:] |= same
    both[:-1] |= same
    owner, col = owner[both], col[both]
    inter = np.zeros((len(rows), g), np.float32)
    if len(col):
        col = np.cumsum(np.concatenate([[0], (col[1:] != col[:-1]).astype(np.int64)]))
        step = 4096
        for lo in range(0, int(col[-1]) + 1, step):
            a, b = np.searchsorted(col, [lo, lo + step])
            x = np.zeros((g, min(step, int(col[-1]) + 1 - lo)), np.float32)
            x[owner[a:b], col[a:b] - lo] = 1
            inter += x[rows] @ x.T
    inter = inter.astype(np.int64)
    union = size[rows][:, None] + size[None, :] - inter
    out[rows] = need[rows] & (inter * den >= num * union) & (inter > 0)
    return out | out.T


def _needed(grp: int, side: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Pairs of a task's members that no earlier group of both compares."""
    need = ~np.eye(len(side), dtype=bool)
    if not (side == 2).all():
        need &= side[:, None] != side[None, :]
    who = np.repeat(np.arange(len(groups)), [len(x) for x in groups])
    which = np.concatenate(groups)
    early = which < grp
    ids, col, n = np.unique(which[early], return_inverse=True, return_counts=True)
    if (n > 1).any():
        col_of = np.cumsum(n > 1) - 1
        pick = (n > 1)[col]
        x = np.zeros((len(side), int((n > 1).sum())), np.float32)
        x[who[early][pick], col_of[col[pick]]] = 1
        need &= (x @ x.T) == 0
    return need


_FOUND = pa.schema([("cls", pa.int64()), ("rep", pa.int64()), ("star", pa.int64()), ("linked", pa.int64())])


def _verify(k: int, num: int, den: int):
    def run(key, members, texts):
        cls = texts.column("class").to_numpy()
        order = np.argsort(cls)
        sets = []
        for _, _, data, off in tc.chunks(texts.column("text")):
            s, ptr = shingle_sets(data, off, k)
            sets += [s[ptr[i] : ptr[i + 1]] for i in range(len(ptr) - 1)]
        task = members.column("task").to_numpy()
        members = members.take(pa.array(np.argsort(task, kind="stable")))
        task, own, rep, copies, side, grp = (members.column(c).to_numpy() for c in ("task", "cls", "rep", "copies", "side", "grp"))
        lists = members.column("groups").combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        place = order[np.searchsorted(cls[order], own)] if len(own) else own
        cuts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]])) if len(task) else np.zeros(1, np.int64)
        out = {name: [np.zeros(0, np.int64)] for name in _FOUND.names}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            need = _needed(grp[a], side[a:b], [flat[at[i] : at[i + 1]] for i in range(a, b)])
            ok = _linked([sets[i] for i in place[a:b]], need, num, den)
            hit = np.flatnonzero(ok.any(axis=1))
            if not len(hit):
                continue
            ok = ok[np.ix_(hit, hit)]
            label = rep[a:b][hit].copy()
            while True:  # smallest representative of the linked part
                low = np.minimum(label, np.where(ok, label[None, :], np.iinfo(np.int64).max).min(axis=1))
                if (low == label).all():
                    break
                label = low
            for name, x in zip(out, (own[a:b][hit], rep[a:b][hit], label, ok @ copies[a:b][hit]), strict=True):
                out[name].append(x)
        one, mate, star, linked = (np.concatenate(x) for x in out.values())
        # One row for each class and star of the pack.
        by = np.lexsort((star, one))
        one, mate, star, linked = one[by], mate[by], star[by], linked[by]
        first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (star[1:] != star[:-1])])) if len(one) else np.zeros(0, np.int64)
        return pa.table([pa.array(one[first]), pa.array(mate[first]), pa.array(star[first]), pa.array(np.add.reduceat(linked, first) if len(first) else linked)], schema=_FOUND)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each connected part; edges (a, b) in any direction.

    Each round takes the smallest label among neighbours and then the label of the label; labels are
    checkpointed between rounds.
    """
    both = common.kept(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = common.kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = common.kept(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        changed = new.where("old <> label").isEmpty()
        labels = new.select("node", "label")
        if changed:
            return labels


def join(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, k: int = WORDS) -> DataFrame:
    """(doc_id, class_id, copy_of, n_links) of every document."""
    num, den = round(threshold * 1000), 1000
    runs = runs_for(threshold, recall)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    sketches = common.kept(base.mapInArrow(_sketch(k), "doc_id long, h long, n long, s1 long, s2 long, sig binary"))
    real = sketches.where("n > 0 and doc_id is not null")
    reps = real.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "h", "n", "sig")).alias("m"), F.count(F.lit(1)).alias("copies"))
    reps = common.kept(reps.select("s1", "s2", F.xxhash64("s1", "s2").alias("cls"), F.col("m.doc_id").alias("rep"), F.col("m.h").alias("h"), F.col("m.n").alias("n"), F.col("m.sig").alias("sig"), "copies"))
    small, dense = (common.kept(x) for x in _groups(_buckets(reps, runs), reps))
    work = small.join(reps.select("cls", "n"), "cls").select("leader", "cls", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    packs = max(8, -(-work // PACK_SHINGLES))
    tasks = small.select("grp", "cls", F.col("grp").alias("task"), F.lit(2).alias("side"), F.pmod(F.xxhash64("leader"), F.lit(packs)).alias("pack"))
    # Pairs of blocks are packs of their own: each holds two blocks.
    tasks = tasks.unionByName(_block_pairs(dense).withColumn("pack", -F.col("task").bitwiseAND(F.lit((1 << 62) - 1)) - 1))
    belongs = small.select("cls", "grp").unionByName(dense.select("cls", "grp")).groupBy("cls").agg(F.sort_array(F.collect_set("grp")).alias("groups"))
    tasks = common.kept(tasks.join(reps.select("cls", "rep", "copies"), "cls").join(belongs, "cls"))
    texts = base.where("doc_id is not null").groupBy(F.col("doc_id").alias("rep"), "h").agg(F.first("text").alias("text"))
    wanted = tasks.select(F.col("pack").alias("to"), F.col("cls").alias("class")).distinct().join(reps.select(F.col("cls").alias("class"), F.col("rep").alias("rep"), "h"), "class")
    texts = wanted.join(texts, ["rep", "h"]).select("to", "class", "text")
    found = common.kept(tasks.groupBy("pack").cogroup(texts.groupBy("to")).applyInArrow(_verify(k, num, den), "cls long, rep long, star long, linked long"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("star").alias("b")))
    linked = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    classes = reps.select("s1", "s2", "rep", "cls", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(linked, "cls", "left")
    classes = classes.select("s1", "s2", "rep", F.coalesce("label", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    joined = real.select("doc_id", "s1", "s2").join(classes, ["s1", "s2"]).select("doc_id", "class_id", F.col("rep").alias("copy_of"), "n_links")
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return joined.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each group stays, with its columns: the one whose doc_id is the class id.

    Rows with a null doc_id stay; of repeated rows of a doc_id one stays.
    """
    mark = common.fresh(docs, "keep")
    ids = join(docs, threshold).where("doc_id = class_id").select(F.col("doc_id").alias(mark)).distinct()
    kept = docs.where("doc_id is not null").join(ids, F.col("doc_id") == F.col(mark)).drop(mark).dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
