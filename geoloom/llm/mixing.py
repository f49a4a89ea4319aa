"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in the order of a hash of their id, are cut into blocks of `block_docs`. With
integer weights n of the sources still running and Q their sum, block j of a source has the window
[floor(j Q / n), ceil((j + 1) Q / n)) of slots within a round of Q slots. Each slot takes, among the
released blocks, the one with the earliest deadline. One resource and whole weights are always
feasible, so every block runs inside its window and every source stays within one block of its share
at every slot. A round gives each source n blocks and is the same each time, so it is computed once
for each set of running sources (a source leaves after the round in which it runs out), and block
numbers find their slot by division; nothing depends on a global order of rows.

Ranks within a source are found in salted parts (leading hex digits of the hash; a part that a hot id
fills is cut further), so neither a source nor an id with a third of all rows is a single task. The schedule has at most sources x period rows; it is broadcast
up to BROADCAST_ROWS and joined by shuffle beyond.

Defined cases: a null source counts as the empty one; null ids and repeated rows get places of their
own, in the order of a hash of the whole row (rows that are equal throughout cannot be told apart); an
empty table gives an empty result; sources without a given weight get weight 1. Every row is kept, with
all its columns but former ones named like those made here (mix_...), which are replaced. The schedule
is made in one task (about sources x period x sources steps).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD = 100
BLOCK_DOCS = 16
PART_ROWS = 4096
HOT_PARTS = 16
BROADCAST_ROWS = 200_000
_TIE = 1_000_000


def weights_table(counts: DataFrame, weights: dict[str, int] | None, period: int) -> DataFrame:
    """(s, c, n): given whole weights, or in proportion to the root of the source's size, scaled to about `period`."""
    if weights is not None:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        return counts.withColumn("n", F.coalesce(given[F.col("s")].cast("long"), F.lit(1).cast("long")) if weights else F.lit(1).cast("long"))
    root = counts.withColumn("q", F.floor(F.sqrt("c")).cast("long"))
    total = root.agg(F.sum("q").alias("t"))
    return root.crossJoin(F.broadcast(total)).select("s", "c", F.greatest(F.lit(1).cast("long"), F.expr(f"q * {period} div t")).alias("n"))


def _round(active: Column, q: Column) -> Column:
    """Picks of one round of earliest-deadline-first: array of (source index, block number) by slot."""
    start = F.struct(F.transform(active, lambda x: F.lit(0).cast("long")).alias("next"), F.array().cast("array<struct<i:int,j:bigint>>").alias("out"))

    def slot(acc, t):
        def window(a, i):
            j = F.get(acc["next"], i)
            deadline = F.floor(((j + 1) * q + a["n"] - 1) / a["n"]).cast("long")
            return F.when(F.floor(j * q / a["n"]) <= t, deadline * _TIE + i)

        best = F.array((F.array_min(F.transform(active, window)) % _TIE).cast("int"))
        return F.get(F.transform(best, lambda i: F.struct(F.transform(acc["next"], lambda v, k: F.when(k == i, v + 1).otherwise(v)).alias("next"), F.concat(acc["out"], F.array(F.struct(i.alias("i"), F.get(acc["next"], i).alias("j")))).alias("out"))), F.lit(0))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), q - 1), start, slot, lambda acc: acc["out"])


def schedule(sources: DataFrame, block_docs: int) -> DataFrame:
    """(s, n, low, high, base, q, j, t, release, deadline): the places of a source's block j of a round, for rounds low..high-1."""
    b = sources.withColumn("rounds", F.expr(f"((c + {block_docs} - 1) div {block_docs} + n - 1) div n"))
    every = b.agg(F.sort_array(F.collect_list(F.struct("s", "n", "rounds"))).alias("all")).where(F.size("all") > 0)
    ends = every.select("all", F.array_sort(F.array_distinct(F.transform("all", lambda x: x["rounds"]))).alias("ends"))
    phase = ends.select("all", "ends", F.posexplode("ends").alias("p", "high")).select("all", "ends", "p", "high", F.when(F.col("p") > 0, F.get("ends", F.col("p") - 1)).otherwise(F.lit(0)).cast("long").alias("low"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    active = phase.withColumn("active", F.filter("all", lambda x: x["rounds"] >= F.col("high"))).withColumn("q", total(F.col("active")))
    # Slots before the phase: each earlier round has the weights of the sources that still ran in it.
    before = F.aggregate("all", F.lit(0).cast("long"), lambda acc, x: acc + x["n"] * F.least(x["rounds"], F.col("low")))
    done = active.select("active", "q", "low", "high", before.alias("base"), F.posexplode(_round(F.col("active"), F.col("q"))).alias("t", "pick"))
    own = F.get("active", F.col("pick.i"))
    return done.select(own["s"].alias("s"), own["n"].alias("n"), "low", "high", "base", "q", F.col("pick.j").alias("j"), F.col("t").cast("long").alias("t"), F.floor(F.col("pick.j") * F.col("q") / own["n"]).cast("long").alias("release"), F.floor(((F.col("pick.j") + 1) * F.col("q") + own["n"] - 1) / own["n"]).cast("long").alias("deadline"))


MADE = ("mix_block", "mix_round", "mix_slot", "mix_release", "mix_deadline", "mix_place")


def _ranked(docs: DataFrame, counted: int) -> DataFrame:
    """(s, row, rank): each row's place in its source, ordered by a hash of doc_id, then by one of the whole row.

    Places are found part by part (leading hex digits of the first hash); a part that many rows of few
    ids fill is cut further by both hashes.
    """
    digits = max(1, math.ceil(math.log(max(1, counted / PART_ROWS), 16)))
    row = F.struct(*[c for c in docs.columns if c not in MADE])
    rows = docs.select(F.coalesce(F.col("source"), F.lit("")).alias("s"), row.alias("row"), F.col("doc_id").alias("id"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    rows = rows.withColumns({"part": F.substring("h", 1, digits), "tie": F.hex(F.xxhash64("row"))})
    full = rows.groupBy("s", "part").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > HOT_PARTS * PART_ROWS).select(F.col("s").alias("hs"), F.col("part").alias("hp"))
    rows = rows.join(full, (F.col("s") == F.col("hs")) & (F.col("part") == F.col("hp")), "left")
    # A longer part begins with the shorter one, so the order of parts stays that of the rows.
    rows = rows.withColumn("part", F.when(F.col("hs").isNull(), F.col("part")).otherwise(F.concat("h", F.when(F.col("id").isNull(), "0").otherwise("1"), F.substring("tie", 1, digits)))).drop("hs", "hp")
    parts = rows.groupBy("s", "part").agg(F.count(F.lit(1)).alias("c"))
    offsets = parts.select(F.col("s").alias("os"), F.col("part").alias("op"), (F.sum("c").over(Window.partitionBy("s").orderBy("part")) - F.col("c")).alias("before"))
    ranked = rows.join(offsets, (F.col("s") == F.col("os")) & (F.col("part") == F.col("op")))
    return ranked.select("s", "row", (F.col("before") + F.row_number().over(Window.partitionBy("s", "part").orderBy("h", "id", "tie")) - 1).alias("rank"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """All rows of docs with mix_block (of the source), mix_round, mix_slot, mix_release, mix_deadline and mix_place (in the block).

    Reading by mix_slot, then mix_place, gives the mixture.
    """
    counts = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("s")).agg(F.count(F.lit(1)).alias("c"))
    size = counts.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    table = weights_table(counts, weights, period)
    plan = schedule(table, block_docs).withColumnRenamed("s", "ps").drop("n")
    # n by source, to find the round before the schedule is joined.
    hint = F.broadcast if size["k"] * (period + size["k"]) <= BROADCAST_ROWS else (lambda df: df)
    n = hint(table.select(F.col("s").alias("ns"), F.col("n").alias("w")))
    blocks = _ranked(docs, size["n"]).join(n, F.col("s") == F.col("ns")).withColumn("mix_block", F.expr(f"rank div {block_docs}")).withColumn("mix_round", F.expr("mix_block div w"))
    placed = blocks.join(hint(plan), (F.col("s") == F.col("ps")) & (F.col("mix_block") % F.col("w") == F.col("j")) & (F.col("mix_round") >= F.col("low")) & (F.col("mix_round") < F.col("high")))
    start = F.col("base") + (F.col("mix_round") - F.col("low")) * F.col("q")
    return placed.select("row.*", "mix_block", "mix_round", (start + F.col("t")).alias("mix_slot"), (start + F.col("release")).alias("mix_release"), (start + F.col("deadline")).alias("mix_deadline"), (F.col("rank") % block_docs).alias("mix_place"))


SQL = f"""
WITH RECURSIVE c AS (
  SELECT coalesce(source, '') AS s, count(*) AS c FROM documents GROUP BY 1
), r AS (
  SELECT s, c, CAST(floor(sqrt(c)) AS BIGINT) AS q FROM c
), w AS (
  SELECT s, c, greatest(1, (q * {PERIOD}) // CAST((SELECT sum(q) FROM r) AS BIGINT)) AS n FROM r
), b AS (
  SELECT *, ((c + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} + n - 1) // n AS rounds FROM w
), p AS (
  SELECT rounds AS high, coalesce(lag(rounds) OVER (ORDER BY rounds), 0) AS low FROM (SELECT DISTINCT rounds FROM b)
), a AS (
  SELECT p.high, p.low, list(b.s ORDER BY b.s) AS names, list(b.n ORDER BY b.s) AS ns, CAST(sum(b.n) AS BIGINT) AS q
  FROM p JOIN b ON b.rounds >= p.high GROUP BY ALL
), base AS (
  SELECT p.high, CAST(sum(b.n * least(b.rounds, p.low)) AS BIGINT) AS base FROM p CROSS JOIN b GROUP BY 1
), e AS (
  SELECT high, low, names, ns, q, -1::BIGINT AS t, list_transform(ns, lambda x: 0::BIGINT) AS nxt, NULL::BIGINT AS i, NULL::BIGINT AS j FROM a
  UNION ALL
  SELECT high, low, names, ns, q, t + 1, list_transform(range(len(ns)), lambda k: nxt[k + 1] + CASE WHEN k = best THEN 1 ELSE 0 END), best, nxt[best + 1]
  FROM (
    SELECT *, list_min(list_transform(range(len(ns)), lambda k: CASE WHEN (nxt[k + 1] * q) // ns[k + 1] <= t + 1
      THEN ((nxt[k + 1] + 1) * q + ns[k + 1] - 1) // ns[k + 1] * {_TIE} + k END)) % {_TIE} AS best
    FROM e WHERE t + 1 < q
  )
), plan AS (
  SELECT high, low, q, names[i + 1] AS s, ns[i + 1] AS n, j, t, (j * q) // ns[i + 1] AS rel, ((j + 1) * q + ns[i + 1] - 1) // ns[i + 1] AS dl FROM e WHERE t >= 0
), d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS rank FROM documents
), k AS (
  SELECT d.*, rank // {BLOCK_DOCS} AS mix_block, (rank // {BLOCK_DOCS}) // w.n AS mix_round, w.n AS wn FROM d JOIN w USING (s)
)
SELECT k.doc_id, k.source, k.mix_block, k.mix_round,
  base.base + (k.mix_round - plan.low) * plan.q + plan.t AS mix_slot,
  base.base + (k.mix_round - plan.low) * plan.q + plan.rel AS mix_release,
  base.base + (k.mix_round - plan.low) * plan.q + plan.dl AS mix_deadline,
  k.rank % {BLOCK_DOCS} AS mix_place
FROM k JOIN plan ON plan.s = k.s AND plan.j = k.mix_block % k.wn AND k.mix_round >= plan.low AND k.mix_round < plan.high
JOIN base ON base.high = plan.high
"""
