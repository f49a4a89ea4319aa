"""The pipeline against a brute-force version of its decisions."""

import re
from pathlib import Path

import corpus_pipeline as cp
import numpy as np
import pytest
from geoloom.llm import common, decontaminate, lang_id, pii

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r["doc_id"] for r in lang_id.language(docs).where("not rejected").select("doc_id").collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in known}

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets = {i: shingles(t) for i, t in text.items()}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[b] < low[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    low[a], changed = low[b], True
    kept = {i for i in sets if low[i] == i}
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i in kept if not any(b in text[i] for b in bench)}
    got = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == kept and len(got) == len(kept)
    masked = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs).collect()}
    assert all(r["text"] == masked[r["doc_id"]] for r in got)
    assert len({(r["mix_slot"], r["mix_place"]) for r in got}) == len(got)


def test_columns_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in cp.STAGES] and decontaminate.WINDOW == 8


def _anonymous_mb(pid="self"):
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="needs /proc")
def test_stage_returns_freed_memory_of_the_driver(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dict(cp.STAGES)["PII"](spark, docs, SF)  # what was held before is gone
    small = [np.ones(8 << 10, np.uint8) for _ in range(16 << 10)]
    last = np.ones(8 << 10, np.uint8)  # above the freed ones, so that the heap cannot shrink by itself
    small = small[::64]
    held = _anonymous_mb()
    dict(cp.STAGES)["PII"](spark, docs, SF)
    assert held - _anonymous_mb() > 64 and len(small) == 256 and last.all()


def test_driver_jvm_returns_freed_memory(spark):
    assert "rim native heap" in common._jvm_trimmed(spark)
