"""Allocation, exact-size samples and document numbers."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from searchlab.operators import sampling as s
from searchlab.operators.ids import assign_document_ids
from searchlab.operators.scan import earlier_sums


def allocate_by_walking(sizes: dict[str, int], sample: int) -> dict[str, int]:
    """One row at a time, as the rule is stated."""
    total = sum(sizes.values())
    n = {k: min(max(round(v / total * sample), 1), v) for k, v in sizes.items()}
    gap = sample - sum(n.values())
    order = sorted(sizes, key=lambda k: (sizes[k] if gap > 0 else -sizes[k], k))
    while gap:
        for k in order:
            if gap > 0 and n[k] < sizes[k]:
                n[k], gap = n[k] + 1, gap - 1
            elif gap < 0 and n[k] > 1:
                n[k], gap = n[k] - 1, gap + 1
    return n


@pytest.mark.parametrize("seed, small", [*((i, s.SMALL_STRATA) for i in range(12)), *((i, 0) for i in range(6))])
def test_allocation(spark, seed, small):
    rng = random.Random(seed)
    sizes = {f"s{i:02}": rng.choice([1, 2, 20, 21, 25, rng.randint(20, 900)]) for i in range(14)}
    sample = rng.randint(len(sizes), sum(sizes.values()) - 1)
    table = spark.createDataFrame(list(sizes.items()), "stratum string, size bigint")
    got = {r["stratum"]: r["n"] for r in s.allocate(table, sample, small=small).collect()}
    assert got == allocate_by_walking(sizes, sample)
    assert sum(got.values()) == sample
    assert all(1 <= got[k] <= sizes[k] for k in sizes)


@pytest.fixture(scope="module")
def rows(spark):
    """Two thirds of all rows in one stratum, some rare strata."""
    table = spark.range(3000).select(
        F.concat(F.lit("k"), "id").alias("key"),
        F.when(F.col("id") % 3 != 0, "hot")
        .when(F.col("id") % 30 == 0, F.concat(F.lit("rare"), F.col("id") % 400))
        .otherwise(F.concat(F.lit("s"), F.col("id") % 4))
        .alias("stratum"),
    )
    return table.repartition(5)


def digest(key: str) -> str:
    return hashlib.md5(f"42|{key}".encode()).hexdigest()


def test_stratified_sample_takes_smallest_hashes(spark, rows):
    data = [(r["key"], r["stratum"]) for r in rows.collect()]
    counts: dict[str, int] = {}
    for _, stratum in data:
        counts[stratum] = counts.get(stratum, 0) + 1
    merged = {k: "rare" if n < 20 else k for k, n in counts.items()}
    sizes: dict[str, int] = {}
    for stratum, n in counts.items():
        sizes[merged[stratum]] = sizes.get(merged[stratum], 0) + n
    want = set()
    for stratum, n in allocate_by_walking(sizes, 700).items():
        keys = sorted((k for k, g in data if merged[g] == stratum), key=digest)
        want |= set(keys[:n])
    got = s.stratified_sample(rows, 700, ["key"])
    assert got.columns == ["key", "stratum"] or set(got.columns) == {"key", "stratum"}
    assert {r["key"] for r in got.collect()} == want
    again = s.stratified_sample(rows.repartition(2), 700, ["key"])
    assert {r["key"] for r in again.collect()} == want


def test_stratified_sample_bounds(rows):
    assert s.stratified_sample(rows, 3000, ["key"]).count() == 3000
    with pytest.raises(ValueError, match="strata"):
        s.stratified_sample(rows, 2, ["key"])


@pytest.mark.parametrize("n", [1, 7, 1500, 2999])
def test_fixed_size_sample(rows, n):
    keys = sorted((r["key"] for r in rows.collect()), key=digest)
    got = [r["key"] for r in s.fixed_size_sample(rows, n, ["key"]).collect()]
    assert sorted(got) == sorted(keys[:n])


@pytest.mark.parametrize("brackets", [(1e-9, float("inf")), (float("inf"),)])
def test_missed_bracket_is_widened(spark, rows, monkeypatch, brackets):
    want = {r["key"] for r in s.stratified_sample(rows, 700, ["key"]).collect()}
    few = {r["key"] for r in s.fixed_size_sample(rows, 50, ["key"]).collect()}
    monkeypatch.setattr(s, "BRACKETS", brackets)
    assert {r["key"] for r in s.stratified_sample(rows, 700, ["key"]).collect()} == want
    assert {r["key"] for r in s.fixed_size_sample(rows, 50, ["key"]).collect()} == few


def test_fixed_size_sample_too_few(rows):
    assert s.fixed_size_sample(rows, 3000, ["key"]).count() == 3000
    assert s.fixed_size_sample(rows, 9999, ["key"], allow_fewer=True).count() == 3000
    with pytest.raises(ValueError):
        s.fixed_size_sample(rows, 9999, ["key"])


def test_document_ids_have_no_gaps(rows):
    got = {r["job_id"]: r["key"] for r in assign_document_ids(rows, ["key"]).collect()}
    keys = sorted(got.values(), key=digest)
    assert got == {f"JOB_{i:07d}": key for i, key in enumerate(keys, start=1)}


def test_many_strata_are_not_sorted_by_one_task(spark):
    sizes = spark.range(1, 500).select(F.concat(F.lit("s"), "id").alias("stratum"), (F.col("id") % 40 + 20).alias("size"))
    plan = s.allocate(sizes, 900, small=100)
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.stratum: (r.size, r.n) for r in plan.collect()}
    assert {k: n for k, (_, n) in got.items()} == allocate_by_walking({k: v for k, (v, _) in got.items()}, 900)


def test_earlier_sums(spark):
    rows = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1000)).alias("k"), (F.col("id") % 5).alias("v"))
    data = sorted((r.k, r.v) for r in rows.collect())
    got = {r.k: r.v_before for r in earlier_sums(rows, [F.col("k")], ["v"]).collect()}
    total, want = 0, {}
    for k, v in data:
        want[k], total = total, total + v
    assert got == want
    assert earlier_sums(rows.filter("k < 0"), [F.col("k")], ["v"]).count() == 0
