"""Body reader, compaction and orphan references on small cases."""

from __future__ import annotations

import glob
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.operators import compaction
from spindrift.operators.compaction import ReconciliationError, compact
from spindrift.operators.orphans import Reference, find_orphans, key_code, key_runs, match_runs, normal_key
from spindrift.sources.delimited_bodies import read_bodies

BODIES = [
    ("comma", "mu,method,error\n0.1,target,0.2\n.2,source,0.3", [(0.1, "target", 0.2), (0.2, "source", 0.3)]),
    ("decimal comma", "mu;method;error\r\n0,1;target;0,2\r\n", [(0.1, "target", 0.2)]),
    ("quoted tabs", '"method"\t"mu"\t"error"\n"target"\t"1e-1"\t""\n', [(0.1, "target", None)]),
    ("separator in quotes", 'method,mu,error\n"a,b",0.1,0.5\n', [(0.1, "a,b", 0.5)]),
    ("first field empty", 'error,mu,method\n,"0.1",x\n', [(0.1, "x", None)]),
    ("byte order mark, case, blanks", "﻿MU; METHOD ;ERROR\n 0.1 ; target ;0.2\n\n", [(0.1, "target", 0.2)]),
    ("broken off", "mu,method,error\n0.1,target,0.2\n0.2,sour", [(0.1, "target", 0.2)]),
    ("broken in quotes", '"mu","method","error"\n"0.1","target","0.', []),
    ("column missing", "mu,method\n0.1,target\n", [(0.1, "target", None)]),
    ("column added", "host,mu,method,error\nh,0.1,target,0.2\n", [(0.1, "target", 0.2)]),
    ("header again", "mu,method,error\n0.1,target,0.2\nmu,method,error\n", [(None, "method", None), (0.1, "target", 0.2)]),
    ("header alone", "mu,method,error\n", []),
    ("empty", "", []),
    ("null", None, []),
]


def test_bodies(spark):
    files = spark.createDataFrame([(n, b) for n, b, _ in BODIES], "name string, body string")
    got: dict[str, list] = {}
    for r in read_bodies(files, "body", ["name"], ["method"], ["mu", "error"]).collect():
        got.setdefault(r["name"], []).append((r["mu"], r["method"], r["error"]))
    for name, _, want in BODIES:
        assert sorted(got.get(name, []), key=repr) == sorted(want, key=repr), name


def test_long_body(spark):
    body = "mu,method,error\n" + "".join(f"{i},m{i},0.5\n" for i in range(20000))
    files = spark.createDataFrame([("a", body)], "name string, body string")
    assert read_bodies(files, "body", ["name"], ["method"], ["mu"]).distinct().count() == 20000


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_compact_keeps_all_rows(spark, tmp_path, n):
    rnd = random.Random(n)
    rows = [(rnd.choice(["hot", "hot", None, "b", "c"]), rnd.choice([None, rnd.randint(0, 9)]), rnd.choice(["", "x" * 50, "é"])) for _ in range(n)]
    df = spark.createDataFrame(rows + rows[: n // 10], "k string, v int, `a b` string").repartition(7)
    path = str(tmp_path / "out")
    report = compact(df, path, ["k", "v"], target_bytes=2_000)
    back = spark.read.schema(df.schema).parquet(path)
    assert rows_of(back) == rows_of(df)
    assert report.rows == n + n // 10
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) <= max(report.files, 1)
    if n == 3000:
        assert report.files > 1
        # The hot key is spread over files, and every file is sorted.
        per_file = back.groupBy(F.input_file_name().alias("f")).agg(F.count_if(F.col("k") == "hot").alias("hot"))
        assert per_file.where("hot > 0").count() > 1
    # A second run replaces the folder.
    compact(df.limit(5), path, ["k"])
    assert spark.read.parquet(path).count() == min(5, n + n // 10)
    assert not glob.glob(f"{path}.*")


def test_compact_keeps_the_old_folder_if_counts_differ(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    compact(spark.range(10), path, ["id"])
    real = compaction._sums
    calls = []

    def wrong(df):
        calls.append(1)
        return real(df) if len(calls) == 1 else [F.lit(0).alias("n"), real(df)[1]]

    monkeypatch.setattr(compaction, "_sums", wrong)
    with pytest.raises(ReconciliationError):
        compact(spark.range(20), path, ["id"])
    assert spark.read.parquet(path).count() == 10
    assert not glob.glob(f"{path}.*")


def test_broken_lines_are_told(spark):
    body = 'mu,method,error\n0.1,target,0.2\n0.2,sour\nmu,method,error\n"0.3","x'
    rows = read_bodies(spark.createDataFrame([("a", body)], "name string, body string"), "body", ["name"], ["method"], ["mu"], broken="broken").collect()
    assert sorted((r["broken"], r["mu"], r["method"]) for r in rows if not r["broken"] and r["mu"]) == [(False, 0.1, "target")]
    assert sorted(r["broken"] for r in rows) == [False, False, True, True]
    assert all(r["mu"] is None and r["method"] is None for r in rows if r["broken"])


def test_lines_are_split_once(spark):
    files = spark.createDataFrame([("a", "mu,method\n1,x")], "name string, body string")
    plan = read_bodies(files, "body", ["name"], ["method"], ["mu"])._jdf.queryExecution().executedPlan().toString()
    # Once for the header, once for the lines.
    assert plan.count("regexp_extract_all(") <= 2


def test_a_broken_swap_is_taken_back(spark, tmp_path):
    path = str(tmp_path / "out")
    compact(spark.range(10), path, ["id"])
    # Between the two renames the job was lost.
    (tmp_path / "out").rename(tmp_path / "out.old-1")
    spark.range(3).write.parquet(path + ".staging-2")
    compaction.recover(spark, path)
    assert spark.read.parquet(path).count() == 10
    assert not glob.glob(f"{path}.*")
    # After them, before the old folder was deleted.
    spark.range(4).write.parquet(path + ".old-3")
    compact(spark.range(20), path, ["id"])
    assert spark.read.parquet(path).count() == 20
    assert not glob.glob(f"{path}.*")


def test_ranges_of_the_files_do_not_overlap(spark, sf, monkeypatch):
    from spindrift.plans import problems

    monkeypatch.setattr(problems, "SMALL_TARGET_BYTES", 2 << 10)
    got = sorted(problems.p1_ranges(spark, sf).collect(), key=lambda r: r["first"])
    assert len(got) >= 4
    assert all(a["last"] <= b["first"] for a, b in zip(got, got[1:]))


def test_key_codes_are_one_to_one(spark):
    keys = ["a", "a1", "a01", "a001", "a10", "1", "01", "0", "00", "", "acgtacgt", "acgtacgt-1", "acgtacgt-2", "aacgtacgt", "tttttttt", "a9999999999999999999", "9" * 15, "9" * 16, "a-1", "é12", " b 7"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    codes = df.select(key_code(F.col("k")).alias("c")).select("c.stem", "c.num").collect()
    assert len({tuple(r) for r in codes}) == len(keys)


def test_runs(spark):
    nums = [1, 2, 3, 7, 8, 65535, 65536]
    keys = spark.createDataFrame([("s", n >> 16, n) for n in nums], "stem string, block long, num long")
    runs = sorted((r["run_start"], r["run_end"]) for r in key_runs(keys).collect())
    assert runs == [(1, 3), (7, 8), (65535, 65535), (65536, 65536)]
    refs = spark.createDataFrame([("s", n >> 16, n) for n in range(10)] + [("s", 1, 65537), ("t", 0, 1)], "stem string, block long, num long")
    got = {(r["stem"], r["num"]) for r in match_runs(refs, key_runs(keys)).where("known").collect()}
    assert got == {("s", n) for n in (1, 2, 3, 7, 8)}


def brute_orphans(child, parent):
    out = set()
    norm = lambda k: (k or "").strip().lower()
    for rid, k, at in child:
        if not norm(k):
            continue
        same = [(a, d) for p, a, d in parent if norm(p) == norm(k)]
        if any(a <= at and (d is None or d > at) for a, d in same):
            continue
        out.add((rid, "missing" if not same else "deleted" if any(a <= at for a, _ in same) else "late"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_orphans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    day = lambda: datetime(2023, 1, 1) + timedelta(hours=rnd.randint(0, 40))
    pool = ["Gene1", "gene2 ", "GENE3", "x", "ACGTACGTAC-1", "acgtacgtac-2", None, "  ", "q10", "q11", "\tq12"]
    parent = []
    for _ in range(25):
        a = day()
        parent.append((rnd.choice(pool[:9]), a, None if rnd.random() < 0.4 else a + timedelta(hours=rnd.randint(1, 20))))
    child = [(i, rnd.choice([*pool, "gene1", "gene1", "GENE1"]), day()) for i in range(150)]
    cdf = spark.createDataFrame(child + child[:20], "row_id long, sym string, loaded_at timestamp_ntz").withColumn("deleted_at", F.lit("clash"))
    pdf = spark.createDataFrame(parent + parent[:5], "key string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    got = find_orphans([("c", cdf, "row_id", [(Reference("r", "sym", "key"), pdf)])])
    rows = [(r["row_id"], r["kind"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute_orphans(child, parent)


def test_orphans_of_empty_tables(spark):
    child = spark.createDataFrame([(1, "a", None)], "row_id long, sym string, loaded_at timestamp_ntz")
    parent = spark.createDataFrame([], "key string, loaded_at timestamp_ntz")
    ref = [(Reference("r", "sym", "key"), parent)]
    assert [r["kind"] for r in find_orphans([("c", child, "row_id", ref)]).collect()] == ["missing"]
    assert find_orphans([("c", child.limit(0), "row_id", ref)]).count() == 0


def test_normal_key(spark):
    df = spark.createDataFrame([(" A\t",), ("",), (None,), ("  ",)], "k string")
    assert [r[0] for r in df.select(normal_key(F.col("k"))).collect()] == ["a", None, None, None]
