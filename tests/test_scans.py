"""Scans, selections, tiles and split readers against plain versions, on data cut into many small parts."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from repeatwise.fixtures import Views
from repeatwise.functions.scan import FAN, exclusive_scan
from repeatwise.functions.selection import exact_quantiles
from repeatwise.operators import population as PO
from repeatwise.operators import recoord as RC
from repeatwise.operators import tracts as TR
from repeatwise.plans import recoord as RP, tracts as TP
from repeatwise.sources import text as IO

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_exclusive_scan(spark):
    rng = random.Random(1)
    rows = [(k, b, rng.randint(-50, 50)) for k in ("x", "y") for b in sorted(rng.sample(range(4 * FAN), 900))]
    df = spark.createDataFrame(rows, "k STRING, blk BIGINT, value BIGINT").repartition(5)
    for how, fn in (("sum", sum), ("max", max)):
        got = {(r.k, r.blk): r.carry for r in exclusive_scan(df, ["k"], how).collect()}
        for k, b, _ in rows:
            before = [v for kk, bb, v in rows if kk == k and bb < b]
            assert got[k, b] == (fn(before) if before else None)


def brute_islands(tracts):
    out = []
    for s, e in sorted(tracts):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_islands_and_offsets_by_blocks(spark, block):
    """Tracts that cross and span blocks, touch at their borders, and nest."""
    rng = random.Random(3)
    rows = [(k, s, s + rng.choice([2, 7, 30, 400])) for k in (1, 2) for s in rng.sample(range(1, 9000), 300)]
    rows += [(3, 1, 10), (3, 11, 20), (3, 4, 5), (3, 22, 64), (3, 65, 65), (3, 1000, 3000), (3, 1500, 1501), (3, 3001, 3001)]
    df = spark.createDataFrame(rows, "k INT, start BIGINT, stop BIGINT").repartition(4)
    found = TR.islands(df, ["k"], block).collect()
    index = {(r.k, r.position): r.offset for r in TR.offset_index(df, ["k"], block).collect()}
    want = {}
    for k in (1, 2, 3):
        mine = brute_islands([(s, e) for kk, s, e in rows if kk == k])
        assert sorted((r.start, r.stop) for r in found if r.k == k) == mine
        removed = 0
        for s, e in mine:
            removed += e - s + 1
            want[k, e - removed + 1] = removed
    assert index == want


def test_one_long_sequence(spark):
    """10 million bases in one row: tracts, islands and offsets come from many tasks and no window holds the sequence."""
    rng = np.random.default_rng(8)
    unit = "".join(rng.choice(list("ACGT"), 250_000))
    seq = unit * 40
    df = spark.createDataFrame([("chr", seq)], "chrom STRING, seq STRING")
    tracts = TR.detect(df, ["chrom"], "seq", block=1 << 16)
    index = TR.offset_index(tracts, ["chrom"], 1 << 18)
    rows = sorted((r.position, r.offset) for r in index.collect())
    one = sorted((r.start, r.stop) for r in TR.detect(spark.createDataFrame([("u", unit * 3)], "chrom STRING, seq STRING"), ["chrom"], "seq").collect())
    middle = [t for t in one if 250_000 < t[0] <= 500_000]
    assert abs(len(rows) - 40 * len(brute_islands(middle))) <= 40
    assert rows == sorted(rows, key=lambda x: x[1]) and rows[-1][1] == sum(e - s + 1 for s, e in brute_islands([(r.start, r.stop) for r in tracts.select("start", "stop").collect()]))
    given = spark.createDataFrame([("chr", 1, 9)], "chrom STRING, start BIGINT, stop BIGINT")
    for line in plan(TR.offset_index(given, ["chrom"]))[0].splitlines():
        if "Window " in line and "windowspecdefinition(" in line:
            keys = line.split("windowspecdefinition(")[1]
            assert "blk" in keys or "_group" in keys, line


def test_reads_carry_their_tracts_without_a_shuffle(spark):
    v = Views(spark, SF)
    frames = [
        TP.carried(v), TP._with_reads(v), TR.tract_quality(TP._with_reads(v), "qual"), RP.turned(v).select("read_id", RC.leading_bases(F.col("tracts")).alias("n")), TR.each_tract(RP.turned(v)),
        TP.carried(v).select("read_id", TR.condensed(F.col("seq"), F.col("tracts")).alias("s")),
    ]
    for df in frames:
        exchanges = [line for line in plan(df)[1].splitlines() if "Exchange " in line]
        assert all("RoundRobinPartitioning" in line for line in exchanges)  # the fixture spreads the raw texts of a small table
    reads = v.reads.select("read_id", "mate", "seq")
    carried = sorted((r.read_id, r.mate, r.start, r.stop, r.unit) for r in TR.each_tract(TR.carry_tracts(reads)).collect())
    assert carried == sorted((r.read_id, r.mate, r.start, r.stop, r.unit) for r in TR.detect(reads, ["read_id", "mate"], "seq").collect())


def test_asof_over_chromosomes_and_ranges(spark):
    """Ranges that begin without an index row, one busy position, chromosomes without an index, null chromosomes and positions."""
    rng = random.Random(6)
    index = [(c, p, i + 1) for c in ("a", "c", "d") for i, p in enumerate(sorted(rng.sample(range(10, 900), 3)))]
    reads = [(i, rng.choice("abcde"), rng.randint(0, 1000)) for i in range(600)] + [(1000 + i, "c", 500) for i in range(800)] + [(5000, None, 3), (5001, "a", None)]
    idx = spark.createDataFrame(index, "chrom STRING, position BIGINT, offset BIGINT")
    df = spark.createDataFrame(reads, "id INT, chrom STRING, at INT").repartition(6)
    out = RC.asof_offsets(df, idx, "chrom", "at", 30)
    got = {r.id: (r.index_position, r.offset) for r in out.collect()}
    assert len(got) == len(reads)
    for i, c, at in reads:
        below = [(p, n) for cc, p, n in index if cc == c and at is not None and p <= at]
        assert got[i] == (max(below) if below else (None, 0)), (i, c, at)
    assert "Join" not in "".join(line for line in plan(out)[0].splitlines() if "chrom" in line.split("Join")[-1][:40])


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_fasta_over_many_splits(spark, small_splits, tmp_path):
    rng = random.Random(4)
    records, text = {}, {"a.fa": "", "b.fa": "", "c.fa": "no header\n"}
    for i in range(14):
        seq = "".join(rng.choice("acgtn") if rng.random() < 0.5 else "ac" * rng.randint(1, 9) for _ in range(rng.choice([0, 1, 40, 900, 6000])))
        width = rng.choice([13, 60, 61])
        name = f"c{i} x>y"
        text[rng.choice("ab") + ".fa"] += f">  {name}\n" + "".join(seq[j : j + width] + rng.choice(["\n", "\r\n", " \n"]) for j in range(0, len(seq), width)) + rng.choice(["", "\n"])
        records[name] = seq.upper()
    for name, body in text.items():
        (tmp_path / name).write_text(body)
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 20
    assert {r.chrom: r.seq for r in IO.read_fasta(spark, path).collect()} == {n: s for n, s in records.items() if s}
    for block in (10, 64, 1 << 14):
        blocks = IO.read_fasta_blocks(spark, path, block).collect()
        assert max(len(r.seq) for r in blocks) <= block + 6
        for name, seq in records.items():
            mine = sorted((r for r in blocks if r.chrom == name), key=lambda r: r.blk)
            assert "".join(r.seq[r.ctx :] for r in mine) == seq and [r.is_last for r in mine] == [False] * (len(mine) - 1) + [True] * bool(mine)
        got = sorted((r.chrom, r.start, r.stop, r.unit) for r in TR.detect_blocks(IO.read_fasta_blocks(spark, path, block), ["rec", "chrom"], "seq").collect())
        whole = spark.createDataFrame(list(records.items()), "chrom STRING, seq STRING")
        assert got == sorted((r.chrom, r.start, r.stop, r.unit) for r in TR.detect(whole, ["chrom"], "seq").collect())


@pytest.mark.parametrize("n_people", [1, 5, 256, 257, 700])
def test_matrix_tiles(spark, n_people):
    rng = random.Random(n_people)
    people = spark.createDataFrame([(1000 + c, c) for c in range(n_people)], "person_id BIGINT, col_no BIGINT")
    cells = {(k, c): rng.randint(1, 99) for k in range(6) for c in rng.sample(range(n_people), max(1, n_people * k // 6))}
    df = spark.createDataFrame([(k, 1000 + c, n) for (k, c), n in cells.items()], "k INT, person_id BIGINT, n BIGINT").repartition(3)
    got = {r.k: r.counts for r in PO.dense_rows(df, ["k"], people, n_people).collect()}
    assert got == {k: ",".join(str(cells.get((k, c), 0)) for c in range(n_people)) for k in range(6)}


def test_matrix_of_20000_people(spark):
    n = 20_000
    people = spark.range(n).select(F.col("id").alias("person_id"), F.col("id").alias("col_no"))
    cells = spark.range(n * 5).select((F.col("id") % 5).alias("k"), F.floor(F.col("id") / 5).alias("person_id"), (F.col("id") % 7).alias("n")).filter("person_id % 3 = 0")
    rows = {r.k: r.counts.split(",") for r in PO.dense_rows(cells, ["k"], people, n).collect()}
    assert all(rows[k] == [str((5 * p + k) % 7) if p % 3 == 0 else "0" for p in range(n)] for k in range(5))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    groups = {"one": [3.5], "ties": [2.0] * 501 + [7.25] * 500, "wide": list(rng.lognormal(0, 8, 4001)), "even": list(rng.normal(size=1000)), "near": list(1 + rng.integers(0, 9000, 999) * 2.0**-50), "signs": [-1e300, 0.0, 1e-300, 5.0]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)], "k STRING, x DOUBLE").repartition(7)
    for share in (0.5, 0.0, 0.9, 1.0):
        got = {r.k: r.quantile for r in exact_quantiles(df, ["k"], "x", share).collect()}
        assert set(got) == set(groups)
        for k, xs in groups.items():
            assert got[k] == pytest.approx(np.quantile(xs, share), rel=1e-12, abs=0), (k, share)
    assert "percentile" not in os.linesep.join(plan(exact_quantiles(df, ["k"], "x")))


def test_area_trim_walks_many_strings_at_once(spark):
    """The cut of every string is that of a walk from its 3' end, whatever stands beside it; no expression per base."""
    from repeatwise.operators import reads as R

    def walk(text):
        area = best = cut = 0
        for seen, c in enumerate(reversed(text), 1):
            area += 20 - (ord(c) - 33)
            if area < 0:
                break
            if area > best:
                best, cut = area, seen
        return len(text) - cut

    rng = random.Random(3)
    texts = ["".join(rng.choice("#$+567IHé😀") for _ in range(rng.randint(1, 50))) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, qual string").select("i", R.kept_length(F.col("qual"), "area").alias("kept"))
    assert {r.i: r.kept for r in df.collect()} == {i: None if t is None else walk(t) for i, t in enumerate(texts)}
    assert "lambdafunction" not in df._jdf.queryExecution().toString()


def test_fastq_records_are_put_together_in_order(spark, tmp_path):
    """Whole records need no shuffle or sort; those over batches, byte ranges and a cut end of the file come out as well."""
    records = [(f"@r{i}", "ACGT" * (i % 5), "+", "@" * (i % 7)) for i in range(3001)]
    (tmp_path / "a.fastq").write_text("\n".join("\n".join(r) for r in records) + "\n@last\nAC\n")
    (tmp_path / "b.fastq").write_text("@b\n\n+\n\n")
    want = {("a", i, *r) for i, r in enumerate(records)} | {("a", 3001, "@last", "AC", None, None), ("b", 0, "@b", "", "+", "")}
    for size, batch in (("128m", "10000"), ("5k", "7")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            df = IO.read_fastq(spark, str(tmp_path))
            found = [(r.file.split("/")[-1][0], r.rec, r.l1, r.l2, r.l3, r.l4) for r in df.collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(found) == len(want) and set(found) == want
    assert "Union" in df._jdf.queryExecution().optimizedPlan().toString()
