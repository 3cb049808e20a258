"""Operators against brute force on small fixtures, and plan checks."""

import gzip
import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from repeatwise.functions import mathx as M
from repeatwise.operators import coverage as CV
from repeatwise.operators import family as FM
from repeatwise.operators import genotype as G
from repeatwise.operators import reads as R
from repeatwise.operators import recoord as RC
from repeatwise.operators import tracts as TR


def brute_tracts(seq, limits=TR.Thresholds()):
    found = {}
    for p in range(limits.max_unit, 0, -1):
        same = [i >= p and seq[i] == seq[i - p] and seq[i] in "ACGT" for i in range(len(seq))]
        i = 0
        while i < len(seq):
            j = i
            while j < len(seq) and same[j]:
                j += 1
            if j - i >= limits.max_unit:
                found[(i - p + 1, j)] = seq[i - p : i]
            i = max(j, i + 1)
    keep = lambda a, z, u: z - a + 1 >= limits.min_length and (z - a + 1) // len(u) >= limits.min_units
    return {(a, z, u) for (a, z), u in found.items() if keep(a, z, u)}


def repetitive(rng, size):
    out = ""
    while len(out) < size:
        unit = "".join(rng.choice("ACGTN") if rng.random() < 0.05 else rng.choice("ACGT") for _ in range(rng.randint(1, 6)))
        out += unit * rng.randint(1, 30)
    return out[:size]


@pytest.mark.parametrize("block", [None, 7, 16, 50])
def test_detection_equals_brute_force(spark, block):
    rng = random.Random(5)
    seqs = [repetitive(rng, rng.randint(0, 200)) for _ in range(150)] + ["", "A" * 300, "ACG" * 90]
    df = spark.createDataFrame(list(enumerate(seqs)), "id INT, seq STRING").repartition(3)
    got = {(r.id, r.start, r.stop, r.unit) for r in TR.detect(df, ["id"], "seq", block=block).collect()}
    want = {(i, *t) for i, s in enumerate(seqs) for t in brute_tracts(s)}
    assert got == want


def test_read_detection_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "ACACACACAC")], "id INT, seq STRING")
    plan = TR.detect(df, ["id"], "seq")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_thresholds_fall_back():
    assert TR.Thresholds(min_unit=0, max_unit=0, min_length=2, min_units=1).checked() == TR.Thresholds()


def brute_area(qual, least):
    area = best = 0
    cut, pos = len(qual), len(qual) - 1
    while pos >= 0 and area >= 0:
        area += least - (ord(qual[pos]) - 33)
        if area > best:
            best, cut = area, pos
        pos -= 1
    return cut


def test_area_trim(spark):
    rng = random.Random(3)
    quals = ["".join(chr(33 + rng.choice([2, 10, 19, 20, 21, 35])) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = spark.createDataFrame([(q,) for q in quals], "qual STRING").select("qual", R.kept_length(F.col("qual"), "area").alias("kept")).collect()
    assert all(r.kept == brute_area(r.qual, 20) for r in rows)


def test_condense_and_restore(spark):
    rng = random.Random(11)
    seqs = [repetitive(rng, 120) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(seqs)), "id INT, seq STRING")
    tracts = TR.detect(df, ["id"], "seq")
    listed = TR.with_tracts(TR.condense(df, tracts, ["id"], ["seq"]), tracts, ["id"])
    back = {r.id: r.s for r in listed.select("id", RC.restore(F.col("seq"), F.col("tracts")).alias("s")).collect()}
    assert back == dict(enumerate(seqs))


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_asof_offsets(spark, ranges):
    rng = random.Random(2)
    index = sorted(rng.sample(range(1, 2000), 60))
    reads = [(i, "c1", rng.randint(0, 2300)) for i in range(500)]
    idx = spark.createDataFrame([("c1", p, i + 1) for i, p in enumerate(index)], "chrom STRING, position INT, offset INT")
    df = spark.createDataFrame(reads, "id INT, chrom STRING, at INT")
    got = {r.id: (r.index_position, r.offset) for r in RC.asof_offsets(df.repartition(3), idx, "chrom", "at", ranges).collect()}
    for i, _, at in reads:
        below = [(p, k + 1) for k, p in enumerate(index) if p <= at]
        assert got[i] == (below[-1] if below else (None, 0))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.floats(0.1, 40))
def test_poisson_two_sided(x, rate):
    pmf = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(400)]
    want = sum(p for p in pmf if p <= pmf[x] * (1 + 1e-7))
    assert M.poisson_two_sided(np.array([x]), np.array([rate]))[0] == pytest.approx(want, abs=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40), st.floats(0.001, 0.9))
def test_binomial_upper(x, n, p):
    want = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x, n + 1)) if x else 1.0
    assert M.binomial_upper(np.array([x]), np.array([n]), np.array([p]))[0] == pytest.approx(want, abs=1e-9)


def test_chi_square_upper():
    # 5% points of chi-square for 1..6 degrees
    points = [3.841459, 5.991465, 7.814728, 9.487729, 11.070498, 12.591587]
    assert M.chi_square_upper(np.array(points), np.arange(1, 7)) == pytest.approx([0.05] * 6, abs=1e-6)


def test_obedience_equals_listing():
    rng = np.random.default_rng(0)
    k = 3
    first, second = M.pair_order(k)
    m, f, c = (rng.dirichlet(np.ones(len(first)), 4) for _ in range(3))
    got, kin = M.trio_table(m, f, c, k, None)
    pairs = list(zip(first, second))

    def listing(a, b, d):
        total = 0.0
        for (i, x), (j, y), (h, z) in itertools.product(enumerate(pairs), repeat=3):
            if (z[0] in x and z[1] in y) or (z[1] in x and z[0] in y):
                total += a[i] * b[j] * d[h]
        return total

    for r in range(4):
        assert got[r] == pytest.approx(listing(m[r], f[r], c[r]))
        assert kin[r] == pytest.approx(max(listing(c[r], f[r], m[r]), listing(m[r], c[r], f[r])))
    assert (got <= 1 + 1e-9).all()


def test_mendel_triples_list(spark):
    rows = spark.range(1).select(FM.mendel_triples(F.lit(2)).alias("t")).first().t
    assert len(rows) == len(set(rows)) == 15


def test_batched_sums_equal_row_sums(spark):
    rng = random.Random(9)
    cov = spark.createDataFrame([(l, p, a, rng.randint(1, 9)) for l in range(3) for p in range(30) for a in (8, 9, 11) if rng.random() < 0.7], "locus_id INT, person_id BIGINT, allele_len INT, n BIGINT")
    exp = cov.groupBy("locus_id", "person_id").agg((F.sum("n") / 2.0).alias("exp_cov"))
    loci = G.ranked_alleles(cov)
    rows, model = G.person_rows(cov, exp, loci), G.start_model(loci)
    a = G.batched_sums(G.packed_people(rows, 7), model).toPandas().sort_values(["locus_id", "pair_no"]).reset_index(drop=True)
    b = G.pair_sums(G.pair_rows(G.scored(rows, model))).toPandas().sort_values(["locus_id", "pair_no"]).reset_index(drop=True)
    for c in M.SUM_COLUMNS:
        assert np.allclose(a[c].astype(float), b[c].astype(float)), c
    people = G.pair_rows(G.scored(rows, model)).groupBy("locus_id", "person_id").agg(F.sum("prob").alias("s")).toPandas()
    assert np.allclose(people.s, 1)


def test_packed_people_reach_python_in_small_batches(spark, monkeypatch):
    """However many rows a task has, Python holds a few of the packed rows at a time, and the session's own setting stays."""
    key, seen, store = "spark.sql.execution.arrow.maxBytesPerBatch", [], G.written

    def watched(df, label, *more):
        out = store(df, label, *more)
        if label == "genotypes":
            seen.extend(more)
        return out

    monkeypatch.setattr(G, "written", watched)
    cov = spark.range(4000).selectExpr("CAST(id % 2 AS INT) AS locus_id", "id AS person_id", "CAST(8 + id % 3 AS INT) AS allele_len", "id % 9 + 1 AS n")
    loci = G.ranked_alleles(cov)
    rows = G.person_rows(cov, cov.groupBy("locus_id", "person_id").agg((F.sum("n") / 2.0).alias("exp_cov")), loci)
    own = spark.conf.get(key, None)
    assert G.calls(rows, G.start_model(loci)).count() == 4000 and seen == [G.BATCH] and spark.conf.get(key, None) == own

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    from repeatwise.session import written

    wide = spark.range(0, 64, 1, 1).select(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda x: x.cast("double") + F.col("id")).alias("x"))  # 10 MB in a task
    assert max(r["size"] for r in written(wide.mapInArrow(sizes, "size long"), "sizes", "1m").collect()) < 2 << 20
    spark.conf.set(key, "32m")
    try:
        written(wide.mapInArrow(sizes, "size long"), "sizes", "1m")
        assert spark.conf.get(key) == "32m"
    finally:
        spark.conf.unset(key)


def test_low_rank_equals_svd(spark):
    rng = np.random.default_rng(4)
    a = rng.gamma(3, 2, (25, 12)) * rng.gamma(3, 1, (25, 1))
    cov = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(25) for j in range(12)], "locus_id INT, person_id INT, cov DOUBLE")
    u, d, vt = np.linalg.svd(a)
    low = (u[:, :2] * d[:2]) @ vt[:2]
    low[low < 0] = low[low > 0].min()
    got = {(r.locus_id, r.person_id): r.exp_cov for r in CV.expected_coverage(cov, 2).collect()}
    assert len(got) == 25 * 12
    assert max(abs(got[i, j] - low[i, j]) for i in range(25) for j in range(12)) < 1e-3


def test_low_rank_product_is_not_broadcast(spark, monkeypatch):
    """Packed people are far larger than their file, so no pair of blocks goes through the driver; several blocks give the whole product."""
    plans, store = {}, CV.written
    monkeypatch.setattr(CV, "written", lambda df, label: plans.update({label: df._jdf.queryExecution().executedPlan().toString()}) or store(df, label))
    monkeypatch.setattr(CV, "SIDE", 5, raising=False)
    a = np.random.default_rng(5).gamma(3, 2, (12, 18))
    cov = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(12) for j in range(18)], "locus_id INT, person_id INT, cov DOUBLE")
    u, d, vt = np.linalg.svd(a)
    low = (u[:, :3] * d[:3]) @ vt[:3]
    low[low < 0] = low[low > 0].min()
    got = {(r.locus_id, r.person_id): r.exp_cov for r in CV.expected_coverage(cov, 3).collect()}
    assert len(got) == 12 * 18 and max(abs(got[i, j] - low[i, j]) for i in range(12) for j in range(18)) < 1e-3
    assert "BroadcastExchange" not in plans["expected"]


def test_sequence_blocks_are_dealt_out(spark):
    df = spark.createDataFrame([(1, "ACACACACAC" * 20)], "id INT, seq STRING")
    plan = TR.detect(df, ["id"], "seq", block=50)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan.replace("#", " ").split("MapInArrow")[1] or "hashpartitioning" in plan.split("MapInArrow")[1]


def test_odd_headers_do_not_stop_the_job(spark):
    df = spark.createDataFrame([("r1 1:N:0:ACGT",), ("r2/2",), ("r3",), ("r4 x",), ("",)], "h STRING")
    got = [(r.name, r.mate) for r in df.select(R.parse_header(F.col("h")).alias("p")).select("p.*").collect()]
    assert got == [("r1", 1), ("r2", 2), ("r3", 3), ("r4", None), ("", None)]


def test_encoding_sees_all_reads(spark):
    df = spark.createDataFrame([("a", "hhhh")] * 1500 + [("a", "!hhh"), ("b", "hhhh"), ("c", "JJ")], "file STRING, qual STRING")
    assert {r.file: r.encoding for r in R.guess_encoding(df).collect()} == {"a": "phred33", "b": "phred64", "c": "unknown"}


def test_chi_square_tail_of_many_alleles():
    values = M.chi_square_upper(np.array([1500.0, 1500.0, 3000.0, 10.0, 0.0]), np.array([1500, 1501, 1500, 0, 5]))
    assert values[:2] == pytest.approx([0.495, 0.502], abs=0.01)
    assert 0 < values[2] < 1e-90
    assert values[3:].tolist() == [1.0, 1.0]


def test_siblings_are_never_mixed(spark):
    """Of two siblings the one with the smaller id stands for the role, with all its fields."""
    from repeatwise.operators import denovo as DN

    people = [(1, 7, "mother"), (2, 7, "father"), (3, 7, "self"), (5, 7, "sibling"), (4, 7, "sibling")]
    person = spark.createDataFrame([(p, f, r, "F", "whole blood") for p, f, r in people], "person_id INT, family_id INT, relation STRING, sex STRING, sample_type STRING")
    calls = spark.createDataFrame([(0, 1, 8, 8), (0, 2, 9, 9), (0, 3, 8, 9), (0, 4, 8, 20), (0, 5, 10, 11)], "locus_id INT, person_id INT, allele_1 INT, allele_2 INT")
    (row,) = DN.member_records(calls, person, ["allele_1", "allele_2"]).collect()
    assert (row.sibling_allele_1, row.sibling_allele_2) == (8, 20)
    post = calls.withColumn("k", F.lit(1)).withColumn("lens", F.array(F.lit(8))).withColumn("p", F.array(F.col("allele_2").cast("double")))
    (fam,) = FM.family_rows(post, person).collect()
    assert fam.sibling == [20.0]


def test_read_names_have_one_rule(spark):
    from repeatwise.operators import profile as PR

    small, large = spark.range(300).selectExpr("1 AS locus", "id AS read_name"), spark.range(12_000).selectExpr("2 AS locus", "id AS read_name")
    rows = PR.read_names(small.union(large), ["locus"]).collect()
    assert sorted(r.part for r in rows if r.locus == 1) == [0] and sorted(r.part for r in rows if r.locus == 2) == [0, 1, 2]
    assert sorted(int(x) for r in rows if r.locus == 2 for x in r.names.split(",")) == list(range(12_000))


def test_chromosome_numbers(spark):
    from repeatwise.operators import profile as PR

    df = spark.createDataFrame([("chr2",), ("chrX",), ("Y",), ("chrM",), ("chrUn",)], "c STRING")
    assert [r.n for r in df.select(PR.chrom_number(F.col("c")).alias("n")).collect()] == [2, 23, 24, 25, None]


def test_vcf_files_are_whole(spark, tmp_path):
    from repeatwise.sources import text as IO

    rows = [(p, c, pos, ".", "AC", ".", 50.0, ".", "END=1", "GT", "0/0") for p in (1, 2, 3) for c in ("chrX", "chr10", "chr2") for pos in (30, 5)]
    df = spark.createDataFrame(rows, "person_id INT, chrom STRING, pos INT, id STRING, ref STRING, alt STRING, qual DOUBLE, filter STRING, info STRING, format STRING, sample STRING")
    IO.write_vcf(df.repartition(5), str(tmp_path / "vcf"))
    for p in (1, 2, 3):
        (file,) = (tmp_path / "vcf" / f"person_id={p}").glob("part-*")
        lines = file.read_text().splitlines()
        head = [x for x in lines if x.startswith("#")]
        assert lines[: len(head)] == head and head[-1].startswith("#CHROM")
        assert [tuple(x.split("\t")[:2]) for x in lines[len(head) :]] == [(c, pos) for c in ("chr2", "chr10", "chrX") for pos in ("5", "30")]


def test_resampling_draws_with_replacement(spark):
    cov = spark.range(4000).selectExpr("CAST(id / 40 AS INT) AS locus_id", "CAST(id % 40 AS INT) AS person_id", "CAST(id % 100 + 1 AS DOUBLE) AS cov")
    drawn = CV.resampled(cov, 3)
    mean, sd, n = drawn.agg(F.avg("cov"), F.stddev("cov"), F.count("*")).first()
    assert n == 4000 and mean == pytest.approx(50.5, abs=2) and sd == pytest.approx(28.9, abs=1.5)
    assert drawn.select("locus_id", "person_id").distinct().count() == 4000


def test_singular_values_equal_numpy(spark):
    rng = np.random.default_rng(4)
    a = rng.random((30, 12)) * np.linspace(1, 3, 12)
    cov = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(30) for j in range(12)], "locus_id INT, person_id INT, cov DOUBLE")
    _, values, residual = CV.singular_vectors(cov, 5)
    assert values == pytest.approx(np.linalg.svd(a, compute_uv=False)[:5], rel=1e-5) and residual <= 1e-7
    assert [r.singular_value for r in CV.singular_values(cov, 3).orderBy("component").collect()] == pytest.approx(values[:3], rel=1e-6)


def test_one_file_per_person(spark, tmp_path):
    """Rows of a person that lie in many partitions come in one file."""
    from repeatwise.sources import text as IO

    rows = spark.range(120).selectExpr("id % 3 AS person_id", "id AS x").repartition(8, "x")
    IO.write_person_files(rows, str(tmp_path / "people"))
    assert [len(list((tmp_path / "people" / f"person_id={i}").glob("part-*"))) for i in range(3)] == [1, 1, 1]
    assert spark.read.csv(str(tmp_path / "people")).groupBy("person_id").count().collect() and spark.read.csv(str(tmp_path / "people")).count() == 120


def test_people_are_listed_in_groups(spark, tmp_path, monkeypatch):
    """Folders of many people lie in groups, which are read one after the other; files written by tasks hold the lines of Spark's writer."""
    from repeatwise.sources import text as IO

    monkeypatch.setattr(IO, "GROUP", 3)
    texts = ["a", "", None, 'q"x', "two\twords", " lead", "\\", "#c"]
    rows = spark.createDataFrame([(None if i == 13 else i % 13, texts[i % 8], i, None if i % 3 else 0.5) for i in range(91)], "person_id LONG, t STRING, x LONG, y DOUBLE").repartition(8, "x")
    for kind in ("LONG", "STRING"):  # by the tasks, and by Spark
        IO.write_person_files(rows.withColumn("person_id", F.col("person_id").cast(kind)), str(tmp_path / kind))
    for kind in ("LONG", "STRING"):
        files = list((tmp_path / kind).glob("people=*/person_id=*/part-*"))
        assert len(files) == 14 and len({f.parts[-3] for f in files}) > 1 and not list((tmp_path / kind).glob("people=*/person_id=*/_*"))
    lines = [sorted((f.parts[-2], line) for f in (tmp_path / k).glob("people=*/*/part-*") for line in gzip.open(f, "rt")) for k in ("LONG", "STRING")]
    assert lines[0] == lines[1] and len(lines[0]) == 91
    reads, csv = [], type(spark.read).csv
    monkeypatch.setattr(type(spark.read), "csv", lambda self, at, **a: reads.append(at) or csv(self, at, **a))
    back = IO.read_person_files(spark, str(tmp_path / "LONG"), "t STRING, x LONG, y DOUBLE", ["person_id", "x", "y"])
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select("person_id", "x", "y").collect()))
    assert len(reads) == len(list((tmp_path / "LONG").glob("people=*"))) and all("people=" in at for at in reads)


def test_files_of_few_people_are_written_by_many_tasks(spark, tmp_path):
    """However small the rows are, people are dealt to as many tasks as the session asks for."""
    from repeatwise.sources import text as IO

    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    IO.write_person_files(spark.range(0, 40, 1, 1).selectExpr("id AS person_id", "id AS x"), str(tmp_path / "people"))
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in set(status.getJobIdsForGroup(None)) - set(before) for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 8
    assert len(list((tmp_path / "people").glob("person_id=*/part-*"))) == 40


def test_long_batches_are_searched_in_steps():
    """A batch is cut into steps of bounded size that hold all its rows in order; a row longer than a step is one of its own."""
    import pyarrow as pa

    texts = ["ACGT" * n for n in (10, 0, 500, 3, 700, 1)] + [None, "AC"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "seq"])
    steps = list(TR._steps(batch, "seq", 1000))
    assert [i for s in steps for i in s.column("i").to_pylist()] == list(range(len(texts)))
    assert len(steps) > 2 and all(s.num_rows == 1 or sum(len(t or "") for t in s.column("seq").to_pylist()) <= 1000 for s in steps)


def test_genotyper_input_is_put_together_once(spark, tmp_path, monkeypatch):
    """Steps on the same data share the person rows, which equal those of the views."""
    from repeatwise.fixtures import Views
    from repeatwise.plans import genotypes as GT

    lines = spark.range(60).selectExpr(
        "id AS l_orderkey", "id % 5 AS l_partkey", "id % 4 AS l_suppkey", "CAST(id % 7 + 1 AS INT) AS l_linenumber", "CAST(id AS DOUBLE) AS l_quantity", "0.05 AS l_discount",
        "0.01 AS l_tax", "'A' AS l_returnflag", "'F' AS l_linestatus")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    v, made, build = Views(spark, str(tmp_path)), [], G.person_rows
    want = build(v.allele_cov, v.expected, G.ranked_alleles(v.allele_cov))
    monkeypatch.setattr(G, "person_rows", lambda *a: made.append(1) or build(*a))
    first, second = GT.start(v)[0], GT.start(v)[0]
    assert len(made) == 1 and sorted(map(str, first.collect())) == sorted(map(str, second.collect())) == sorted(map(str, want.collect()))


def test_singular_values_without_gaps(spark):
    """Values that lie close together settle after the few rounds that fill the space."""
    rng = np.random.default_rng(6)
    a = np.sqrt(np.linspace(1.0, 1.02, 20))[:, None] * np.linalg.qr(rng.normal(size=(32, 20)))[0].T
    cov = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(20) for j in range(32)], "locus_id INT, person_id INT, cov DOUBLE")
    vectors, values, _ = CV.singular_vectors(cov, 2, extra=3, rounds=8)
    assert values == pytest.approx(np.linalg.svd(a, compute_uv=False)[:2], rel=1e-9)
    v = np.array([[r.v0, r.v1] for r in vectors.orderBy("person_id").collect()])
    assert v.T @ v == pytest.approx(np.eye(2), abs=1e-8) and np.linalg.norm(a @ v, axis=0) == pytest.approx(values, rel=1e-9)


def test_equilibrium_of_all_degrees(spark):
    """P-values of odd degrees are there too, and people's counts leave out loci out of equilibrium."""
    import math

    import __spark_entry__ as entry

    def tail(x, df):
        """Upper tail of chi-square by its finite sum."""
        total, term = (0.0, math.exp(-x / 2)) if df % 2 == 0 else (math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2))
        for j in range(2 if df % 2 == 0 else 3, df + 2, 2):
            total, term = total + term, term * x / j
        return total

    queries, sf = entry.queries(), "/root/testdata/sf0.001"
    want = {r.locus_id: tail(r.score, r.df) for r in queries["st11_hardy_weinberg"](spark, sf).collect() if r.score is not None and r.df > 0}
    got = {r.locus_id: r.p_value for r in queries["st11_hwe_p_values"](spark, sf).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    even = {r.locus_id for r in queries["st11_hwe_p_value"](spark, sf).collect()}
    assert even < set(got)
    count = lambda name: sum(sum(r[1:]) for r in queries[name](spark, sf).collect())
    assert (count("st12_het_loci_in_equilibrium") < count("st12_het_loci_by_context")) == any(p <= 0.05 for p in got.values())
