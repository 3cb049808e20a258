"""Text sources and sinks: FASTA, FASTQ, tract, offset, profile, matrix, person and VCF files.

All readers are Spark text or CSV scans; gzip is transparent. Writers are ``df.write``.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.numbering import number_rows
from ..operators import tracts as TR, vcf as V
from ..operators.population import relation_code
from ..operators.profile import chrom_number
from ..operators.reads import parse_header
from ..session import scratch_path, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package


def fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """Sequence lines of FASTA files: ``rec`` (number of the record), ``chrom``, ``at`` (bases of the record before the line) and ``bases`` in upper case.

    Every byte range of a file numbers its own lines and bases. One row per range, with its last header and its bases, is carried to the
    ranges that follow, so a record may span any number of ranges and none is read in one task. Headers lose leading blanks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("mid"), "value"
    )
    kept = written(lines, "fasta-lines").withColumn("is_head", F.col("value").startswith(">"))
    parsed = kept.select(
        "file", "split", "mid", F.when(F.col("is_head"), F.struct(F.col("mid").alias("rec"), F.trim(F.substring("value", 2, 1 << 30)).alias("chrom"))).alias("head"),
        F.when(F.col("is_head"), "").otherwise(F.upper(F.regexp_replace("value", r"\s", ""))).alias("bases"))
    here = Window.partitionBy("file", "split").orderBy("mid")
    placed = parsed.withColumn("before", F.coalesce(F.sum(F.length("bases")).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "begun", F.when(F.col("head").isNotNull(), F.col("before")))
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    headed = placed.withColumn("head", F.last("head", ignorenulls=True).over(upto)).withColumn("begun", F.max("begun").over(upto))

    ranges = placed.groupBy("file", "split").agg(
        F.sum(F.length("bases")).alias("total"), F.max("begun").alias("begun"), F.max_by("head", F.when(F.col("head").isNotNull(), F.col("mid"))).alias("head"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # one row per byte range
    summed = ranges.withColumn("so_far", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    given = summed.select(
        "file", "split", F.last("head", ignorenulls=True).over(earlier).alias("given"),
        (F.col("so_far") - F.max(F.col("so_far") + F.col("begun")).over(earlier)).alias("given_bases"))
    known = headed.filter(F.length("bases") > 0).join(given, ["file", "split"])
    record = F.coalesce("head", "given")
    at = F.when(F.col("head").isNotNull(), F.col("before") - F.col("begun")).otherwise(F.col("before") + F.col("given_bases"))
    return known.filter(record.isNotNull()).select(record["rec"].alias("rec"), record["chrom"].alias("chrom"), at.alias("at"), "bases")


def read_fasta_blocks(spark: SparkSession, path: str, block: int = 1 << 14, context: int = 6) -> DataFrame:
    """Records as blocks of ``block`` bases with the ``context`` bases before each, as ``detect_blocks`` takes them (keys ``rec, chrom``).

    A line gives its bases to every block they lie in or stand before; no row or group is longer than a block and its context.
    """
    lines = fasta_lines(spark, path)
    stop = F.col("at") + F.length("bases")
    span = F.sequence(F.floor(F.col("at") / block), F.floor((stop - 1 + context) / block))
    dealt = lines.withColumn("blk", F.explode(span)).withColumn("base", F.col("blk") * block)
    begin = F.greatest("at", F.col("base") - context)
    end = F.least(stop, F.col("base") + block)
    pieces = dealt.select("rec", "chrom", "blk", F.struct(begin.alias("begin"), F.substring(F.col("bases"), (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("s")).alias("piece"))
    whole = pieces.groupBy("rec", "chrom", "blk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["s"]), "").alias("seq"))
    sizes = lines.groupBy("rec").agg(F.max(stop).alias("size"))
    first, ctx = F.col("blk") * block, F.least(F.lit(context), F.col("blk") * block).cast("int")
    return whole.join(sizes, "rec").filter(first < F.col("size")).select(
        "rec", "chrom", F.col("blk").cast("int").alias("blk"), (first + 1).alias("first"), (first + block >= F.col("size")).alias("is_last"), ctx.alias("ctx"), "seq")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, seq`` per record whose sequence fits a row; longer ones are read with ``read_fasta_blocks``. Records without bases are left out."""
    blocks = read_fasta_blocks(spark, path, context=0)
    parts = F.array_sort(F.collect_list(F.struct("blk", "seq")))
    return blocks.groupBy("rec", "chrom").agg(F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq")).select("chrom", "seq")


def write_fasta(seqs: DataFrame, path: str, chrom: str = "chrom", seq: str = "seq", width: int = 60) -> None:
    lines = F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n")
    seqs.select(F.concat(F.lit(">"), F.col(chrom), F.lit("\n"), lines).alias("value")).write.text(path)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Four-line records as ``file, rec, l1..l4``, found by line number, never by ``@`` (it is a quality too).

    Lines get (file, byte-range partition, line in partition); files start at line 0 of their first partition and
    later partitions are shifted by the lines before them, so any split size works and no file is one task. Records are put together in the
    order of the lines; only lines at the ends of batches are shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value"
    )
    kept = written(lines, "fastq-lines")
    sizes = kept.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size"), F.min("mid").alias("first"))
    shift = F.sum("size").over(Window.partitionBy("file").orderBy("block")) - F.col("size")
    starts = sizes.select("file", "block", "first", shift.alias("shift"))
    line_no = F.col("mid") - F.col("first") + F.col("shift")
    numbered = kept.join(written(starts, "fastq-starts"), ["file", "block"]).select("file", line_no.alias("no"), "value")
    parts = written(numbered.mapInArrow(_fastq_parts, "file STRING, rec BIGINT, l1 STRING, l2 STRING, l3 STRING, l4 STRING, whole BOOLEAN"), "fastq-records")
    loose = parts.filter("NOT whole").groupBy("file", "rec").agg(*[F.max(f"l{i}").alias(f"l{i}") for i in range(1, 5)])
    return parts.filter("whole").drop("whole").unionByName(loose)


def _fastq_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose four lines follow one another in a batch, and every other line in a row of its own."""
    for batch in batches:
        file, value = batch.column("file"), batch.column("value")
        no = batch.column("no").to_numpy()
        n = len(no)
        follows = np.zeros(n, bool)  # the line is the next one of the same file
        if n > 1:
            follows[1:] = (np.diff(no) == 1) & pc.equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero((no[: max(0, n - 3)] % 4 == 0) & follows[1 : n - 2] & follows[2 : n - 1] & follows[3:]) if n > 3 else np.zeros(0, np.int64)
        used = np.zeros(n, bool)
        for i in range(4):
            used[first + i] = True
        rest = np.flatnonzero(~used)
        lines = [pa.concat_arrays([value.take(pa.array(first + i)), value.take(pa.array(rest, pa.int64(), mask=no[rest] % 4 != i))]) for i in range(4)]
        at = np.concatenate([first, rest])
        yield pa.RecordBatch.from_arrays(
            [file.take(pa.array(at)), pa.array(no[at] // 4), *lines, pa.array(np.arange(len(at)) < len(first))], names=["file", "rec", "l1", "l2", "l3", "l4", "whole"])


def fastq_reads(records: DataFrame) -> DataFrame:
    """Typed reads: name, mate and filter flag from the header, tract list after ``|`` if there is one."""
    head = F.substring(F.col("l1"), F.lit(2), F.length("l1"))
    parsed = records.select("file", "rec", parse_header(F.substring_index(head, "|", 1)).alias("h"), head.alias("header"), F.col("l2").alias("seq"), F.col("l4").alias("qual"))
    return parsed.select("file", "rec", F.col("h.name").alias("read_id"), F.col("h.mate").alias("mate"), F.col("h.passed").alias("passed"), "header", "seq", "qual")


def fastq_text(name: Column, seq: Column, qual: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), name), seq, F.concat(F.lit("+"), F.substring_index(name, "|", 1)), qual)


def write_fastq(reads: DataFrame, path: str, name: str = "name") -> None:
    reads.select(fastq_text(F.col(name), F.col("seq"), F.col("qual")).alias("value")).write.text(path)


def tract_cell(t: Column, qual: Column | None = None) -> Column:
    parts = [t["unit"], t["start"].cast("string"), t["length"].cast("string")]
    if qual is not None:
        parts.append(F.substring(qual, t["start"].cast("int"), t["length"].cast("int")))
    return F.concat_ws(":", *parts)


def annotated_name(name: Column, tracts: Column, qual: Column | None = None) -> Column:
    """Read name with its tract list appended: ``name|unit:start:length[:qual]|...``."""
    cells = F.transform(tracts, lambda t: tract_cell(t, qual))
    return F.when(F.size(tracts) > 0, F.concat_ws("|", name, F.array_join(cells, "|"))).otherwise(name)


def condensed_fastq(condensed: DataFrame, name: str) -> DataFrame:
    """Condensed reads; an empty one becomes base N with quality B."""
    return condensed.select(
        F.col(name).alias("name"), F.when(F.length("seq") > 0, F.col("seq")).otherwise("N").alias("seq"),
        F.when(F.length("seq") > 0, F.col("qual")).otherwise("B").alias("qual"),
    )


REF_TRACT_SCHEMA = "chrom STRING, start INT, stop INT, length INT, unit STRING"


def read_ref_tracts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=REF_TRACT_SCHEMA)


def write_ref_tracts(tracts: DataFrame, path: str) -> None:
    """Tab-separated tracts, with flanks and snapshot when present."""
    names = [c for c in ("chrom", "start", "stop", "length", "unit", "front_flank", "rear_flank", "snapshot") if c in tracts.columns]
    tracts.select(*names).write.csv(path, sep="\t", emptyValue="")


def write_offset_index(index: DataFrame, path: str) -> None:
    """Three lines per chromosome: name, positions, offsets."""
    packed = index.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("position", "offset"))).alias("e"))
    line = lambda f: F.array_join(F.transform("e", lambda x: x[f].cast("string")), "\t")
    packed.select(F.concat_ws("\n", "chrom", line("position"), line("offset")).alias("value")).write.text(path, lineSep="\n\n")


def read_offset_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Offset rows, and the chromosomes whose two lists differ in length."""
    raw = spark.read.text(path, lineSep="\n\n").select(F.split("value", "\n").alias("l"))
    named = raw.select(F.col("l")[0].alias("chrom"), F.split(F.col("l")[1], "\t").alias("p"), F.split(F.col("l")[2], "\t").alias("o"))
    rows = named.filter(F.size("p") == F.size("o")).select("chrom", F.explode(F.arrays_zip("p", "o")).alias("z"))
    return rows.select("chrom", F.col("z.p").cast("long").alias("position"), F.col("z.o").cast("long").alias("offset")), named.filter(F.size("p") != F.size("o")).select("chrom")


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """``name/mate|unit:start:length:qual|...`` lines to one row per tract."""
    part = F.split("value", r"\|(?=[A-Za-z]+:\d+:\d+)")
    raw = spark.read.text(path).select(part[0].alias("h"), F.explode_outer(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))).alias("t"))
    name = F.substring_index("h", "/", 1)
    return raw.select(name.alias("read_id"), F.substring_index("h", "/", -1).try_cast("int").alias("mate"), TR.parse_tract_text(F.col("t")).alias("t")).select("read_id", "mate", "t.*")


def write_sidecar(reads: DataFrame, path: str) -> None:
    """One line per read from ``read_id, mate, qual, tracts``."""
    name = F.concat_ws("/", F.col("read_id").cast("string"), F.col("mate").cast("string"))
    reads.select(annotated_name(name, F.col("tracts"), F.col("qual")).alias("value")).write.text(path)


PROFILE_SCHEMA = (
    "chrom STRING, start INT, motif STRING, ref_length INT, num_flanks INT, rank INT, flank STRING, flank_count BIGINT, histogram STRING, read_names STRING"
)


GROUP = 8192  # people, about, whose folders lie in one folder and are listed together
PEOPLE = 512  # people, about, whose files one task writes


def write_person_files(rows: DataFrame, path: str) -> None:
    """Tab-separated gzip files, one folder and one file per person; for more than ``GROUP`` people the folders lie in folders ``people=k``.

    A person's rows, at most a few for each locus, are dealt to one of a number of tasks that grows with the people, so that the number of files is the
    number of people whatever the number of tasks. Tasks move their own files into place; ``path`` is new for each write and is read only once the write
    has ended.
    """
    spark, rows = rows.sparkSession, written(rows, "person-rows")  # counted and dealt out
    people = rows.select("person_id").distinct().count()
    groups, tasks = -(-people // GROUP), max(1, min(people, max(int(spark.conf.get("spark.sql.shuffle.partitions")), people // PEOPLE)))
    dealt = rows.repartition(tasks, "person_id")
    if groups > 1:
        dealt = dealt.withColumn("people", F.pmod(F.xxhash64("person_id"), F.lit(groups)).cast("int"))
    folders = ["people", "person_id"][groups <= 1 :]
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() == "file" and isinstance(rows.schema["person_id"].dataType, T.IntegralType):
        # in a shared folder tasks write by themselves: Spark's writer starts processes (chmod) for each file there
        store.mkdirs(target)
        _write_local(dealt, folders, store.makeQualified(target).toUri().getPath())
    else:
        dealt.write.partitionBy(*folders).option("mapreduce.fileoutputcommitter.algorithm.version", "2").csv(path, sep="\t", compression="gzip")


def _write_local(rows: DataFrame, folders: list[str], path: str) -> None:
    """The files of ``write_person_files`` in a folder that all executors share. A file gets its name when it is whole; a task that runs again replaces it."""
    line = F.to_csv(F.struct(*[c for c in rows.columns if c not in folders]), {"sep": "\t"})
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in folders])

    def put(batches):
        import gzip
        import os

        at, file, n = None, None, 0

        def close():
            file.close()
            os.replace(file.name, f"{path}/{at}/part-00000.csv.gz")

        for batch in batches:
            for where, text in zip(batch.column("folder").to_pylist(), batch.column("line").to_pylist()):
                if where != at:
                    if file is not None:
                        close()
                    os.makedirs(f"{path}/{where}", exist_ok=True)
                    at, file, n = where, gzip.open(f"{path}/{where}/_{uuid.uuid4().hex}", "wb", 6), n + 1
                file.write(f"{text}\n".encode())
        if file is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["files"])

    rows.select(folder.alias("folder"), line.alias("line")).sortWithinPartitions("folder").mapInArrow(put, "files long").agg(F.sum("files")).collect()


def read_person_files(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """``columns`` of the files of ``write_person_files``; ``person_id`` comes from the folder.

    Groups of people are read one after the other and stored, so that the driver never holds the list of all files. A session of its own lists a
    group's folders in a few tasks and reads many files in one, where Spark would start a task for each folder and for a few files.
    """
    groups = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/people=*")
    found = groups.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(groups)
    reader = spark.newSession()
    reader.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * spark.sparkContext.defaultParallelism))
    reader.conf.set("spark.sql.files.openCostInBytes", "64k")
    stored = scratch_path(spark, "person-files")
    for at in [x.getPath().toString() for x in found] or [path]:
        rows = reader.read.csv(at, sep="\t", schema=f"{schema}, person_id BIGINT").select(*columns)
        rows.write.mode("append").parquet(stored)
    return spark.read.schema(rows.schema).parquet(stored)


def write_profiles(rows: DataFrame, path: str) -> None:
    """Profile files, one folder per person, gzip; ``read_names`` is left empty where rows come without."""
    if "read_names" not in rows.columns:
        rows = rows.withColumn("read_names", F.lit(None).cast("string"))
    write_person_files(rows.select("person_id", *[c.split()[0] for c in PROFILE_SCHEMA.split(", ")]), path)


def read_profiles(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """``columns`` of profile files, or all."""
    return read_person_files(spark, path, PROFILE_SCHEMA, list(columns) or [c.split()[0] for c in PROFILE_SCHEMA.split(", ")] + ["person_id"])


def profile_lengths(profiles: DataFrame) -> DataFrame:
    """Long counts from the dense histogram text of the all-flank rows."""
    cells = profiles.filter("rank = 0").select("person_id", "chrom", "start", "motif", "ref_length", F.posexplode(F.split("histogram", ",")).alias("i", "c"))
    return cells.filter("c <> '0'").select("person_id", "chrom", "start", "motif", "ref_length", (F.col("i") + 1).alias("length"), F.col("c").cast("long").alias("n"))


PERSON_SCHEMA = "person_id BIGINT, family_id INT, relation STRING"


def read_people(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=PERSON_SCHEMA).withColumn("rel_code", relation_code(F.col("relation")))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered report; short rows are filled with nulls."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, mode="PERMISSIVE")


def write_report(lines: DataFrame, header: str, path: str) -> None:
    """Lines (column ``value``) as report files, each of which begins with the header."""

    def headed(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
            yield batch

    lines.select("value").mapInArrow(headed, "value string").write.text(path)


def quad_report(report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole-blood quads with a bare id, and those whose status is not ok."""
    blood = report.filter(F.col("quad_id").rlike("^auSSC.*wholeblood")).withColumn("family_id", F.regexp_replace("quad_id", "-wholeblood.*$", ""))
    return blood, blood.filter(~F.col("status").ilike("%ok%"))


LOCUS_INFO_SCHEMA = "chrom STRING, start INT, motif STRING, ref_length INT, pop_count BIGINT, max_count BIGINT, sum_count BIGINT, length INT, num_lengths BIGINT"


def locus_rows(info: DataFrame) -> DataFrame:
    """Where each locus begins: ``chrom, start, motif, first_row``, rows of the locus info numbered from 0 in genome order, the total (length 0) first."""
    keyed = info.withColumn("chrom_no", chrom_number(F.col("chrom"))).withColumn("motif_length", F.length("motif"))
    numbered = number_rows(keyed, ["chrom_no", "start", "motif_length", "motif", "length"], "first_row")
    return numbered.filter("length = 0").select("chrom", "start", "motif", "first_row")


def read_locus_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=LOCUS_INFO_SCHEMA)


def read_bed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom STRING, start INT, stop INT, info STRING").withColumn("kind", F.lit(kind))


def read_gene_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="ref_gene STRING, gene STRING, ccds STRING")


def write_partitioned(df: DataFrame, path: str, by: str, buckets: int = 64) -> None:
    """Store by locus bucket, so a locus range reads only its own files. Writing a chunk of loci again replaces its buckets and no others."""
    rows = df.withColumn("locus_bucket", F.floor(F.col(by) / buckets).cast("int")).write.partitionBy("locus_bucket")
    rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Append the rows of one run to a table; the same run written again, whole or after a failure, counts once.

    Parts are written aside, into a folder of their own, and listed by one small file once they are complete; the list names one attempt for each run.
    The header of the table stands there too, once.
    """
    spark, attempt = df.sparkSession, uuid.uuid4().hex
    df.write.csv(f"{path}/parts/run={run}/attempt={attempt}")
    spark.createDataFrame([(attempt,)], "attempt STRING").coalesce(1).write.mode("overwrite").csv(f"{path}/listed/run={run}")
    spark.createDataFrame([(",".join(df.columns),)], "header STRING").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def read_runs(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of the listed parts of a table of runs; ``schema`` is that of its rows."""
    plain = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*plain.fields, T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])
    listed = spark.read.schema("attempt STRING, run STRING").csv(f"{path}/listed")
    return spark.read.schema(whole).csv(f"{path}/parts").join(listed, ["run", "attempt"], "left_semi").select(*plain.names)


def write_vcf(records: DataFrame, path: str, person: DataFrame | None = None) -> None:
    """One VCF per person folder, in one file: header first, with the person's ids if ``person`` is given, then records by chromosome (X, Y and MT after the autosomes) and position.

    A person's lines, at most one for each locus, are dealt to one partition and sorted there.
    """
    body = records.select(
        "person_id", F.lit(1).alias("part"), chrom_number(F.col("chrom")).alias("c"), "pos",
        F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref", "alt", F.round("qual", 3).cast("string"), "filter", "info", "format", "sample").alias("value"),
    )
    known, lines = records.select("person_id").distinct(), V.header_lines()
    if person is not None:
        known, lines = known.join(person.select("person_id", "family_id"), "person_id", "left"), V.header_lines(F.col("person_id"), F.col("family_id"))
    head = known.select("person_id", F.lit(0).alias("part"), F.lit(0).alias("c"), F.lit(0).alias("pos"), F.array_join(lines, "\n").alias("value"))
    body.unionByName(head).repartition("person_id").sortWithinPartitions("person_id", "part", "c", "pos").select(
        "person_id", "value").write.partitionBy("person_id").text(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Named tables beside each other as Parquet."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
