"""Per-person locus profiles from tract observations.

Every step that could meet a hot locus is a partial aggregate (combined before the shuffle) or a join that can be
split; no window runs over raw observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["person_id", "chrom", "start", "motif"]
MIN_MAPQ = 30
MIN_COVERAGE = 2


def fate(min_mapq: int = MIN_MAPQ) -> Column:
    """First reason that stops an observation, or ``kept``."""
    return (
        F.when(~F.col("mapped"), "unmapped").when(F.col("mapq") < min_mapq, "lowMapQ")
        .when(F.col("mate_elsewhere"), "disparateCoord").when(F.col("motif").isNull(), "noMS")
        .when(~F.col("motif").rlike("^[ACGT]+$"), "badUnit").otherwise("kept")
    )


def usable(obs: DataFrame, min_mapq: int = MIN_MAPQ) -> DataFrame:
    return obs.filter(
        F.col("mapped") & (F.col("mapq") >= min_mapq) & ~F.col("mate_elsewhere") & F.col("motif").rlike("^[ACGT]+$")
    )


def mate_groups(obs: DataFrame, *carry: str) -> DataFrame:
    """Reads of one name at one locus: how many, how many lengths, and the first of them."""
    first = F.min_by(F.struct("obs_id", "length", "mapq", "is_dup", "pos", "mate_pos", *carry), "obs_id")
    return obs.groupBy(*KEY, "read_name").agg(
        F.count(F.lit(1)).alias("reads"), F.min("length").alias("lo"), F.max("length").alias("hi"), first.alias("first")
    )


def merge_mates(obs: DataFrame, *carry: str) -> DataFrame:
    """Overlapping mates: equal lengths count once, different lengths drop both."""
    return mate_groups(obs, *carry).filter(F.col("lo") == F.col("hi")).select(*KEY, "read_name", "first.*")


def discordant_mates(obs: DataFrame) -> DataFrame:
    """The observations of names whose mates disagree, for the sequencing-noise sink."""
    bad = mate_groups(obs).filter(F.col("lo") != F.col("hi")).select(*KEY, "read_name")
    return obs.join(bad, [*KEY, "read_name"], "left_semi")


def covered(merged: DataFrame, raw: DataFrame | None = None, minimum: int = MIN_COVERAGE) -> DataFrame:
    """Observations of loci with enough reads (names still counted when mates disagree, if ``raw`` is given)."""
    counted = (mate_groups(raw) if raw is not None else merged).groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"))
    return merged.join(counted.filter(F.col("c") >= minimum).select(*KEY), KEY, "left_semi")


def with_reference(df: DataFrame, ref: DataFrame) -> DataFrame:
    """Reference length by (chrom, start); 0 where there is none, and loci of another unit are dropped."""
    side = ref.select("chrom", "start", F.col("unit").alias("ref_unit"), F.col("length").alias("ref_length"))
    joined = df.join(side, ["chrom", "start"], "left")
    return joined.filter(F.col("ref_unit").isNull() | (F.col("ref_unit") == F.col("motif"))).withColumn(
        "ref_length", F.coalesce("ref_length", F.lit(0))
    )


SET = ["lo_pos", "hi_pos"]


def duplicate_sets(merged: DataFrame, *carry: str) -> DataFrame:
    """One row per (locus, set of fragment ends, length [, carried column]).

    ``best`` is the read to keep: not flagged first, then highest mapping quality, then first seen.
    """
    ends = merged.withColumn("lo_pos", F.least("pos", "mate_pos")).withColumn("hi_pos", F.greatest("pos", "mate_pos"))
    rank = F.struct(F.col("is_dup"), F.when(F.col("is_dup"), F.lit(0)).otherwise(-F.col("mapq")).alias("q"), F.col("obs_id"))
    return ends.groupBy(*KEY, *SET, "length").agg(
        F.count(F.lit(1)).alias("n"), F.max("is_dup").alias("flagged"),
        F.min_by(F.struct("obs_id", "read_name", *carry), rank).alias("best"), F.min(F.when(F.col("is_dup"), F.col("obs_id"))).alias("first_flagged"),
    )


def set_summary(sets: DataFrame) -> DataFrame:
    """Whether a set is active (holds a flagged read and more than one read) and how many lengths it has."""
    return sets.groupBy(*KEY, *SET).agg(
        F.sum("n").alias("size"), F.max("flagged").alias("flagged"), F.count(F.lit(1)).alias("n_lengths")
    ).withColumn("active", F.col("flagged") & (F.col("size") > 1))


def dedup_reads(merged: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Reportable reads: active duplicate sets give their representative, or nothing if lengths differ.

    The per-set row is small; reads look it up by join, so a hot set is never gathered in one task.
    """
    if keep_duplicates:
        return merged
    sets = duplicate_sets(merged)
    summary = set_summary(sets).filter("active").select(*KEY, *SET, "n_lengths")
    chosen = sets.groupBy(*KEY, *SET).agg(F.min("best.obs_id").alias("keep_id"))
    active = summary.join(chosen, [*KEY, *SET])
    ends = merged.withColumn("lo_pos", F.least("pos", "mate_pos")).withColumn("hi_pos", F.greatest("pos", "mate_pos"))
    looked = ends.join(active, [*KEY, *SET], "left")
    return looked.filter(
        F.col("n_lengths").isNull() | ((F.col("n_lengths") == 1) & (F.col("obs_id") == F.col("keep_id")))
    ).drop(*SET, "n_lengths", "keep_id")


def profile(merged: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Long profile ``key, length, n`` of reportable reads at loci with more than one of them.

    Works from the set counts, so raw reads are shuffled once, already combined.
    """
    if keep_duplicates:
        lengths = merged.groupBy(*KEY, "length").agg(F.count(F.lit(1)).alias("n"))
    else:
        per_set = duplicate_sets(merged).groupBy(*KEY, *SET).agg(
            F.sum("n").alias("size"), F.max("flagged").alias("flagged"), F.count(F.lit(1)).alias("n_lengths"),
            F.collect_list(F.struct("length", "n")).alias("cells"),
        )
        active = F.col("flagged") & (F.col("size") > 1)
        lengths = (
            per_set.filter(~active | (F.col("n_lengths") == 1))
            .select(*KEY, active.alias("one"), F.explode("cells").alias("c"))
            .groupBy(*KEY, F.col("c.length").alias("length")).agg(F.sum(F.when(F.col("one"), F.lit(1)).otherwise(F.col("c.n"))).alias("n"))
        )
    total = F.sum("n").over(Window.partitionBy(*KEY))
    return lengths.withColumn("total", total).filter(F.col("total") > 1).drop("total")


def modal_length(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent length, the shortest of equals."""
    return lengths.groupBy(*keys).agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("mode"))


def dense(cells: Column, up_to: Column) -> Column:
    """Histogram over lengths 1..up_to from an array of (length, n)."""
    lookup = F.map_from_entries(cells)
    return F.transform(F.sequence(F.lit(1), up_to.cast("int")), lambda i: F.coalesce(F.element_at(lookup, i), F.lit(0).cast("long")))


def histograms(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Dense histogram text and longest length per locus."""
    packed = lengths.groupBy(*keys).agg(F.collect_list(F.struct(F.col("length").cast("int"), "n")).alias("cells"), F.max("length").alias("longest"))
    return packed.select(*keys, "longest", F.array_join(dense(F.col("cells"), F.col("longest")).cast("array<string>"), ",").alias("histogram"))


def duplicate_report(merged: DataFrame, ref: DataFrame) -> DataFrame:
    """One row per active duplicate set: mode of the profile, share of reads off the set's mode, size, histogram."""
    sets = duplicate_sets(merged)
    per_set = sets.groupBy(*KEY, *SET).agg(
        F.sum("n").alias("size"), F.max("flagged").alias("flagged"), F.max("n").alias("top"), F.max("length").alias("longest"),
        F.collect_list(F.struct(F.col("length").cast("int"), "n")).alias("cells"),
    ).filter(F.col("flagged") & (F.col("size") > 1))
    modes = modal_length(profile_lengths(merged), KEY)
    full = with_reference(per_set, ref).join(modes, KEY, "left")
    return full.select(
        *KEY, F.length("motif").alias("motif_length"), "ref_length", *SET, F.col("mode").alias("profile_mode"),
        ((F.col("size") - F.col("top")) / F.col("size")).alias("off_mode_share"), "size",
        F.array_join(dense(F.col("cells"), F.col("longest")).cast("array<string>"), ",").alias("histogram"),
    )


def profile_lengths(merged: DataFrame) -> DataFrame:
    return merged.groupBy(*KEY, "length").agg(F.count(F.lit(1)).alias("n"))


def flank_haplotype(df: DataFrame, seq: str, size: int = 5) -> Column:
    """``size`` bases each side of the tract in its read, ``#`` where the read ends."""
    text = F.col(seq)
    left = F.substring(text, F.greatest(F.col("start") - size, F.lit(1)).cast("int"), F.least(F.col("start") - 1, F.lit(size)).cast("int"))
    right = F.substring(text, (F.col("stop") + 1).cast("int"), F.lit(size))
    return F.concat(F.lpad(left, size, "#"), F.rpad(right, size, "#"))


def flank_table(reads: DataFrame) -> DataFrame:
    """Reads per (locus, flank, length) with all-flank rows beside them: rank 0 is all, then by reads, then flank.

    Rows are combined to counts before anything is ranked.
    """
    cells = reads.groupBy(*KEY, "flank", "length").agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(*KEY, "length", "n", F.explode(F.array(F.lit("all"), F.col("flank"))).alias("flank"))
    rows = both.groupBy(*KEY, "flank", "length").agg(F.sum("n").alias("n")).groupBy(*KEY, "flank").agg(
        F.sum("n").alias("flank_count"), F.max("length").alias("longest"), F.collect_list(F.struct(F.col("length").cast("int"), "n")).alias("cells")
    )
    locus = Window.partitionBy(*KEY)
    order = locus.orderBy(F.when(F.col("flank") == "all", 0).otherwise(1), F.desc("flank_count"), F.desc("flank"))
    return rows.select(
        *KEY, "flank", "flank_count", (F.count(F.lit(1)).over(locus) - 1).alias("num_flanks"),
        (F.row_number().over(order) - 1).alias("rank"),
        F.array_join(dense(F.col("cells"), F.max("longest").over(locus)).cast("array<string>"), ",").alias("histogram"),
    )


def read_names(reads: DataFrame, keys: list[str], chunk: int = 5000) -> DataFrame:
    """Reportable read names per row, in parts of about ``chunk`` names.

    A row with n names has ceil(n / chunk) parts and a name goes to a part by its hash, so no task gathers an unbounded list.
    """
    sized = reads.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    part = F.pmod(F.xxhash64("read_name"), F.col("parts")).cast("int")
    return reads.join(sized, keys).withColumn("part", part).groupBy(*keys, "part").agg(
        F.array_join(F.sort_array(F.collect_list(F.col("read_name").cast("string"))), ",").alias("names")
    )


def with_read_names(rows: DataFrame, reads: DataFrame) -> DataFrame:
    """Profile rows (see ``flank_table``) with the names of their reads, comma-joined in order: as many as the person has reads there."""
    both = reads.select(*KEY, "read_name", F.explode(F.array(F.lit("all"), F.col("flank"))).alias("flank"))
    names = both.groupBy(*KEY, "flank").agg(F.array_join(F.sort_array(F.collect_list(F.col("read_name").cast("string"))), ",").alias("read_names"))
    return rows.join(names, [*KEY, "flank"], "left")


def chrom_number(chrom: Column, autosomes: int = 22) -> Column:
    """Chromosome order: ``chr`` stripped, then X, Y and MT after the autosomes."""
    bare = F.regexp_replace(chrom, "^chr", "")
    return (
        F.when(bare == "X", autosomes + 1).when(bare == "Y", autosomes + 2).when(bare.isin("MT", "M"), autosomes + 3)
        .otherwise(bare.try_cast("int"))
    )


def genome_order() -> list[Column]:
    return [chrom_number(F.col("chrom")), F.col("start"), F.length("motif"), F.col("motif")]


def outcome_counts(obs: DataFrame, ref: DataFrame) -> DataFrame:
    """Tallies of the profile step per person, in the vocabulary of the counter files."""
    raw = obs.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("reads_in"),
        *[F.count_if(fate() == r).alias(r) for r in ("unmapped", "lowMapQ", "disparateCoord", "badUnit", "kept")],
    ).withColumn("hasMS", F.col("kept") + F.col("badUnit"))
    good = usable(obs)
    groups = mate_groups(good)
    mates = groups.groupBy("person_id").agg(
        F.sum(F.when(F.col("lo") == F.col("hi"), F.col("reads") - 1).otherwise(0)).alias("overlappingReadFragment"),
        F.sum(F.when(F.col("lo") != F.col("hi"), F.col("reads") - 1).otherwise(0)).alias("discordantOverlappingReadFragment"),
    )
    loci = groups.groupBy(*KEY).agg(F.count(F.lit(1)).alias("c"))
    side = ref.select("chrom", "start", F.col("unit").alias("ref_unit"))
    looked = loci.join(side, ["chrom", "start"], "left").groupBy("person_id").agg(
        F.count_if(F.col("c") < MIN_COVERAGE).alias("lowCoverage"),
        F.count_if((F.col("c") >= MIN_COVERAGE) & F.col("ref_unit").isNull()).alias("nonReference"),
        F.count_if((F.col("c") >= MIN_COVERAGE) & (F.col("ref_unit") != F.col("motif"))).alias("wrongUnit"),
    )
    merged = with_reference(covered(merge_mates(good), good), ref)
    dup = set_summary(duplicate_sets(merged)).filter("active").groupBy("person_id").agg(F.sum("size").alias("msInPCRDuplicates"))
    out = profile(merged).groupBy(*KEY).agg(F.sum("n").alias("n")).groupBy("person_id").agg(
        F.count(F.lit(1)).alias("reported"), F.sum("n").alias("reads_out")
    )
    joined = raw
    for part in (mates, looked, dup, out):
        joined = joined.join(part, "person_id", "left")
    return joined.na.fill(0)
