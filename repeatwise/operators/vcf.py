"""VCF columns from genotype records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import seq as S

# Fixed values of the export format.
INFO_FIELDS = [
    ("END", "1", "Integer", "End of microsatellite tract"),
    ("RL", "1", "Integer", "Reference length of microsatellite tract"),
    ("RU", "1", "String", "Reference motif of microsatellite tract"),
    ("POP", "1", "Integer", "Number of people with locus in population"),
    ("SUM", "1", "Integer", "Total locus coverage across population"),
    ("TOP", "1", "Integer", "Maximum locus coverage across population"),
    ("NR", "1", "Float", "log10 of locus-wide error rate"),
]
FORMAT_FIELDS = [
    ("GT", "1", "String", "Genotype"),
    ("GB", "1", "String", "Genotype in bp (-1 means null allele)"),
    ("GC", "1", "Float", "Genotype confidence"),
    ("EC", "1", "Float", "Expected per-allele coverage"),
    ("AF", "1", "Float", "Exact Poisson allele fit"),
    ("NF", "1", "Float", "Exact binomial noise fit"),
    ("AL1", "1", "Integer", "Coverage for allele 1"),
    ("AL2", "1", "Integer", "Coverage for allele 2"),
    ("ALN", "1", "Integer", "Noise coverage"),
    ("PNULL", "1", "Float", "-10log10 of marginal likelihood for null allele"),
    ("DP", "1", "Integer", "Read depth"),
    ("SEEN", "2", "String", "Genotyped alleles"),
]


def alt_lengths() -> Column:
    """Called lengths that are neither null nor the reference, in call order."""
    return F.array_distinct(F.filter(F.array("allele_1", "allele_2"), lambda a: (a > 0) & (a != F.col("ref_length"))))


def alt_text() -> Column:
    seqs = F.transform(alt_lengths(), lambda a: S.tract_sequence(F.col("unit"), a))
    return F.when(F.size(alt_lengths()) > 0, F.array_join(seqs, ",")).otherwise(".")


def genotype_index() -> Column:
    """``i/j``: 0 reference, 1.. alternative, -1 null; 0/0 when nothing but the reference or nulls is called."""
    alts = alt_lengths()
    one = lambda a: F.when(a == F.col("ref_length"), "0").when(a > 0, F.array_position(alts, a).cast("string")).otherwise("-1")
    return F.when(F.size(alts) > 0, F.concat_ws("/", one(F.col("allele_1")), one(F.col("allele_2")))).otherwise("0/0")


def base_pair_genotype() -> Column:
    return F.concat_ws("/", F.col("allele_1").cast("string"), F.col("allele_2").cast("string"))


def quality() -> Column:
    """-10 log10(1 - confidence), 100 where that is infinite."""
    rest = 1 - F.col("confidence")
    return F.when(rest > 0, -10 * F.log10(rest)).otherwise(100.0)


def depth() -> Column:
    return F.col("allele_1_cov") + F.col("allele_2_cov") + F.col("rest_cov")


def seen() -> Column:
    return F.array_join(F.array_distinct(F.filter(F.array("allele_1", "allele_2"), lambda a: a > 0)).cast("array<string>"), ",")


def _fixed(x: Column, digits: int) -> Column:
    """Fixed decimals with zero padding, rounded half up."""
    return F.round(x, digits).cast(f"decimal(20,{digits})").cast("string")


def info_text() -> Column:
    pair = lambda key, value: F.concat(F.lit(f"{key}="), value.cast("string"))
    return F.concat_ws(
        ";", pair("END", F.col("start") + F.col("ref_length") - 1), pair("RL", F.col("ref_length")), pair("RU", F.col("unit")),
        pair("POP", F.col("pop_count")), pair("SUM", F.col("sum_count")), pair("TOP", F.col("top_count")), pair("NR", _fixed(F.log10("eps"), 2)),
    )


def sample_text() -> Column:
    null_phred = F.when(F.col("p_null") > 0, _fixed(-10 * F.log10("p_null"), 3)).otherwise("inf")
    return F.concat_ws(
        ":", genotype_index(), base_pair_genotype(), _fixed(F.col("confidence"), 3), _fixed(F.col("exp_allele_cov"), 3), _fixed(F.col("allele_fit"), 3),
        _fixed(F.col("noise_fit"), 3), F.col("allele_1_cov").cast("string"), F.col("allele_2_cov").cast("string"), F.col("rest_cov").cast("string"),
        null_phred, depth().cast("string"), seen(),
    )


def header_lines(person_id: Column | None = None, family_id: Column | None = None) -> Column:
    """Header of a file as an array of lines, with the ids of its person if they are given."""
    fields = [f'##{kind}=<ID={i},Number={n},Type={t},Description="{d}">' for kind, fs in (("INFO", INFO_FIELDS), ("FORMAT", FORMAT_FIELDS)) for i, n, t, d in fs]
    person = [] if person_id is None else [F.concat(F.lit("##personInfo=<IndividualID="), person_id.cast("string"), F.lit(",FamilyID="), F.coalesce(family_id.cast("string"), F.lit("unknown")), F.lit(">"))]
    names = "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE"])
    return F.array(F.lit("##fileformat=VCFv4.1"), F.lit("##source=repeatwise"), *person, *[F.lit(f) for f in fields], F.lit(names))


def records(genotypes: DataFrame, loci: DataFrame, counts: DataFrame) -> DataFrame:
    """VCF columns for all people at once; one person is a filter on ``person_id``."""
    full = genotypes.join(loci.select("locus_id", "chrom", "start", "unit", "ref_length"), "locus_id").join(counts, "locus_id")
    return full.select(
        "person_id", "locus_id", F.col("chrom"), F.col("start").alias("pos"), F.lit(".").alias("id"), S.tract_sequence(F.col("unit"), F.col("ref_length")).alias("ref"),
        alt_text().alias("alt"), quality().alias("qual"), F.lit(".").alias("filter"), info_text().alias("info"),
        F.lit(":".join(f[0] for f in FORMAT_FIELDS)).alias("format"), sample_text().alias("sample"),
    )


def person_calls(genotypes: DataFrame, person: DataFrame, person_id: int) -> DataFrame:
    """Calls of one person over all loci; an unknown person is an error."""
    if person.filter(F.col("person_id") == person_id).isEmpty():
        raise ValueError(f"person {person_id} is not in the person table")
    return genotypes.filter(F.col("person_id") == person_id)
