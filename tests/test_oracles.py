"""Registered queries against DuckDB at the smallest scale; REPEATWISE_ALL=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from compare import DATA, compare, connect

SF = f"{DATA}/sf0.001"
SAMPLE = [
    "rp03_trim_area", "rp09_filter_gate", "md01_sequence_tracts", "md08_condensed_reads", "md09_offset_index", "ri03_asof_offset", "ri07_reverse_remap",
    "ri12_restore_read", "pr09_representatives", "pr14_duplicate_statistics", "pr19_profile_rows", "po06_matrix_rows", "po13_dense_allele_rows", "co09_families",
    "cm08_person_fit", "gt04_pair_probabilities", "gt10_biased_pairs", "gt20_em_genotypes", "gt17_allele_fit", "fm08_em_family_scores", "dn05_ranked_cases",
    "dn13_parental_frequency", "dn21_violation_tally", "st11_hardy_weinberg", "st16_transmissions", "an09_annotation_text", "vc09_person_calls", "io02_fastq", "io32_vcf_sink", "pc01_stage_counts",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("REPEATWISE_ALL") else [n for n in SAMPLE if n in QUERIES]


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert set(SAMPLE) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, message = compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, message
