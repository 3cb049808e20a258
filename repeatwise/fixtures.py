"""Views over the driver tables that give every operator deterministic input at any scale.

One SQL text serves Spark and DuckDB; where the dialects differ the entry is a (spark, duckdb) pair.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

# Fixed recoding of letters to bases and to Phred+33 qualities (test data only).
LETTERS = "abcdefghijklmnopqrstuvwxyz"
DNA_CODE = "ACAGACAGATGTCTAGTCTGATGCTC"
READ_CODE = "ACAGACAGATGTCTAGNCTGATGCTN"
QUAL_CODE = "IHGFEDCBA#%@?>=<%;:98+7#6#"
READ_LENGTH = 100


def _letters(flag: str) -> str:
    return f"regexp_replace(lower(text), '[^a-z]', ''{flag})"


def _dna(flag: str) -> str:
    return f"""SELECT doc_id, lang, source,
      translate({_letters(flag)}, '{LETTERS}', '{DNA_CODE}') AS seq,
      translate({_letters(flag)}, '{LETTERS}', '{QUAL_CODE}') AS qual
    FROM documents"""


_READS_SPARK = f"""SELECT doc_id, lang, k, doc_id * 100000 + CAST(FLOOR(k / 2) AS BIGINT) AS read_id,
      CAST(k % 2 + 1 AS INT) AS mate, translate(w, '{LETTERS}', '{READ_CODE}') AS seq,
      translate(w, '{LETTERS}', '{QUAL_CODE}') AS qual,
      substring(translate(w, '{LETTERS}', '{QUAL_CODE}'), 1, 1) <> '#' AS passed
    FROM (SELECT doc_id, lang, posexplode(regexp_extract_all({_letters("")}, '.{{1,{READ_LENGTH}}}', 0)) AS (k, w)
      FROM documents)"""
_READS_DUCK = f"""SELECT doc_id, lang, k, doc_id * 100000 + CAST(FLOOR(k / 2) AS BIGINT) AS read_id,
      CAST(k % 2 + 1 AS INT) AS mate, translate(w, '{LETTERS}', '{READ_CODE}') AS seq,
      translate(w, '{LETTERS}', '{QUAL_CODE}') AS qual,
      substring(translate(w, '{LETTERS}', '{QUAL_CODE}'), 1, 1) <> '#' AS passed
    FROM (SELECT doc_id, lang, unnest(ws) AS w, unnest(range(len(ws))) AS k
      FROM (SELECT doc_id, lang, regexp_extract_all({_letters(", 'g'")}, '.{{1,{READ_LENGTH}}}') AS ws FROM documents))"""

VIEWS: dict[str, str | tuple[str, str]] = {
    "dna": (_dna(""), _dna(", 'g'")),
    "reads": (_READS_SPARK, _READS_DUCK),
    "alignments": """SELECT read_id, mate, doc_id, k, CAST(k * 93 AS BIGINT) AS pos, ascii(substring(qual, 1, 1)) - 33 AS mapq,
      passed AS mapped, mate = 2 AS reverse, CASE WHEN substring(qual, 2, 1) = '#' THEN '5S95M' WHEN substring(qual, 3, 1) < '9' THEN '97M3S'
      ELSE '100M' END AS cigar, seq, qual, length(seq) AS read_length FROM reads""",
    "person": """SELECT s_suppkey AS person_id, CAST(FLOOR(s_suppkey / 4) AS INT) AS family_id,
      CASE s_suppkey % 4 WHEN 0 THEN 'mother' WHEN 1 THEN 'father' WHEN 2 THEN 'self' ELSE 'sibling' END AS relation,
      CASE WHEN s_suppkey % 4 = 0 THEN 'F' WHEN s_suppkey % 4 = 1 THEN 'M' WHEN s_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
      CASE WHEN s_nationkey = 7 THEN 'saliva' ELSE 'whole blood' END AS sample_type FROM supplier""",
    "bad_family": """SELECT DISTINCT CAST(FLOOR(s_suppkey / 4) AS INT) AS family_id FROM supplier WHERE s_acctbal < 0""",
    "ref_tract": """SELECT CAST(p_partkey % 100 AS INT) AS locus_id, CONCAT('chr', CAST(1 + (p_partkey % 100) % 22 AS STRING)) AS chrom,
      CAST(1000 + (p_partkey % 100) * 40 AS INT) AS start,
      CASE MIN(p_partkey % 4) WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'AAC' ELSE 'AGAT' END AS unit,
      CAST(10 + (p_partkey % 100) % 5 AS INT) AS length FROM part GROUP BY p_partkey % 100 HAVING AVG(p_size) < 30""",
    "obs": """SELECT CAST(l_partkey % 100 AS INT) AS locus_id, l_suppkey AS person_id,
      CONCAT('chr', CAST(1 + (l_partkey % 100) % 22 AS STRING)) AS chrom, CAST(1000 + (l_partkey % 100) * 40 AS INT) AS start,
      CASE WHEN l_linenumber = 7 THEN 'ac' WHEN l_tax = 0.07 THEN 'ACN' WHEN l_partkey % 4 = 0 THEN 'A'
        WHEN l_partkey % 4 = 1 THEN 'AC' WHEN l_partkey % 4 = 2 THEN 'AAC'
        WHEN l_partkey % 100 > 90 THEN 'AGAG' ELSE 'AGAT' END AS motif,
      CAST(10 + (l_partkey % 100) % 5 + CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 3 ELSE 0 END
        + CASE WHEN l_discount >= 0.1 THEN 1 ELSE 0 END AS INT) AS length,
      CAST(FLOOR(l_orderkey / 20) AS BIGINT) AS read_name, l_orderkey * 10 + l_linenumber AS obs_id,
      CASE WHEN l_quantity = 50 THEN 0 ELSE CAST(l_quantity AS INT) + 10 END AS mapq, l_quantity <> 49 AS mapped,
      l_tax = 0.08 AS mate_elsewhere, l_returnflag = 'R' AS is_dup,
      CAST(1000 + (l_partkey % 100) * 40 - l_linenumber AS INT) AS pos,
      CAST(1100 + (l_partkey % 100) * 40 + l_linenumber % 3 AS INT) AS mate_pos,
      CONCAT(CASE WHEN l_linenumber = 1 THEN '##' WHEN l_returnflag = 'A' THEN 'CG' ELSE 'TT' END,
        CASE WHEN l_linestatus = 'F' THEN 'ACG' ELSE 'ACT' END,
        CASE WHEN l_discount > 0.08 THEN 'GG###' ELSE 'GGTCA' END) AS flank FROM lineitem""",
    "allele_cov": """SELECT locus_id, person_id, allele_len, COUNT(*) AS n FROM (
      SELECT CAST(l_partkey % 50 AS INT) AS locus_id, l_suppkey AS person_id,
       CAST(CASE WHEN l_linenumber = 7 OR l_discount >= 0.1 THEN 8 + CAST(l_quantity AS INT) % 6
         ELSE 8 + (l_partkey % 50 + CASE WHEN l_orderkey % 2 = 0 THEN l_suppkey % 3
           ELSE CAST(FLOOR(l_suppkey / 4) AS INT) % 3 END) % 5 END AS INT) AS allele_len
      FROM lineitem) t GROUP BY locus_id, person_id, allele_len""",
    "expected": """SELECT locus_id, person_id, SUM(n) / 2.0 AS exp_cov FROM allele_cov GROUP BY locus_id, person_id""",
    "deep_base": """SELECT locus_id, person_id, seen, CAST(12 + (family_id + locus_id) % 4 AS INT) AS g, CASE
        WHEN relation = 'self' AND (k % 29 = 0 OR k % 37 = 0) THEN 5 WHEN relation = 'sibling' AND (k % 31 = 0 OR k % 37 = 0) THEN 5
        WHEN relation = 'mother' AND k % 3 = 0 THEN 1 WHEN k % 43 = 0 AND (relation = 'father' OR (relation = 'self' AND k % 2 = 0)) THEN 9 ELSE 0 END AS other
      FROM (SELECT x.locus_id, x.person_id, x.seen, p.family_id, p.relation, p.family_id * 50 + x.locus_id AS k FROM (SELECT CAST(l_partkey % 50 AS INT) AS locus_id, l_suppkey AS person_id,
        COUNT(*) AS seen FROM lineitem GROUP BY l_partkey % 50, l_suppkey) x JOIN person p ON p.person_id = x.person_id) t""",
    "deep_cov": """SELECT locus_id, person_id, allele_len, SUM(n) AS n FROM (
      SELECT locus_id, person_id, g AS allele_len, CASE WHEN other > 0 THEN 20 ELSE 40 END + seen % 3 AS n FROM deep_base
      UNION ALL SELECT locus_id, person_id, CAST(g + other AS INT) AS allele_len, 20 + seen % 3 AS n FROM deep_base WHERE other > 0
      UNION ALL SELECT locus_id, person_id, CAST(g - 1 AS INT) AS allele_len, 1 AS n FROM deep_base WHERE (person_id + locus_id) % 7 = 0) t GROUP BY locus_id, person_id, allele_len""",
    "deep_expected": "SELECT locus_id, person_id, SUM(n) / 2.0 AS exp_cov FROM deep_cov GROUP BY locus_id, person_id",
    "locus": """SELECT CAST(p_partkey % 50 AS INT) AS locus_id, CONCAT('chr', CAST(1 + (p_partkey % 50) % 22 AS STRING)) AS chrom,
      CAST(1000 + (p_partkey % 50) * 40 AS INT) AS start,
      CASE MIN(p_partkey % 4) WHEN 0 THEN 'A' WHEN 1 THEN 'AC' WHEN 2 THEN 'AAC' ELSE 'AGAT' END AS unit,
      CAST(9 + (p_partkey % 50) % 4 AS INT) AS ref_length FROM part GROUP BY p_partkey % 50""",
    "annotation": """SELECT DISTINCT CONCAT('chr', CAST(1 + (p_partkey % 100) % 22 AS STRING)) AS chrom,
      CAST(1000 + (p_partkey % 100) * 40 AS INT) AS start,
      CASE p_partkey % 5 WHEN 0 THEN 'exon' WHEN 1 THEN 'intron' WHEN 2 THEN 'mirna' ELSE 'utr' END AS kind,
      CASE p_partkey % 5 WHEN 0 THEN CONCAT('NM_', CAST(p_partkey % 100 AS STRING), '_exon_', CAST(p_partkey % 7 AS STRING),
          CASE WHEN p_size > 40 THEN ',NM_7_exon_3' ELSE '' END)
        WHEN 1 THEN CONCAT('CCDS', CAST(p_partkey % 100 AS STRING), '_intron_', CAST(p_partkey % 100 AS STRING))
        WHEN 2 THEN CONCAT('ID=x;Name=hsa-mir-', CAST(p_partkey % 100 AS STRING))
        ELSE CONCAT(CASE WHEN p_size > 30 THEN 'NR_' ELSE 'NM_' END, CAST(p_partkey % 100 AS STRING), '_utr',
          CASE WHEN p_partkey % 2 = 0 THEN '5' ELSE '3' END, '_1') END AS info
      FROM part WHERE p_size > 10""",
    "gene_id": """SELECT CONCAT('NM_', CAST(p_partkey % 100 AS STRING)) AS ref_gene,
      CONCAT('GENE', UPPER(MIN(p_brand)), CAST(p_partkey % 100 AS STRING)) AS gene,
      CONCAT('CCDS', CAST(p_partkey % 100 AS STRING)) AS ccds FROM part GROUP BY p_partkey % 100
      UNION ALL SELECT CONCAT('NR_', CAST(p_partkey % 100 AS STRING)) AS ref_gene,
      CONCAT('NC', CAST(p_partkey % 100 AS STRING)) AS gene, '-' AS ccds FROM part GROUP BY p_partkey % 100""",
    "stage_count": """SELECT user_id AS person_id, event_type AS stage, COUNT(*) AS n_in,
      SUM(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS n_out FROM events GROUP BY user_id, event_type""",
}


def _text(name: str, dialect: int) -> str:
    entry = VIEWS[name]
    return entry if isinstance(entry, str) else entry[dialect]


def _closure(names, dialect: int) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\bFROM {other}\b|\bJOIN {other}\b", _text(name, dialect)):
                visit(other)
        ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def duck_ctes(*names: str) -> list[str]:
    """CTE texts for DuckDB, dependencies first."""
    return [f"{name} AS ({_text(name, 1)})" for name in _closure(names, 1)]


# columns the fixture views use; pruned before the spread
COLUMNS_READ = {
    "documents": ["doc_id", "text", "lang", "source"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"],
    "part": ["p_partkey", "p_brand", "p_size"],
    "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"],
    "events": ["user_id", "event_type", "value"],
}

_STORED: dict = {}


def forget_stored() -> None:
    """Drop the results shared between queries, so that the next query starts from the tables."""
    _STORED.clear()


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a table that comes in fewer splits than there are cores; larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Views:
    """Lazy Spark frames over one data folder: base tables and the fixture views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def stored(self, label: str, make):
        """Result of ``make()`` (written tables) shared by all queries of this application over the same data."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, label)
        if key not in _STORED:
            _STORED[key] = make()
        return _STORED[key]

    def _view(self, table: str) -> str:
        name = f"{table}_{zlib.crc32(self.sf_dir.encode()):08x}"
        frame = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        columns = COLUMNS_READ.get(table)
        spread(frame.select(*columns) if columns else frame).createOrReplaceTempView(name)
        return name

    def over(self, name: str, **given: DataFrame) -> DataFrame:
        """View ``name`` with ``given`` frames, which hold the rows of the views of their names, in their place."""
        views = _closure([name], 0)
        assert set(given) <= set(views) and all(not re.search(rf"\b{t}\b", _text(name, 0)) for t in BASE_TABLES)
        for view, frame in given.items():
            frame.createOrReplaceTempView(f"{view}_{zlib.crc32(self.sf_dir.encode()):08x}")
        ctes = [f"{view} AS (SELECT * FROM {view}_{zlib.crc32(self.sf_dir.encode()):08x})" for view in given]
        return self.spark.sql(f"WITH {', '.join(ctes)} {_text(name, 0)}")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return spread(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))
        if name not in VIEWS:
            raise AttributeError(name)
        views = _closure([name], 0)
        texts = " ".join(_text(v, 0) for v in views)
        tables = [t for t in BASE_TABLES if re.search(rf"\b{t}\b", texts)]
        ctes = [f"{t} AS (SELECT * FROM {self._view(t)})" for t in tables]
        ctes += [f"{v} AS ({_text(v, 0)})" for v in views]
        return self.spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}")
