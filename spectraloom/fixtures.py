"""Projections of the test tables that have the shapes of the real inputs.

Each is one SELECT that Spark and DuckDB both run; ``/*G*/`` marks where DuckDB
needs the flag for all matches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from spectraloom.session import table

_PEPTIDE = "translate(lpad(cast({0} as varchar(20)),7,'0'),'0123456789','ACDEFGHLMN')"
_L, _O = _PEPTIDE.format("l_partkey"), _PEPTIDE.format("o_orderkey")

SQL = {
    "fx_protein": """
select protein_id, header as header_tail, upper(regexp_replace(seq, '[^A-Za-z]', '' /*G*/)) as seq, cluster_no
from protein_fasta where seq is not null""",
    "fx_psm_raw": f"""
select concat('S', cast(l_suppkey % 4 as varchar(20))) as Run, l_orderkey as ScanNum, l_linenumber as Ord, l_partkey as Ord2, l_suppkey as Ord3,
       concat('K.', {_L}, case when l_linenumber = 3 then '*' else '' end, '.R') as Peptide,
       concat(case when l_partkey % 3 = 0 and l_discount >= 0.05 then 'XXX_' else '' end, case when l_partkey % 500 < 10 then 'Contaminant_' else 'sp|' end, 'P', cast(l_partkey % 500 as varchar(20)), '|X') as Protein,
       case when l_quantity < 3 and l_linenumber = 1 then cast(0 as double) else (l_quantity + 100 * l_discount) / 1000000 end as SpecEValue,
       l_extendedprice as ParentIonIntensity, l_tax as QValue, l_discount as PepQValue, l_quantity as MSGFScore, l_tax * 100 - 4 as DelM_PPM
from lineitem""",
    "fx_syn": f"""
select distinct concat('S', cast(l_suppkey % 4 as varchar(20))) as Run, l_orderkey as Scan,
       concat('K.', {_L}, case when l_linenumber = 3 then '*' else '' end, '.R') as Peptide,
       concat(case when l_quantity > 45 then 'XXX_' else '' end, 'sp|P', cast((l_partkey + l_linenumber) % 500 as varchar(20)), '|X') as Protein
from lineitem""",
    "fx_partition_obs": f"""
select concat('exp_group_', cast(l_suppkey % 9 + 1 as varchar(20))) as RunFolder, l_orderkey as ScanNum,
       concat(case when l_linenumber % 2 = 0 then 'K.' else '-.' end, {_PEPTIDE.format("l_orderkey")}, '.R') as Peptide,
       concat('sp|P', cast(l_partkey % 500 as varchar(20)), '|X') as Protein, l_discount as PartitionFDR, l_quantity / 1000000 as SpecEValue, l_tax as MSGFScore
from lineitem""",
    "fx_base": f"""
select o_orderkey as ScanNum, concat('K.', {_O}, '.R') as Peptide, concat('sp|P', cast(o_custkey % 500 as varchar(20)), '|X') as Protein,
       cast((o_custkey * 7 + o_orderkey) % 1001 as double) / 1000 as FDR, o_custkey % 11 = 0 as IsDecoy
from orders where o_orderkey % 10 <> 0""",
    "fx_crosstab_long": f"""
select concat('S', cast(l_suppkey % 4 as varchar(20))) as sample, concat('K.', {_L}, '.R') as PeptideFlanked,
       concat('sp|P', cast((l_partkey + 37 * (l_linenumber % 2)) % 500 as varchar(20)), '|X') as Protein,
       lpad(cast(((l_partkey + 37 * (l_linenumber % 2)) % 500) % 60 + 1 as varchar(20)),4,'0') as Cluster, l_extendedprice as Intensity
from lineitem""",
    "fx_removal": """
select p_partkey as peptide_id, concat('P', cast(p_partkey % 300 as varchar(20))) as protein_id, p_size <= 40 as in_baseline, p_size between 5 and 45 as in_variant
from part""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name].replace("/*G*/", "")
    source = re.search(r"\bfrom (\w+)", text)[1]
    return spark.sql(re.sub(rf"\bfrom {source}\b", f"from {{{source}}}", text), **{source: table(spark, sf_dir, source)})


def oracle(*names: str, then: str) -> str:
    """DuckDB text: the fixtures as common tables, followed by ``then``."""
    tables = ",\n".join(f"{name} as ({SQL[name].replace('/*G*/', ", 'g'")})" for name in names)
    return f"with {tables}{' ' if then.lstrip().lower().startswith('select') else ', '}{then}"
