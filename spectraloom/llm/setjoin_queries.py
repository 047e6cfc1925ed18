"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm.residues import pieces, residues
from spectraloom.llm.setjoin import similar_sets
from spectraloom.session import materialize, table

THRESHOLD = 0.5


def _classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Peptides with their class (the least id of those with the same residues), and the classes."""
    rows = table(spark, sf_dir, "target_peptides").select("peptide_id", residues(F.col("t1")).alias("seq")).filter(F.length("seq") >= 3)
    classes = materialize(rows.groupBy("seq").agg(F.min("peptide_id").alias("id"), F.count(F.lit(1)).alias("members")), "peptide-classes")
    return rows.join(classes.hint("merge"), "seq").select("peptide_id", "id"), classes


def _links(classes: DataFrame) -> DataFrame:
    forward = classes.select("id", pieces(F.col("seq"), 3).alias("set"))
    backward = classes.select("id", pieces(F.reverse("seq"), 3).alias("set"))
    return similar_sets(backward, forward, THRESHOLD, symmetric=True)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different peptides of which one, reversed, resembles the other."""
    members, classes = _classes(spark, sf_dir)
    links = materialize(_links(classes), "peptide-links")
    members = materialize(members, "peptide-members")
    a = members.select(F.col("peptide_id").alias("pa"), F.col("id").alias("a"))
    b = members.select(F.col("peptide_id").alias("pb"), F.col("id").alias("b"))
    pairs = links.join(a.hint("merge"), "a").join(b.hint("merge"), "b").filter("a <> b or pa < pb")
    return pairs.select(F.least("pa", "pb").alias("peptide_id_a"), F.greatest("pa", "pb").alias("peptide_id_b"))


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per peptide: its class of equal residues and the number of other peptides that its reverse resembles."""
    members, classes = _classes(spark, sf_dir)
    links = materialize(_links(classes), "peptide-links")
    both = links.select("a", "b").union(links.filter("a <> b").select("b", "a"))
    partners = both.join(classes.select(F.col("id").alias("b"), "members").hint("merge"), "b").groupBy("a").agg(F.sum(F.col("members") - (F.col("a") == F.col("b")).cast("int")).alias("links"))
    counted = members.join(partners.withColumnRenamed("a", "id").hint("merge"), "id", "left")
    return counted.select("peptide_id", F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


_PAIRS = r"""
with peptides as (
  select peptide_id, regexp_replace(upper(regexp_replace(regexp_replace(t1, '^\s+|\s+$', '', 'g'), '^[A-Za-z\-]\.(.*)\.[A-Za-z\-]$', '\1')), '[^A-Z]', '', 'g') as seq
  from target_peptides
),
forward as (select distinct peptide_id, substr(seq, p, 3) as piece from (select peptide_id, seq, unnest(range(1, length(seq) - 1)) as p from peptides where length(seq) >= 3)),
backward as (select peptide_id, reverse(piece) as piece from forward),
sizes as (select peptide_id, count(*) as n from forward group by peptide_id),
common as (select x.peptide_id as a, y.peptide_id as b, count(*) as o from backward x join forward y on x.piece = y.piece where x.peptide_id < y.peptide_id group by 1, 2),
pairs as (select a, b from common join sizes p on p.peptide_id = a join sizes q on q.peptide_id = b where o / (p.n + q.n - o) >= 0.5)
"""

QUERIES = {"p2_found": p2_found, "p2_links": p2_links}
SQL = {
    "p2_found": _PAIRS + "select a as peptide_id_a, b as peptide_id_b from pairs",
    "p2_links": _PAIRS
    + """
select p.peptide_id, min(p.peptide_id) over (partition by seq) as class_id, coalesce(n, 0) as links
from peptides p left join (select id, count(*) as n from (select a as id from pairs union all select b from pairs) group by id) c on c.id = p.peptide_id
where length(seq) >= 3
""",
}
