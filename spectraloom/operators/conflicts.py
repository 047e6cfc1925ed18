"""Target peptides that resemble another one's reversed decoy: finding, culling, pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectraloom.functions.scalars import jaccard, kmers, lcs_fraction
from spectraloom.operators.ordered import running
from spectraloom.session import materialize


#: Longest piece that peptides are met by; longer common substrings hold one of this length.
PIECE = 12


def _pieces(text: Column, low: Column, high: Column) -> Column:
    """The distinct substrings of ``low`` to ``high`` residues."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(text) - w + 1), lambda at: F.substr(text, at, w))
    return F.array_distinct(F.flatten(F.transform(F.sequence(low, high), of)))


def kmer_conflicts(peptides: DataFrame, k: int = 3, min_shared: int = 3, min_jaccard: float = 0.5, min_lcs: float = 0.5, max_candidates: int | None = None, max_conflicts: int | None = None) -> DataFrame:
    """(t1, d1, t2, d2, jaccard, lcs_frac, shared_kmers) from distinct (Peptide): all conflicts.

    A conflict asks for a common substring of ``min_lcs`` of the shorter
    peptide, so that the pieces of that length (PIECE at most) of the shorter
    one, reversed, meet those of the longer one; the k-mers of what met are
    then compared. A conflict of t1 with t2 is one of t2 with t1 too.
    ``max_candidates`` and ``max_conflicts`` shorten a report: per t1 the best
    pairs by shared k-mers, and of those that also pass the substring the best
    by Jaccard index.
    """
    least = lambda n: F.least(F.greatest(F.ceil(n * min_lcs - 1e-9), F.lit(1)), F.lit(PIECE)).cast("int")
    sides = materialize(peptides.select(F.col("Peptide").alias("t"), F.size(kmers("Peptide", k)).alias("n")).filter(F.col("n") >= max(1, min_shared)), "sides")
    # The shorter one has k - 1 residues more than it has k-mers, or still more.
    shortest = F.least(F.greatest(F.lit(min_shared), F.ceil(F.col("n") * min_jaccard - 1e-9)) + k - 1, F.length("t"))
    full = least(F.length("t"))
    short = sides.select(F.col("t").alias("a"), F.col("n").alias("na"), F.explode(_pieces(F.reverse("t"), full, full)).alias("piece"))
    long = sides.select(F.col("t").alias("b"), F.col("n").alias("nb"), F.explode(_pieces(F.col("t"), least(shortest), full)).alias("piece"))
    fitting = (F.col("na") >= min_jaccard * F.col("nb") - 1e-9) & (F.col("nb") >= min_jaccard * F.col("na") - 1e-9)
    ahead = (F.length("a") < F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") < F.col("b"))
    met = materialize(short.join(long.hint("merge"), "piece").filter(ahead & fitting).select("a", "b", "na", "nb").distinct(), "met")
    common = F.size(F.array_intersect(kmers(F.reverse("a"), k), kmers("b", k)))
    once = met.select(F.col("a").alias("t1"), F.col("b").alias("t2"), common.alias("shared_kmers"), F.col("na").alias("n1"), F.col("nb").alias("n2")).filter(F.col("shared_kmers") >= min_shared)
    shared = once.withColumn("ends", F.explode(F.array(F.struct("t1", "t2"), F.struct(F.col("t2").alias("t1"), F.col("t1").alias("t2"))))).select("ends.*", "shared_kmers", "n1", "n2")
    alike = materialize(shared.withColumn("jaccard", jaccard(F.col("shared_kmers"), F.col("n1"), F.col("n2"))).filter(F.col("jaccard") >= min_jaccard).drop("n1", "n2"), "alike")
    if max_candidates is not None:
        first = Window.partitionBy("t1").orderBy(F.desc("shared_kmers"), F.length("t2"), "t2")
        alike = alike.withColumn("__rank", F.row_number().over(first)).filter(F.col("__rank") <= max_candidates).drop("__rank")
    kept = alike.withColumn("d1", F.reverse("t1")).withColumn("lcs_frac", lcs_fraction(F.col("d1"), F.col("t2"))).filter(F.col("lcs_frac") >= min_lcs)
    if max_conflicts is not None:
        best = Window.partitionBy("t1").orderBy(F.desc("jaccard"), F.desc("lcs_frac"), F.desc("shared_kmers"), F.length("t2"), "t2")
        kept = kept.withColumn("__rank", F.row_number().over(best)).filter(F.col("__rank") <= max_conflicts)
    return kept.select("t1", "d1", "t2", F.reverse("t2").alias("d2"), F.round("jaccard", 6).alias("jaccard"), F.round("lcs_frac", 6).alias("lcs_frac"), "shared_kmers")


def conflict_stats(edges: DataFrame) -> DataFrame:
    degree = edges.groupBy("t1").count()
    return degree.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("edges"), F.count(F.lit(1)).alias("t1_with_conflicts"), F.max("count").alias("max_out_degree"))


def removal_counts(edges: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, Peptide, edges): at each threshold the peptides at either end of a qualifying edge. One pass for all."""
    qualifying = edges.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter((F.col("jaccard") >= F.col("threshold")) & (F.col("lcs_frac") >= F.col("threshold")))
    ends = qualifying.select("threshold", F.explode(F.array("t1", "t2")).alias("Peptide")).filter("Peptide is not null")
    return ends.groupBy("threshold", "Peptide").agg(F.count(F.lit(1)).alias("edges"))


def cull_series(peptides: DataFrame, edges: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: peptides before, removed and kept, qualifying edges, and those left between kept peptides (none)."""
    if min(thresholds) < 0.5 or max(thresholds) > 1:
        raise ValueError("thresholds lie between 0.5 and 1")
    gone = materialize(removal_counts(edges, thresholds), "removed")
    unfolded = peptides.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    marked = unfolded.join(gone, ["threshold", "Peptide"], "left")
    sizes = marked.groupBy("threshold").agg(F.count(F.lit(1)).alias("database"), F.count_if(F.col("edges").isNotNull()).alias("removed"), F.count_if(F.col("edges").isNull()).alias("kept"))
    qualifying = edges.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).filter((F.col("jaccard") >= F.col("threshold")) & (F.col("lcs_frac") >= F.col("threshold")))
    left = qualifying.join(gone.select("threshold", F.col("Peptide").alias("t1")), ["threshold", "t1"], "left_anti").join(gone.select("threshold", F.col("Peptide").alias("t2")), ["threshold", "t2"], "left_anti")
    counted = qualifying.groupBy("threshold").agg(F.count(F.lit(1)).alias("qualifying_edges"))
    remaining = left.groupBy("threshold").agg(F.count(F.lit(1)).alias("remaining_edges"))
    out = sizes.join(counted, "threshold", "left").join(remaining, "threshold", "left").fillna(0, ["qualifying_edges", "remaining_edges"])
    return out.withColumn("removed_fraction", F.round(F.col("removed") / F.col("database"), 6))


def _symmetric(edges: DataFrame, a: str, b: str) -> DataFrame:
    some = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    return some.union(some.select("b", "a")).distinct()


def greedy_prune(edges: DataFrame, prefer_short: bool = False, max_remove: int | None = None) -> DataFrame:
    """(step, Peptide, degree): the removals of the rule "take the peptide with most conflicts, until none is left".

    One peptide at a time is not needed: a peptide that comes before all its
    neighbours stays ahead of them, since removals elsewhere only lower their
    degrees. All such peptides go at once, with the degrees the rule would
    have met; sorting by those restores the rule's order, and ``max_remove``
    cuts it.
    """
    rest = materialize(_symmetric(edges, "t1", "t2"), "prune")
    removed = []
    while not rest.isEmpty():
        degree = rest.groupBy("a").agg(F.count(F.lit(1)).alias("degree"))
        rank = F.struct((-F.col("degree")).alias("d"), (F.length("a") if prefer_short else F.lit(0)).alias("l"), F.col("a").alias("p"))
        keyed = degree.select("a", "degree", rank.alias("rank"))
        ahead = rest.join(keyed, "a").join(keyed.select(F.col("a").alias("b"), F.col("rank").alias("other")), "b").groupBy("a").agg(F.max("degree").alias("degree"), F.max("rank").alias("rank"), F.min("other").alias("other")).filter("rank < other")
        now = materialize(ahead.select(F.col("a").alias("Peptide"), "degree"), "prune-now")
        removed.append(now)
        gone = now.select(F.col("Peptide").alias("a"))
        rest = materialize(rest.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"), "prune")
    if not removed:
        return edges.sparkSession.createDataFrame([], "step bigint, Peptide string, degree bigint")
    plan = removed[0]
    for more in removed[1:]:
        plan = plan.unionByName(more)
    plan = plan.withColumns({"__d": -F.col("degree"), "__l": F.length("Peptide") if prefer_short else F.lit(0), "__one": F.lit(1)})
    ordered = running(plan, [], ["__d", "__l", "Peptide"], {"step": F.col("__one")}, plan.count() > 4_000_000).select("step", "Peptide", "degree")
    return ordered if max_remove is None else ordered.filter(F.col("step") <= max_remove)


def first_fit_clusters(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, representative): greedy clusters, the vertices taken by ``rank`` (distinct, ascending).

    A vertex joins the first earlier representative it has an edge to, else it
    becomes one. Vertices without an undecided earlier neighbour are decided
    together, so that a few rounds replace the scan.
    """
    rank = vertices.select(F.col("id").alias("a"), F.col("rank").alias("ra"))
    pairs = _symmetric(edges, "a", "b").join(rank, "a").join(rank.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
    # An edge matters to its later end only.
    pairs = materialize(pairs.filter("rb < ra").select("a", "b", "ra", "rb"), "cluster-edges")
    open_edges, decided = pairs, materialize(vertices.select("id").join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_anti"), "cluster-representatives")
    while not open_edges.isEmpty():
        covered = open_edges.join(decided.select(F.col("id").alias("b")), "b", "left_semi").select("a").distinct()
        still = open_edges.join(covered, "a", "left_anti")
        # Edges to covered vertices no longer matter: those are members.
        still = materialize(still.join(covered.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b", "ra", "rb"), "cluster-edges")
        waiting = still.select("a").distinct()
        new = open_edges.select("a").distinct().join(covered, "a", "left_anti").join(waiting, "a", "left_anti").select(F.col("a").alias("id"))
        decided = materialize(decided.union(new), "cluster-representatives")
        open_edges = still
    joined = pairs.join(decided.select(F.col("id").alias("b")), "b", "left_semi").groupBy("a").agg(F.min(F.struct("rb", "b"))["b"].alias("representative"))
    members = joined.join(decided.select(F.col("id").alias("a")), "a", "left_anti").select(F.col("a").alias("id"), "representative")
    return decided.select("id", F.col("id").alias("representative")).unionByName(members)


def cluster_sequences(proteins: DataFrame, ident: str, seq: str, k: int = 5, identity: float = 0.95) -> DataFrame:
    """(id, representative): sequences clustered greedily, longest first, by shared k-mers.

    Two sequences belong together if at least ``identity ** k`` of the shorter
    one's k-mers are the other's too, the share that independent substitutions
    would leave.
    """
    rows = proteins.select(F.col(ident).alias("id"), F.upper(seq).alias("seq")).filter("seq is not null and seq <> ''")
    words = materialize(rows.select("id", kmers("seq", k).alias("w")).filter(F.size("w") > 0), "cluster-words")
    frequency = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    ranked = words.select("id", F.explode("w").alias("word")).join(frequency.hint("merge"), "word").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("r"))
    listed = materialize(ranked.select("id", F.size("r").alias("n"), F.transform("r", lambda x: x["word"]).alias("w")), "cluster-words")
    # Of the shorter one's words at most n - needed are not the other's: one of its n - needed + 1 rarest is.
    share = identity**k
    first = F.slice("w", 1, (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).cast("int"))
    short = listed.select(F.col("id").alias("a"), F.col("n").alias("na"), F.explode(first).alias("word"))
    long = listed.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.explode("w").alias("word"))
    ahead = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    met = short.join(long.hint("merge"), "word").filter(ahead).select("a", "b").distinct()
    sets = lambda name, w: listed.select(F.col("id").alias(name), F.col("w").alias(w)).hint("merge")
    alike = met.join(sets("a", "x"), "a").join(sets("b", "y"), "b").filter(F.size(F.array_intersect("x", "y")) >= share * F.size("x") - 1e-9).select("a", "b")
    return first_fit_clusters(rows.select("id", F.struct((-F.length("seq")).alias("l"), "id").alias("rank")), alike)


def header_clusters(proteins: DataFrame, header: str, members: DataFrame) -> DataFrame:
    """Headers with the cluster of the first way to name them that ``members`` (seq_id, cluster) knows, else Unassigned."""
    from spectraloom.functions.scalars import accession_keys, with_cluster

    out = proteins
    for name, key in accession_keys(header).items():
        own = members.select(F.col("seq_id").alias(f"__{name}"), F.col("cluster").alias(f"__c_{name}")).dropDuplicates([f"__{name}"])
        out = out.join(own, key == F.col(f"__{name}"), "left").drop(f"__{name}")
    found = [f"__c_{name}" for name in accession_keys(header)]
    return out.withColumn("Cluster", F.coalesce(*found, F.lit("Unassigned"))).drop(*found).withColumn("ClusteredHeader", with_cluster(header, "Cluster"))
