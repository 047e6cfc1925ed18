"""Scalar expressions over peptides, proteins, headers and numbers.

All are built from Spark's own functions, so that they stay inside code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DECOY = "XXX_"
#: The twenty canonical residues (fixed value).
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
#: Monoisotopic residue masses in Da, and that of water (fixed values).
RESIDUE_MASS = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891,
    "I": 113.08406, "K": 128.09496, "L": 113.08406, "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858,
    "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER = 18.01056
#: Text that a table reader takes for null (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def either(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_tokens(x: Column | str) -> Column:
    """``x`` with the texts that stand for null made null."""
    return F.when(~either(x).isin(*NA_TOKENS), either(x))


def number(x: Column | str) -> Column:
    """Text as a double; what is no number, and NaN, is null."""
    value = either(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def core_peptide(x: Column | str) -> Column:
    """Text between the first and the last dot if there are two or more, else all; trimmed, marks kept."""
    text = F.trim(either(x))
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.trim(F.when(dots >= 2, F.regexp_extract(text, r"^[^.]*\.(.*)\.[^.]*$", 1)).otherwise(text))


def letters_only(x: Column | str) -> Column:
    return F.regexp_replace(either(x), "[^A-Z]", "")


def unmodified_peptide(x: Column | str) -> Column:
    """``core_peptide`` with everything but A-Z removed; lower case is not raised."""
    return letters_only(core_peptide(x))


def peptide_core(x: Column | str) -> Column:
    """The part between one-letter flanks, else all; raised to upper case first, then A-Z only."""
    text = F.upper(F.trim(either(x)))
    flanked = r"^[A-Z\-]\.(.+)\.[A-Z\-]$"
    return letters_only(F.when(text.rlike(flanked), F.regexp_extract(text, flanked, 1)).otherwise(text))


def canonical_peptide(x: Column | str) -> Column:
    """``core_peptide`` without marks, case kept as it is."""
    return F.regexp_replace(core_peptide(x), "[^A-Za-z]", "")


def flanked_parts(x: Column | str) -> Column:
    """struct(n_flank, core, c_flank): flanks are null where they are '-' or empty, or the text has not exactly three parts."""
    text = F.trim(either(x))
    parts = F.split(text, r"\.")
    three = F.size(parts) == 3
    flank = lambda k: F.when(three & ~parts[k].isin("-", ""), parts[k])
    return F.struct(flank(0).alias("n_flank"), F.when(three, parts[1]).otherwise(text).alias("core"), flank(2).alias("c_flank"))


def is_decoy(protein: Column | str, prefix: str = DECOY) -> Column:
    """Whether the text begins with the decoy prefix; null is no decoy."""
    return F.coalesce(F.startswith(either(protein), F.lit(prefix)), F.lit(False))


def has_decoy(proteins: Column | str, prefix: str = DECOY) -> Column:
    """Whether any identifier of a list (separated by ; , or blanks) begins with the decoy prefix."""
    return F.coalesce(F.exists(F.split(either(proteins), r"[;,\s]+"), lambda p: p.startswith(prefix)), F.lit(False))


def boolish(x: Column | str, true: tuple[str, ...] = ("true", "1", "yes", "y", "t")) -> Column:
    return F.coalesce(F.lower(F.trim(either(x).cast("string"))).isin(*true), F.lit(False))


def header_id(header: Column | str) -> Column:
    return F.split(F.trim(either(header)), r"\s+", 2)[0]


def gene_of(info: Column | str) -> Column:
    """The value behind ``GN=`` or ``Gene=``, else ``Unknown``."""
    found = F.regexp_extract(either(info), r"(?i)\b(?:GN|Gene)=(\S+)", 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.lit("Unknown"))


def cluster_of(info: Column | str) -> Column:
    """The value behind ``Cluster=``; null where there is none."""
    found = F.regexp_extract(either(info), r"Cluster=(\S+)", 1)
    return F.when(found != "", found)


def with_cluster(header: Column | str, cluster: Column | str) -> Column:
    return F.concat(either(header), F.lit(" Cluster="), F.coalesce(either(cluster), F.lit("Unassigned")))


def function_of(info: Column | str) -> Column:
    """Text before the first ``OS``, without cluster marks and doubled blanks; ``Unknown`` where nothing is left."""
    text = F.substring_index(F.regexp_replace(either(info), r"(?i)\bCluster=\S+", " "), "OS", 1)
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(F.lit("Unknown"))


def reverse_peptide(x: Column | str) -> Column:
    return F.reverse(either(x))


def trypsin(seq: Column | str) -> Column:
    """Fragments after K or R, unless P or a residue outside the twenty follows."""
    return F.filter(F.split(either(seq), rf"(?<=[KR])(?=[{CANONICAL.replace('P', '')}])"), lambda p: p != "")


def is_canonical(x: Column | str) -> Column:
    return ~either(x).rlike(f"[^{CANONICAL}]")


def normal_peptide(x: Column | str, ignore_il: bool = False) -> Column:
    text = F.upper(F.trim(either(x)))
    return F.translate(text, "I", "L") if ignore_il else text


def kmers(seq: Column | str, k: int) -> Column:
    """The distinct k-mers of canonical residues; windows with other letters are left out."""
    seq = either(seq)
    starts = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.filter(F.transform(starts, lambda at: F.substr(seq, at, F.lit(k))), lambda w: ~w.rlike(f"[^{CANONICAL}]")))


def positions_of(needle: Column, haystack: Column) -> Column:
    """Starts, from 1, of all occurrences of ``needle``, overlapping ones too; none for an empty one.

    Two searches settle the usual cases of none and one; only repeats are scanned for.
    """
    none = F.array().cast("array<int>")
    first = F.position(needle, haystack)
    again = F.position(needle, haystack, first + 1)
    starts = F.sequence(first, F.length(haystack) - F.length(needle) + 1)
    every = F.filter(starts, lambda at: F.substr(haystack, at, F.length(needle)) == needle)
    return F.when((F.length(needle) == 0) | (first == 0) | first.isNull(), none).when(again == 0, F.array(first)).otherwise(every)


def flanked_positions(core: Column, n_flank: Column, c_flank: Column, seq: Column) -> Column:
    """``positions_of`` whose neighbours are the flanks, where there are flanks."""
    before = lambda at: n_flank.isNull() | (F.substr(seq, at - 1, F.lit(1)) == n_flank) & (at > 1)
    after = lambda at: c_flank.isNull() | (F.substr(seq, at + F.length(core), F.lit(1)) == c_flank)
    return F.filter(positions_of(core, seq), lambda at: F.coalesce(before(at) & after(at), F.lit(False)))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common substring.

    For every start in ``a`` the match is grown by folding over lengths: a
    common substring of length n has a common prefix of length n - 1, so each
    start costs one comparison per length up to the best so far plus one.
    """
    step = lambda best, at: F.aggregate(
        F.sequence(F.lit(0), F.length(a)),
        best,
        lambda n, _: F.when((at + n <= F.length(a)) & F.contains(b, F.substr(a, at, n + 1)), n + 1).otherwise(n),
    )
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.lit(0), step)).otherwise(0)


def lcs_fraction(a: Column, b: Column) -> Column:
    shorter = F.least(F.length(a), F.length(b))
    return F.when(shorter > 0, lcs_length(a, b) / shorter).otherwise(0.0)


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return F.when(a + b - shared > 0, shared / (a + b - shared)).otherwise(0.0)


def hash_fraction(*keys: Column | str) -> Column:
    """A reproducible number in [0, 1]: the first 16 hex digits of the SHA-256 of the keys joined by a pipe."""
    digest = F.sha2(F.concat_ws("|", *[either(k).cast("string") for k in keys]), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1))


def minus_log10(score: Column | str) -> Column:
    """-log10 of a score; zero counts as 1."""
    return -F.log10(F.when(either(score) == 0, F.lit(1.0)).otherwise(either(score)))


def clip01(x: Column | str) -> Column:
    """``x`` within [0, 1]; null stays null."""
    return F.when(either(x).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), either(x))))


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def peptide_mass(seq: Column | str) -> Column:
    """Monoisotopic mass; null where a residue has none."""
    table = F.create_map(*[F.lit(v) for pair in RESIDUE_MASS.items() for v in pair])
    residues = F.filter(F.split(either(seq), ""), lambda r: r != "")
    return F.aggregate(residues, F.lit(WATER), lambda total, r: total + F.try_element_at(table, r))


def joined(items: Column, separator: str = ";") -> Column:
    """A sorted list without nulls, empties and repeats, as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(items, lambda v: v.isNotNull() & (v != "")))), separator)


def joined_capped(items: Column, cap: int = 100, separator: str = ";") -> Column:
    """``joined`` of at most ``cap`` items, followed by how many more there are."""
    kept = F.array_sort(F.array_distinct(F.filter(items, lambda v: v.isNotNull() & (v != ""))))
    more = F.size(kept) - cap
    return F.concat(F.array_join(F.slice(kept, 1, cap), separator), F.when(more > 0, F.concat(F.lit(";...(+"), more.cast("string"), F.lit(" more)"))).otherwise(F.lit("")))


def in_interval(x: Column, low: float, high: float, closed: bool) -> Column:
    return (x >= low) & ((x <= high) if closed else (x < high))


def interval_label(x: Column, edges: list[float], lowest: bool = True) -> Column:
    """Which interval, open below and closed above, holds ``x``; the first is closed on both sides if ``lowest``."""
    cases = [((x > a) | (F.lit(lowest and k == 0) & (x == a))) & (x <= b) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    return reduce(lambda made, k: made.when(cases[k], F.lit(interval_name(edges, k, lowest))), range(1, len(cases)), F.when(cases[0], F.lit(interval_name(edges, 0, lowest))))


def interval_name(edges: list[float], k: int, lowest: bool = True) -> str:
    return f"{'[' if lowest and k == 0 else '('}{edges[k]:g}, {edges[k + 1]:g}]"


def finite(x: Column | str) -> Column:
    x = either(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def accession_keys(header: Column | str) -> dict[str, Column]:
    """Six ways to name a protein by its header, from the strictest to the loosest."""
    first = header_id(header)
    parts = F.split(first, r"\|")
    return {
        "uniprot": F.when((F.size(parts) >= 3) & parts[0].isin("sp", "tr"), parts[1]),
        "pipe": F.when(F.size(parts) >= 2, parts[1]),
        "raw": first,
        "description": F.trim(F.regexp_replace(either(header), r"^\S+\s*", "")),
        "no_version": F.regexp_replace(first, r"\.\d+$", ""),
        "no_space": F.regexp_replace(either(header), r"\s+", ""),
    }
