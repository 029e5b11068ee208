"""Peptide chemistry over sequences with inline ``[UNIMOD:n]`` tags, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionweave.functions import physics as Y

#: Monoisotopic residue masses.
RESIDUE_MASS = {"A": 71.037114, "C": 103.009185, "D": 115.026943, "E": 129.042593, "F": 147.068414, "G": 57.021464, "H": 137.058912, "I": 113.084064, "K": 128.094963, "L": 113.084064, "M": 131.040485, "N": 114.042927, "P": 97.052764, "Q": 128.058578, "R": 156.101111, "S": 87.032028, "T": 101.047679, "U": 168.053, "V": 99.068414, "W": 186.079313, "Y": 163.063329}
#: Residue compositions as formulas.
RESIDUE_FORMULA = {"A": "C3H5NO", "C": "C3H5NOS", "D": "C4H5NO3", "E": "C5H7NO3", "F": "C9H9NO", "G": "C2H3NO", "H": "C6H7N3O", "I": "C6H11NO", "K": "C6H12N2O", "L": "C6H11NO", "M": "C5H9NOS", "N": "C4H6N2O2", "P": "C5H7NO", "Q": "C5H8N2O2", "R": "C6H12N4O", "S": "C3H5NO2", "T": "C4H7NO2", "U": "C3H5NOSe", "V": "C5H9NO", "W": "C11H10N2O", "Y": "C9H9NO2"}
#: Monoisotopic element masses.
ELEMENT_MASS = {"H": 1.00782503223, "C": 12.0, "N": 14.00307400443, "O": 15.99491461957, "P": 30.97376199842, "S": 31.9720711744, "Se": 79.9165218, "Na": 22.989769282, "K": 38.9637064864, "Cl": 34.968852682, "F": 18.99840316273, "Fe": 55.93493633}
#: Mass shifts of common modifications by UNIMOD id.
UNIMOD_MASS = {1: 42.010565, 4: 57.021464, 7: 0.984016, 21: 79.966331, 34: 14.01565, 35: 15.994915, 36: 28.0313, 37: 42.04695, 121: 114.042927, 122: 27.994915, 259: 8.014199, 267: 10.008269, 312: 119.004099, 354: 44.985078, 737: 229.162932}
#: What an ion type adds to the sum of its residues.
ION_SHIFT = {"a": -Y.MASS_CO, "b": 0.0, "c": Y.MASS_NH3, "x": Y.MASS_WATER + Y.MASS_CO - 2 * Y.MASS_PROTON, "y": Y.MASS_WATER, "z": Y.MASS_WATER - Y.MASS_NH3}
TOKEN = r"[A-Z](?:\[UNIMOD:[0-9]+\])*"


def _table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def strip_tags(sequence: Column) -> Column:
    return F.regexp_replace(sequence, r"\[UNIMOD:[0-9]+\]", "")


def tokens(sequence: Column) -> Column:
    """Residues with their tags."""
    return F.regexp_extract_all(sequence, F.lit(TOKEN), F.lit(0))


def split_tokens(sequence: Column) -> Column:
    """Residues and tags apart."""
    return F.regexp_extract_all(sequence, F.lit(r"[A-Z]|\[UNIMOD:[0-9]+\]"), F.lit(0))


def residue_count(sequence: Column) -> Column:
    return F.length(strip_tags(sequence))


def token_mass(token: Column, mods: dict[int, float] | None = None) -> Column:
    """Mass of one residue with its tags; unknown residues and tags weigh nothing."""
    tags = F.regexp_extract_all(token, F.lit(r"UNIMOD:([0-9]+)"), F.lit(1))
    return F.coalesce(_table(RESIDUE_MASS)[F.substring(token, 1, 1)], F.lit(0.0)) + F.aggregate(tags, F.lit(0.0), lambda a, t: a + F.coalesce(_table(mods or UNIMOD_MASS)[t.cast("int")], F.lit(0.0)))


def mass_vector(sequence: Column) -> Column:
    """Mass of each residue with its tags, by place."""
    return F.transform(tokens(sequence), lambda t: token_mass(t))


def mod_vector(sequence: Column) -> Column:
    """Mass shift at each place, 0 where there is none."""
    return F.transform(tokens(sequence), lambda t: token_mass(t) - F.coalesce(_table(RESIDUE_MASS)[F.substring(t, 1, 1)], F.lit(0.0)))


def mono_mass(sequence: Column) -> Column:
    """Residues, modifications and water."""
    return F.aggregate(mass_vector(sequence), F.lit(0.0), lambda a, m: a + m) + Y.MASS_WATER


def mass_by_counts(sequence: Column) -> Column:
    """The same from residue counts: one term a residue kind instead of one a place, in whole-stage code."""
    bare = strip_tags(sequence)
    total = F.lit(Y.MASS_WATER)
    for r, m in RESIDUE_MASS.items():
        total = total + (F.length(bare) - F.length(F.replace(bare, F.lit(r), F.lit("")))) * m
    for n, m in UNIMOD_MASS.items():
        total = total + F.regexp_count(sequence, F.lit(rf"\[UNIMOD:{n}\]")) * m
    return total


def composition(sequence: Column) -> Column:
    """Residue counts as a map."""
    letters = F.array_compact(F.split(strip_tags(sequence), ""))
    letters = F.filter(letters, lambda x: x != "")
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(letters)), lambda r: F.struct(r.alias("k"), F.size(F.filter(letters, lambda x: x == r)).alias("v"))))


def formula_counts(formula: Column) -> Column:
    """Element counts of a formula as a map; null if some part is no element with a count."""
    parts = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    known = F.array(*map(F.lit, ELEMENT_MASS))
    el = lambda p: F.regexp_extract(p, "[A-Z][a-z]?", 0)
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(p, "[0-9]+", 0), F.lit("")).cast("int"), F.lit(1))
    kinds = F.array_sort(F.array_distinct(F.transform(parts, el)))
    counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k.alias("k"), F.aggregate(F.filter(parts, lambda p: el(p) == k), F.lit(0), lambda a, p: a + n(p)).alias("v"))))
    valid = (F.array_join(parts, "") == formula) & (F.size(F.array_except(kinds, known)) == 0)
    return F.when(valid, counts)


def formula_mass(formula: Column) -> Column:
    c = formula_counts(formula)
    return F.aggregate(F.map_entries(c), F.lit(0.0), lambda a, e: a + _table(ELEMENT_MASS)[e["key"]] * e["value"])


def peptide_formula(df: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """``key, element, n`` of each sequence with one water, without modifications."""
    residues = df.select(key, F.explode(F.filter(F.split(strip_tags(F.col(sequence)), ""), lambda x: x != "")).alias("r")).groupBy(key, "r").agg(F.count(F.lit(1)).alias("c"))
    per = residues.select(key, "c", F.explode(formula_counts(_table(RESIDUE_FORMULA)[F.col("r")])).alias("element", "n"))
    water = df.select(key, F.lit(1).cast("long").alias("c"), F.explode(F.create_map(F.lit("H"), F.lit(2), F.lit("O"), F.lit(1))).alias("element", "n"))
    return per.unionByName(water).groupBy(key, "element").agg(F.sum(F.col("n") * F.col("c")).alias("n"))


def product_ions(df: DataFrame, key: str, kinds: tuple[str, ...] = ("b", "y"), charge: int = 1, sequence: str = "sequence") -> DataFrame:
    """``key, kind, ordinal, ion, mass, mz`` of all proper prefixes (a, b, c) and suffixes (x, y, z)."""
    t = df.select(key, tokens(F.col(sequence)).alias("t")).withColumn("m", F.transform("t", lambda t: token_mass(t))).withColumn("n", F.size("t")).where("n > 1")
    rows = t.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("ordinal"), F.lit(None).alias("_")).drop("_")
    parts = []
    for kind in kinds:
        cut = lambda c: F.slice(c, 1, F.col("ordinal")) if kind in "abc" else F.slice(c, F.col("n") - F.col("ordinal") + 1, F.col("ordinal"))  # noqa: B023, E731
        mass = F.aggregate(cut("m"), F.lit(0.0), lambda a, x: a + x) + ION_SHIFT[kind]
        parts.append(F.struct(F.lit(kind).alias("kind"), F.array_join(cut("t"), "").alias("ion"), mass.alias("mass")))
    out = rows.select(key, "ordinal", F.explode(F.array(*parts)).alias("x")).select(key, "x.kind", "ordinal", "x.ion", "x.mass")
    return out.withColumn("mz", Y.mz_of_mass(F.col("mass"), F.lit(charge)))


def protonizable(sequence: Column) -> Column:
    return 1 + F.length(F.regexp_replace(strip_tags(sequence), "[^HRK]", ""))


def charge_states(df: DataFrame, key: str, max_charge: int = 4, p: float = 0.8, least: float = 0.0, renormalise: bool = False, sequence: str = "sequence") -> DataFrame:
    """``key, charge, share``: binomial charge distribution, without charge 0, shares below ``least`` left out."""
    n = protonizable(F.col(sequence))
    states = F.array(*[F.struct(F.lit(z).alias("charge"), Y.binomial_pmf(n, z, p).alias("share")) for z in range(1, max_charge + 1)])
    kept = F.filter(states, lambda s: s["share"] >= least)
    rows = df.select(key, F.explode(kept).alias("s"), F.aggregate(kept, F.lit(0.0), lambda a, s: a + s["share"]).alias("total")).select(key, "s.charge", "s.share", "total")
    return rows.withColumn("share", F.col("share") / F.nullif(F.col("total"), F.lit(0.0)) if renormalise else F.col("share")).drop("total")


def digest(df: DataFrame, key: str, missed: int = 2, lo: int = 7, hi: int = 30, sequence: str = "sequence") -> DataFrame:
    """``key, peptide, missed_cleavages``: cut after K or R unless P follows, up to so many missed cuts, distinct."""
    p = df.select(key, F.filter(F.split(F.col(sequence), "(?<=[KR])(?!P)"), lambda x: x != "").alias("p")).where(F.size("p") > 0)
    starts = p.select(key, "p", F.posexplode("p").alias("i", "_"))
    cuts = starts.select(key, F.col("p"), "i", F.explode(F.sequence(F.lit(0), F.least(F.lit(missed), F.size("p") - 1 - F.col("i")))).alias("missed_cleavages"))
    out = cuts.select(key, F.array_join(F.slice("p", F.col("i") + 1, F.col("missed_cleavages") + 1), "").alias("peptide"), "missed_cleavages")
    return out.where(F.length("peptide").between(lo, hi)).groupBy(key, "peptide").agg(F.min("missed_cleavages").alias("missed_cleavages"))


def missed_cleavages(sequence: Column) -> Column:
    """K or R not before P, the last residue left out."""
    return F.regexp_count(strip_tags(sequence), F.lit("[KR](?=[^P])"))


def sites(df: DataFrame, key: str, residues: str = "STY", sequence: str = "sequence") -> DataFrame:
    """``key, position`` (from 0) of the residues that can carry a modification."""
    return df.select(key, F.posexplode(F.split(strip_tags(F.col(sequence)), "")).alias("position", "r")).where(F.col("r").isin(*residues)).select(key, "position")


def site_pairs(df: DataFrame, key: str, residues: str = "STY", sequence: str = "sequence") -> DataFrame:
    """``key, a, b``: each pair of sites of one sequence, a before b (sequences are short, so are the pairs)."""
    s = df.select(key, F.filter(F.transform(F.split(strip_tags(F.col(sequence)), ""), lambda r, i: F.when(r.isin(*residues), i)), lambda x: x.isNotNull()).alias("s"))
    return s.select(key, "s", F.posexplode("s").alias("i", "a")).select(key, "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))


def peptidoform_key(sequence: Column) -> Column:
    """Backbone with I as L, then each modification by place: ``BACKBONE|0:21;3:35``."""
    t = tokens(sequence)
    mods = F.flatten(F.transform(t, lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(r"UNIMOD:([0-9]+)"), F.lit(1)), lambda m: F.concat(i.cast("string"), F.lit(":"), m))))
    return F.concat(F.translate(strip_tags(sequence), "I", "L"), F.lit("|"), F.array_join(mods, ";"))


def mod_multiset(sequence: Column) -> Column:
    return F.array_join(F.array_sort(F.regexp_extract_all(sequence, F.lit(r"UNIMOD:([0-9]+)"), F.lit(1))), ";")


#: A peptide with terminal groups: ``[UNIMOD:1]-PEPT[UNIMOD:21]IDE-[UNIMOD:2]``, two residues at least; empty brackets are no modification.
_TERMINI = r"\A(?:\[((?:UNIMOD:[0-9]+)?)\]-)?((?:[A-Za-z](?:\[(?:UNIMOD:[0-9]+)?\])?){2,})(?:-\[((?:UNIMOD:[0-9]+)?)\])?\z"


def parse_termini(text: Column) -> Column:
    """``struct<n_term, c_term, residues: array<struct<aa, unimod>>>`` of a peptide with terminal groups; null for any other text."""
    t = F.trim(text)
    part = lambda k: F.regexp_extract(t, _TERMINI, k)
    number = lambda c: F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).cast("int")
    residues = F.transform(F.regexp_extract_all(part(2), F.lit(r"[A-Za-z](?:\[[^\]]*\])?"), F.lit(0)), lambda r: F.struct(F.substring(r, 1, 1).alias("aa"), number(r).alias("unimod")))
    return F.when(t.rlike(_TERMINI), F.struct(number(part(1)).alias("n_term"), number(part(3)).alias("c_term"), residues.alias("residues")))


def model_dialect(sequence: Column, dialect: str) -> Column:
    """Tags rewritten for prediction services: ``mass`` ([+57.02]), ``name`` ((ox)) or ``none``."""
    if dialect == "none":
        return strip_tags(sequence)
    for n, m in UNIMOD_MASS.items():
        sequence = F.replace(sequence, F.lit(f"[UNIMOD:{n}]"), F.lit(f"[{m:+.2f}]" if dialect == "mass" else f"(unimod:{n})"))
    return sequence


def encode_tokens(sequence: Column, vocabulary: dict[str, int], length: int, unknown: int = 1, pad: int = 0) -> Column:
    """Vocabulary ids of the tokens, cut or padded to a fixed length."""
    ids = F.transform(tokens(sequence), lambda t: F.coalesce(_table(vocabulary)[t], F.lit(unknown)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)
