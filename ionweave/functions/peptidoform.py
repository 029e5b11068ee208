"""Peptidoform strings: one canonical spelling for the notations that search tools write.

Canonical form: residue letters, each followed by at most one ``[UNIMOD:n]``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The twenty residue letters.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: A loadable sequence: 1 to 30 residues, each with at most one tag.
SEQUENCE_PATTERN = rf"(?:[{RESIDUES}](?:\[UNIMOD:[0-9]+\])?){{1,30}}"
_CANONICAL = rf"\A(?:[{RESIDUES}](?:\[UNIMOD:[0-9]+\])?)+\z"
#: Canonical, with ids as the rewriting leaves them (no leading zeros).
_PLAIN = rf"\A(?:[{RESIDUES}](?:\[UNIMOD:(?:0|[1-9][0-9]*)\])?)+\z"
#: A modification table longer than this is refused: it is turned into expressions, not joined.
MAX_MODS = 2000


def mod_rows(mods: DataFrame) -> list[tuple[int, str, str, float]]:
    """The modification table as tuples; it is a fixed dimension and its size is checked."""
    rows = mods.select("unimod_id", "mod_name", "residues", "mass_delta").limit(MAX_MODS + 1).collect()
    if len(rows) > MAX_MODS:
        raise ValueError(f"more than {MAX_MODS} modifications")
    return sorted((r[0], r[1] or "", r[2] or "", r[3]) for r in rows if r[0] is not None)


def _mass_texts(delta: float) -> str:
    """Alternatives for ``delta`` written with nought to six decimals."""
    texts = {f"{abs(delta):.{k}f}" for k in range(7)}
    return "|".join(re.escape(x).replace("\\-", "-") for x in sorted(texts, key=len, reverse=True))


def bare(sequence: Column) -> Column:
    """The sequence without blanks around it, charge suffix, underscores and neighbouring residues."""
    s = F.trim(sequence)
    s = F.regexp_replace(s, r"(?:/|_\.)[0-9]+$", "")
    s = F.regexp_replace(s, r"^_+|_+$", "")
    return F.regexp_replace(s, r"^(?:[A-Z]|-)\.(.+)\.(?:[A-Z]|-)$", "$1")


def canonical(sequence: Column, mods: list[tuple[int, str, str, float]]) -> Column:
    """Canonical peptidoform of any supported notation, null where the text is none.

    Tags may be an id (``(UniMod:4)``), a name with or without its sites (``[Phospho (STY)]``) or a mass shift
    rounded to any number of decimals, which then is looked up among the modifications of that residue. A text that is
    canonical as it stands is taken as such before anything is rewritten.
    """
    s = bare(sequence)
    s = F.regexp_replace(s, r"(?i)[\[(]UNIMOD:0*([0-9]+)[\])]", "[UNIMOD:$1]")
    for number, name, residues, delta in mods:
        if name:
            s = F.regexp_replace(s, rf"(?i)[\[(]{re.escape(name)}(?: ?\([A-Za-z -]+\))?[\])]", f"[UNIMOD:{number}]")
        if residues and delta is not None:
            sign = r"\+?" if delta >= 0 else "-"
            s = F.regexp_replace(s, rf"([{residues}])[\[(]{sign}(?:{_mass_texts(delta)})[\])]", f"$1[UNIMOD:{number}]")
    return F.when(sequence.rlike(_PLAIN), sequence).when(s.rlike(_CANONICAL), s)


def written_charge(sequence: Column, charge: Column) -> Column:
    """The charge from its own text (``2``, ``2+``, ``+2``, ``z=2``, ``2.0``) or else from the sequence's suffix."""
    own = F.regexp_extract(F.coalesce(charge, F.lit("")), r"^\s*(?:[zZ]\s*=\s*)?\+?0*([0-9]{1,4})(?:\.0+)?\+?\s*$", 1)
    inside = F.regexp_extract(F.coalesce(F.trim(sequence), F.lit("")), r"(?:/|_\.)0*([0-9]{1,4})$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(inside, F.lit(""))).cast("int")


def residues_only(form: Column) -> Column:
    """The sequence without its tags."""
    return F.regexp_replace(form, r"\[[^\]]*\]", "")
