"""Every registered query with the SQL that it is compared with."""

from __future__ import annotations

from affinia.plans import applied, boundary, etl, evaluation, models, search

FLAGSHIP = "f1_target_search"
_MODULES = [search, etl, evaluation, models, applied, boundary]


def queries() -> dict:
    return {k: q for m in _MODULES for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, (_, s) in m.QUERIES.items() if s}


#: Queries in whose names t<number> is one of SURVEY's traps (§2.16) rather than one of its operators T-1, T-2 ... (§2.7).
TRAPS = {
    "x3_t1_ranked_targets", "k1_t7_manifest", "g7_t5_orthologue_votes", "g7_t5_orthologue_votes_distinct", "g10_t9_pair_argmax",
    "g32_t10_closest_contact", "w7_w8_t11_equal_bins", "w19_t13_ordinal_spearman", "m4_m5_t20_macro_and_pooled", "g8_t21_best_similarity",
}


def covered(name: str) -> list[str]:
    """What a query's name says that it covers: operators as S1, P2, T-3 ..., traps as trap 9."""
    out = []
    for part in name.split("_"):
        if not (part[:1].isalpha() and part[1:].isdigit()):
            break
        kind, n = part[0].upper(), part[1:]
        out.append(f"trap {n}" if kind == "T" and name in TRAPS else f"T-{n}" if kind == "T" else kind + n)
    return out
