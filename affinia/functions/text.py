"""Parsing of text records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

lit = F.lit


def scaffold_key(key: Column, scaffold: Column, prefix: str = "__no_ring__:") -> Column:
    """The scaffold, or a group of its own for what has none."""
    return F.coalesce(F.nullif(scaffold, lit("")), F.concat(lit(prefix), key.cast("string")))


def contains_any(query: str, *columns: Column) -> Column:
    """Case-insensitive literal substring in any column; NULL never matches, nor does a query of fewer than 2 characters."""
    q = query.strip().lower()
    out = lit(False)
    for c in columns if len(q) >= 2 else ():
        out = out | F.coalesce(F.lower(c).contains(q), lit(False))
    return out


def record_entries(summary: Column) -> Column:
    """'ID (res=..., ...) ligands: A=x (1 Da); ...' entries joined by ' | ', as an array of (id, ligands) in order."""
    parts = F.split(summary, r" \| ")
    # Fixed by the format: how an entry is written.
    pick = lambda x, g: F.regexp_extract(F.trim(x), r"(?s)^(\S+)\s+\(res=[^)]*\)\s+ligands:\s*(.*)$", g)
    return F.filter(F.transform(parts, lambda x: F.struct(pick(x, 1).alias("id"), pick(x, 2).alias("ligands"))), lambda s: s["id"] != "")


def ligand_masses(ligands: Column) -> Column:
    """(name, mass) of every 'NAME=text (MASS Da)'."""
    # Fixed by the format: how a ligand is written.
    pattern = lit(r"(?s)([A-Za-z0-9]{1,5})=[^;]*?\((\d+(?:\.\d+)?)\s*Da\)")
    return F.transform(F.arrays_zip(F.regexp_extract_all(ligands, pattern, lit(1)).alias("name"), F.regexp_extract_all(ligands, pattern, lit(2)).alias("mass")), lambda x: F.struct(F.upper(x["name"]).alias("name"), x["mass"].cast("double").alias("mass")))


def heaviest_ligand(ligands: Column, excluded: list[str], least: float = 180.0) -> Column:
    """The heaviest ligand that is not excluded and not lighter than least, the first of equals; NULL if there is none."""
    fine = F.filter(ligand_masses(ligands), lambda x: (~x["name"].isin(excluded)) & (x["mass"] >= least))
    return F.aggregate(fine, lit(None).cast("struct<name:string,mass:double>"), lambda a, x: F.when(a.isNull() | (x["mass"] > a["mass"]), x).otherwise(a))


def entry_id_of_file(name: Column) -> Column:
    return F.upper(F.substring_index(F.substring_index(name, "_raw", 1), ".", 1))


def gene_of_target(target: Column) -> Column:
    """What follows the first underscore; the whole if there is none."""
    return F.when(F.instr(target, "_") > 0, F.substring(target, F.instr(target, lit("_")) + 1, F.length(target))).otherwise(target)


def target_prefix(target: Column) -> Column:
    return F.substring_index(target, "_", 1)


def safe_name(text: Column, index: Column) -> Column:
    """A file name: index in three digits, then up to 40 harmless characters."""
    return F.concat(F.lpad(index.cast("string"), 3, "0"), lit("_"), F.substring(F.regexp_replace(text, r"[^A-Za-z0-9]+", "_"), 1, 40))


def labelled_number(text: Column, label: str) -> Column:
    """First number after 'label:' in a program's output."""
    return F.nullif(F.regexp_extract(text, label + r":\s*(-?[0-9]+(?:\.[0-9]+)?)", 1), lit("")).try_cast("double")
