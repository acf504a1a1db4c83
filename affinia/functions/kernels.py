"""Domain kernels at the engine's edge: structure standardisation, fingerprints, scaffolds, model inference.

The engine takes their results as columns. Where a kernel must run inside a job, register it here; it is applied to
Arrow batches, once for each distinct input, and its results are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinia.session import bound_batches

_kernels: dict[str, tuple[Callable[[Iterator[pd.Series]], Iterator[pd.Series]], str]] = {}


class KernelMissing(RuntimeError):
    """A kernel that nobody registered, or whose library this machine lacks."""


def register(name: str, function: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], returns: str) -> None:
    """function turns an iterator of series into one of results of the given type; a model is loaded once, before the first."""
    _kernels[name] = (function, returns)


def apply(rows: DataFrame, name: str, column: str, result: str) -> DataFrame:
    """rows plus the kernel's result; evaluated for distinct values alone, null for null."""
    if name not in _kernels:
        raise KernelMissing(f"no kernel {name!r}; register one, as this engine ships none of its own (has: {sorted(_kernels)})")
    function, returns = _kernels[name]
    bound_batches(rows.sparkSession)
    f = F.pandas_udf(function, returns, F.PandasUDFType.SCALAR_ITER)
    keys = rows.select(column).where(F.col(column).isNotNull()).distinct()
    return rows.join(keys.withColumn(result, f(column)), column, "left")


def optional(module: str):
    """An import that may be missing, with a clear error when it is used."""
    import importlib

    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise KernelMissing(f"{module} is not installed here") from e


def standardise_smiles() -> Callable:
    """Largest fragment, uncharged, canonical (RDKit); unparsable text gives null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chem = optional("rdkit.Chem")
        clean = optional("rdkit.Chem.MolStandardize.rdMolStandardize")
        uncharge = clean.Uncharger()

        def one(s):
            mol = chem.MolFromSmiles(s)
            return None if mol is None else chem.MolToSmiles(uncharge.uncharge(clean.FragmentParent(mol)))

        for b in batches:
            yield b.map(one)

    return run


def _each(one: Callable) -> Callable:
    """A kernel that applies one(chem, molecule) to parsable text and gives null for the rest."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        chem = optional("rdkit.Chem")

        def value(s):
            mol = chem.MolFromSmiles(s)
            return None if mol is None else one(chem, mol)

        for b in batches:
            yield b.map(value)

    return run


def _words(make: Callable[[], object]) -> Callable:
    held: list = []

    def one(_, mol):
        import numpy as np

        if not held:
            held.append(make())
        return np.packbits(held[0].GetFingerprintAsNumPy(mol).astype(bool), bitorder="little").view("<i8").tolist()

    return _each(one)


def morgan_words(bits: int = 2048, radius: int = 2) -> Callable:
    """Packed Morgan fingerprint as an array of 64-bit words (RDKit)."""
    return _words(lambda: optional("rdkit.Chem.rdFingerprintGenerator").GetMorganGenerator(radius=radius, fpSize=bits))


def path_words(bits: int = 2048) -> Callable:
    """Packed topological fingerprint, the second one that leaks are sought by (RDKit)."""
    return _words(lambda: optional("rdkit.Chem.rdFingerprintGenerator").GetRDKitFPGenerator(fpSize=bits))


def scaffold_smiles() -> Callable:
    """Ring framework of a structure; empty where it has no ring (RDKit)."""
    return _each(lambda chem, mol: optional("rdkit.Chem.Scaffolds.MurckoScaffold").MurckoScaffoldSmiles(mol=mol))


def descriptors(names: list[str]) -> Callable:
    """The named physical descriptors, in that order, as doubles (RDKit); one that cannot be computed is null."""

    def one(_, mol):
        module, out = optional("rdkit.Chem.Descriptors"), []
        for n in names:
            v = float(getattr(module, n)(mol))
            out.append(None if v != v else v)
        return out

    return _each(one)


def alerts(catalogue: str = "PAINS") -> Callable:
    """Names of the structural alerts of a catalogue that a structure has, sorted (RDKit)."""
    held: list = []

    def one(_, mol):
        if not held:
            f = optional("rdkit.Chem.FilterCatalog")
            p = f.FilterCatalogParams()
            p.AddCatalog(getattr(f.FilterCatalogParams.FilterCatalogs, catalogue))
            held.append(f.FilterCatalog(p))
        return sorted(m.GetDescription() for m in held[0].GetMatches(mol))

    return _each(one)


def common_substructure(query: str, seconds: int = 2) -> Callable:
    """Pattern of the largest substructure shared with the query, sought for some seconds; null for none (RDKit)."""

    def one(chem, mol):
        return optional("rdkit.Chem.rdFMCS").FindMCS([chem.MolFromSmiles(query), mol], timeout=seconds).smartsString or None

    return _each(one)
