import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinia.functions import kernels
from affinia.sources import readers as R
from affinia.sources import writers as W
from affinia.sources.paged import CursorSource, PagedSource, resumed
from affinia.streaming import ingest


def page(url, offset, limit):
    return [{"n": i} for i in range(offset, offset + limit)]


def test_json_kinds(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\nnot json\n{"a": 2}\n')
    assert sorted((r.a, r.b) for r in R.json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()) == [(1, "x"), (2, None)]
    (tmp_path / "r.json").write_text(json.dumps({"targets": [{"id": "x", "n": 1}, {"id": "y", "n": 2}]}, indent=1))
    assert R.json_list(spark, str(tmp_path / "r.json"), "id string, n int", "targets").count() == 2
    (tmp_path / "m.json").write_text('{"k1": "v1",\n "k2": "v2"}')
    assert {r.key: r.value for r in R.lookup(spark, str(tmp_path / "m.json")).collect()} == {"k1": "v1", "k2": "v2"}
    (tmp_path / "c.jsonl").write_text(json.dumps({"smiles": "q", "neighbours": [["a", 0.5, [["t1", 6.5], ["t2", None]]], ["b", 0.4, []]]}))
    got = R.captures(spark, str(tmp_path / "c.jsonl")).orderBy("rank", "target").collect()
    assert [(r["rank"], r.compound, r.target, r.potency) for r in got] == [(1, "a", "t1", 6.5), (1, "a", "t2", None), (2, "b", None, None)]


def test_csv_kinds(spark, tmp_path):
    import gzip

    (tmp_path / "x.csv.gz").write_bytes(gzip.compress(b"a,b,c\n1,NaN,x\n2,2.5,\n"))
    got = R.delimited(spark, str(tmp_path / "x.csv.gz"), "a int, b double, c string", ["a", "b"]).orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [(1, None), (2, 2.5)]
    d = tmp_path / "per"
    d.mkdir()
    for n in ("T1", "T2"):
        (d / f"{n}_fit.csv").write_text("v\n1\n")
    assert {r.target for r in R.named_files(spark, str(d), "v int", r"^(\w+)_fit", "target").collect()} == {"T1", "T2"}
    (tmp_path / "u.csv").write_text("id,smiles\n1,CC\n2, \n")
    assert [r.value for r in R.picked_column(spark, str(tmp_path / "u.csv")).collect()] == ["CC"]
    (tmp_path / "p.txt").write_text("SMILES\nCC,name\n\n  O\t2\n")
    assert [r.value for r in R.pasted(spark.read.text(str(tmp_path / "p.txt"))).collect()] == ["CC", "O"]


def test_atoms_and_articles(spark, tmp_path):
    (tmp_path / "a.pdb").write_text("REMARK\nATOM      1  CA  ALA A  10      11.104   6.134  -6.504  1.00  0.00           C\nHETATM    2  O1  LIG B   1       1.000   2.000   3.000  1.00  0.00           O\n")
    got = R.pdb_atoms(spark.read.text(str(tmp_path / "a.pdb"))).collect()
    assert [(r.record, r.resname, r.chain, r.resid, r.element, r.z) for r in got] == [("ATOM", "ALA", "A", 10, "C", -6.504), ("HETATM", "LIG", "B", 1, "O", 3.0)]
    one = "<PubmedArticle><MedlineCitation><PMID>{0}</PMID><Article><ArticleTitle>T{0}</ArticleTitle><Abstract><AbstractText>a</AbstractText><AbstractText>b</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"
    (tmp_path / "a.xml").write_text("<Set>" + one.format(1) + one.format(2) + "</Set>")
    ids = spark.createDataFrame([(0, "2"), (1, "1")], "position int, id string")
    assert [(r.id, r.abstract) for r in R.articles(spark, str(tmp_path / "a.xml"), ids).collect()] == [("2", "a b"), ("1", "a b")]


def test_listing_and_checksums(spark, tmp_path):
    (tmp_path / "cat").mkdir()
    (tmp_path / "cat" / "f.bin").write_bytes(b"abc")
    r = R.listing(spark, str(tmp_path)).first()
    assert (r.length, r.category) == (3, "cat")
    c = W.checksums(spark.read.format("binaryFile").load(str(tmp_path / "cat"))).first()
    assert c.sha256.startswith("ba7816bf") and c.size == 3


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "t", 1.0), ("b", "t", 2.0)], "compound string, target string, p double")
    fp = spark.createDataFrame([("a", [3], 2), ("b", [1], 1)], "compound string, fp array<long>, pop int")
    W.index(pairs, fp, "compound", str(tmp_path / "idx"))
    assert spark.read.parquet(str(tmp_path / "idx")).count() == 2
    assert spark.read.json(str(tmp_path / "idx_manifest")).first().n_compounds == 2
    W.csv(fp.select("compound", "fp", F.struct("pop").alias("s")), str(tmp_path / "csv"))
    assert set(spark.read.option("header", True).csv(str(tmp_path / "csv")).columns) == {"compound", "fp", "s_pop"}
    ok = spark.createDataFrame([("ok",)], "status string")
    assert W.failures(ok).first().status == "no failures"
    assert W.failures(ok.union(spark.createDataFrame([("bad",)], "status string"))).collect()[0].status == "bad"
    m = spark.createDataFrame([({"b": 1},), ({"a": 2},)], "m map<string,int>")
    assert W.union_of_keys(m, "m") == ["a", "b"]
    W.append_log(ok, str(tmp_path / "log")), W.append_log(ok, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    W.json_rows(spark.createDataFrame([(["b", "a"],)], "x array<string>"), str(tmp_path / "j"), ("x",))
    assert spark.read.json(str(tmp_path / "j")).first().x == ["a", "b"]


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").options(url="x", total=95, page=10, pages_per_task=3, fetch="tests.test_sources:page").load()
    assert df.rdd.getNumPartitions() == 4  # of three pages each, the last of one
    assert sorted(r.n for r in df.select(F.get_json_object("json", "$.n").cast("int").alias("n")).collect()) == list(range(95))


def fails_first(url, offset, limit):
    """Pages 20 and 30 fail until the file at url is there."""
    from pathlib import Path

    if offset in (20, 30) and not Path(url).exists():
        raise OSError("down")
    return page(url, offset, limit)


def fifty(url):
    return 50


def test_a_scan_is_resumed(spark, tmp_path):
    asked = {"url": str(tmp_path / "up"), "page": "10", "pages_per_task": "2", "tries": "1", "fetch": "tests.test_sources:fails_first", "count": "tests.test_sources:fifty"}
    out = str(tmp_path / "out")
    first = resumed(spark, out, **asked)
    assert sorted(r.page for r in first.select("page").distinct().collect()) == [0, 10, 40]
    (tmp_path / "up").touch()
    for _ in range(2):  # the second time nothing is left
        assert sorted(r.offset for r in resumed(spark, out, **asked).collect()) == list(range(50))
    with pytest.raises(Exception, match="down"):
        resumed(spark, str(tmp_path / "strict"), **asked | {"url": "absent", "lenient": "false"})


def chain(url):
    n = int(url)
    return ([{"n": n}] if n % 3 else []), (str(n + 1) if n % 5 != 4 else None)


def test_pages_that_name_the_next(spark):
    spark.dataSource.register(CursorSource)
    df = spark.read.format("cursor").options(starts=json.dumps(["0", "5", "13"]), starts_per_task=2, follow="tests.test_sources:chain").load()
    assert df.rdd.getNumPartitions() == 2
    got = {(r.start, r.page, json.loads(r.json)["n"]) for r in df.collect()}
    assert got == {("0", 1, 1), ("0", 2, 2), ("0", 4, 4), ("5", 0, 5), ("5", 2, 7), ("5", 3, 8), ("13", 0, 13), ("13", 1, 14)}


def test_sdf(spark, tmp_path):
    v2 = "aspirin\n  tool\n\n  3  2  0  0  0  0  0  0  0  0999 V2000\n    0.0\nM  END\n> <ID>\nA1\n\n>  25  <NOTE> (x)\ntwo\nlines\n\n$$$$\n"
    v3 = "\n  tool\n\n  0  0  0     0  0            999 V3000\nM  V30 BEGIN CTAB\nM  V30 COUNTS 1200 1201 0 0 0\nM  END\n$$$$\n"
    (tmp_path / "a.sdf").write_text(v2 + v3 + "broken\n\n\nnothing here\nM  END\n$$$$\n" + "short\n$$$$\n")
    got = R.sdf(spark, str(tmp_path / "a.sdf")).withColumn("id", R.field("ID")).collect()
    assert [(r.name, r.atoms, r.bonds, r.id, r.parsable) for r in got] == [("aspirin", 3, 2, "A1", True), (None, 1200, 1201, None, True), ("broken", None, None, None, False), ("short", None, None, None, False)]
    assert [(f.name, f.value) for f in got[0].fields] == [("ID", "A1"), ("NOTE", "two\nlines")] and got[0].molecule.endswith("M  END")
    (tmp_path / "b.sdf").write_text((v2 + v2).replace("\n", "\r\n"), newline="")
    assert [(r.name, r.atoms, r.fields[1].value) for r in R.sdf(spark, str(tmp_path / "b.sdf"), "\r\n").collect()] == [("aspirin", 3, "two\r\nlines")] * 2


def test_workbooks(spark, tmp_path):
    """Shared strings, cells that are left out, and what our own writer makes."""
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="m"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="AB2"><v>2.5</v></c></row><row><c r="AB3"><v>3</v></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in R.workbook(spark, str(tmp_path / "a.xlsx")).collect()] == [("ab", "2.5"), (None, "3")]
    W.workbook(spark.createDataFrame([(1, "x < y & z", None), (2, " é ", 2.5)], "k int, `a b` string, v double"), str(tmp_path / "b.xlsx"))
    got = R.workbook(spark, str(tmp_path / "b.xlsx"))
    assert got.columns == ["k", "a b", "v"] and [tuple(r) for r in got.collect()] == [("1", "x < y & z", None), ("2", " é ", "2.5")]


def test_adapters_call_the_chemistry_library(monkeypatch):
    """With a stand-in for the library: what is called with what, and null for text that does not parse."""
    import sys
    import types

    import numpy as np

    class Bits:
        def __init__(self, n, shift):
            self.n, self.shift = n, shift

        def GetFingerprintAsNumPy(self, mol):
            return np.roll(np.arange(self.n) < len(mol), self.shift)

    def module(name, **has):
        m = types.ModuleType(name)
        m.__dict__.update(has)
        monkeypatch.setitem(sys.modules, name, m)
        return m

    class Catalog:
        FilterCatalogs = types.SimpleNamespace(PAINS="pains", BRENK="brenk")

        def __init__(self, params=None):
            self.named = params.named if params else None

        def AddCatalog(self, name):
            self.named = name

        def GetMatches(self, mol):
            return [types.SimpleNamespace(GetDescription=lambda k=k: f"{self.named}:{k}") for k in "ba" if k in mol]

    standardize = types.SimpleNamespace(Uncharger=lambda: types.SimpleNamespace(uncharge=str.lower), FragmentParent=lambda m: max(m.split("."), key=len))
    module("rdkit"), module("rdkit.Chem", MolFromSmiles=lambda s: None if s == "?" else s, MolToSmiles=lambda m: m)
    module("rdkit.Chem.MolStandardize"), module("rdkit.Chem.MolStandardize.rdMolStandardize", **vars(standardize))
    module("rdkit.Chem.rdFingerprintGenerator", GetMorganGenerator=lambda radius, fpSize: Bits(fpSize, radius), GetRDKitFPGenerator=lambda fpSize: Bits(fpSize, 0))
    module("rdkit.Chem.Scaffolds"), module("rdkit.Chem.Scaffolds.MurckoScaffold", MurckoScaffoldSmiles=lambda mol: mol[:1])
    module("rdkit.Chem.Descriptors", Size=len, Odd=lambda m: float("nan"))
    module("rdkit.Chem.FilterCatalog", FilterCatalogParams=Catalog, FilterCatalog=Catalog)
    module("rdkit.Chem.rdFMCS", FindMCS=lambda mols, timeout: types.SimpleNamespace(smartsString=f"{mols[0]}{timeout}" if mols[0][0] == mols[1][0] else ""))
    run = lambda kernel, *s: pd.concat(list(kernel(iter([pd.Series(s)])))).tolist()
    assert run(kernels.standardise_smiles(), "A.CCO", "?") == ["cco", None]
    assert run(kernels.path_words(128), "CCO", "?") == [[7, 0], None]
    assert run(kernels.morgan_words(128, 2), "CCO") == [[28, 0]]
    assert run(kernels.scaffold_smiles(), "CCO", "?", "") == ["C", None, ""]
    assert run(kernels.descriptors(["Size", "Odd"]), "CCO") == [[3.0, None]]
    assert run(kernels.alerts("BRENK"), "ab", "c", "?") == [["brenk:a", "brenk:b"], [], None]
    assert run(kernels.common_substructure("Cx", 2), "CCO", "O") == ["Cx2", None]


def test_stream_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    row = {"compound": "c", "target": "t", "document": "d1", "relation": "=", "pchembl": 6.0, "year": 2001, "inactive": False}
    for k, more in enumerate([{}, {"pchembl": 7.0, "relation": "<", "document": "d2"}, {"pchembl": 9.0, "inactive": True, "year": 1999}]):
        (inbox / f"{k}.json").write_text(json.dumps(row | more))
        ingest.ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    r = ingest.best_of(spark, str(tmp_path / "out")).first()
    assert (r.pchembl, r.relation, r.inactive, r.n_documents, r.year) == (7.0, "<", True, 2, 1999)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_kernels(spark):
    calls = spark.createDataFrame([("a",), ("a",), ("bb",), (None,)], "s string")
    kernels.register("length", lambda it: (pd.Series(b.str.len()) for b in it), "long")
    assert sorted((r.s or "", r.n) for r in kernels.apply(calls, "length", "s", "n").collect()) == [("", None), ("a", 1), ("a", 1), ("bb", 2)]
    with pytest.raises(kernels.KernelMissing):
        kernels.apply(calls, "nothing", "s", "n")
    with pytest.raises(kernels.KernelMissing):
        kernels.optional("no_such_module_here")
