"""Scans of the file kinds that evidence comes in. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    """One object a line; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_list(spark: SparkSession, path, schema: str, field: str) -> DataFrame:
    """A document {field: [...]}: a row for each element."""
    return spark.read.schema(f"`{field}` array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode(field).alias("_x")).select("_x.*")


def lookup(spark: SparkSession, path) -> DataFrame:
    """A JSON object of names and values as (key, value)."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def delimited(spark: SparkSession, path, schema: str, keep: list[str] | None = None) -> DataFrame:
    """CSV, compressed or not, with a header; only the kept columns are parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return no_nan(df.select(*keep) if keep else df)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes])


def named_files(spark: SparkSession, path, schema: str, pattern: str, name: str) -> DataFrame:
    """Many CSV files; a column from each one's name, which Spark gives with signs like blanks as %20."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    file = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.withColumn(name, F.regexp_extract(file, pattern, 1))


def first_by_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    from affinia.operators.similarity import top

    return top(df, [key], order, 1, "_r").drop("_r")


def picked_column(spark: SparkSession, path, names: tuple[str, ...] = ("SMILES", "smiles")) -> DataFrame:
    """The first of the named columns of an uploaded CSV, else its first column; blanks are dropped."""
    df = spark.read.option("header", True).csv(path)
    c = next((n for n in names if n in df.columns), df.columns[0])
    return df.select(F.trim(F.col(f"`{c}`")).alias("value")).where("value <> ''")


def pasted(df: DataFrame, column: str = "value") -> DataFrame:
    """First field of each pasted line, blanks and a header dropped."""
    v = F.trim(F.split(column, r"[,;\t]")[0])
    return df.select(v.alias("value")).where("value <> '' AND lower(value) <> 'smiles'")


def pdb_atoms(lines: DataFrame, column: str = "value") -> DataFrame:
    """Atoms from the fixed-width lines of the PDB format."""
    cut = lambda a, n: F.trim(F.substring(column, a, n))
    t = lines.where(F.col(column).rlike("^(ATOM|HETATM)"))
    return t.select(
        cut(1, 6).alias("record"), cut(13, 4).alias("atom"), cut(18, 3).alias("resname"), cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("resid"),
        cut(31, 8).try_cast("double").alias("x"), cut(39, 8).try_cast("double").alias("y"), cut(47, 8).try_cast("double").alias("z"),
        F.coalesce(F.nullif(F.upper(cut(77, 2)), F.lit("")), F.regexp_extract(cut(13, 4), "([A-Za-z])", 1)).alias("element"),
    )


def sdf(spark: SparkSession, path, newline: str = "\n") -> DataFrame:
    """Records of structure-data files, a row each: name, atoms and bonds by the counts line (V2000 or V3000), the data
    fields as (name, value), and the molecule's own lines. ``parsable`` is false where counts or the end mark are missing."""
    t = spark.read.option("lineSep", "$$$$" + newline).text(path).where(F.trim("value") != "")
    lines = F.transform(F.split("value", r"\r?\n"), F.rtrim)
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    wide = F.regexp_extract("value", r"M  V30 COUNTS (\d+) (\d+)", 0) != ""
    count = lambda k: F.when(wide, F.regexp_extract("value", r"M  V30 COUNTS (\d+) (\d+)", k)).otherwise(F.trim(F.substring(line(3), 3 * k - 2, 3))).try_cast("int")
    head = r"(?m)^>[^\n<]*<([^>\n]+)>[^\n]*\n"
    names, values = F.regexp_extract_all("value", F.lit(head), F.lit(1)), F.regexp_extract_all("value", F.lit(r"(?ms)^>[^\n<]*<[^>\n]+>[^\n]*\n(.*?)(?=^[ \r]*$|\z)"), F.lit(1))
    fields = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), F.regexp_replace(v, r"\s+$", "").alias("value")))
    t = t.select(F.nullif(line(0), F.lit("")).alias("name"), count(1).alias("atoms"), count(2).alias("bonds"), fields.alias("fields"), F.regexp_extract("value", r"(?s)^(.*?M  END)", 1).alias("molecule"))
    return t.withColumn("parsable", F.col("atoms").isNotNull() & F.col("bonds").isNotNull() & (F.col("molecule") != ""))


def field(name: str, fields: str = "fields") -> Column:
    """First data field of that name of an SDF record."""
    return F.get(F.filter(fields, lambda x: x["name"] == name), F.lit(0))["value"]


def captures(spark: SparkSession, path) -> DataFrame:
    """Stored neighbours, one row each: nested lists of [key, similarity, [[target, potency]]]."""
    raw = spark.read.schema("smiles string, neighbours array<array<string>>").json(path)
    t = raw.select("smiles", F.posexplode("neighbours").alias("pos", "n"))
    t = t.select(F.col("smiles").alias("query"), (F.col("pos") + 1).alias("rank"), F.get("n", F.lit(0)).alias("compound"), F.get("n", F.lit(1)).cast("double").alias("t"), F.from_json(F.get("n", F.lit(2)), "array<array<string>>").alias("targets"))
    return t.select("query", "rank", "compound", "t", F.explode_outer("targets").alias("x")).select("query", "rank", "compound", "t", F.get("x", F.lit(0)).alias("target"), F.get("x", F.lit(1)).try_cast("double").alias("potency"))


def articles(spark: SparkSession, path, ids: DataFrame) -> DataFrame:
    """Articles of an XML answer in the order of a search's ids (position, id)."""
    a = spark.read.format("xml").option("rowTag", "PubmedArticle").schema("MedlineCitation struct<PMID string, Article struct<ArticleTitle string, Abstract struct<AbstractText array<string>>>>").load(path)
    a = a.select(F.col("MedlineCitation.PMID").alias("id"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), F.array_join("MedlineCitation.Article.Abstract.AbstractText", " ").alias("abstract"))
    return ids.join(a, "id").orderBy("position")


def listing(spark: SparkSession, path, recursive: bool = True) -> DataFrame:
    """Names, sizes and category (first folder) of files; contents stay unread."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return df.select("path", "length", F.element_at(F.split("path", "/"), -2).alias("category"))


def complete_sets(files: DataFrame, by: str, needed: list[str]) -> DataFrame:
    """Folders that hold every needed file."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(by).agg(F.array_size(F.array_intersect(F.collect_set(F.when(name.isin(needed), name)), F.array(*[F.lit(n) for n in needed]))).alias("n")).where(F.col("n") == len(set(needed))).select(by)


def workbook(spark: SparkSession, path: str, sheet: int = 0) -> DataFrame:
    """A small XLSX sheet as text columns named by its first row; empty cells are null. It is unpacked on the driver."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    book = zipfile.ZipFile(io.BytesIO(spark.read.format("binaryFile").load(path).first().content))
    plain = lambda tag: tag.rpartition("}")[2]
    text = lambda node: "".join(t.text or "" for t in node.iter() if plain(t.tag) == "t")
    shared = [text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in book.namelist() else []
    sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    rows = []
    for row in ElementTree.fromstring(book.read(sheets[sheet])).iter():
        if plain(row.tag) != "row":
            continue
        cells: dict[int, str | None] = {}
        for c in row:
            place = 0
            for letter in re.match("[A-Z]*", c.get("r", "")).group() or "@":
                place = place * 26 + ord(letter) - 64
            value = next((v.text for v in c if plain(v.tag) == "v"), None)
            value = shared[int(value)] if c.get("t") == "s" and value is not None else text(c) if c.get("t") == "inlineStr" else value
            cells[place or len(cells) + 1] = value or None
        rows.append(cells)
    names = rows[0] if rows else {}
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows[1:]], ", ".join(f"`{n}` string" for n in names.values()))


def optional_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not be there: then it is empty, with the given schema."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def index(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """An index written by writers.index; a range of popcounts skips the row groups beyond it."""
    df = spark.read.parquet(path)
    if low is not None:
        df = df.where(F.col("pop") >= low)
    return df if high is None else df.where(F.col("pop") <= high)
