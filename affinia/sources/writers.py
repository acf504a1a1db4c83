"""Sinks: each writes a folder that Spark commits as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(pairs: DataFrame, fingerprints: DataFrame, key: str, path: str) -> None:
    """Pairs with their fingerprints, near popcounts together, so that a popcount range skips row groups."""
    t = pairs.join(fingerprints, key).repartitionByRange("pop").sortWithinPartitions("pop")
    t.write.mode("overwrite").parquet(path)
    t.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_compounds"), F.countDistinct("target").alias("n_targets")).coalesce(1).write.mode("overwrite").json(path + "_manifest")


#: Columns of an orthologue index.
ORTHOLOGUES = "compound long, target long, species string, pchembl double, n_documents long"


def orthologue_index(activities: DataFrame, path: str) -> None:
    """One row a compound, target and species: its best potency and number of documents. Rows of a target lie together."""
    t = activities.groupBy("compound", "target", F.col("assay_type").alias("species")).agg(F.max("pchembl").alias("pchembl"), F.count_distinct("document").alias("n_documents"))
    t.repartitionByRange("target", "compound").sortWithinPartitions("target", "compound", "species").write.parquet(path)


def json_rows(df: DataFrame, path: str, sorted_arrays: tuple[str, ...] = ()) -> None:
    df.withColumns({c: F.array_sort(c) for c in sorted_arrays}).write.mode("overwrite").json(path)


def flat(df: DataFrame) -> DataFrame:
    """Fields of structs as columns, arrays as '; '-joined text."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
        elif f.dataType.typeName() == "array":
            out.append(F.array_join(F.col(f"`{f.name}`").cast("array<string>"), "; ").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def named_csv(df: DataFrame, folder: str, name: str) -> None:
    """A small table as one CSV file of that name in a folder; it appears whole or not at all."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    made = f"{folder}/_{name}"
    csv(df.coalesce(1), made)
    fs = path(folder).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    fs.rename(fs.globStatus(path(f"{made}/part-*"))[0].getPath(), path(f"{folder}/{name}"))
    fs.delete(path(made), True)


def workbook(df: DataFrame, path: str) -> None:
    """A small table as an XLSX file of one sheet; it is packed on the driver."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    cell = lambda v: "<c/>" if v is None else f"<c><v>{v!r}</v></c>" if isinstance(v, int | float) and not isinstance(v, bool) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    rows = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [df.columns, *map(tuple, df.collect())])
    main, kind = "http://schemas.openxmlformats.org", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{main}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r1" Type="{main}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}/spreadsheetml/2006/main" xmlns:r="{main}/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{main}/package/2006/relationships"><Relationship Id="r1" Type="{main}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>',
    }
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(held.getvalue())
    out.close()


def failures(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows that did not end well; where there are none, one row that says so."""
    bad = df.where(~F.coalesce(F.col(status) == "ok", F.lit(False)))
    none = bad.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("no failures").alias(status))
    return bad.unionByName(none, allowMissingColumns=True)


def union_of_keys(rows: DataFrame, column: str) -> list[str]:
    """All keys of a map column, sorted: the header of an export."""
    return [r.k for r in rows.select(F.explode(F.map_keys(column)).alias("k")).distinct().orderBy("k").collect()]


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def checksums(files: DataFrame) -> DataFrame:
    """SHA-256 and size of binary files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))
