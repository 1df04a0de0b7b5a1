"""Document files: scan, decode, DOCX, sidecars, link lists, JSON manifests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrove.functions.text import non_blank

# Fixed value: XML name space of word-processing text.
ColumnOrName = Column | str
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan_documents(spark: SparkSession, root: str, max_files: int = 0, pattern: str = "*.{txt,pdf,TXT,PDF}") -> DataFrame:
    """Files below ``root``: path, modificationTime, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.orderBy("path").limit(max_files) if max_files > 0 else files


def decode_text(content: ColumnOrName) -> Column:
    """UTF-8 with replacement of broken bytes."""
    column = F.col(content) if isinstance(content, str) else content
    return F.make_valid_utf8(column.cast("string"))


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """Non-empty paragraphs of DOCX files: path, para_idx, text; a broken file gives an error row."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    if len(content):
                        with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                            body = ElementTree.fromstring(z.read("word/document.xml"))
                        lines = ("".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in body.iter(f"{WORD}p"))
                        rows += [(path, i, line, None) for i, line in enumerate(lines) if line]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as exc:
                    rows.append((path, None, None, str(exc)))
            out = pd.DataFrame(rows, columns=["path", "para_idx", "text", "error"])
            yield out.astype({"para_idx": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path string, para_idx int, text string, error string")


def docx_text(files: DataFrame) -> DataFrame:
    """One text per DOCX file; ``error`` says why a file could not be read."""
    paras = docx_paragraphs(files).groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("para_idx", "text")))).alias("p"), F.max("error").alias("error")
    )
    return files.select("path").join(paras, "path", "left").select(
        "path", F.coalesce(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit("")).alias("text"), "error"
    )


def read_texts(files: DataFrame) -> DataFrame:
    """Text per file by extension; PDF needs a parser that is not available and is marked."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    f = files.withColumn("ext", ext)
    plain = f.where(~F.col("ext").isin("docx", "pdf")).select("path", decode_text("content").alias("text"), F.lit(None).cast("string").alias("error"))
    docx = docx_text(f.where(F.col("ext") == "docx"))
    pdf = f.where(F.col("ext") == "pdf").select("path", F.lit(None).cast("string").alias("text"), F.lit("unsupported").alias("error"))
    return plain.unionByName(docx).unionByName(pdf)


def with_sidecar(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Add ``source_url`` from the JSON file that shares the stem of a document."""
    url = F.get_json_object(F.try_validate_utf8(F.col("content").cast("string")), "$.source_url")
    s = sidecars.select(F.regexp_replace("path", r"\.json$", "").alias("_stem"), non_blank(url).alias("source_url"))
    f = files.withColumn("_stem", F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", ""))
    return f.join(s, "_stem", "left").drop("_stem")


def read_link_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of URLs in file order: pos, url."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "url")).where(F.col("url").isNotNull())


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str, indented: bool = False) -> DataFrame:
    """Rows of a manifest: one object per line, or with ``indented`` one JSON array per file over many lines."""
    return spark.read.schema(schema).json(path, multiLine=indented)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalog documents as text, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"))
