"""Dependency resolution: which libraries the formats of a directory need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORE = [("numpy", "numpy"), ("pyarrow", "pyarrow")]
#: extension -> (import name, pip name, required); OCR is needed for image PDFs only.
FORMATS: dict[str, list[tuple[str, str, bool]]] = {
    **{e: [("docx", "python-docx", True)] for e in ("docx", "doc")},
    **{e: [("openpyxl", "openpyxl", True)] for e in ("xlsx", "xls")},
    **{e: [("pptx", "python-pptx", True)] for e in ("pptx", "ppt")},
    "pdf": [("fitz", "PyMuPDF", True), ("rapidocr_onnxruntime", "rapidocr-onnxruntime", False)],
    "epub": [("ebooklib", "EbookLib", True), ("bs4", "beautifulsoup4", True)],
    **{e: [] for e in ("mobi", "azw", "azw3", "txt", "md", "markdown", "rst", "csv", "tsv")},
    **{e: [("bs4", "beautifulsoup4", False)] for e in ("html", "htm")},
}


def extension(path: Column) -> Column:
    """Lower-case suffix; null for hidden files and those without one."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    e = F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1))
    return F.when(~base.startswith(".") & (e != ""), e)


def formats_table(spark: SparkSession) -> DataFrame:
    """X01."""
    rows = [(e, m, p, r) for e, deps in sorted(FORMATS.items()) for m, p, r in deps]
    return spark.createDataFrame(rows, "ext string, import_name string, pip_spec string, required boolean")


def required(files: DataFrame, path: str = "path", image_pdf: bool = False) -> DataFrame:
    """One row per package: the core ones and those of the extensions found; OCR is required with image PDFs."""
    spark = files.sparkSession
    core = spark.createDataFrame([(m, p, True) for m, p in CORE], "import_name string, pip_spec string, required boolean")
    found = files.select(extension(F.col(path)).alias("ext")).where("ext is not null").distinct()
    rows = formats_table(spark).join(found, "ext", "left_semi").select("import_name", "pip_spec", (F.col("required") | (F.lit(image_pdf) & F.col("pip_spec").startswith("rapidocr"))).alias("required"))
    return core.unionByName(rows).groupBy("pip_spec").agg(F.min("import_name").alias("import_name"), F.max("required").alias("required"))


def summary(report: DataFrame, installed: set[str]) -> str:
    """A report of few rows as text."""
    rows = report.orderBy("pip_spec").collect()
    lines = [f"{'required' if r['required'] else 'optional'}: {r['pip_spec']}" for r in rows if r["import_name"] not in installed]
    return "All dependencies are installed." if not lines else "Missing\n" + "\n".join(lines)
