"""Case sheets and record lists: CSV scans with tidy headers, padded projections, sinks with a fixed field list."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Opening brackets and the ones that close them (fixed values).
BRACKETS = {"（": "）", "(": ")"}


def tidy(header: str) -> str:
    """A header without its comment: cut at the first line break and at the first bracket that is closed again."""
    line = header.lstrip("\ufeff").split("\n", 1)[0].split("\r", 1)[0]
    for opening, closing in BRACKETS.items():
        at = line.find(opening)
        if at >= 0 and closing in line[at:]:
            line = line[:at]
    return line.strip()


def tidy_columns(df: DataFrame, headers: list[str | None] | None = None) -> DataFrame:
    """Tidy headers, by default those of df; empty and ``Unnamed`` ones go, repeated ones are numbered _2, _3 and so on."""
    seen: Counter[str] = Counter()
    keep: list[Column] = []
    plain = df.toDF(*(f"_c{i}" for i in range(len(df.columns))))
    for i, name in enumerate(tidy(h or "") for h in headers or df.columns):
        if name and not name.startswith("Unnamed"):
            seen[name] += 1
            keep.append(F.col(f"_c{i}").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return plain.select(*keep)


def read_sheet(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the paths that Spark can read, as text columns; empty cells are null."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            reader = spark.read.option("multiLine", True).option("escape", '"')
            # The headers as they stand: Spark renames repeated ones.
            headers = reader.csv(path).first()
            return tidy_columns(reader.option("header", True).csv(path), list(headers or []))
    raise FileNotFoundError(", ".join(paths))


def project(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Output fields name: (source column, type), in order; a source that is missing gives nulls."""
    there = set(df.columns)
    return df.select(*((F.col(f"`{source}`").try_cast(kind) if source in there else F.lit(None).cast(kind)).alias(name) for name, (source, kind) in fields.items()))


def age(birth: Column, exam: Column, least_year: int = 1980, most: float = 30.0) -> Column:
    """Years between two dates; null before ``least_year``, for negative ages and for those over ``most``."""
    years = F.datediff(exam, birth) / 365.25
    return F.when((F.year(birth) >= least_year) & (years >= 0) & (years <= most), years)


def age_columns(recorded: Column, calculated: Column) -> dict[str, Column]:
    """The recorded age before the calculated one, where it came from, and whether the two differ by more than a year."""
    source = F.when(recorded.isNotNull(), "recorded").when(calculated.isNotNull(), "calculated").otherwise("missing")
    return {"age": F.coalesce(recorded, calculated), "age_source": source, "age_check_flag": F.coalesce((F.abs(recorded - calculated) > 1).cast("int"), F.lit(0))}
