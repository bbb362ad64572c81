"""Writers: tables for the next job, and small reports."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import there


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows under the ordered union of the columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(tables: list[DataFrame], path: str, spark: SparkSession | None = None) -> None:
    """All tables under the union of their columns; without any table an empty file (which needs the session)."""
    if not tables:
        spark = spark or SparkSession.getActiveSession()
        spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    union_tables(tables).write.mode("overwrite").option("header", True).csv(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at path has not yet; how many there were. A second call with the same rows adds none."""
    spark = df.sparkSession
    done = spark.read.parquet(path).select(key) if there(spark, path) else None  # a first run finds no table
    fresh = df.dropDuplicates([key]) if done is None else df.dropDuplicates([key]).join(done, key, "left_anti")
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _commit(spark: SparkSession, path: str, batch: str) -> None:
    """Mark a batch as whole: one empty file, which appears by a rename."""
    system, mark = _file_system(spark, f"{path}/_commits/{batch}")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/.draft-{batch}")
    system.create(draft, True).close()
    if not system.rename(draft, mark) and not system.exists(mark):
        raise OSError(f"{mark} cannot be written")


def committed(spark: SparkSession, path: str) -> list[str]:
    """The batches whose rows count."""
    system, folder = _file_system(spark, f"{path}/_commits")
    return sorted(x.getPath().getName() for x in system.listStatus(folder) if not x.getPath().getName().startswith(".")) if system.exists(folder) else []


def read_committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all whole batches; what a crash left behind is not among them.  None before the first."""
    batches = committed(spark, path)
    return spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in batches)).drop("batch") if batches else None


def append_batch(df: DataFrame, path: str, key: str, batch: str) -> int:
    """Append the rows whose key no whole batch has, as one batch, all or nothing; how many there were.

    The rows go to a folder of the batch's name, and count once a mark of that name is there.  A batch that comes again after its mark adds
    nothing; one that crashed before its mark writes its folder anew.  One writer at a time, as a stream is.
    """
    spark = df.sparkSession
    if batch in committed(spark, path):
        return 0
    done = read_committed(spark, path)
    fresh = df.dropDuplicates([key]) if done is None else df.dropDuplicates([key]).join(done.select(key), key, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    n = spark.read.schema(df.schema).parquet(f"{path}/batch={batch}").count()
    _commit(spark, path, batch)
    return n


def json_safe(df: DataFrame) -> DataFrame:
    """Doubles that JSON has no number for (NaN, infinities) are null, with their names in <column>_note."""
    out = df
    for c, t in df.dtypes:
        if t in ("double", "float"):
            odd = F.isnan(c) | (F.abs(F.col(c)) == F.lit(math.inf))
            out = out.withColumn(f"{c}_note", F.when(odd, F.col(c).cast("string"))).withColumn(c, F.when(odd, F.lit(None).cast(t)).otherwise(F.col(c)))
    return out


def nested_report(rates: DataFrame, outer: list[str], group: str, values: list[str]) -> DataFrame:
    """One JSON object per outer key: {group: {values}}."""
    return rates.groupBy(*outer).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(group), F.struct(*values)))))).alias("report"))


def _cells(df: DataFrame, most: int) -> tuple[list[str], list[tuple]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    return df.columns, [tuple(r) for r in rows]


def _text(value, digits: int) -> str:
    if value is None:
        return "--"
    return f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def markdown(df: DataFrame, digits: int = 2, most: int = 1000) -> str:
    """A Markdown table of a small result."""
    names, rows = _cells(df, most)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(_text(v, digits) for v in r) + " |" for r in rows)]) + "\n"


def latex(df: DataFrame, digits: int = 1, most: int = 1000) -> str:
    """A LaTeX table of a small (pivoted) result, -- where there is no value."""
    names, rows = _cells(df, most)
    safe = lambda x: str(x).replace("\\", r"\textbackslash{}").replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    body = [" & ".join(safe(_text(v, digits)) for v in r) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{l" + "r" * (len(names) - 1) + "}", r"\toprule", " & ".join(map(safe, names)) + r" \\", r"\midrule", *body, r"\bottomrule", r"\end{tabular}"]) + "\n"


def report(title: str, sections: dict[str, DataFrame | None], digits: int = 2) -> str:
    """A Markdown report of small tables; a section whose table is missing says so."""
    parts = [f"# {title}\n"]
    for name, df in sections.items():
        parts.append(f"## {name}\n\n" + (markdown(df, digits) if df is not None else "Not available.\n"))
    return "\n".join(parts)
