"""Catalog sinks: the format follows from the name; metadata goes beside the table."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fits_tables

FORMATS = {"parquet": "parquet", "pq": "parquet", "csv": "csv", "json": "json", "orc": "orc"}


#: Names that ECSV has for Spark's types.
ECSV = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "boolean": "bool", "string": "string"}


def write_ecsv(cat: DataFrame, path: str, metadata: dict | None = None, mode: str = "errorifexists") -> None:
    """A folder of text whose parts, one after the other, are one ECSV table: the first holds the header with names, types and metadata. Null is an empty field, an empty string a quoted one."""
    kinds = {f.name: f.dataType.simpleString() for f in cat.schema.fields}
    if odd := [c for c, k in kinds.items() if k not in ECSV]:
        raise ValueError(f"no ECSV type for {', '.join(odd)}")
    head = ["%ECSV 1.0", "---", "delimiter: ','", "datatype:", *(f"- {{name: {json.dumps(c)}, datatype: {ECSV[k]}}}" for c, k in kinds.items())]
    head += [f"meta: {json.dumps(metadata, sort_keys=True, default=str)}"] if metadata else []
    names = ",".join(c if c.isidentifier() else '"' + c.replace('"', '""') + '"' for c in kinds)
    lines = ["# " + line for line in [*head, "schema: astropy-2.0"]] + [names]
    of = lambda c: F.when(F.col(c), "True").when(~F.col(c), "False") if kinds[c.strip("`")] == "boolean" else F.col(c)
    rows = cat.select(F.to_csv(F.struct(*[of(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kinds)]), {"escape": '"'}).alias("value"))
    cat.sparkSession.createDataFrame([(line,) for line in lines], "value string").coalesce(1).union(rows).write.mode(mode).text(path)


def write_catalog(cat: DataFrame, path: str, metadata: dict | None = None, mode: str = "errorifexists") -> None:
    """Write by extension (parquet without one) through Spark's committers, and metadata as path + ".meta". A FITS table is one file, in the order of id if there is one."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "parquet"
    if ext == "fits":
        if mode not in ("errorifexists", "error", "overwrite"):
            raise ValueError(f"a FITS table is not written by mode {mode}")
        fits_tables.write_table(cat, path, ["id"] if "id" in cat.columns else None, mode="overwrite" if mode == "overwrite" else "append")
    elif ext == "ecsv":
        write_ecsv(cat, path, metadata, mode)
    elif ext in FORMATS:
        w = cat.write.mode(mode).format(FORMATS[ext])
        (w.option("header", True) if ext == "csv" else w).save(path)
    else:
        raise ValueError(f"no writer for .{ext}")
    if metadata is not None:
        spark = cat.sparkSession
        metadata = {"written_utc": datetime.now(timezone.utc).isoformat(timespec="seconds")} | metadata
        spark.createDataFrame([(json.dumps(metadata, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".meta")


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path + ".meta").head()[0])


def cached(spark: SparkSession, folder: str, sql: str, make) -> DataFrame:
    """make()'s rows kept under the SHA-256 of the query's text, with its provenance; another query under the same key is an error."""
    import hashlib

    text = " ".join(sql.split())
    at = f"{folder}/{hashlib.sha256(text.encode()).hexdigest()}"
    if exists(spark, at + ".meta"):  # written last
        if read_metadata(spark, at)["query"] != text:
            raise ValueError("the cached table answers another query")
    else:
        write_catalog(make(), at, {"query": text}, "overwrite")
    return spark.read.parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def cached_cutout(spark: SparkSession, folder: str, band: str, ra: float, dec: float, size_arcsec: float, make) -> DataFrame:
    """make()'s pixel rows of one cutout or mask, kept under its band, position and size; Spark's committer renames what is complete. Flags are written as 32-bit integers."""

    def whole() -> DataFrame:
        px = make()
        return px.withColumn("flag", F.col("flag").cast("int")) if "flag" in px.columns else px

    return cached(spark, f"{folder}/{band.upper()}", f"cutout {band.upper()} {ra:.6f} {dec:.6f} {size_arcsec:.3f}", whole)


def cached_psf(spark: SparkSession, folder: str, band: str, tile: str, ra: float, dec: float, radius_arcsec: float, make) -> DataFrame:
    """make()'s PSF samples (id, ra, dec, stamp, size), kept under band, tile, position and radius."""
    return cached(spark, f"{folder}/{band.upper()}", f"psf {band.upper()} {tile} {ra:.6f} {dec:.6f} {radius_arcsec:.3f}", make)


def save_fit(catalog: DataFrame, planes: DataFrame, folder: str, metadata: dict | None = None) -> None:
    """A ground fit: its catalog and its planes (x, y and one column for each)."""
    write_catalog(catalog, f"{folder}/catalog.parquet", metadata, "overwrite")
    planes.write.mode("overwrite").partitionBy(*[c for c in ("tile",) if c in planes.columns]).parquet(f"{folder}/planes.parquet")


def provenance(cat: DataFrame) -> dict:
    """Row count and missing fluxes per band, for the metadata."""
    bands = [c for c in cat.columns if c.startswith("flux_") and c.endswith("_ujy") and "err" not in c]
    row = cat.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in bands]).head()
    return row.asDict()
