"""PSF grids from folders of stamps: a table of nodes, a file for each, read, resampled and kept once."""

from __future__ import annotations

import gzip

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sky
from ..functions.cut import cut
from ..operators import psf
from ..operators.render import normalized, resized
from . import fits

#: The name of a node's file, where the table gives none, and the width of a detector's pixel (arcsec) over a header's SAMP_NEW.
NAME, DETECTOR_ARCSEC = "mosaic_gp%06d.fits", {1: 1.221, 2: 1.213, 3: 1.222, 4: 1.220}
#: Relative difference of scales that counts as none: a fixed value.
SAME_SCALE = 1e-3


def nodes(table: DataFrame, wcs: dict) -> DataFrame:
    """(node, x, y, file) of a grid's table, in any case of letters: ID_GRIDPT, its place as RA and DEC (or DEC_CEN) or as X and Y counted from 1, and FILENAME if it has one (its last part counts). Nodes without a finite place are left out."""
    have = {c.upper(): c for c in table.columns}
    of = lambda *names: next((F.col(f"`{have[n]}`") for n in names if n in have), None)
    if of("ID_GRIDPT") is None:
        raise ValueError("a grid needs a column ID_GRIDPT")
    ra, dec = of("RA"), of("DEC", "DEC_CEN")
    if ra is not None and dec is not None:
        at = sky.sky_to_pixel(ra.cast("double"), dec.cast("double"), sky.wcs(**wcs))
        x, y = at["x"], at["y"]
    elif of("X") is not None and of("Y") is not None:
        x, y = of("X").cast("double") - 1, of("Y").cast("double") - 1
    else:
        raise ValueError("a grid needs RA and DEC or X and Y")
    named = of("FILENAME")
    node = of("ID_GRIDPT").cast("long")
    usual = F.format_string(NAME, node)
    file = usual if named is None else F.coalesce(F.nullif(F.element_at(F.split(F.trim(named.cast("string")), "/"), -1), F.lit("")), usual)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return table.select(node.alias("node"), x.alias("x"), y.alias("y"), file.alias("file")).where(finite(F.col("x")) & finite(F.col("y")))


def plain_name(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.gz$", "")


def stamp_of(content: bytes, input_scale: float | None, output_scale: float, size: int, channel: int | None) -> tuple[np.ndarray, int]:
    """A file's first image as a stamp of the output's pixels with unit sum, and its NFRAMES."""
    f = pa.BufferReader(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    head, at = next((h, at) for h, at in fits.headers(f) if fits.is_plane(h))
    kind = np.dtype(fits._TYPES[head["BITPIX"]])
    f.seek(at)
    data = fits.scaled(head, np.frombuffer(f.read(kind.itemsize * head["NAXIS1"] * head["NAXIS2"]), kind).reshape(head["NAXIS2"], head["NAXIS1"]))
    if input_scale is None and head.get("SAMP_NEW") and channel:
        input_scale = DETECTOR_ARCSEC[channel] / float(head["SAMP_NEW"])
    if input_scale is None or abs(input_scale / output_scale - 1) <= SAME_SCALE:
        return normalized(resized(np.nan_to_num(data), size)), int(head.get("NFRAMES", 0))
    return normalized(psf.resampled(np.nan_to_num(data), output_scale / input_scale, size)), int(head.get("NFRAMES", 0))


def stamps(grid: DataFrame, folder: str, output_scale: float, size: int = 51, input_scale: float | None = None, channel: int | None = None) -> DataFrame:
    """(id, x, y, stamp, width, n_frames) of the grid's nodes (see nodes), each file read and resampled once: the samples that psf.with_stamps looks up by place. A node without its file (plain or .gz) is an error."""
    size += 1 - size % 2
    files = grid.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.fits*").option("recursiveFileLookup", "true").load(folder).select(plain_name(F.col("path")).alias("file"), "content")
    wanted = grid.withColumn("file", plain_name(F.col("file")))
    lost = wanted.join(files.select("file"), "file", "left_anti").select("file").head(3)
    if lost:
        raise FileNotFoundError(f"{folder}: {', '.join(r.file for r in lost)}")

    def run(frames):
        for f in frames:
            made = [stamp_of(c, input_scale, output_scale, size, channel) for c in f.content]
            yield pd.DataFrame({"file": f.file, "stamp": [s.ravel().tolist() for s, _ in made], "n_frames": [n for _, n in made]})

    needed = files.join(wanted.select("file").distinct(), "file", "left_semi").dropDuplicates(["file"])
    own = cut(needed.mapInPandas(run, "file string, stamp array<double>, n_frames long"))
    return wanted.join(own, "file").select(F.col("node").alias("id"), "x", "y", "stamp", F.lit(size).alias("width"), "n_frames")


def samples(settings: dict, wcs: dict, output_scale: float, size: int = 51, table: DataFrame | None = None, folder: str | None = None, positions: DataFrame | None = None, exposures: DataFrame | None = None, prfs: dict | None = None, **more) -> DataFrame:
    """(id, x, y, stamp, width, n_frames) by psf.grid_settings(): from files (table, folder), or from detector PRFs stacked at positions (node, ra, dec)."""
    if settings["source"] == "files":
        return stamps(nodes(table, wcs), folder, output_scale, size, **more)
    size += 1 - size % 2
    made = psf.stacked_grid(positions, exposures, prfs, output_scale, size, **more)
    at = sky.sky_to_pixel(F.col("ra"), F.col("dec"), sky.wcs(**wcs))
    placed = positions.select("node", at["x"].alias("x"), at["y"].alias("y"))
    return made.join(placed, "node").select(F.col("node").alias("id"), "x", "y", "stamp", F.lit(size).alias("width"), F.col("n_exposures").alias("n_frames"))
