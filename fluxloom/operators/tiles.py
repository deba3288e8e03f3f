"""Image planes as pixel tables, and product discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import bad_bits, bit_mask
from ..functions import sky, units


def pixels(tiles: DataFrame) -> DataFrame:
    """Long rows (tile, band, x, y, d, rms, flag) from tiles with row-major planes data, rms, flag and their width."""
    planes = F.arrays_zip("data", "rms", "flag")
    return tiles.select("tile", "band", "width", F.posexplode(planes).alias("k", "p")).select("tile", "band", (F.col("k") % F.col("width")).alias("x"), F.floor(F.col("k") / F.col("width")).cast("int").alias("y"), F.col("p.data").alias("d"), F.col("p.rms").alias("rms"), F.col("p.flag").alias("flag"))


def weighted(px: DataFrame, extra_mask: DataFrame | None = None) -> DataFrame:
    """px with w: 1 / rms^2, and 0 for bad data, bad bits of the band, and pixels (tile, x, y) of extra_mask."""
    w = units.invvar_from_rms(F.col("rms"), F.col("d"))
    vis, other = bit_mask(bad_bits("VIS")), bit_mask(bad_bits("H"))
    bad = F.when(F.upper("band") == "VIS", F.lit(vis)).otherwise(F.lit(other))
    out = px.withColumn("w", F.when(F.coalesce(F.col("flag").bitwiseAND(bad), F.lit(0)) != 0, 0.0).otherwise(w))
    if extra_mask is not None:
        hit = extra_mask.select("tile", "x", "y").distinct().withColumn("_hit", F.lit(True))
        out = out.join(hit, ["tile", "x", "y"], "left").withColumn("w", F.when(F.col("_hit"), 0.0).otherwise(F.col("w"))).drop("_hit")
    return out


def cutout(px: DataFrame, x0: int, y0: int, width: int, height: int, fill: bool = False) -> DataFrame:
    """The rectangle's pixels, moved to its corner. With fill, pixels off the tile are there with zero data and weight."""
    inside = px.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    if not fill:
        return inside
    grid = px.select("tile").distinct().select("tile", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    out = grid.join(inside, ["tile", "x", "y"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("d", "w") if c in out.columns})


def resampled_mask(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """grid (x, y, mx, my: its position in the mask's pixels) with the flag of the nearest mask pixel, 0 off the mask."""
    g = grid.withColumns({"_x": F.rint("mx").cast("int"), "_y": F.rint("my").cast("int")})
    m = mask.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "flag")
    return g.join(m, ["_x", "_y"], "left").withColumn("flag", F.coalesce("flag", F.lit(0))).drop("_x", "_y")


# -- products ---------------------------------------------------------------------------

#: What a file name holds -> product kind, in this order.
PRODUCT_KINDS = (("BGSUB-MOSAIC", "science"), ("RMS", "rms"), ("GRID-PSF", "psf_grid"), ("CATALOG-PSF", "psf_catalog"), ("FLAG", "flag"), ("BGMOD", "bgmodel"))


def product_kind(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, kind in reversed(PRODUCT_KINDS):
        out = F.when(name.contains(part), F.lit(kind)).otherwise(out)
    return out


def discovered(products: DataFrame, ra: float, dec: float, half_deg: float) -> DataFrame:
    """products (fname, band, s_ra, s_dec, access) whose centre is near or unknown, with ptype, tile_id (the name without one), path (from the access JSON) and sep; one row per band, kind and tile."""
    path = F.concat_ws("/", F.get_json_object("access", "$.aws.bucket_name"), F.get_json_object("access", "$.aws.key"))
    p = products.withColumns({"ptype": product_kind(F.col("fname")), "tile_id": F.coalesce(F.nullif(F.regexp_extract("fname", r"TILE(\d+)", 1), F.lit("")), "fname"), "path": path, "sep": sky.separation_arcsec(F.lit(ra), F.lit(dec), F.col("s_ra"), F.col("s_dec"))})
    near = (F.abs(sky.wrapped(F.col("s_ra") - ra)) * F.cos(F.radians(F.lit(dec))) <= half_deg) & (F.abs(F.col("s_dec") - dec) <= half_deg)
    p = p.where(F.col("ptype").isNotNull() & F.coalesce(near, F.lit(True)))
    w = Window.partitionBy("band", "ptype", "tile_id").orderBy("fname")
    return p.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def closest_product(products: DataFrame, keys: list[str]) -> DataFrame:
    """The product of least sep in each group; those without a position come last, ties by name."""
    w = Window.partitionBy(*keys).orderBy(F.col("sep").asc_nulls_last(), "fname")
    return products.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def aligned_planes(science: DataFrame, rms: DataFrame, flag: DataFrame) -> DataFrame:
    """Planes joined on tile; tiles whose planes differ in shape raise when the row is read."""
    j = science.join(rms.select("tile_id", F.col("width").alias("_w"), F.col("height").alias("_h"), "rms"), "tile_id").join(flag.select("tile_id", F.col("width").alias("_w2"), F.col("height").alias("_h2"), "flag"), "tile_id")
    same = (F.col("width") == F.col("_w")) & (F.col("height") == F.col("_h")) & (F.col("width") == F.col("_w2")) & (F.col("height") == F.col("_h2"))
    return j.withColumn("rms", F.when(F.assert_true(same, F.lit("the planes of a tile are not aligned")).isNull(), F.col("rms"))).drop("_w", "_h", "_w2", "_h2")


def coadd_position(name: Column) -> dict[str, Column]:
    """2709p666 -> 270.9, +66.6."""
    sign = F.when(F.substring(name, 5, 1) == "m", -1.0).otherwise(1.0)
    return {"ra": F.substring(name, 1, 4).cast("double") / 10, "dec": sign * F.substring(name, 6, 3).cast("double") / 10}


def grouped_products(urls: DataFrame, pattern: str, kinds: list[str]) -> DataFrame:
    """One row per root with a column for each kind, of urls (url, sep) that match pattern (root, kind); roots that lack a kind are left out."""
    u = urls.select("url", "sep", F.regexp_extract("url", pattern, 1).alias("root"), F.regexp_extract("url", pattern, 2).alias("kind")).where("root <> ''")
    out = u.groupBy("root").agg(F.min("sep").alias("sep"), *[F.min(F.when(F.col("kind") == k, F.col("url"))).alias(k) for k in kinds])
    return out.where(" and ".join(f"`{k}` is not null" for k in kinds))


def deepest_cutout(coverage: DataFrame) -> DataFrame:
    """The root with the largest median positive coverage. coverage: root, cov."""
    return coverage.where("cov > 0").groupBy("root").agg(F.percentile("cov", F.lit(0.5)).alias("depth")).orderBy(F.desc("depth"), "root").limit(1)


def query_key(sql: Column) -> Column:
    """SHA-256 of a query with its white space made single."""
    return F.sha2(F.trim(F.regexp_replace(sql, r"\s+", " ")), 256)


def standard_columns(df: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Only the columns asked for, found by any of their names without regard to case."""
    low = {c.lower(): c for c in df.columns}
    found = {k: next((low[a.lower()] for a in v if a.lower() in low), None) for k, v in names.items()}
    if missing := [k for k, v in found.items() if v is None]:
        raise ValueError(f"no column for {missing}")
    return df.select(*[F.col(v).alias(k) for k, v in found.items()])


def packed_masks(masks: DataFrame) -> DataFrame:
    """tile, blob, x0, y0, width, height and cells: the pixels (tile, blob, x, y) of each blob as sorted places in its bounding box, for sending."""
    box = masks.groupBy("tile", "blob").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    m = masks.join(box, ["tile", "blob"]).withColumn("width", (F.col("_x1") - F.col("x0") + 1).cast("int"))
    place = (F.col("y") - F.col("y0")) * F.col("width") + (F.col("x") - F.col("x0"))
    return m.groupBy("tile", "blob", "x0", "y0", "width", (F.col("_y1") - F.col("y0") + 1).cast("int").alias("height")).agg(F.sort_array(F.collect_set(place.cast("int"))).alias("cells"))


def unpacked_masks(packed: DataFrame) -> DataFrame:
    """The pixels of packed_masks()."""
    p = packed.select("tile", "blob", "x0", "y0", "width", F.explode("cells").alias("k"))
    return p.select("tile", "blob", (F.col("x0") + F.col("k") % F.col("width")).alias("x"), (F.col("y0") + F.floor(F.col("k") / F.col("width"))).alias("y"))


def blob_boxes(masks: DataFrame, width: int, height: int, margin: int = 20) -> DataFrame:
    """tile, blob and the corner and size of its bounding box with a margin, cut at the image."""
    box = masks.groupBy("tile", "blob").agg(*[f(c).alias(f"_{n}{c}") for c in ("x", "y") for f, n in ((F.min, "a"), (F.max, "z"))])
    lo = lambda c: F.greatest(F.col(f"_a{c}") - margin, F.lit(0))
    hi = lambda c, n: F.least(F.col(f"_z{c}") + margin, F.lit(n - 1))
    return box.select("tile", "blob", lo("x").alias("x0"), lo("y").alias("y0"), (hi("x", width) - lo("x") + 1).alias("width"), (hi("y", height) - lo("y") + 1).alias("height"))


def masked_clones(pixels: DataFrame, masks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each blob's pixels (tile, x, y, d, w) inside its box, moved to the box's corner; weight 0 off the blob's own mask. Pixels and boxes meet in cells."""
    size = 32
    span = lambda a, n: F.sequence(F.floor(F.col(a) / size).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / size).cast("int"))
    b = boxes.where("width > 0 and height > 0").withColumn("_ci", F.explode(span("x0", "width"))).withColumn("_cj", F.explode(span("y0", "height")))
    p = pixels.withColumns({"_ci": F.floor(F.col("x") / size).cast("int"), "_cj": F.floor(F.col("y") / size).cast("int")}).join(b, ["tile", "_ci", "_cj"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + F.col("width")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + F.col("height")))
    own = masks.select("tile", "blob", "x", "y").distinct().withColumn("_own", F.lit(True))
    p = p.join(own, ["tile", "blob", "x", "y"], "left")
    return p.select("tile", "blob", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "d", F.when(F.col("_own"), F.col("w")).otherwise(0.0).alias("w"))


def containing_tiles(fields: DataFrame, candidates: DataFrame) -> DataFrame:
    """fields (field, ra, dec, size_arcsec) with tile_id, x0, y0 and n of the first candidate tile (field, rank, tile_id, width, height, crval1 .. cd22) that holds the whole square; null without one."""
    w = {k: F.col(k) for k in sky.WCS_FIELDS}
    p = sky.sky_to_pixel(F.col("ra"), F.col("dec"), w)
    j = fields.join(candidates, "field").withColumn("n", F.ceil(F.col("size_arcsec") / sky.pixel_scale_arcsec(w)).cast("int"))
    j = j.withColumns({"x0": F.rint(p["x"] - (F.col("n") - 1) / 2).cast("int"), "y0": F.rint(p["y"] - (F.col("n") - 1) / 2).cast("int")})
    inside = j.where((F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x0") + F.col("n") <= F.col("width")) & (F.col("y0") + F.col("n") <= F.col("height")))
    first = inside.groupBy("field").agg(F.min(F.struct("rank", "tile_id", "x0", "y0", "n")).alias("m")).select("field", "m.tile_id", "m.x0", "m.y0", "m.n")
    return fields.join(first, "field", "left")
