"""Descriptors of scenes from long tables of images, poses, points and pixels (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import quantiles, unpivot
from ..sources.tables import stored


def parse_points_text(df: DataFrame, text: str = "text", key: str = "scene") -> DataFrame:
    """key, point_id, x, y, z, error, track: a point on each line, `ID X Y Z R G B ERROR (IMAGE INDEX)*`; '#' lines are comments."""
    d = df.select(key, F.explode(F.split(text, "\n")).alias("line")).filter("trim(line) <> '' and not startswith(trim(line), '#')")
    p = F.split(F.trim("line"), r"\s+")
    n = lambda i: F.get(p, F.lit(i)).try_cast("double")
    return d.select(key, F.get(p, F.lit(0)).try_cast("long").alias("point_id"), n(1).alias("x"), n(2).alias("y"), n(3).alias("z"), n(7).alias("error"), F.greatest(F.lit(0), F.floor((F.size(p) - 8) / 2)).alias("track"))


def parse_images_text(df: DataFrame, text: str = "text", key: str = "scene") -> DataFrame:
    """key, image_id, name, qw, qx, qy, qz, tx, ty, tz, observations array<struct<x, y, point_id>>: pairs of lines, the
    image and its triples `X Y POINT`; '#' lines are comments."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.startswith(F.trim(x), F.lit("#")))
    two = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("lines") - 1), F.lit(2)), lambda i: F.struct(F.get("lines", i).alias("head"), F.coalesce(F.get("lines", i + 1), F.lit("")).alias("rest")))
    d = df.select(key, lines.alias("lines")).select(key, F.explode(two).alias("x")).select(key, "x.*").filter("trim(head) <> ''")
    d = d.withColumn("h", F.split(F.trim("head"), r"\s+")).withColumn("o", F.filter(F.split(F.trim("rest"), r"\s+"), lambda x: x != ""))
    n = lambda i: F.get("h", F.lit(i)).try_cast("double")
    triple = lambda i: F.struct(F.get("o", i).try_cast("double").alias("x"), F.get("o", i + 1).try_cast("double").alias("y"), F.get("o", i + 2).try_cast("long").alias("point_id"))
    triples = F.when(F.size("o") >= 3, F.transform(F.sequence(F.lit(0), F.size("o") - 3, F.lit(3)), triple)).otherwise(F.array().cast("array<struct<x:double,y:double,point_id:bigint>>"))
    return d.select(key, F.get("h", F.lit(0)).try_cast("long").alias("image_id"), F.get("h", F.lit(9)).alias("name"), *[n(i).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"), 1)], triples.alias("observations"))


def view_stats(obs: DataFrame) -> DataFrame:
    """scene, n_images, mean and deviation of visible points (point_id other than -1) and of their share of all keypoints."""
    per = obs.groupBy("scene", "image").agg(F.count("point_id").alias("k"), F.count_if(F.col("point_id") != -1).alias("v"))
    share = F.when(F.col("k") > 0, F.col("v") / F.col("k")).otherwise(0.0)
    return per.groupBy("scene").agg(F.count(F.lit(1)).alias("n_images"), F.avg("v").alias("visible_mean"), F.stddev_pop("v").alias("visible_std"), F.avg(share).alias("share_mean"), F.stddev_pop(share).alias("share_std"))


def camera(df: DataFrame) -> DataFrame:
    """df (qw, qx, qy, qz, tx, ty, tz) with the camera's centre cx, cy, cz = -R^T t and direction dx, dy, dz (the third row
    of R), from the normalised quaternion."""
    n = F.sqrt(sum((F.col(q) * F.col(q) for q in ("qx", "qy", "qz")), F.col("qw") * F.col("qw")))
    d = df.select("*", *[(F.col(q) / n).alias(f"_{q}") for q in ("qw", "qx", "qy", "qz")])
    w, x, y, z = (F.col(f"_{q}") for q in ("qw", "qx", "qy", "qz"))
    r = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
    t = [F.col(c) for c in ("tx", "ty", "tz")]
    centre = [(-(r[0][i] * t[0] + r[1][i] * t[1] + r[2][i] * t[2])).alias(c) for i, c in enumerate(("cx", "cy", "cz"))]
    return d.select("*", *centre, *[r[2][i].alias(c) for i, c in enumerate(("dx", "dy", "dz"))]).drop("_qw", "_qx", "_qy", "_qz")


def pose_stats(df: DataFrame) -> DataFrame:
    """scene, n_images, mean and deviation of the centres' distance to the origin, mean angle (degrees) to the mean direction."""
    c = camera(df)
    m = c.groupBy("scene").agg(*[F.avg(d).alias(f"m{d}") for d in ("dx", "dy", "dz")])
    c = c.join(m, "scene")
    dot = sum((F.col(d) * F.col(f"m{d}") for d in ("dy", "dz")), F.col("dx") * F.col("mdx"))
    norm = lambda p: F.sqrt(sum((F.col(f"{p}{d}") * F.col(f"{p}{d}") for d in ("dy", "dz")), F.col(f"{p}dx") * F.col(f"{p}dx")))
    cos = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / F.when(norm("m") * norm("") > 0, norm("m") * norm(""))))
    far = F.sqrt(F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy") + F.col("cz") * F.col("cz"))
    return c.groupBy("scene").agg(F.count(F.lit(1)).alias("n_images"), F.avg(far).alias("distance_mean"), F.stddev_pop(far).alias("distance_std"), F.avg(F.degrees(F.acos(cos))).alias("angle_mean"))


def point_stats(df: DataFrame, scenes: DataFrame | None = None) -> DataFrame:
    """scene, n_points, extents, volume, density, mean, deviation and median of error and track; scenes without points: nulls."""
    d = df.groupBy("scene").agg(F.count("x").alias("n_points"), *[(F.max(c) - F.min(c)).alias(f"extent_{c}") for c in "xyz"], *[f(c).alias(f"{c}_{n}") for c in ("error", "track") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    q = quantiles(unpivot(df, ["scene"], ["error", "track"]), ["scene", "feature"], {"median": 0.5})  # of any number of points in a scene
    q = q.groupBy("scene").agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"{c}_median") for c in ("error", "track")])
    d = d.join(q, "scene", "left")
    volume = F.greatest(F.col("extent_x"), F.lit(1e-12)) * F.greatest(F.col("extent_y"), F.lit(1e-12)) * F.greatest(F.col("extent_z"), F.lit(1e-12))
    d = d.withColumn("volume", volume).withColumn("density", F.col("n_points") / volume)
    return d if scenes is None else scenes.select("scene").distinct().join(d, "scene", "left").withColumn("n_points", F.coalesce("n_points", F.lit(0)))


def intrinsics(df: DataFrame) -> DataFrame:
    """df (w, h, fl_x, fl_y, angle_x, all but w nullable) with fx and fy: given, else from the field of view; fy falls back to fx."""
    fx = F.coalesce("fl_x", 0.5 * F.col("w") / F.tan(0.5 * F.col("angle_x")))
    return df.withColumn("fx", fx).withColumn("fy", F.coalesce("fl_y", "fx"))


def image_entropy(levels: DataFrame) -> DataFrame:
    """scene, image, entropy in bits of the histogram (scene, image, level, n)."""
    d = levels.groupBy("scene", "image", "level").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("scene", "image"))
    return d.withColumn("p", p).groupBy("scene", "image").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def edge_share(pixels: DataFrame) -> DataFrame:
    """scene, image, edges, mask_share: of pixels (scene, image, x, y, level, mask) the share whose gradient (central
    differences, the pixel itself at a border) is above the image's mean, and the share inside the mask."""
    row, col = Window.partitionBy("scene", "image", "y").orderBy("x"), Window.partitionBy("scene", "image", "x").orderBy("y")
    step = lambda w: (F.coalesce(F.lead("level").over(w), "level") - F.coalesce(F.lag("level").over(w), "level")) / 2
    g = pixels.withColumn("gx", step(row)).withColumn("gy", step(col)).withColumn("g", F.round(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")), 9))
    m = g.groupBy("scene", "image").agg(F.round(F.avg("g"), 9).alias("m"))
    g = g.join(m, ["scene", "image"])
    return g.groupBy("scene", "image").agg(F.avg((F.col("g") > F.col("m")).cast("int")).alias("edges"), F.avg(F.col("mask").cast("int")).alias("mask_share"))


def image_stats(per_image: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and deviation over a scene's images of each column; images that lack a value don't count for it."""
    return per_image.groupBy("scene").agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def scene_image_stats(entropy: DataFrame, edges: DataFrame, frames: DataFrame) -> DataFrame:
    """Per scene, mean and deviation of entropy, edge share, mask share and sharpness.

    entropy and edges are as image_entropy and edge_share return them; frames has scene, image and sharpness (null where
    a frame has none). A scene is there if any of the three has it.
    """
    keys = ["scene", "image"]
    d = entropy.join(edges, keys, "full").join(frames.select(*keys, "sharpness"), keys, "full")
    return image_stats(d, ["entropy", "edges", "mask_share", "sharpness"])


LEAST_WEIGHT = 1e-5  # of a pair of rays; more nearly parallel ones say nothing about where they meet


def focus_point(df: DataFrame) -> DataFrame:
    """scene, fx, fy, fz, weight: over all ordered pairs of a scene's rays (image, centre cx, cy, cz, direction dx, dy, dz),
    the mean of the closest points on the first, weighted by |da x db|^2 where that is above LEAST_WEIGHT. Scenes without
    such a pair aren't there.

    Weight and weighted point are polynomials in the second ray, so what a ray sums up over all others follows from
    moments of the scene, and no pairs are made. Only pairs below the weight have to be found and taken off: their
    directions, or one and the other's opposite, are neighbours in a grid of directions.
    """
    d = stored(df.select("scene", "image", *[F.col(x + i).cast("double").alias(x + i) for x in "cd" for i in "xyz"]).na.drop(), "rays")
    square = lambda u: sum((x * x for x in u[1:]), u[0] * u[0])
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    c, v = ([F.col(x + i) for i in "xyz"] for x in "cd")
    places = [(i, j) for i in range(3) for j in range(i, 3)]
    moments = [F.count(F.lit(1)).alias("n"), F.sum(square(v)).alias("squares"), F.min(square(v)).alias("shortest")]
    moments += [F.sum(v[i] * v[j]).alias(f"m{i}{j}") for i, j in places]
    moments += [F.sum(c[i] * square(v) - v[i] * dot(c, v)).alias(f"m{i}") for i in range(3)]  # of the part that doesn't depend on the first centre
    whole = stored(d.groupBy("scene").agg(*moments), "moments")
    m = lambda i, j: F.col(f"m{min(i, j)}{max(i, j)}")
    turned = lambda u: [dot([m(i, j) for j in range(3)], u) for i in range(3)]
    w = square(v) * F.col("squares") - dot(v, turned(v))
    s = dot(v, [F.col(f"m{i}") for i in range(3)]) - dot(c, v) * F.col("squares") + dot(c, turned(v))
    every = d.join(whole, "scene").groupBy("scene").agg(F.max(F.col("n") * (F.col("n") - 1)).alias("pairs"), F.sum(w).alias("w"), *[F.sum(w * c[i] + s * v[i]).alias(f"f{x}") for i, x in enumerate("xyz")])
    few = _nearly_parallel(d, whole.select("scene", "shortest"))
    d = every.join(few, "scene", "left")
    rest = lambda x: F.col(x) - F.coalesce(F.col(f"{x}_off"), F.lit(0))
    return d.filter(rest("pairs") > 0).select("scene", *[(rest(f"f{x}") / rest("w")).alias(f"f{x}") for x in "xyz"], rest("w").alias("weight"))


def _nearly_parallel(d: DataFrame, shortest: DataFrame) -> DataFrame:
    """scene, pairs_off, w_off, fx_off, fy_off, fz_off: number and sums of the ordered pairs of at most LEAST_WEIGHT."""
    size = F.sqrt(sum((F.col(f"d{x}") * F.col(f"d{x}") for x in "yz"), F.col("dx") * F.col("dx")))
    # directions this far apart, of rays as short as the shortest, have more than LEAST_WEIGHT; a scene without a direction has one cell
    step = F.when(F.col("shortest") > 0, F.least(F.lit(4.0), F.lit((2 * LEAST_WEIGHT) ** 0.5 * (1 + 1e-6)) / F.col("shortest"))).otherwise(4.0)
    d = d.join(shortest, "scene").withColumn("step", step).withColumn("size", size)
    cell = lambda sign: F.array(*[F.floor(F.when(F.col("size") > 0, sign * F.col(f"d{x}") / F.col("size")).otherwise(0.0) / F.col("step")) for x in "xyz"])
    rays = [f"{x}{i}" for x in "cd" for i in "xyz"]
    a = d.select("scene", F.col("image").alias("a"), *[F.col(c).alias(f"a{c}") for c in rays], cell(1).alias("at"))
    around = F.array(*[F.array(*[F.lit(x) for x in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    a = a.select("*", F.explode(around).alias("by")).withColumn("cell", F.zip_with("at", "by", lambda x, y: x + y)).drop("at", "by")
    b = d.select("scene", F.col("image").alias("b"), *[F.col(c).alias(f"b{c}") for c in rays], F.explode(F.array(F.struct(F.lit(True).alias("same"), cell(1).alias("cell")), F.struct(F.lit(False).alias("same"), cell(-1).alias("cell")))).alias("x"))
    p = a.join(b.select("*", "x.*").drop("x"), ["scene", "cell"]).filter("a <> b")
    da, db = ([F.col(f"{r}d{x}") for x in "xyz"] for r in "ab")
    t = [F.col(f"bc{x}") - F.col(f"ac{x}") for x in "xyz"]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    n = cross(da, db)
    p = p.filter((dot(da, db) >= 0) == F.col("same")).withColumn("w", dot(n, n)).withColumn("s", dot(cross(t, db), n)).filter(F.col("w") <= LEAST_WEIGHT)
    return p.groupBy("scene").agg(F.count(F.lit(1)).alias("pairs_off"), F.sum("w").alias("w_off"), *[F.sum(F.col("w") * F.col(f"ac{x}") + F.col("s") * da[i]).alias(f"f{x}_off") for i, x in enumerate("xyz")])


def normalize_poses(df: DataFrame, focus: DataFrame) -> DataFrame:
    """Centres moved to the focus and scaled so that their mean distance is 4."""
    d = df.join(focus.select("scene", "fx", "fy", "fz"), "scene")
    d = d.select("scene", "image", *[(F.col(f"c{x}") - F.col(f"f{x}")).alias(f"n{x}") for x in "xyz"])
    far = F.avg(F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")))
    s = d.groupBy("scene").agg((4 / far).alias("scale"))
    return d.join(s, "scene").select("scene", "image", *[(F.col(f"n{x}") * F.col("scale")).alias(f"n{x}") for x in "xyz"])


def resolve_companion(df: DataFrame, files: DataFrame, candidates: list[Column]) -> DataFrame:
    """df with `path`: the first of the candidate paths that is in files (path); null where none is."""
    options = df.select("*", F.posexplode(F.array(*candidates)).alias("rank", "path"))
    hit = options.join(files.select("path").distinct(), "path").groupBy("unit").agg(F.min_by("path", "rank").alias("path"))
    return df.join(hit, "unit", "left")
