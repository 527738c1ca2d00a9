"""Joins, set operations and maintenance of the rating library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Media formats by modality.
FORMATS = {
    "audio": (".mp3", ".flac", ".wav", ".ogg", ".aac", ".m4a", ".opus"),
    "image": (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff"),
    "video": (".mp4", ".webm", ".avi", ".mov", ".wmv", ".flv", ".mkv", ".ogv", ".mpeg", ".mpg"),
    "text": (".txt", ".md", ".htm", ".html"),
}


def modality_of(ext: Column) -> Column:
    out = None
    for kind, formats in FORMATS.items():
        hit = F.lower(ext).isin(*formats)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def effective_rating(files: DataFrame, library: DataFrame) -> DataFrame:
    """Adds `score`: the user's rating, else the model's, else null."""
    r = library.select("file_path", F.coalesce("user_rating", "model_rating").alias("score"))
    return files.join(r, files["path"] == r["file_path"], "left").drop("file_path")


def rating_is_stale(model_rating: Column, model_hash: Column, current: str | None) -> Column:
    """A model rating of another model than the current one; an unknown model hash is stale too."""
    return F.lit(False) if current is None else model_rating.isNotNull() & ~model_hash.eqNullSafe(F.lit(current))


def resolve_play_record(files: DataFrame, plays: DataFrame) -> DataFrame:
    """(idx, path, play columns, found_by): by path; only paths that aren't found, by content hash (least idx of equals)."""
    keep = ["user_rating", "model_rating", "full_play_count", "skip_count", "last_played"]
    by_path = plays.filter("file_path IS NOT NULL").select(F.col("file_path").alias("path"), *keep)
    direct = files.select("idx", "path").join(by_path, "path")
    rest = files.join(by_path.select("path"), "path", "left_anti").select("idx", "path", "hash")
    by_hash = plays.groupBy("hash").agg(*[F.min_by(c, "idx").alias(c) for c in keep])
    indirect = rest.join(by_hash, "hash")
    cols = ["idx", "path", *keep]
    return direct.select(*cols, F.lit("path").alias("found_by")).unionByName(indirect.select(*cols, F.lit("hash").alias("found_by")))


def overlay_ratings(files: DataFrame, resolved: DataFrame, library: DataFrame) -> DataFrame:
    """Ratings and play counts of every file: a library row replaces both ratings, even by null; no row: nulls and zeros."""
    lib = library.select(F.col("file_path").alias("path"), F.col("user_rating").alias("lu"), F.col("model_rating").alias("lm"), F.lit(True).alias("there"))
    rows = files.select("idx", "path").join(resolved.drop("idx", "found_by"), "path", "left").join(lib, "path", "left")
    pick = lambda mine, theirs: F.when(F.col("there"), F.col(mine)).otherwise(F.col(theirs))
    return rows.select("idx", "path", pick("lu", "user_rating").alias("user_rating"), pick("lm", "model_rating").alias("model_rating"), F.coalesce("full_play_count", F.lit(0)).alias("full_play_count"), F.coalesce("skip_count", F.lit(0)).alias("skip_count"), "last_played")


def unrated_files(files: DataFrame, library: DataFrame, current: str | None) -> DataFrame:
    """(idx, path, stale): never rated by the model first (also with an unknown model hash), then stale ones."""
    rated = library.filter("model_rating IS NOT NULL")
    if current is not None:
        rated = rated.filter(F.col("model_hash").isNotNull())
    state = rated.select(F.col("file_path").alias("path"), (F.lit(False) if current is None else F.col("model_hash") != current).alias("stale"))
    return files.select("idx", "path").join(state, "path", "left").filter(F.coalesce("stale", F.lit(True))).select("idx", "path", F.coalesce("stale", F.lit(False)).alias("stale"))


def new_files(files: DataFrame, rated: DataFrame, stale: DataFrame) -> DataFrame:
    return files.select("path").subtract(rated.select("path")).subtract(stale.select("path"))


def upsert_by_hash_or_path(target: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """target: (id, hash, file_path, columns); incoming: (idx, hash, file_path, columns).

    An incoming row updates every row with its hash (if not empty) or its path, else it is inserted; only the given
    columns change. Two equi-joins instead of an OR; of several incoming rows for one target the last (by idx) wins.
    """
    i = incoming.select("idx", F.col("hash").alias("h"), F.col("file_path").alias("p"), *[F.col(c).alias(f"new_{c}") for c in columns])
    by_hash = target.select("id", "hash").join(i.filter("h <> ''"), F.col("hash") == F.col("h")).drop("hash")
    by_path = target.select("id", "file_path").join(i, F.col("file_path") == F.col("p")).drop("file_path")
    hits = by_hash.unionByName(by_path)
    last = hits.groupBy("id").agg(*[F.max_by(f"new_{c}", "idx").alias(f"new_{c}") for c in columns]).withColumn("hit", F.lit(True))
    updated = target.join(last, "id", "left").select("id", "hash", "file_path", *[F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns], F.when(F.col("hit"), "updated").otherwise("kept").alias("change"))
    fresh = incoming.join(hits.select("idx").distinct(), "idx", "left_anti")
    return updated.unionByName(fresh.select(F.col("idx").alias("id"), "hash", "file_path", *columns, F.lit("inserted").alias("change")))


def merge_fill_missing(library: DataFrame, legacy: DataFrame, root: str) -> DataFrame:
    """Relative paths get the root; only nulls are filled, a user rating together with its date, a model rating with its hash."""
    old = legacy.select(F.when(F.contains("file_path", F.lit("://")), F.col("file_path")).otherwise(F.concat(F.lit(root), "file_path")).alias("file_path"), *[F.col(c).alias(f"o_{c}") for c in ("hash", "user_rating", "user_rating_date", "model_rating", "model_hash")])
    rows = library.drop("idx").join(old, "file_path", "full")
    pair = lambda c, d: (F.coalesce(c, f"o_{c}").alias(c), F.when(F.col(c).isNotNull(), F.col(d)).otherwise(F.col(f"o_{d}")).alias(d))
    return rows.select("file_path", F.coalesce("hash", "o_hash").alias("hash"), *pair("user_rating", "user_rating_date"), *pair("model_rating", "model_hash"))


def sync_paths_by_hash(library: DataFrame, files: DataFrame) -> DataFrame:
    """(hash, old_path, new_path) of rows whose content now lies elsewhere; of several files the last one counts."""
    at = files.groupBy("hash").agg(F.max_by("path", "idx").alias("new_path"))
    return library.select("hash", F.col("file_path").alias("old_path")).join(at, "hash").filter(F.col("old_path") != F.col("new_path"))


def missing_features(files: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Files without features for their current key."""
    return files.join(features.select(*keys), keys, "left_anti")


def memory_backfill(library: DataFrame, memory: DataFrame, today: str) -> DataFrame:
    """Rated rows with hash and path that have no record yet, with the day to file them under."""
    rated = library.filter("user_rating IS NOT NULL AND hash <> '' AND file_path <> ''")
    return rated.join(memory.select(F.col("file_stem").alias("hash")).distinct(), "hash", "left_anti").select("hash", "file_path", "user_rating", F.coalesce(F.to_date("user_rating_date"), F.to_date(F.lit(today))).cast("string").alias("day"))


def dedupe_first(df: DataFrame, key: str, idx: str) -> DataFrame:
    """The first row of each key in listing order."""
    return df.groupBy(key).agg(*[F.min_by(c, idx).alias(c) for c in df.columns if c != key])


def latest_per_key(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The newest row of each key."""
    values = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*by)).alias("r")).select(key, "r.*")


def write_back_ratings(library: DataFrame, predicted: DataFrame, model: str) -> DataFrame:
    """Model ratings and model hash by path; user columns stay; paths without a row are added."""
    p = predicted.select(F.col("path").alias("file_path"), F.col("hash").alias("p_hash"), F.col("prediction"))
    rows = library.select("file_path", "hash", "user_rating", "model_rating", "model_hash").join(p, "file_path", "full")
    hit = F.col("prediction").isNotNull()
    return rows.select("file_path", F.coalesce("hash", "p_hash").alias("hash"), "user_rating", F.when(hit, F.col("prediction")).otherwise(F.col("model_rating")).alias("model_rating"), F.when(hit, F.lit(model)).otherwise(F.col("model_hash")).alias("model_hash"))


def rate_files(library: DataFrame, ratings: DataFrame) -> DataFrame:
    """ratings: (file_path, hash, ts, value). The last rating of each path sets rating, date and hash; absent paths are added."""
    last = latest_per_key(ratings, "file_path", ["ts", "value"]).select("file_path", F.col("hash").alias("n_hash"), F.col("ts").alias("n_ts"), F.col("value").alias("n_value"))
    rows = library.select("file_path", "hash", "user_rating", "user_rating_date", "model_rating").join(last, "file_path", "full")
    hit = F.col("n_value").isNotNull()
    return rows.select("file_path", F.when(hit, F.col("n_hash")).otherwise(F.col("hash")).alias("hash"), F.when(hit, F.col("n_value")).otherwise(F.col("user_rating")).alias("user_rating"), F.when(hit, F.col("n_ts")).otherwise(F.col("user_rating_date")).alias("user_rating_date"), "model_rating")


def folder_counts(files: DataFrame, extensions: tuple[str, ...], skip_hidden: bool = False) -> DataFrame:
    """(folder, parent, depth, num_files, total_files): files of the formats right inside, and in the whole subtree."""
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = files.select(segments.alias("s"), F.lower("ext").isin(*extensions).alias("ok"))
    if skip_hidden:
        rows = rows.filter(~F.element_at("s", -1).startswith("."))
    depths = F.sequence(F.lit(1), F.size("s") - 1)
    up = rows.filter(F.size("s") > 1).select("ok", F.explode(F.transform(depths, lambda d: F.struct(F.array_join(F.slice("s", F.lit(1), d), "/").alias("folder"), F.array_join(F.slice("s", F.lit(1), d - 1), "/").alias("parent"), d.alias("depth"), (d == F.size("s") - 1).alias("own")))).alias("x"))
    return up.groupBy("x.folder", "x.parent", "x.depth").agg(F.count_if(F.col("ok") & F.col("x.own")).alias("num_files"), F.count_if("ok").alias("total_files"))


def folder_children(folders: DataFrame, active: str) -> DataFrame:
    """The folders on the active path and the children of each of them."""
    on_path = F.lit(active + "/").startswith(F.concat("folder", F.lit("/")))
    opened = folders.filter(on_path).select(F.col("folder").alias("open"))
    return folders.filter(on_path).unionByName(folders.filter(~on_path).join(opened, F.col("parent") == F.col("open"), "left_semi"))


def epoch(ts: str) -> Column:
    """Seconds since 1970 with fractions, of a timestamp with or without time zone."""
    return F.col(ts).cast("timestamp").cast("double")


def sample_windows(events: DataFrame, key: str, ts: str, n: int, seconds: float, middles: int = 0) -> DataFrame:
    """(key, window_no, start, end, middle_times): n evenly spaced windows of a sequence with a margin of a twentieth."""
    span = events.groupBy(key).agg(F.min(epoch(ts)).alias("t0"), F.max(epoch(ts)).alias("t1"))
    total, d = F.col("t1") - F.col("t0"), F.lit(float(seconds))
    lo = F.lit(0.0) if n == 1 else F.least(d / 2, total * 0.05)
    hi = F.greatest(lo, total - d - lo)
    at = (lambda k: F.greatest(F.lit(0.0), total / 2 - d / 2)) if n == 1 else (lambda k: lo + k * (hi - lo) / (n - 1))
    starts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("window_no"), at(k).alias("s")))
    rows = span.select(key, "t0", total.alias("total"), F.explode(starts).alias("w"))
    end = F.least(F.col("w.s") + d, F.col("total"))
    out = rows.select(key, "w.window_no", (F.col("t0") + F.col("w.s")).alias("start"), (F.col("t0") + end).alias("end"))
    if middles:
        out = out.withColumn("middle_times", F.transform(F.sequence(F.lit(0), F.lit(middles - 1)), lambda k: F.col("start") + (k + 0.5) * (F.col("end") - F.col("start")) / middles))
    return out


def in_windows(events: DataFrame, windows: DataFrame, key: str, ts: str, bucket: float) -> DataFrame:
    """Events inside the windows of their key: an equi-join on key and time bucket, then the exact bounds."""
    first, last = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    w = windows.withColumn("b", F.explode(F.sequence(first, last)))
    e = events.withColumn("t", epoch(ts)).withColumn("b", F.floor(F.col("t") / bucket))
    return e.join(w, [key, "b"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("b")


def servable(files: DataFrame, roots: list[str], modules: str = "osfs:///mnt/project_config/modules/", suffixes: tuple[str, ...] = (".link", ".preview.jpg", ".meta")) -> DataFrame:
    """Default deny: in an allowed root and no dotfile, or a sidecar below the modules root."""
    name = F.substring_index("path", "/", -1)
    inside = F.lit(False)
    for r in roots:
        inside = inside | F.col("path").startswith(r)
    side = F.lit(False)
    for s in suffixes:
        side = side | name.endswith(s)
    return files.filter((inside & ~name.startswith(".")) | (~inside & F.col("path").startswith(modules) & side))

