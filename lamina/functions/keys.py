"""Keys, paths, seeds and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(seed: int | Column, key: Column | str) -> Column:
    """What stands for a shuffle: rows ordered by it are in an order that depends on the seed alone,
    on any engine."""
    key = F.col(key) if isinstance(key, str) else key
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.sha2(F.concat(seed, F.lit(":"), key.cast("string")), 256)


def stable_seed(group_id: Column | str, index: Column | str) -> Column:
    """The first 32 bits of SHA-256 of "group:index", big-endian."""
    group_id, index = (F.col(x) if isinstance(x, str) else x for x in (group_id, index))
    return F.conv(F.substring(F.sha2(F.concat(group_id, F.lit(":"), index.cast("string")), 256), 1, 8), 16, 10).cast("bigint")


def frame_key(group_id: Column | str, frame_index: Column | str) -> Column:
    """Where a frame is stored."""
    return F.format_string("frames/%s/%05d.png", group_id, frame_index)


def clip_of(source_video: Column | str, group_id: Column | str) -> Column:
    """source_video, or the group's own clip."""
    group_id = F.col(group_id) if isinstance(group_id, str) else group_id
    return F.coalesce(source_video, F.concat(group_id, F.lit(".mp4")))


def key_is_safe(key: Column | str) -> Column:
    """Whether a storage key stays under its root: relative, without a drive, and never above it. Back
    slashes count as slashes. A null key is not safe."""
    key = F.col(key) if isinstance(key, str) else key
    plain = F.translate(key, "\\", "/")
    parts = F.split(plain, "/")
    return F.coalesce((F.length(key) > 0) & ~plain.startswith("/") & ~plain.rlike(r"^[A-Za-z]:") & ~F.array_contains(parts, ".."), F.lit(False))


def safe_key(key: Column | str) -> Column:
    """The key with forward slashes; an error for one that leaves the root."""
    col = F.col(key) if isinstance(key, str) else key
    return F.when(key_is_safe(col), F.translate(col, "\\", "/")).otherwise(F.raise_error(F.concat(F.lit("key leaves the storage root: "), F.coalesce(col, F.lit("null")))))


def path_stem(path: Column | str) -> Column:
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)


def path_parent(path: Column | str) -> Column:
    """The name of the folder that holds the file."""
    return F.regexp_extract(path, r"([^/\\]+)[/\\][^/\\]+$", 1)


def path_suffix(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def group_of(subset: Column | str, path: Column | str) -> Column:
    """A group id that can't collide between subsets."""
    return F.concat_ws("_", subset, path_stem(path))


def parse_int(name: str, raw: Column | str, default: int) -> Column:
    """An integer, the default for null, an error that names the setting otherwise."""
    return _parse(name, raw, "bigint", default)


def parse_float(name: str, raw: Column | str, default: float) -> Column:
    return _parse(name, raw, "double", default)


def _parse(name: str, raw: Column | str, kind: str, default) -> Column:
    raw = F.col(raw) if isinstance(raw, str) else raw
    value = raw.try_cast(kind)
    return F.when(raw.isNull(), F.lit(default).cast(kind)).when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not a {kind}: "), raw)).cast(kind))


def is_rtsp(url: Column | str) -> Column:
    return F.lower(url).rlike(r"^rtsps?://")


def stamp(at: Column | None = None) -> Column:
    """Wall-clock time as text."""
    return F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd HH:mm:ss")


def timestamp_s(position_ms: Column | str, frame_index: Column | str, fps: Column | str) -> Column:
    """Media time: the container's if it has one, otherwise by the frame rate."""
    position_ms, frame_index, fps = (F.col(x) if isinstance(x, str) else x for x in (position_ms, frame_index, fps))
    return F.when(position_ms > 0, position_ms / F.lit(1000.0).cast("double")).otherwise(frame_index / fps.cast("double"))


def measured_fps(fps: Column | str, fallback: float) -> tuple[Column, Column]:
    """(frame rate, whether it is the container's own)."""
    fps = F.col(fps) if isinstance(fps, str) else fps
    fine = F.coalesce((fps > 0) & ~F.isnan(fps), F.lit(False))
    return F.when(fine, fps.cast("double")).otherwise(F.lit(float(fallback))), fine
