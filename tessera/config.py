"""Typed settings, read from the session (``spark.conf.set("tessera.block.size", "512")``)."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (default, meaning)
ENTRIES: dict[str, tuple[int | float | bool | str, str]] = {
    "tessera.block.size": (256, "rows and columns of a block in the blocked product"),
    "tessera.broadcast.bytes": (16 << 20, "a side is broadcast only if its shape bounds it below this"),
    "tessera.gram.columns": (2048, "widest matrix whose XᵀX is accumulated in one task's memory"),
    "tessera.blocked.work": (10**8, "scalar multiplications from which dense pairs use numpy blocks"),
    "tessera.outer.rows": (100_000, "rows of a vector that meet all others in one task of a rank-one update"),
    "tessera.rewrite": (True, "apply the algebraic rewrites"),
}


def conf(spark: SparkSession, name: str):
    default, _ = ENTRIES[name]
    raw = spark.conf.get(name, None)
    if raw is None:
        return default
    if isinstance(default, bool):
        if raw.lower() not in ("true", "false"):
            raise ValueError(f"{name} must be true or false, not {raw!r}")
        return raw.lower() == "true"
    return type(default)(raw)


def session(app: str = "tessera", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time and AQE; other settings by name with dots as underscores."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    for k, v in settings.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
