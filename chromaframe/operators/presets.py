"""Presets, snapshots, thresholds as lists, and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chromaframe.functions import color as C

#: Pigment ids of the named palettes; "All" is every essential pigment.
PALETTES = {
    "Zorn": ["yellow_ochre", "cad_red_medium", "carbon_black", "titanium_white"],
    "Primary": ["cad_red_medium", "quin_crimson", "cad_yellow_medium", "cadmium_yellow_light", "ultramarine_blue", "phthalo_blue_gs", "carbon_black", "titanium_white"],
    "Warm": ["cad_red_medium", "cad_red_dark", "cadmium_orange", "cad_yellow_medium", "yellow_ochre", "raw_sienna", "burnt_sienna", "burnt_umber", "titanium_white", "carbon_black"],
    "Cool": ["ultramarine_blue", "phthalo_blue_gs", "cerulean_blue_chromium", "phthalo_green_bs", "chromium_oxide", "dioxazine_purple", "paynes_gray", "raw_umber", "titanium_white", "carbon_black"],
}

SNAPSHOT = "mode string, levels int, bias double, thresholds array<double>, bands array<int>, method string, strength double, grid boolean"
METHODS = ("apisr", "realesrgan", "none")
DEFAULT_METHOD = "apisr"


#: The settings of a fresh start.
DEFAULT = {"mode": "original", "levels": 3, "bias": 0.0, "thresholds": [1 / 3, 2 / 3], "bands": [], "method": "apisr", "strength": 0.5, "grid": False}


def default_snapshot() -> Column:
    """The settings of a fresh start as a snapshot."""
    literal = {k: F.array(*map(F.lit, v)) if v else F.array().cast("array<int>") for k, v in DEFAULT.items() if isinstance(v, list)}
    return F.struct(*[(literal[k] if k in literal else F.lit(v)).alias(k) for k, v in DEFAULT.items()]).cast(f"struct<{', '.join(':'.join(f.split()) for f in SNAPSHOT.split(', '))}>")


def canonical_selection(states: DataFrame, saved: DataFrame) -> DataFrame:
    """What each state (state_id, snapshot, has_previous) is shown as: the first saved preset of equal settings, the default, or the previous settings."""
    same = states.select("state_id", F.to_json("snapshot").alias("key")).join(saved.select("name", "position", F.to_json("snapshot").alias("key")), "key")
    first = same.groupBy("state_id").agg(F.min(F.struct("position", "name"))["name"].alias("name"))
    fresh = F.to_json("snapshot") == F.to_json(default_snapshot())
    shown = F.when(F.col("name").isNotNull(), F.concat(F.lit("saved:"), "name")).when(fresh | ~F.col("has_previous"), "default").otherwise("previous")
    return states.join(first, "state_id", "left").select("state_id", shown.alias("selection"))


def presets_in_order(store: DataFrame) -> DataFrame:
    """Presets by name, without regard to case."""
    return store.withColumn("position", F.row_number().over(Window.orderBy(F.lower("name"), "name")))


def stored_key(name: Column) -> Column:
    """A preset's name as the store compares it: lower case without white space."""
    return F.regexp_replace(F.lower(name), r"\s+", "")


def shown_key(name: Column) -> Column:
    """A preset's name as screens compare it: lower case, trimmed."""
    return F.lower(F.trim(name))


def suggested_name(presets: DataFrame, word: str = "Preset") -> DataFrame:
    """The smallest free "Preset n"."""
    taken = presets.select(stored_key(F.col("name")).alias("key")).distinct()
    n = presets.agg((F.count(F.lit(1)) + 1).alias("n"))
    free = n.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).withColumn("key", F.concat(F.lit(word.lower()), F.col("i").cast("string")))
    return free.join(taken, "key", "left_anti").agg(F.concat(F.lit(f"{word} "), F.min("i").cast("string")).alias("name"))


class PresetError(ValueError):
    """An empty, duplicate or unknown preset name."""


def save(presets: DataFrame, name: str, snapshot: Column, now: Column) -> DataFrame:
    """``presets`` (name, created_at, updated_at, snapshot) with one more; names are unique as the store compares them."""
    _check_name(presets, name)
    row = presets.sparkSession.range(1).select(F.lit(name.strip()).alias("name"), now.alias("created_at"), now.alias("updated_at"), snapshot.alias("snapshot"))
    return presets.unionByName(row)


def rename(presets: DataFrame, old: str, new: str, now: Column) -> DataFrame:
    if presets.where(F.col("name") == old).isEmpty():
        raise PresetError(f"no preset {old!r}")
    _check_name(presets.where(F.col("name") != old), new)
    hit = F.col("name") == old
    return presets.withColumns({"updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "name": F.when(hit, F.lit(new.strip())).otherwise(F.col("name"))})


def delete(presets: DataFrame, name: str) -> DataFrame:
    if presets.where(F.col("name") == name).isEmpty():
        raise PresetError(f"no preset {name!r}")
    return presets.where(F.col("name") != name)


def _check_name(presets: DataFrame, name: str) -> None:
    if not name.strip():
        raise PresetError("a preset needs a name")
    if not presets.where(stored_key(F.col("name")) == stored_key(F.lit(name))).isEmpty():
        raise PresetError(f"a preset {name!r} is there already")


def decode_store(text: Column) -> Column:
    """Presets of a stored JSON text; null unless its schema version is 1."""
    store = F.from_json(text, f"schemaVersion int, presets array<struct<name:string,snapshot:struct<{_struct(SNAPSHOT)}>>>")
    return F.when(store["schemaVersion"] == 1, store["presets"])


def _struct(ddl: str) -> str:
    return ",".join(":".join(part.strip().split(" ")) for part in ddl.split(", "))


def method_or_default(method: Column) -> Column:
    return F.when(method.isin(*METHODS), method).otherwise(DEFAULT_METHOD)


def sanitized(values: Column, levels: Column, defaults: Column) -> Column:
    """Thresholds within 0..1 in order, cut or filled up from defaults to levels - 1."""
    kept = F.array_sort(F.filter(values, lambda v: (v >= 0) & (v <= 1)))
    filled = F.concat(kept, F.slice(defaults, F.size(kept) + 1, F.greatest(F.lit(0), levels - 1 - F.size(kept))))
    return F.array_sort(F.slice(filled, 1, F.greatest(F.lit(0), levels - 1)))


def pigment_indexes(ids: DataFrame, pigments: DataFrame) -> DataFrame:
    """Global indexes of pigment ids in order; unknown ids are left out."""
    return ids.join(pigments.select("id", "pid"), "id").orderBy("pid")


def pigment_names(ids: DataFrame, pigments: DataFrame) -> DataFrame:
    """Display names; an unknown id keeps itself."""
    return ids.join(pigments.select("id", "name"), "id", "left").withColumn("name", F.coalesce("name", "id"))


def palette_members(pigments: DataFrame, name: str) -> DataFrame:
    """The pigments of a named palette, by id; "All" is every essential one."""
    return pigments.where(F.col("essential") if name == "All" else F.col("id").isin(PALETTES[name]))


def pigment_list(named: DataFrame) -> DataFrame:
    """``Name [id], …`` in the order of names."""
    text = F.concat("name", F.lit(" ["), "id", F.lit("]"))
    return named.groupBy("owner").agg(F.array_join(F.sort_array(F.collect_list(text)), ", ").alias("pigments"))


def on_off(flag: Column) -> Column:
    return F.when(flag, "On").otherwise("Off")


def scalar_text(v: Column, places: int = 2, signed: bool = False) -> Column:
    """A number with up to so many decimals, without trailing zeros."""
    text = F.format_string(f"%{'+' if signed else ''}.{places}f", F.round(v, places))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "") if places else text


def full_report(sections: DataFrame) -> DataFrame:
    """The report of an export (image_id, section, place, label, value): sections and their lines in order, a blank line between sections."""
    line = F.concat_ws(": ", "label", "value")
    block = sections.groupBy("image_id", "section").agg(F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    text = F.concat_ws("\n", F.col("section"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    every = block.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))).alias("blocks"))
    return every.select("image_id", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n\n").alias("report"))


def settings_report(settings: DataFrame) -> DataFrame:
    """The settings of a study as lines of text, in a fixed order."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Mode: "), "mode"),
        F.concat(F.lit("Levels: "), F.col("levels").cast("string")),
        F.concat(F.lit("Bias: "), scalar_text(F.col("bias"), 2, True)),
        F.concat(F.lit("Grid: "), on_off(F.col("grid"))),
    )
    return settings.select("image_id", lines.alias("report"))


def sections_in_order(sections: DataFrame) -> DataFrame:
    order = Window.partitionBy("image_id").orderBy(F.lower("title"), "band")
    return sections.withColumn("position", F.row_number().over(order))


def enabled(stored: Column, essential: Column) -> Column:
    """Stored pigment ids that are essential; all essential ones where nothing is left."""
    kept = F.array_sort(F.array_intersect(stored, essential))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.array_sort(essential))


def bias_thresholds(levels: int, bias: float) -> Column:
    return F.array(*[C.num(t) for t in C.thresholds(levels, bias)])
