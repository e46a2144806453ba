"""From variable blocks to one labelled, balanced, normalised and split row per device."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import FACILITY_VALUES, VERSION_VALUES, clean_sentinels, percent
from ..operators.cohort import balance_down, label_frame, split_exact
from ..operators.features import (
    ZScore, bin_label, bin_number, column_names, decile_edges, label_last, multi_hot, safe_name, vocabulary_by_source,
)
from ..operators.joins import attach_small, semi_join_keys, star_join
from ..sources import stage, stage_all, write_csv
from . import activity as act
from . import variables as var
from .study import DISPLAY_NAMES, DURATION_NAMES, Study, Tables

SHARES = (("train", 0.6), ("test", 0.2), ("valid", 0.2))


@dataclass(frozen=True)
class Wide:
    """A wide table with the role of each column: 0/1 flags are never normalised."""

    df: DataFrame
    flags: list[str]
    numerics: list[str]
    key: str = "asset_id"
    label: str = "y_flag"

    @property
    def features(self) -> list[str]:
        return [*self.flags, *self.numerics]


def clean_attributes(long: DataFrame) -> DataFrame:
    """Sentinel values of versions and facility types become ``unknown``."""
    value = (
        F.when(F.col("variable") == "software_version", clean_sentinels("value", VERSION_VALUES))
        .when(F.col("variable") == "facility_type", clean_sentinels("value", FACILITY_VALUES))
        .otherwise(F.col("value"))
    )
    return long.withColumn("value", value).distinct()


def free_space_pct(spaces: DataFrame, types: DataFrame, t: Tables) -> DataFrame:
    """Smallest free space of the type as a share of each free-space value of an asset."""
    typed = attach_small(types.join(spaces, "asset_name"), var.min_free_space(t), ["device_type"])
    return typed.filter(F.col("free_disk_space").isNotNull()).select(
        "asset_name", percent(F.col("min_free_space_by_type"), F.col("free_disk_space")).alias("fs_pct")
    ).distinct()


def device_labels(case_software: DataFrame, control: DataFrame, study: Study) -> DataFrame:
    """Devices of the studied type with their label: case 1, control 0."""
    return label_frame(case_software.filter(F.col("device_type") == study.device_type),
                       control.filter(F.col("device_type") == study.device_type), "asset_name", "asset_tag")


def wide_table(cases: DataFrame, control: DataFrame, t: Tables, study: Study, naming=safe_name,
               bins: str = "edges") -> Wide:
    """The modelling table of one device type before sampling: cases and controls, label last.

    ``cases`` and ``control`` are the cohorts, ideally stored tables. Attributes stay in long form
    up to one pivot; both cohorts share one vocabulary, so no column belongs to one cohort only
    and one reference level is dropped per variable. The activity logs are read once for both
    cohorts together.
    """
    typed_control = control.filter(F.col("device_type") == study.device_type)
    first = stage_all(software=var.case_software(cases, t, study),
                      control_history=var.control_history(typed_control, t, study))
    named, history = first["software"], first["control_history"]
    control_base = stage(var.control_latest(typed_control, t, study, history), "control_base")
    typed = named.filter(F.col("device_type") == study.device_type)
    own_cases = cases.join(typed.select("asset_name").distinct(), "asset_name", "left_semi")
    everyone = cases.select(F.col("asset_name").alias("asset_id"), "device_type").unionByName(
        typed_control.select(F.col("asset_tag").alias("asset_id"), "device_type")).distinct()
    types = typed.select("asset_name", "device_type").distinct().unionByName(
        control_base.select("asset_name", "device_type"))
    spaces = typed.select("asset_name", "free_disk_space").distinct().unionByName(
        var.control_free_space(history))
    stored = stage_all(
        labels=device_labels(named, control, study),
        attributes=clean_attributes(var.case_attributes(own_cases, t, study, named)).withColumn("src", F.lit(1))
        .unionByName(clean_attributes(var.control_attributes(typed_control, t, study, control_base, history))
                     .withColumn("src", F.lit(0))),
        free_space=free_space_pct(spaces, types, t),
        touches=act.touches(everyone, "asset_id", t, study),
    )
    labels, attributes, pct, touch = (stored[n] for n in ("labels", "attributes", "free_space", "touches"))

    # Categories.
    vocab = vocabulary_by_source(attributes, "src")
    hot = multi_hot(attributes, "asset_name", vocab, naming)
    hot_names = list(column_names(vocab, naming).values())

    # Free-space deciles over both cohorts; the last bin is the reference level.
    edges = decile_edges(pct, "fs_pct")
    binned = pct.select("asset_name", F.lit("fs_pct").alias("variable"),
                        bin_number(F.col("fs_pct"), edges).cast("string").alias("value")).distinct()
    bin_names = {str(i): naming(f"fs_pct_{bin_label(edges, i)}") if bins == "edges" else f"fs_pct_{i}"
                 for i in range(1, len(edges) - 1)}
    bin_hot = multi_hot(binned, "asset_name", {"fs_pct": list(bin_names)},
                        lambda n: bin_names[n.removeprefix("fs_pct_")])

    # Activity; the models touched in both cohorts become columns.
    models = vocabulary_by_source(
        touch.join(labels, "asset_id").select(F.lit("touch").alias("variable"),
                                              F.col("anatomy_model").alias("value"), "y_flag"),
        "y_flag", drop_reference=False).get("touch", [])
    model_names = {m: naming(m) for m in models}
    clinics = var.clinic_attributes(own_cases, "asset_name", t, study).unionByName(
        var.clinic_attributes(typed_control, "asset_tag", t, study)
    ).groupBy(F.col("asset_name").alias("asset_id")).agg(F.max("clinic_had_mia").alias("clinic_had_mia"))

    blocks = [
        hot.withColumnRenamed("asset_name", "asset_id"), bin_hot.withColumnRenamed("asset_name", "asset_id"),
        act.ad_activity(everyone, "asset_id", t, study), act.sessions(everyone, "asset_id", t, study),
        act.touch_pivot(touch, model_names), semi_join_keys(var.power_off(t, study), "asset_id", labels), clinics,
    ]
    flags = [*hot_names, *bin_names.values(), "clinic_had_mia"]
    numerics = ["avg_campaigns", *DISPLAY_NAMES.values(), *DURATION_NAMES.values(),
                *act.session_names().values(), *model_names.values(), "avg_times", "avg_days"]
    cells = [f"cast(coalesce(`{c}`, 0) as int) as `{c}`" for c in flags]
    cells += [f"cast(coalesce(`{c}`, 0) as double) as `{c}`" for c in numerics]
    wide = star_join(labels, blocks, "asset_id").selectExpr("asset_id", *cells, "y_flag")
    return Wide(stage(wide, "wide"), flags, numerics)


def balanced(wide: Wide, study: Study) -> Wide:
    """All cases and as many sampled controls.

    Keys are sampled first, on two narrow columns; wide rows move once, in the final semi join.
    """
    keys = wide.df.select(wide.key, wide.label)
    sample = stage(balance_down(keys.filter(F.col(wide.label) == 1), keys.filter(F.col(wide.label) == 0),
                                wide.key, study.seed), "sample")
    return Wide(wide.df.join(sample.select(wide.key), wide.key, "left_semi"), wide.flags, wide.numerics)


def normalised_splits(wide: Wide, study: Study, fit_on: str = "train") -> Wide:
    """Add the split column and z-score the numeric columns.

    ``fit_on='train'`` keeps test rows out of the fit; ``'all'`` fits before the split, as the
    study did.
    """
    parts = stage(split_exact(wide.df.select(wide.key), wide.key, SHARES, study.seed), "splits")
    split = wide.df.join(parts, wide.key)
    sample = split if fit_on == "all" else split.filter(F.col("split") == "train")
    return Wide(ZScore.fit(sample, wide.numerics).apply(split), wide.flags, wide.numerics)


def write_splits(splits: Wide, root: str) -> None:
    """One CSV folder per split, label last, as later runs reuse the same rows."""
    ordered = label_last(splits.df, splits.key, splits.label)
    for part, _ in SHARES:
        write_csv(ordered.filter(F.col("split") == part).drop("split"), f"{root.rstrip('/')}/{part}")
