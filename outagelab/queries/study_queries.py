"""The study's jobs over base tables bound to the benchmark data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import recode_display_name, recode_system_type, rounded
from ..operators.cohort import coverage
from ..operators.features import column_names, multi_hot, vocabulary, vocabulary_rows
from ..plans import activity as act
from ..plans import cohorts, prepare
from ..plans import tables as tab
from ..plans import variables as var
from ..plans.study import DISPLAY_NAMES, DURATION_NAMES, SESSION_MONTHS, SESSION_TYPES
from ..sources import audit, stage
from .binding import CAPPED, STUDY, tables
from .registry import query
from .study_sql import CL, D1, D2, HW, NAME_RECODE, SW, TYPE_RECODE, study_sql


def _cases(t):
    """The stored case cohort: every later job reads it several times."""
    return stage(cohorts.case_cohort(t, STUDY), "cases")


def _control(t):
    return cohorts.control_cohort(t, STUDY)


def _kept_control(t):
    """The stored control cohort, whole: for jobs that read it several times."""
    return stage(_control(t), "control")


def _both(t):
    return _cases(t), _kept_control(t)


def _text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def _round(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(f"`{c}`"), places) for c in cols})


# Cohorts -----------------------------------------------------------------------------------

@query("case_cohort", study_sql("""
select case_id, asset_name, device_type, reason_code, case_asset_id, resolution, client_id, ams_status, ams_id, cmh_id,
       cast(created_date as string) as created_date, cast(closed_date as string) as closed_date from mia"""))
def case_cohort(spark, d):
    return _text(cohorts.case_cohort(tables(spark, d), STUDY), "created_date", "closed_date")


@query("control_cohort", study_sql("from clean"))
def control_cohort(spark, d):
    return _control(tables(spark, d))


@query("control_cap", study_sql("from capped"))
def control_cap(spark, d):
    return cohorts.capped_control(_control(tables(spark, d)), CAPPED)


@query("device_type_counts", study_sql(f"""
select 'named' as source, {NAME_RECODE} as device_type, count(distinct asset_name) as assets
from case_reason_codes group by 2
union all select 'system', {TYPE_RECODE}, count(distinct asset_id) from devices group by 2"""))
def device_type_counts(spark, d):
    t = tables(spark, d)

    def counted(df, kind, key, source):
        return df.groupBy(F.lit(source).alias("source"), kind.alias("device_type")).agg(
            F.count_distinct(key).alias("assets"))
    return counted(t["case_reason_codes"], recode_display_name("device_type"), "asset_name", "named").unionByName(
        counted(t["devices"], recode_system_type("type"), "asset_id", "system"))


@query("cohort_audit", study_sql("""
select 'case' as cohort, count(*) as n_rows, count(distinct asset_name) as n_keys from mia
union all select 'control', count(*), count(distinct asset_tag) from clean
union all select 'capped', count(*), count(distinct asset_tag) from capped"""))
def cohort_audit(spark, d):
    t = tables(spark, d)
    control = _control(t)
    parts = {"case": (cohorts.case_cohort(t, STUDY), "asset_name"), "control": (control, "asset_tag"),
             "capped": (cohorts.capped_control(control, CAPPED), "asset_tag")}
    out = None
    for name, (df, key) in parts.items():
        row = audit(df, key).withColumn("cohort", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@query("coverage_intersect", study_sql("""
select asset_name as asset_id from mia where device_type in ('TV Screen', 'Waiting Room Screen')
intersect select asset_id from devices_history where type in ('AndroidMediaPlayer', 'LinuxMediaPlayer')"""))
def coverage_intersect(spark, d):
    t = tables(spark, d)
    return cohorts.type_coverage(_cases(t), t, ["TV Screen", "Waiting Room Screen"],
                                 ["AndroidMediaPlayer", "LinuxMediaPlayer"])


@query("coverage_by_type", study_sql(f"""
select device_type, count(distinct asset_name) as named,
       count(distinct asset_name) filter (where exists (from devices_history h where h.asset_id = asset_name
             and {TYPE_RECODE.replace("type ", "h.type ").replace("(type)", "(h.type)")} = m.device_type)) as known
from (select asset_name, {NAME_RECODE} as device_type from mia) m group by device_type"""))
def coverage_by_type(spark, d):
    t = tables(spark, d)
    named = stage(_cases(t).select(F.col("asset_name").alias("asset_id"),
                                   recode_display_name("device_type").alias("device_type")).distinct(), "named")
    known = t["devices_history"].select("asset_id", recode_system_type("type").alias("device_type")).distinct()
    covered = coverage(named, known).groupBy("device_type").agg(F.count(F.lit(1)).alias("known"))
    total = named.groupBy("device_type").agg(F.count(F.lit(1)).alias("named"))
    return total.join(covered, "device_type", "left").select("device_type", "named",
                                                            F.coalesce("known", F.lit(0)).alias("known"))


# Device variables --------------------------------------------------------------------------

@query("case_software", study_sql("from sw"))
def case_software(spark, d):
    t = tables(spark, d)
    return var.case_software(_cases(t), t, STUDY)


@query("case_software_min_space", study_sql("from sw left join floor_space using (device_type)"))
def case_software_min_space(spark, d):
    t = tables(spark, d)
    from ..operators.joins import attach_small
    return attach_small(var.case_software(_cases(t), t, STUDY), var.min_free_space(t), ["device_type"])


@query("case_hardware", study_sql("from hw"))
def case_hardware(spark, d):
    t = tables(spark, d)
    return var.case_hardware(_cases(t), t, STUDY)


@query("poweroff_summary", study_sql("select asset_id, avg_times, round(avg_days, 6) as avg_days from power"))
def poweroff_summary(spark, d):
    t = tables(spark, d)
    return _round(var.power_off(t, STUDY), "avg_days")


@query("clinic_flag", study_sql("from mia_clinic"))
def clinic_flag(spark, d):
    t = tables(spark, d)
    return var.clinic_attributes(_cases(t), "asset_name", t, STUDY)


@query("clinic_flag_control", study_sql("from control_clinic"))
def clinic_flag_control(spark, d):
    t = tables(spark, d)
    return var.clinic_attributes(_control(t), "asset_tag", t, STUDY)


def _gap_sql(cohort: str) -> str:
    return study_sql(f"""
select asset_tag, month, export_days, ntw_days, export_days - ntw_days as gap_days from (
  select asset_tag, cast(month(export_date) as bigint) as month, count(distinct export_date) as export_days,
         count(distinct strftime(last_pinged_at, '%Y-%m-%d')) as ntw_days
  from assets_history where asset_tag in ({cohort}) and export_date between {D1} and {D2} group by 1, 2)""")


@query("network_gap_case", _gap_sql("select asset_name from mia"))
def network_gap_case(spark, d):
    t = tables(spark, d)
    return var.network_gap(_cases(t), "asset_name", t, STUDY)


@query("network_gap_control", _gap_sql("select asset_tag from clean"))
def network_gap_control(spark, d):
    t = tables(spark, d)
    return var.network_gap(_control(t), "asset_tag", t, STUDY)


_VARS = ", ".join(["asset_name", "device_type", *SW, "min_free_space_by_type", *HW, "avg_times",
                   "round(avg_days, 6) as avg_days", *CL, "clinic_had_mia"])


def _star(software: str, hardware: str, clinic: str) -> str:
    return f"""select distinct {_VARS}
from (select * from {software}) left join floor_space using (device_type)
left join (select distinct asset_name, {', '.join(HW)} from {hardware}) using (asset_name)
left join (select asset_id as asset_name, avg_times, avg_days from power) using (asset_name)
left join (select asset_name, {', '.join(CL)}, clinic_had_mia from {clinic}) using (asset_name)"""


def _order(*cols: str) -> str:
    return ", ".join(f"{c} desc nulls last" for c in cols)


_ONE = {
    "sw_one": f"select * exclude created_date from sw_all qualify row_number() over (partition by asset_name "
              f"order by {_order('created_date', 'device_type', *SW)}) = 1",
    "hw_one": f"select * exclude created_date from hw_all qualify row_number() over (partition by asset_name "
              f"order by {_order('created_date', *HW)}) = 1",
    "mia_clinic_one": "select * from mia_clinic qualify row_number() over (partition by asset_name "
                      "order by cmh_id desc nulls last) = 1",
    "control_one": "select b.*, v.software_version, s.free_disk_space from battery b "
                  "left join (select asset_name, max(software_version) as software_version from versions group by 1) v "
                  "using (asset_name) left join (select asset_name, max(free_disk_space) as free_disk_space from spaces "
                  "group by 1) s using (asset_name)",
    "control_hw_one": f"select * from control_hw qualify row_number() over (partition by asset_name "
                     f"order by {_order(*HW)}) = 1",
    "control_clinic_one": "select * from control_clinic qualify row_number() over (partition by asset_name "
                         "order by cmh_id desc nulls last) = 1",
    "control_all": "select b.*, v.software_version, s.free_disk_space from battery b left join versions v "
                  "using (asset_name) left join spaces s using (asset_name)",
}


@query("case_variable_combinations", study_sql(_star("sw", "hw", "mia_clinic")))
def case_variable_combinations(spark, d):
    t = tables(spark, d)
    return _round(var.case_variables(_cases(t), t, STUDY, distinct_combinations=True), "avg_days")


@query("case_variable_table", study_sql(_star("sw_one", "hw_one", "mia_clinic_one"), _ONE))
def case_variable_table(spark, d):
    t = tables(spark, d)
    return _round(var.case_variables(_cases(t), t, STUDY), "avg_days")


@query("control_variable_combinations", study_sql(_star("control_all", "control_hw", "control_clinic"), _ONE))
def control_variable_combinations(spark, d):
    t = tables(spark, d)
    return _round(var.control_variables(_kept_control(t), t, STUDY, distinct_combinations=True), "avg_days")


@query("control_variable_table", study_sql(_star("control_one", "control_hw_one", "control_clinic_one"), _ONE))
def control_variable_table(spark, d):
    t = tables(spark, d)
    return _round(var.control_variables(_kept_control(t), t, STUDY), "avg_days")


# Activity ----------------------------------------------------------------------------------

@query("network_off_issues", study_sql("""
select asset_id, count(*) as months_withissues, round(avg(n), 6) as avg_network_issues
from (select asset_id, month(moment) as m, count(distinct event_id) as n from zoned_events
      where asset_id in (from mia_walls) and event_name like '%ExtendedNetworkOffEvent%' group by 1, 2) group by 1"""))
def network_off_issues(spark, d):
    t = tables(spark, d)
    return _round(act.network_off(_cases(t), "asset_name", t, STUDY), "avg_network_issues")


@query("network_off_summary", study_sql("""
select count(distinct asset_id) as assets, min(month(moment)) as first_month, max(month(moment)) as last_month
from zoned_events where asset_id in (from mia_walls) and event_name like '%ExtendedNetworkOffEvent%'"""))
def network_off_summary(spark, d):
    t = tables(spark, d)
    return act.network_off_summary(_cases(t), "asset_name", t, STUDY)


_DAILY = """select asset_id, month(shown_day) as m, avg(vd) as vd, avg(vt) as vt from (
  select asset_id, shown_day, sum(total_displays) filter (where ad_type ilike '%in%stream%') as vd,
         sum(total_duration) filter (where ad_type ilike '%in%stream%') as vt
  from shown where asset_id in (from {walls}) group by 1, 2) group by 1, 2"""
_MONTHLY = """select asset_id, avg(n) as avg_campaigns from (
  select asset_id, month(day) as m, count(distinct campaign_id) as n
  from shown where asset_id in (from {walls}) group by 1, 2) group by 1"""


def _ad_sql(walls: str) -> str:
    cells = ",\n".join(
        f"round(coalesce(sum({src}) filter (where m = {m}), 0), 6) as {name}"
        for src, names in (("vd", DISPLAY_NAMES), ("vt", DURATION_NAMES)) for m, name in names.items())
    return study_sql(f"""select asset_id, round(any_value(avg_campaigns), 6) as avg_campaigns, {cells}
from ({_MONTHLY.format(walls=walls)}) left join ({_DAILY.format(walls=walls)}) using (asset_id) group by asset_id""")


def _ad_rows_sql(walls: str) -> str:
    cells = ",\n".join(
        f"case when m = {m} then round({src}, 6) else 0.0::double end as {name}"
        for src, names in (("vd", DISPLAY_NAMES), ("vt", DURATION_NAMES)) for m, name in names.items())
    return study_sql(f"""select distinct asset_id, round(avg_campaigns, 6) as avg_campaigns, {cells}
from ({_MONTHLY.format(walls=walls)}) left join ({_DAILY.format(walls=walls)}) using (asset_id)""")


def _activity_round(df):
    return _round(df, "avg_campaigns", *DISPLAY_NAMES.values(), *DURATION_NAMES.values())


@query("ad_activity_case", _ad_sql("mia_walls"))
def ad_activity_case(spark, d):
    t = tables(spark, d)
    return _activity_round(act.ad_activity(_cases(t), "asset_name", t, STUDY))


@query("ad_activity_control", _ad_sql("control_walls"))
def ad_activity_control(spark, d):
    t = tables(spark, d)
    return _activity_round(act.ad_activity(_kept_control(t), "asset_tag", t, STUDY))


@query("ad_activity_rows", _ad_rows_sql("mia_walls"))
def ad_activity_rows(spark, d):
    t = tables(spark, d)
    return _activity_round(act.ad_activity_rows(_cases(t), "asset_name", t, STUDY))


@query("ad_activity_folded", _ad_sql("control_walls"))
def ad_activity_folded(spark, d):
    t = tables(spark, d)
    return _activity_round(act.fold_activity_rows(act.ad_activity_rows(_kept_control(t), "asset_tag", t, STUDY)))


@query("ad_types_shown", study_sql("select distinct ad_type from shown where asset_id in (from mia_walls)"))
def ad_types_shown(spark, d):
    t = tables(spark, d)
    return act.cohort_displays(_cases(t), "asset_name", t, STUDY).select("ad_type").distinct()


def _brand_sql(walls: str) -> str:
    return study_sql(f"""select distinct s.asset_id, p.name from shown s
left join sponsors p on p.salesforce_campaign_id = s.campaign_id where s.asset_id in (from {walls})""")


@query("brands_case", _brand_sql("mia_walls"))
def brands_case(spark, d):
    t = tables(spark, d)
    return act.brands(_cases(t), "asset_name", t, STUDY)


@query("brands_control", _brand_sql("control_walls"))
def brands_control(spark, d):
    t = tables(spark, d)
    return act.brands(_control(t), "asset_tag", t, STUDY)


def _session_sql(walls: str) -> str:
    cells = ",\n".join(
        f"round(coalesce(sum(n) filter (where m = {m} and kind = '{kind}'), 0), 6) as {short}_avg_{word}_sessions"
        for m, short in SESSION_MONTHS.items() for kind, word in SESSION_TYPES.items())
    return study_sql(f"""select asset_id, {cells} from (
  select asset_id, month(day) as m, kind, avg(n) as n from (
    select asset_id, cast(moment as date) as day, session_end_type as kind, count(distinct asset_id || session_id) as n
    from zoned_events where event_name like '%SessionEndEvent%' and asset_id in (from {walls}) group by 1, 2, 3)
  group by 1, 2, 3) group by asset_id""")


@query("sessions_case", _session_sql("mia_walls"))
def sessions_case(spark, d):
    t = tables(spark, d)
    return _round(act.sessions(_cases(t), "asset_name", t, STUDY), *act.session_names().values())


@query("sessions_control", _session_sql("control_walls"))
def sessions_control(spark, d):
    t = tables(spark, d)
    return _round(act.sessions(_control(t), "asset_tag", t, STUDY), *act.session_names().values())


def _touch_sql(walls: str) -> str:
    return f"""select assetid as asset_id, anatomy_model, avg(n) as avg_touches from (
  select assetid, anatomy_model, cast(make_timestamp(time * 1000000) as date) as day,
         count(distinct event_datetime) as n
  from model_interaction where cast(event_date as date) between {D1} and {D2} and assetid in (from {walls})
  group by 1, 2, 3) group by 1, 2"""


@query("touches_case", study_sql(
    f"select asset_id, anatomy_model, round(avg_touches, 6) as avg_touches from ({_touch_sql('mia_walls')})"))
def touches_case(spark, d):
    t = tables(spark, d)
    return _round(act.touches(_cases(t), "asset_name", t, STUDY), "avg_touches")


@query("touches_control", study_sql(
    f"select asset_id, anatomy_model, round(avg_touches, 6) as avg_touches from ({_touch_sql('control_walls')})"))
def touches_control(spark, d):
    t = tables(spark, d)
    return _round(act.touches(_control(t), "asset_tag", t, STUDY), "avg_touches")


# Preparation -------------------------------------------------------------------------------

def _attributes_sql(sources: list[tuple[str, list[str]]]) -> str:
    """Distinct (asset, variable, value) rows, with sentinels cleaned."""
    parts = []
    for table, cols in sources:
        for c in cols:
            shown = f"case {c} when true then 'True' when false then 'False' end" if c.startswith("is_") else c
            value = f"coalesce(cast({shown} as string), 'unknown')"
            if c == "software_version":
                value = f"if({value} in ('[APK NOT INSTALLED]', 'nil', 'None', 'NOT INSTALLED'), 'unknown', {value})"
            if c == "facility_type":
                value = f"if({value} = 'Other', 'unknown', {value})"
            parts.append(f"select asset_name, '{c}' as variable, {value} as value from {table}")
    return " union ".join(parts)


_CLINIC_VARS = ["state", "facility_type", "ranking", "specialty"]
_ATTRIBUTES = {
    "case_long": _attributes_sql([("sw", ["software_version", "is_battery_charging"]),
                                  ("hw", ["manufacturer", "model", "sku"]), ("mia_clinic", _CLINIC_VARS)]),
    "control_versions": "select asset_name, software_version from battery left join versions using (asset_name)",
    "control_long": _attributes_sql([("control_versions", ["software_version"]), ("battery", ["is_battery_charging"]),
                                     ("control_hw", ["manufacturer", "model", "sku"]),
                                     ("control_clinic", _CLINIC_VARS)]),
}


@query("case_attributes", study_sql("from case_long", _ATTRIBUTES))
def case_attributes(spark, d):
    t = tables(spark, d)
    return prepare.clean_attributes(var.case_attributes(_cases(t), t, STUDY))


@query("control_attributes", study_sql("from control_long", _ATTRIBUTES))
def control_attributes(spark, d):
    t = tables(spark, d)
    return prepare.clean_attributes(var.control_attributes(_kept_control(t), t, STUDY))


@query("attribute_columns", study_sql("""
select variable, value from (
  select variable, value, count(distinct src) as n,
         row_number() over (partition by variable order by value desc) as from_end
  from (select variable, value, 1 as src from case_long union all select variable, value, 2 from control_long)
  group by 1, 2) where n = 2 and from_end > 1""", _ATTRIBUTES))
def attribute_columns(spark, d):
    """Columns of the multi-hot block: values of both cohorts without each variable's last level."""
    t = tables(spark, d)
    cases, control = _both(t)
    # Stages keep each plan small and read the history once; the answer need not pass the driver.
    history = stage(var.control_history(control, t, STUDY), "history")
    base = stage(var.control_latest(control, t, STUDY, history), "control_base")
    longs = [stage(prepare.clean_attributes(var.case_attributes(cases, t, STUDY)), "long"),
             stage(prepare.clean_attributes(var.control_attributes(control, t, STUDY, base, history)), "long")]
    return vocabulary_rows(*longs)


@query("attribute_hot_sums", study_sql("""
select variable, value, count(distinct asset_name) as devices from (from case_long union all from control_long)
where (variable, value) in (select (variable, value) from (
  select variable, value, count(distinct src) as n,
         row_number() over (partition by variable order by value desc) as from_end
  from (select variable, value, 1 as src from case_long union all select variable, value, 2 from control_long)
  group by 1, 2) where n = 2 and from_end > 1) group by 1, 2""", _ATTRIBUTES))
def attribute_hot_sums(spark, d):
    """Column sums of the multi-hot block, one row per column."""
    t = tables(spark, d)
    cases, control = _both(t)
    longs = [stage(prepare.clean_attributes(var.case_attributes(cases, t, STUDY)), "long"),
             stage(prepare.clean_attributes(var.control_attributes(control, t, STUDY)), "long")]
    vocab = vocabulary(*longs)
    hot = multi_hot(longs[0].unionByName(longs[1]), "asset_name", vocab)
    names = column_names(vocab)
    sums = hot.agg(*[F.sum(n).alias(f"s{i}") for i, n in enumerate(names.values())])
    cells = F.array(*[F.struct(F.lit(k).alias("variable"), F.lit(v).alias("value"), F.col(f"s{i}").alias("devices"))
                      for i, (k, v) in enumerate(names)])
    return sums.select(F.inline(cells))


_FREE_SPACE = """select distinct asset_name, min_free_space_by_type / nullif(free_disk_space, 0) * 100 as pct from (
  select asset_name, device_type, free_disk_space from sw
  union all select b.asset_name, b.device_type, s.free_disk_space from battery b join spaces s using (asset_name))
  join floor_space using (device_type) where free_disk_space is not null"""


@query("free_space_share", study_sql(
    f"select asset_name, round(pct, 6) as fs_pct from ({_FREE_SPACE}) where pct is not null"))
def free_space_share(spark, d):
    t = tables(spark, d)
    cases, control = _both(t)
    pct = _all_free_space(t, cases, control)
    return _round(pct.filter(F.col("fs_pct").isNotNull()), "fs_pct")


def _all_free_space(t, cases, control):
    software = stage(var.case_software(cases, t, STUDY), "software")
    history = stage(var.control_history(control, t, STUDY), "control-history")
    types = var.control_latest(control, t, STUDY, history).select("asset_name", "device_type")
    own = prepare.free_space_pct(software.select("asset_name", "device_type", "free_disk_space").select(
        "asset_name", "free_disk_space"), software.select("asset_name", "device_type").distinct(), t)
    return own.unionByName(prepare.free_space_pct(var.control_free_space(history), types, t)).distinct()


_WALL_LABELS = {
    "wall_labels": """select distinct asset_name as asset_id, 1 as y_flag from sw where device_type = 'WALLBOARD'
union all select distinct asset_tag, 0 from clean where device_type = 'WALLBOARD'""",
}


def _wide(spark, d):
    t = tables(spark, d)
    cases, control = _both(t)
    return prepare.wide_table(cases, control, t, STUDY, bins="ordinal")


@query("wide_table", study_sql(f"""
select asset_id, y_flag, coalesce(round(any_value(avg_campaigns), 6), 0) as avg_campaigns,
       coalesce(round(any_value(aug), 6), 0) as aug_video_displays, coalesce(any_value(avg_times), 0)::double as avg_times,
       coalesce(round(any_value(avg_days), 6), 0) as avg_days, coalesce(max(clinic_had_mia), 0) as clinic_had_mia,
       coalesce(round(any_value(heart), 6), 0) as heart
from wall_labels
left join (select * from ({_MONTHLY.format(walls='mia_walls')}) union all ({_MONTHLY.format(walls='control_walls')})) using (asset_id)
left join (select asset_id, vd as aug from ({_DAILY.format(walls='mia_walls')}) where m = 8
           union all select asset_id, vd from ({_DAILY.format(walls='control_walls')}) where m = 8) using (asset_id)
left join power using (asset_id)
left join (select asset_name as asset_id, clinic_had_mia from mia_clinic
           union select asset_name, clinic_had_mia from control_clinic) using (asset_id)
left join (select asset_id, avg_touches as heart from ({_touch_sql('mia_walls')}) where anatomy_model = 'Heart'
           union all select asset_id, avg_touches from ({_touch_sql('control_walls')}) where anatomy_model = 'Heart') using (asset_id)
group by asset_id, y_flag""", _WALL_LABELS))
def wide_table(spark, d):
    """One row per device of the studied type; a selection of the columns is checked."""
    wide = _wide(spark, d).df
    return _round(wide.select("asset_id", "y_flag", "avg_campaigns",
                              F.col("AUG_avg_video_dispalys").alias("aug_video_displays"), "avg_times", "avg_days",
                              "clinic_had_mia", F.col("Heart").alias("heart")),
                  "avg_campaigns", "aug_video_displays", "avg_days", "heart")


@query("wide_flag_sums", study_sql("""
select variable, value, count(distinct asset_name) as devices from (
  select * from case_long where asset_name in (select asset_id from wall_labels where y_flag = 1)
  union all select * from control_long where asset_name in (select asset_id from wall_labels where y_flag = 0))
where (variable, value) in (select (variable, value) from (
  select variable, value, count(distinct y_flag) as n,
         row_number() over (partition by variable order by value desc) as from_end
  from (select variable, value, 1 as y_flag from case_long where asset_name in (select asset_id from wall_labels where y_flag = 1)
        union all select variable, value, 0 from control_long where asset_name in (select asset_id from wall_labels where y_flag = 0))
  group by 1, 2) where n = 2 and from_end > 1) group by 1, 2""", {**_ATTRIBUTES, **_WALL_LABELS}))
def wide_flag_sums(spark, d):
    """Column sums of the wide table's attribute flags."""
    t = tables(spark, d)
    cases, control = _both(t)
    sep = "\u0001"
    wide = prepare.wide_table(cases, control, t, STUDY, naming=lambda n: n, bins="ordinal")
    split = {c: next(((v, c[len(v) + 1:]) for v in prepare_variables() if c.startswith(v + "_")), None)
             for c in wide.flags}
    kept = {c: p for c, p in split.items() if p}
    sums = wide.df.agg(*[F.sum(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(kept)])
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.lit(x).alias("value"), F.col(f"s{i}").alias("devices"))
                      for i, (v, x) in enumerate(kept.values())])
    return sums.select(F.inline(cells)).filter(F.col("value") != sep)


def prepare_variables():
    from ..plans.study import CATEGORICAL
    return CATEGORICAL


def _sampled(spark, d):
    return prepare.balanced(_wide(spark, d), STUDY)


_SAMPLE = {
    **_WALL_LABELS,
    "sampled": f"""select asset_id, y_flag from wall_labels where y_flag = 1 union all
select asset_id, y_flag from (select *, row_number() over (order by md5(asset_id || '|{STUDY.seed}'), asset_id) as r
  from wall_labels where y_flag = 0) where r <= (select count(*) from wall_labels where y_flag = 1)""",
    "wall_split": f"""select asset_id, y_flag, case when r <= floor(n * 0.6) then 'train' when r <= floor(n * 0.8) then 'test'
  else 'valid' end as split from (
  select *, row_number() over (order by md5(asset_id || '|{STUDY.seed}'), asset_id) as r, count(*) over () as n from sampled)""",
    "raw_power": "select s.*, coalesce(avg_times, 0)::double as avg_times, coalesce(avg_days, 0) as avg_days "
                 "from wall_split s left join power using (asset_id)",
}


@query("balanced_devices", study_sql("from sampled", _SAMPLE))
def balanced_devices(spark, d):
    """Sampling needs the labels only, not the wide rows."""
    t = tables(spark, d)
    cases, control = _both(t)
    found = stage(prepare.device_labels(var.case_software(cases, t, STUDY), control, STUDY), "labels")
    return prepare.balanced(prepare.Wide(found, [], []), STUDY).df


@query("prepare_splits", study_sql("""
select asset_id, y_flag, split,
       round((avg_times - avg(avg_times) over ()) / stddev_samp(avg_times) over (), 6) + 0.0 as avg_times,
       round((avg_days - avg(avg_days) over ()) / stddev_samp(avg_days) over (), 6) + 0.0 as avg_days
from raw_power""", _SAMPLE))
def prepare_splits(spark, d):
    """Normalised and split sample, with the z-score fitted on all rows."""
    out = prepare.normalised_splits(_sampled(spark, d), STUDY, fit_on="all").df
    return _round(out.select("asset_id", "y_flag", "split", "avg_times", "avg_days"), "avg_times", "avg_days")


@query("prepare_splits_train_fit", study_sql("""
select asset_id, y_flag, split,
       round((avg_times - avg(avg_times) filter (where split = 'train') over ())
             / stddev_samp(avg_times) filter (where split = 'train') over (), 6) + 0.0 as avg_times
from raw_power""", _SAMPLE))
def prepare_splits_train_fit(spark, d):
    """The same with the z-score fitted on the training rows only."""
    out = prepare.normalised_splits(_sampled(spark, d), STUDY).df
    return _round(out.select("asset_id", "y_flag", "split", "avg_times"), "avg_times")


@query("category_profile", study_sql("""
select variable, split, y_flag, devices, total, round(devices / total * 100, 6) as pct from (
  select *, cast(sum(devices) over (partition by variable, split) as bigint) as total from (
    select variable || '_' || value as variable, split, y_flag, count(distinct asset_id) as devices
    from wall_split join (select asset_name as asset_id, 1 as y_flag, variable, value from case_long
                          union all select asset_name, 0, variable, value from control_long) using (asset_id, y_flag)
    where split <> 'valid' and variable in ('is_battery_charging', 'manufacturer')
      and variable || '_' || value not in ('is_battery_charging_unknown', 'manufacturer_unknown')
    group by 1, 2, 3))""", {**_ATTRIBUTES, **_SAMPLE}))
def category_profile(spark, d):
    """Prevalence of the battery and manufacturer flags."""
    splits = prepare.normalised_splits(_sampled(spark, d), STUDY, fit_on="all")
    return _round(tab.category_profile(splits).filter(
        F.col("variable").startswith("is_battery_charging_") | F.col("variable").startswith("manufacturer_")
    ).select("variable", "split", "y_flag", "devices", "total", "pct"), "pct")


@query("numeric_table", study_sql("""
select variable, split,
""" + ",\n".join(f"round({f}(v) filter (where y_flag = {y}), 6) as {n}_{y}"
                 for f, n in (("avg", "mean"), ("median", "median"), ("min", "min"), ("max", "max")) for y in (0, 1)) + """
from (select split, y_flag, 'avg_times' as variable, avg_times as v from raw_power
      union all select split, y_flag, 'avg_days', avg_days from raw_power)
where split <> 'valid' group by 1, 2""", _SAMPLE))
def numeric_table(spark, d):
    """Numeric profile on values before normalisation."""
    wide = _wide(spark, d)
    splits = prepare.normalised_splits(prepare.balanced(wide, STUDY), STUDY, fit_on="all")
    raw = prepare.Wide(wide.df, wide.flags, ["avg_times", "avg_days"])
    out = tab.numeric_table(splits, raw)
    return _round(out, *[c for c in out.columns if c not in ("variable", "split")])
