"""Queries over cohorts, labels, notes, events, frames, wide tables, signals and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import (
    audit,
    checks,
    cohort,
    events,
    frames,
    labels,
    metadata,
    notes,
    scenario,
    signals,
    splits,
    tabular,
)
from ..plans.loop import schedule_table
from ..session import scratch_path
from ..sources import sinks, tables
from . import bindings as B
from .oracle_views import N, R, sql_clean_note, sql_group3, sql_number
from .registry import query

U = B.DUCK.u

# -- cohort -----------------------------------------------------------------------


@query("stays_without_transfer", "B1", "select stay_id, subject_id from raw_stays where first_ward = last_ward and first_unit = last_unit")
def _(t):
    return cohort.without_transfer(t.raw_stays).select("stay_id", "subject_id")


@query("stays_with_admission", "C1",
       "select s.stay_id, a.ethnicity from raw_stays s join raw_admissions a on s.subject_id = a.subject_id and s.hadm_id = a.hadm_id")
def _(t):
    return cohort.with_admission(t.raw_stays, t.raw_admissions).select("stay_id", "ethnicity")


@query("stays_with_patient", "C2", "select s.stay_id, p.gender from raw_stays s join raw_patients p on s.subject_id = p.subject_id")
def _(t):
    return cohort.with_patient(t.raw_stays, t.raw_patients).select("stay_id", "gender")


@query("single_stay_admissions", "D1", "select hadm_id, stay_id from stays_single")
def _(t):
    joined = cohort.with_patient(cohort.with_admission(cohort.without_transfer(t.raw_stays), t.raw_admissions), t.raw_patients)
    return cohort.single_stay_admissions(joined).select("hadm_id", "stay_id")


@query("stay_age", "B2", f"""
    select stay_id, {R('age')} as age from (select stay_id, case when a < 0 then 90.0::double else a end as age from (
      select stay_id, (epoch_us(intime) - epoch_us(born)) / 3.6e9::double / 24.0::double / 365.0::double as a
      from raw_stays s join raw_patients p on s.subject_id = p.subject_id) x) y where age >= 18""")
def _(t):
    return cohort.with_age(cohort.with_patient(t.raw_stays, t.raw_patients)).select("stay_id", "age")


@query("stay_length_at_least", "B3 H18", f"""
    select stay_id, {R('l')} as los_hours from (
      select stay_id, (epoch_us(outtime) - epoch_us(intime)) / 3.6e9::double as l from raw_stays) x where l >= 48""")
def _(t):
    return cohort.with_los(t.raw_stays, 48.0).select("stay_id", "los_hours")


@query("cohort_stays", "I1 B8", f"""
    select subject_id, hadm_id, stay_id, first_unit, dbsource, {R('los_hours')} as los_hours, {R('age')} as age, gender, ethnicity from stays""")
def _(t):
    return t.stays.drop("intime", "outtime")


@query("cohort_partitions", "I2 A6", "select stay_id, subject_id, partition from split_stays")
def _(t):
    found = {}
    for name in ("test", "val"):
        path = scratch_path(t.spark, f"{name}-list")
        t.subject_lists.filter(F.col("list") == name).select("subject_id", "flag").write.csv(path)
        found[name] = cohort.subject_list(tables.subject_file(t.spark, path))
    return cohort.assign_partitions(t.stays, found["test"], found["val"]).select("stay_id", "subject_id", "partition")


@query("subject_list_overlap", "I2", """
    select 'subject in both test and val list' as "check", count(*) as violations from (
      select subject_id from subject_lists where flag = 1 and list = 'test' intersect
      select subject_id from subject_lists where flag = 1 and list = 'val') x""")
def _(t):
    return cohort.split_overlap(
        cohort.subject_list(t.subject_lists.filter("list = 'test'")), cohort.subject_list(t.subject_lists.filter("list = 'val'"))
    )


@query("unit_codes", "I12", "select first_unit, cast(row_number() over (order by first_unit) - 1 as int) as unit_code from (select distinct first_unit from stays) x")
def _(t):
    return cohort.unit_codes(t.stays)


@query("stay_one_subject", "J6", """
    select 'stay maps to several subjects' as "check", count(*) as violations from (
      select stay_id from raw_stays group by stay_id having count(distinct subject_id) > 1) x""")
def _(t):
    return cohort.one_subject_per_stay(t.raw_stays)


@query("first_stays_by_id", "B13", "select stay_id from stays order by stay_id limit 100")
def _(t):
    return cohort.first_stays(t.stays, 100).select("stay_id")


@query("partition_and_label_counts", "D22", """
    with x as (select l.label, s.partition from stay_labels l join split_stays s on l.stay_id = s.stay_id)
    select partition, '(rows)' as label, count(*) as n from split_stays group by partition union all
    select partition, label, count(*) from x group by partition, label union all
    select '(all)', label, count(*) from x group by label""")
def _(t):
    return cohort.split_counts(t.split_stays, labels.stay_groups(t.coded))


@query("note_window_population", "B9 I6", """
    select s.stay_id, coalesce(o.first_note_hours <= 2, false) as has_note
    from (select *, (epoch_us(outtime) - epoch_us(intime)) / 3.6e9::double as los from note_stays) s
    left join note_offsets o on s.stay_id = o.stay_id where los >= 2""")
def _(t):
    stays = cohort.with_los(t.note_stays)
    return cohort.window_population(stays, t.note_offsets, 2.0, False).select("stay_id", "has_note")


@query("cohort_sizing_grid", "I23 D8", f"""
    with s as (select *, (epoch_us(outtime) - epoch_us(intime)) / 3.6e9::double as los from note_stays),
    g as (select unnest([1.0, 2.0, 3.0])::double as duration),
    l as (select duration, s.stay_id, s.hadm_id, coalesce(first_note_hours <= duration, false) as noted
          from s cross join g left join note_offsets o on s.stay_id = o.stay_id where los >= duration),
    d as (select n.hadm_id, d.grp, d.source_row from dx_groups d join (select distinct hadm_id, subject_id from note_stays) n on d.hadm_id = n.subject_id),
    sc as (select h.duration, d.* from d join (select distinct duration, hadm_id from l where noted) h on d.hadm_id = h.hadm_id),
    f as (select duration, grp, row_number() over (partition by duration order by count(*) desc, min(source_row), grp) as rn from sc group by duration, grp),
    k as (select duration, grp from f where rn <= 60),
    ph as (select sc.duration, hadm_id, count(distinct sc.grp) as n from sc join k on sc.duration = k.duration and sc.grp = k.grp group by sc.duration, hadm_id)
    select a.duration, a.long_enough, a.with_note, coalesce(c.final_cohort, 0) as final_cohort, coalesce(b.label_groups, 0) as label_groups,
           {R('c.labels_per_stay')} as labels_per_stay, coalesce(c.final_cohort, 0) * cast(a.duration as bigint) as step_rows
    from (select duration, count(*) as long_enough, count(*) filter (noted) as with_note from l group by duration) a
    left join (select duration, count(*) as label_groups from k group by duration) b on a.duration = b.duration
    left join (select l.duration, count(*) as final_cohort, avg(n) as labels_per_stay from l join ph on l.duration = ph.duration and l.hadm_id = ph.hadm_id where noted group by l.duration) c
      on a.duration = c.duration""")
def _(t):
    stays = cohort.with_los(t.note_stays)
    link = t.note_stays.select("hadm_id", F.col("subject_id").alias("_s")).distinct()
    groups = t.dx_groups.withColumnRenamed("hadm_id", "_s").join(link, "_s").select("hadm_id", "grp", "source_row")
    return cohort.sizing_grid(stays, t.note_offsets, groups, [1.0, 2.0, 3.0], 60)


# -- labels -----------------------------------------------------------------------


@query("group_dimension", "A4", "select grp, cast(group_id as int) as group_id, use_flag, code from ccs")
def _(t):
    path = scratch_path(t.spark, "groups")
    t.ccs.groupBy("grp", "group_id", "use_flag").agg(F.collect_list("code").alias("codes")).write.json(path)
    # Codes in two groups are rows of the SQL too; group_dimension_findings counts them.
    return labels.group_dimension(tables.group_definitions(t.spark, path, strict=False))


@query("group_dimension_findings", "A4", """
    select 'code in two groups' as "check", (select count(*) from (select code from ccs group by code having count(distinct grp) > 1)) as violations
    union all select 'group id used twice', (select count(*) from (select group_id from ccs group by group_id having count(distinct grp) > 1))""")
def _(t):
    packed = t.ccs.groupBy("grp", "group_id", "use_flag").agg(F.collect_list("code").alias("codes"))
    return labels.group_dimension_findings(packed)


@query("dictionary_codes", "C3", "select d.source_row, d.code, c.title from raw_dx d join dictionary c on d.code = c.code")
def _(t):
    return labels.known_codes(t.raw_dx, t.dictionary).select("source_row", "code", "title")


@query("diagnoses_to_stays", "C4", "select stay_id, seq, code from dx_stays")
def _(t):
    return labels.to_stays(labels.known_codes(t.raw_dx, t.dictionary), t.stays).select("stay_id", "seq", "code")


@query("code_groups", "C5", "select d.source_row, c.grp, c.use_flag from raw_dx d left join ccs c on d.code = c.code")
def _(t):
    return labels.attach_groups(t.raw_dx, t.ccs).select("source_row", "grp", "use_flag")


@query("coded_diagnoses", "I3 F1", "select stay_id, seq, code, grp, use_flag from coded order by stay_id, seq")
def _(t):
    return labels.coded_diagnoses(t.raw_dx, t.dictionary, t.stays, t.ccs).select("stay_id", "seq", "code", "grp", "use_flag")


@query("cohort_diagnoses", "C11", "select source_row from raw_dx where hadm_id in (select hadm_id from stays)")
def _(t):
    return t.raw_dx.join(t.stays.select("hadm_id"), "hadm_id", "left_semi").select("source_row")


@query("stay_group_set", "D7", "select stay_id, label from stay_labels")
def _(t):
    return labels.stay_groups(t.coded)


@query("flagged_label_names", "F6", "select grp as label, cast(row_number() over (order by grp) - 1 as int) as ord from (select distinct grp from definitions where use_flag) x")
def _(t):
    return labels.flagged_names(t.definitions)


@query("flagged_labels", "I4", """
    select l.stay_id, l.label, o.ord from stay_labels l join (select grp, cast(row_number() over (order by grp) - 1 as int) as ord
      from (select distinct grp from definitions where use_flag) x) o on l.label = o.grp""")
def _(t):
    return labels.flagged_labels(t.stays, t.coded, t.definitions).select("stay_id", "label", "ord")


_FREQ = """(select label, episodes, group_id, cast(row_number() over (order by group_id, label) - 1 as int) as ord from (
    select l.label, count(*) as episodes, min(d.group_id) as group_id from stay_labels l join definitions d on l.label = d.grp
    group by l.label having count(*) >= 30) f)"""


@query("frequent_label_names", "D6", f"select label, episodes, ord from {_FREQ} f")
def _(t):
    return labels.frequent_names(t.coded, t.definitions, t.stays, 30).select("label", "episodes", "ord")


@query("frequent_labels", "I5 I24", f"select l.stay_id, l.label, f.ord from stay_labels l join {_FREQ} f on l.label = f.label")
def _(t):
    return labels.frequent_labels(t.stays, t.coded, t.definitions, 30).select("stay_id", "label", "ord")


@query("label_positive_counts", "I24 D24", "select label, count(*) as positives from stay_labels group by label")
def _(t):
    return labels.positive_counts(labels.stay_groups(t.coded))


@query("diagnosis_group3", "H2", f"select source_row, {sql_group3('code')} as grp from raw_dx")
def _(t):
    return t.raw_dx.select("source_row", C.diagnosis_group3(F.col("code")).alias("grp"))


_TOP = """(select grp, n, cast(row_number() over (order by grp) - 1 as int) as ord from (
    select grp, count(*) as n, min(source_row) as f from dx_groups group by grp order by n desc, f, grp limit 100) x)"""


@query("top_diagnosis_groups", "D5", f"select grp, n, ord from {_TOP} x")
def _(t):
    return labels.top_groups(t.dx_groups, 100).select("grp", "n", "ord")


@query("window_label_positives", "I6 B10", """
    with p as (select stay_id, hadm_id from stays where los_hours >= 48),
    s as (select d.* from dx_groups d where hadm_id in (select hadm_id from p)),
    k as (select grp, row_number() over (order by grp) - 1 as ord from (select grp, count(*) as n, min(source_row) as f from s group by grp order by n desc, f, grp limit 100) x)
    select distinct p.stay_id, s.grp as label, cast(k.ord as int) as ord from p join s on p.hadm_id = s.hadm_id join k on s.grp = k.grp""")
def _(t):
    return labels.window_labels(t.stays.filter("los_hours >= 48"), t.dx_groups, 100)


@query("stays_with_label", "B10", "select stay_id from stays where stay_id in (select stay_id from stay_labels)")
def _(t):
    return cohort.with_positive_label(t.stays, labels.stay_groups(t.coded), "stay_id").select("stay_id")


@query("label_matrix", "A14", "select s.stay_id, " + ", ".join(
    f"cast(coalesce(max(case when l.label = '{b}' then 1 end), 0) as int) as \"{b}\"" for b in B.BRANDS
) + " from stays s left join stay_labels l on s.stay_id = l.stay_id group by s.stay_id")
def _(t):
    return labels.label_matrix(t.stays, labels.stay_groups(t.coded), B.BRANDS)


@query("label_metadata", "A20", "select 'flagged' as task, cast(row_number() over (order by grp) - 1 as int) as ord, grp as label from (select distinct grp from definitions where use_flag) x")
def _(t):
    return labels.label_metadata(labels.flagged_names(t.definitions), "flagged")


@query("label_prevalence_top", "D24", "select label, count(*) as positives from stay_labels group by label order by 2 desc, 1 limit 50")
def _(t):
    return labels.prevalence_top(labels.stay_groups(t.coded))


@query("label_cardinality_histogram", "D24", """
    select labels, count(*) as items from (select s.stay_id, count(l.label) as labels from stays s left join stay_labels l on s.stay_id = l.stay_id group by s.stay_id) x group by labels""")
def _(t):
    return labels.cardinality_histogram(t.stays, labels.stay_groups(t.coded))


@query("label_cooccurrence", "D25", f"""
    with n as (select label, count(*) as n from stay_labels group by label order by 2 desc, 1 limit 25)
    select a.label as left_label, b.label as right_label, count(*) as both, {R('count(*) / greatest(sqrt(max(x.n) * max(y.n)), 1.0)')} as cosine
    from stay_labels a join stay_labels b on a.stay_id = b.stay_id join n x on a.label = x.label join n y on b.label = y.label
    group by a.label, b.label""")
def _(t):
    return labels.cooccurrence(labels.stay_groups(t.coded), 25)


@query("label_cooccurrence_density", "D25", f"""
    with c as (select distinct a.label as l, b.label as r from stay_labels a join stay_labels b on a.stay_id = b.stay_id)
    select count(*) as pairs, {R('count(*) / (25.0 * 25.0)')} as density from c""")
def _(t):
    names = t.definitions.select(F.col("grp").alias("label"), (F.col("group_id") - 1).alias("ord"))
    return labels.cooccurrence_density(labels.stay_groups(t.coded), names)


@query("label_coverage_by_split", "D26", "select partition, count(distinct label) as labels from stay_labels l join split_stays s on l.stay_id = s.stay_id group by partition")
def _(t):
    return labels.split_coverage(t.split_stays, labels.stay_groups(t.coded))


@query("label_counts_by_split", "D23", """
    select g.partition, g.label, count(s.stay_id) as n from (select grp as label, unnest(['train', 'val', 'test']) as partition from definitions) g
    left join (select l.stay_id, l.label, s.partition from stay_labels l join split_stays s on l.stay_id = s.stay_id) s
      on g.label = s.label and g.partition = s.partition group by g.partition, g.label""")
def _(t):
    names = t.definitions.select(F.col("grp").alias("label"))
    return labels.absent_labels(t.split_stays, labels.stay_groups(t.coded), names, list(cohort.SPLITS), "stay_id")


@query("label_frequency_rank", "E12", """
    select label, ord, coalesce(n, 0) as positives, row_number() over (order by coalesce(n, 0) desc, ord) as freq_rank from (
      select grp as label, cast(group_id as int) - 1 as ord from definitions) d
    left join (select l.label as lab, count(*) as n from stay_labels l join split_stays s on l.stay_id = s.stay_id where partition = 'train' group by 1) c on d.label = c.lab""")
def _(t):
    names = t.definitions.select(F.col("grp").alias("label"), (F.col("group_id") - 1).alias("ord"))
    train = labels.stay_groups(t.coded).join(t.split_stays.filter("partition = 'train'").select("stay_id"), "stay_id", "left_semi")
    return labels.frequency_ranks(train, names)


# -- notes ------------------------------------------------------------------------


@query("usable_notes", "B4", "select source_row from usable_notes")
def _(t):
    return notes.usable(t.raw_notes).select("source_row")


@query("note_cleaning", "H1", f"select source_row, {sql_clean_note('text')} as body from raw_notes")
def _(t):
    return t.raw_notes.select("source_row", C.clean_note(F.col("text")).alias("body"))


@query("note_variable_name", "H3", "select source_row, coalesce(category, 'nan') || '/' || coalesce(description, 'nan') as variable from raw_notes")
def _(t):
    return t.raw_notes.select("source_row", C.variable_name(F.col("category"), F.col("description")).alias("variable"))


@query("notes_on_stays", "C9", f"select source_row, stay_id, {R('hours')} as hours from timed_notes")
def _(t):
    return notes.on_stays(notes.usable(t.raw_notes), t.note_stays).select("source_row", "stay_id", "hours")


@query("first_note_offset", "D2", f"select stay_id, {R('first_note_hours')} as first_note_hours from note_offsets")
def _(t):
    return t.note_offsets


_LATEST = f"""(select stay_id, variable, hours, source_row, {sql_clean_note("coalesce(text, ' ')")} as body from (
    select *, coalesce(category, 'nan') || '/' || coalesce(description, 'nan') as variable,
           row_number() over (partition by stay_id, coalesce(category, 'nan') || '/' || coalesce(description, 'nan') order by hours desc, source_row) as rn
    from timed_notes where hours >= 0 and hours <= 2) x where rn = 1)"""


@query("latest_note_per_variable", "E1", f"select stay_id, variable, {R('hours')} as hours, source_row, body from {_LATEST} x")
def _(t):
    return notes.latest_per_variable(t.raw_notes, t.note_stays, 2.0)


@query("joined_latest_notes", "H4", f"select stay_id, string_agg(body, chr(10) order by variable) as text from {_LATEST} x group by stay_id")
def _(t):
    return notes.joined_text(notes.latest_per_variable(t.raw_notes, t.note_stays, 2.0), "variable")


_CHRON = f"""(select stay_id, charttime, source_row, {sql_clean_note("coalesce(text, ' ')")} as body from timed_notes
    where (category in ('Nursing', 'Physician ') and charttime between intime and outtime) or category = 'Discharge summary')"""


@query("notes_in_stay_or_discharge", "B6 E2", f"select stay_id, source_row, body from {_CHRON} x")
def _(t):
    return notes.chronological(t.raw_notes, t.note_stays).select("stay_id", "source_row", "body")


@query("joined_chronological_notes", "H4 E2", f"select stay_id, string_agg(body, chr(10) order by charttime, source_row) as text from {_CHRON} x group by stay_id")
def _(t):
    return notes.joined_text(notes.chronological(t.raw_notes, t.note_stays), "charttime", "source_row")


@query("attach_note_tokens", "C6 H30", """
    select s.stay_id, o.stay_id is not null as notes_available,
           case when o.stay_id is null then 101 else 7 end as first_token, case when o.stay_id is null then 102 else 8 end as second_token,
           8 as tokens, case when o.stay_id is null then 2 else 8 end as mask_sum
    from note_stays s left join note_offsets o on s.stay_id = o.stay_id""")
def _(t):
    tok = t.note_offsets.select(
        "stay_id",
        F.array(*[F.lit(i + 7) for i in range(8)]).alias("input_ids"),
        F.array_repeat(F.lit(0), 8).alias("token_type_ids"),
        F.array_repeat(F.lit(1), 8).alias("attention_mask"),
    )
    out = notes.attach_notes(t.note_stays, tok, 8)
    return out.select(
        "stay_id",
        "notes_available",
        F.element_at("input_ids", 1).alias("first_token"),
        F.element_at("input_ids", 2).alias("second_token"),
        F.size("input_ids").alias("tokens"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"),
    )


@query("stays_with_note", "B14", "select stay_id from note_stays where stay_id in (select stay_id from note_offsets)")
def _(t):
    return t.note_stays.join(t.note_offsets, "stay_id", "left_semi").select("stay_id")


# -- events and frames ------------------------------------------------------------


@query("event_union_scan", "A2", "select subject_id, stay_id, item_id, value, uom from raw_events")
def _(t):
    by_id = t.raw_events.filter("stay_id is not null")
    without = t.raw_events.filter("stay_id is null").drop("stay_id")
    return events.event_scan(by_id, without).drop("charttime")


@query("item_map", "A5", "select cast(item_id as int) as item_id, variable, item_label from items where variable <> 'Heart Rate'")
def _(t):
    path = scratch_path(t.spark, "item-map")
    t.items.select(
        F.col("item_id").alias("ITEMID"),
        F.col("variable").alias("LEVEL2"),
        F.lit(1).alias("COUNT"),
        F.when(F.col("variable") == "Heart Rate", "draft").otherwise("ready").alias("STATUS"),
        F.col("item_label").alias("MIMIC LABEL"),
    ).write.option("header", True).csv(path)
    return tables.item_map_file(t.spark, path)


@query("events_in_scope", "B5", """
    select event_id from raw_events where charttime is not null and item_id in (select item_id from items) and subject_id in (select subject_id from ev_stays)""")
def _(t):
    return events.in_scope(t.raw_events, t.ev_stays, t.items).select("event_id")


@query("blood_pressure", "H5", f"""
    select event_id, {R("coalesce(" + sql_number('value') + ", try_cast(nullif(regexp_extract(value, '^(\\d+)/(\\d+)$', 1), '') as double))")} as systolic,
           {R("coalesce(" + sql_number('value') + ", try_cast(nullif(regexp_extract(value, '^(\\d+)/(\\d+)$', 2), '') as double))")} as diastolic from raw_events""")
def _(t):
    v = F.col("value")
    return t.raw_events.select("event_id", events.systolic(v).alias("systolic"), events.diastolic(v).alias("diastolic"))


_NUM = sql_number("value")


@query("capillary_refill", "H6", """
    select event_id, case when w in ('Normal <3 secs', 'Brisk') then 0.0::double when w in ('Abnormal >3 secs', 'Delayed') then 1.0::double end as refill
    from (select event_id, case event_type when 'click' then 'Brisk' when 'error' then 'Delayed' when 'view' then 'Normal <3 secs' when 'signup' then 'Abnormal >3 secs' else event_type end as w from events) x""")
def _(t):
    words = F.create_map(*[F.lit(x) for x in ("click", "Brisk", "error", "Delayed", "view", "Normal <3 secs", "signup", "Abnormal >3 secs")])
    w = F.coalesce(F.try_element_at(words, F.col("event_type")), F.col("event_type"))
    return t.raw("events").select("event_id", events.capillary_refill(w).alias("refill"))


@query("oxygen_fraction", "H7", f"""
    select event_id, {R(f"case when lower(coalesce(uom, '')) not like '%torr%' and {_NUM} > 1 then {_NUM} / 100.0::double else {_NUM} end")} as fio2
    from (select event_id, value, case when item_id = 1 then 'Torr' else uom end as uom from raw_events) x""")
def _(t):
    uom = F.when(F.col("item_id") == 1, "Torr").otherwise(F.col("uom"))
    return t.raw_events.select("event_id", events.oxygen_fraction(F.col("value"), uom).alias("fio2"))


@query("lab_value", "H8 H13", f"select event_id, {R(_NUM)} as lab from (select event_id, case when item_id = 2 then value || 'd' else value end as value from raw_events) x")
def _(t):
    v = F.when(F.col("item_id") == 2, F.concat("value", F.lit("d"))).otherwise(F.col("value"))
    return t.raw_events.select("event_id", events.lab_value(v).alias("lab"))


@query("oxygen_saturation", "H9", f"select event_id, {R(f'case when {_NUM} <= 1 then {_NUM} * 100.0::double else {_NUM} end')} as o2 from raw_events")
def _(t):
    return t.raw_events.select("event_id", events.oxygen_saturation(F.col("value")).alias("o2"))


@query("temperature", "H10", f"""
    select event_id, {R(f"case when lower(coalesce(uom, '')) like '%f%' or {_NUM} >= 79 then ({_NUM} - 32.0::double) * 5.0::double / 9.0::double else {_NUM} end")} as temperature from raw_events""")
def _(t):
    return t.raw_events.select("event_id", events.temperature(F.col("value"), F.col("uom"), F.lit("Temp C")).alias("temperature"))


@query("weight", "H11", f"""
    select event_id, {R(f"case when u = 'oz' then {_NUM} / 16.0::double * 0.453592::double when u = 'lb' then {_NUM} * 0.453592::double else {_NUM} end")} as weight
    from (select event_id, value, case item_id when 1 then 'oz' when 3 then 'lb' else 'kg' end as u from raw_events) x""")
def _(t):
    u = F.when(F.col("item_id") == 1, "OZ").when(F.col("item_id") == 3, "lb").otherwise("kg")
    return t.raw_events.select("event_id", events.weight(F.col("value"), u, F.lit(None).cast("string")).alias("weight"))


@query("height", "H12", f"""
    select event_id, {R(f"case when item_id = 3 then round_even({_NUM} * 2.54::double, 0) else {_NUM} end")} as height from raw_events""")
def _(t):
    u = F.when(F.col("item_id") == 3, "Inch").otherwise("cm")
    return t.raw_events.select("event_id", events.height(F.col("value"), u, F.lit(None).cast("string")).alias("height"))


@query("cleaned_events", "I7 C10", f"select event_id, variable, {R('num')} as num from clean")
def _(t):
    scoped = events.in_scope(t.raw_events, t.ev_stays, t.items)
    return events.clean_events(scoped, t.items).select("event_id", "variable", "num")


@query("attributed_events", "C8 B12 I8", f"select stay_id, variable, {R('hours')} as hours, {R('num')} as num from attributed")
def _(t):
    return events.attribute(t.clean, t.ev_stays).select("stay_id", "variable", "hours", "num")


@query("largest_value_per_time", "D3 D4", f"select stay_id, variable, {R('hours')} as hours, {R('num')} as num from stay_events")
def _(t):
    return t.stay_events.select("stay_id", "variable", "hours", "num")


@query("stays_with_events", "B11", "select stay_id from ev_stays where stay_id in (select stay_id from stay_events)")
def _(t):
    return events.with_events(t.ev_stays, t.stay_events).select("stay_id")


@query("bin_counts_and_ids", "H19", """
    select stay_id, bins, sum(bin)::bigint as bin_sum, count(*) as n from (
      select e.stay_id, cast(trunc(los_hours + 1.0::double - 1e-6) as int) as bins, cast(trunc(hours - 1e-6) as bigint) as bin
      from attributed e join ev_stays s on e.stay_id = s.stay_id) x group by stay_id, bins""")
def _(t):
    e = events.attribute(t.clean, t.ev_stays).join(t.ev_stays.select("stay_id", "los_hours"), "stay_id")
    return e.groupBy("stay_id", C.bin_count(F.col("los_hours")).alias("bins")).agg(
        F.sum(C.bin_id(F.col("hours")).cast("bigint")).alias("bin_sum"), F.count("*").alias("n")
    )


@query("bin_values", "E3", f"select stay_id, variable, bin, {R('num')} as num, cats from binned")
def _(t):
    out = frames.bin_values(t.stay_events, t.ev_stays)
    return out.select("stay_id", "variable", "bin", "num", F.array_join("cats", ",").alias("cats"))


@query("hourly_frames", "I9 E4", f"select stay_id, variable, step, {R('num')} as num, cats, observed from frame")
def _(t):
    binned = frames.bin_values(t.stay_events, t.ev_stays)
    long = frames.frames_long(frames.validity_runs(binned, t.ev_stays))
    return long.select("stay_id", "variable", "step", "num", F.array_join("cats", ",").alias("cats"), "observed")


def _wide(t):
    binned = frames.bin_values(t.stay_events, t.ev_stays)
    return frames.frames_wide(frames.validity_runs(binned, t.ev_stays))


_SHOWN = [c.name for c in frames.CHANNELS if not c.categorical]
_SHOWN_SQL = ", ".join(f"'{c}'" for c in _SHOWN)


@query("frame_vectors", "H26 I9", f"""
    select stay_id, step, 76 as width,
           {R(f"sum(case when variable in ({_SHOWN_SQL}) then cast(num as float)::double else 0 end)")} as measured,
           sum(case when cats is not null then length(cats) - length(replace(cats, ',', '')) + 1 else 0 end)::bigint as categories,
           sum(observed::int)::bigint as observed
    from frame group by stay_id, step""")
def _(t):
    names = frames.frame_columns()

    def total(keep):
        # Neighbouring columns are summed as slices: an expression a column makes a method too long to be compiled.
        at = [i for i, n in enumerate(names) if keep(n)]
        ends = [k for k in range(1, len(at)) if at[k] != at[k - 1] + 1]
        out = F.lit(0.0)
        for a, b in zip([0, *ends], [*ends, len(at)]):
            out = F.aggregate(F.slice("x", at[a] + 1, b - a), out, lambda s, v: s + v.cast("double"))
        return out

    return _wide(t).select(
        "stay_id",
        "step",
        F.size("x").alias("width"),
        total(lambda n: n in _SHOWN).alias("measured"),
        total(lambda n: "->" in n and not n.startswith("mask->")).cast("bigint").alias("categories"),
        total(lambda n: n.startswith("mask->")).cast("bigint").alias("observed"),
    )


@query("channel_statistics", "D11", f"""
    with full_bins as (select stay_id, cast(trunc(los_hours + 1.0::double - 1e-6) as int) as bins from ev_stays where partition = 'train'),
    b as (select e.stay_id, variable, cast(trunc(hours - 1e-6) as int) as bin, arg_max(num, hours) as num from stay_events e join full_bins f on e.stay_id = f.stay_id
          where trunc(hours - 1e-6) >= 0 and trunc(hours - 1e-6) < bins and variable <> 'Glascow coma scale total' group by 1, 2, 3),
    g as (select stay_id, variable, normal, unnest(range(0, bins)) as step from full_bins cross join channel_list where normal is not null),
    d as (select g.stay_id, g.variable, coalesce(last_value(num ignore nulls) over (partition by g.stay_id, g.variable order by step rows between unbounded preceding and current row), normal) as v
          from g left join b on g.stay_id = b.stay_id and g.variable = b.variable and g.step = b.bin)
    select variable, {R('avg(v)')} as mean, {R('greatest(stddev_samp(v), 1e-7)')} as std, count(*) as rows from d group by variable""")
def _(t):
    binned = frames.bin_values(t.stay_events, t.ev_stays, max_steps=None)
    runs = frames.validity_runs(binned, t.ev_stays, max_steps=None)
    return frames.channel_stats(runs, t.ev_stays.filter("partition = 'train'"))


@query("normalised_frames", "I10", f"""
    with s as (select f.variable, avg(num - normal) + any_value(normal) as m, greatest(stddev_samp(num - normal), 1e-7) as sd
               from frame f join channel_list c on f.variable = c.variable where partition = 'train' and num is not null group by f.variable)
    select stay_id, f.variable, step, {R('(num - m) / sd')} as z from frame f join s on f.variable = s.variable""")
def _(t):
    binned = frames.bin_values(t.stay_events, t.ev_stays)
    runs = frames.validity_runs(binned, t.ev_stays)
    stats = frames.channel_stats(runs, t.ev_stays.filter("partition = 'train'"))
    out = frames.normalise(frames.frames_long(runs), stats).filter(F.col("num").isNotNull())
    return out.select("stay_id", "variable", "step", F.col("num").alias("z"))


@query("padded_frames", "H27", """
    select stay_id, cast(300 as bigint) as steps, cast(bins as bigint) as real_steps from stay_bins where bins > 0""")
def _(t):
    has = t.ev_stays.filter(C.bin_count(F.col("los_hours")) > 0)
    out = frames.padded(_wide(t), has, 300, 76)
    return out.groupBy("stay_id").agg(F.count("*").alias("steps"), F.count_if("step_mask").alias("real_steps"))


@query("channel_findings", "I9", """
    select 'unknown category' as "check", count(*) filter (variable = 'Glascow coma scale total' and txt not in ('3','4','5','6','7','8','9','10','11','12','13','14','15')) as violations from stay_events
    union all select 'text in a continuous channel', count(*) filter (variable <> 'Glascow coma scale total' and num is null) from stay_events
    union all select 'unknown channel', 0""")
def _(t):
    return frames.channel_findings(t.stay_events)


# -- split table ------------------------------------------------------------------


@query("stay_split_findings", "C7", """
    select 'stay without split' as "check", count(*) filter (p.stay_id is null) as violations from raw_stays r left join split_stays p on r.stay_id = p.stay_id
    union all select 'subject id not positive', count(*) filter (coalesce(p.subject_id <= 0, true)) from raw_stays r left join split_stays p on r.stay_id = p.stay_id""")
def _(t):
    return splits.split_findings(splits.attach_split(t.raw_stays.select("stay_id"), t.split_stays))


@query("subject_leaks", "G3", """
    with s as (select distinct subject_id, case when first_unit = '2-HIGH' then 'train' else partition end as p from split_stays)
    select a.p || '/' || b.p as pair, count(*) as subjects from s a join s b on a.subject_id = b.subject_id
      and ((a.p = 'train' and b.p in ('val', 'test')) or (a.p = 'val' and b.p = 'test')) group by 1""")
def _(t):
    mixed = t.split_stays.withColumn("partition", F.when(F.col("first_unit") == "2-HIGH", "train").otherwise(F.col("partition")))
    return splits.subject_leaks(mixed)


@query("assembled_split_table", "I11 A10", """
    select s.stay_id, s.partition, u.unit_code, o.stay_id is not null as notes_available from split_stays s
    join (select first_unit, cast(row_number() over (order by first_unit) - 1 as int) as unit_code from (select distinct first_unit from split_stays) x) u on s.first_unit = u.first_unit
    left join note_offsets o on s.stay_id = o.stay_id where s.stay_id in (select stay_id from stay_labels)""")
def _(t):
    tok = t.note_offsets.select(
        "stay_id", F.array_repeat(F.lit(1), 8).alias("input_ids"), F.array_repeat(F.lit(0), 8).alias("token_type_ids"),
        F.array_repeat(F.lit(1), 8).alias("attention_mask"),
    )
    pop = labels.stay_groups(t.coded).groupBy("stay_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return splits.assemble(pop, tok, t.split_stays, None, 8).select("stay_id", "partition", "unit_code", "notes_available")


@query("attach_column_findings", "C15", """
    select 'key only in artifact' as "check", 0 as violations union all
    select 'key only in addition', (select count(*) from raw_stays where stay_id not in (select stay_id from stays)) union all
    select 'labels differ', (select count(*) from stays s join raw_stays r on s.stay_id = r.stay_id where s.dbsource is distinct from (case when r.first_ward = '0' then 'Z' else r.dbsource end)) union all
    select 'column first_unit differs', 0""")
def _(t):
    other = t.raw_stays.withColumn("dbsource", F.when(F.col("first_ward") == "0", "Z").otherwise(F.col("dbsource")))
    return splits.attach_findings(t.stays, other, "dbsource", ["first_unit", "first_ward"])


def _label_rows(t):
    pos = labels.stay_groups(t.coded).groupBy("stay_id").agg(F.collect_set("label").alias("s"))
    y = F.array(*[F.coalesce(F.array_contains("s", b), F.lit(False)).cast("int") for b in B.BRANDS])
    return t.split_stays.join(pos, "stay_id", "left").select("stay_id", "subject_id", "partition", y.alias("labels"))


@query("split_table_audit", "J1", """
    select * from (values ('label not binary', 0), ('unknown split', 0), ('labels has wrong width', 0), ('stay listed twice', 0), ('subject in several splits', 0), ('empty split', 0)) v("check", violations)
    union all select 'subject id not positive', count(*) filter (subject_id <= 0) from split_stays
    union all select 'no positive label', count(*) filter (stay_id not in (select stay_id from stay_labels)) from split_stays""")
def _(t):
    return audit.split_table_findings(_label_rows(t), arrays={"labels": 25})


@query("split_table_manifest", "A16", """
    select count(*) as rows, count(*) filter (partition = 'train') as train, count(*) filter (partition = 'val') as val,
           count(*) filter (partition = 'test') as test, 25 as labels_width from split_stays""")
def _(t):
    m = sinks.table_manifest(_label_rows(t), ["labels"])
    pick = lambda s: F.coalesce(F.try_element_at("split_rows", F.lit(s)), F.lit(0)).alias(s)
    return m.select("rows", pick("train"), pick("val"), pick("test"), "labels_width")


# -- wide table -------------------------------------------------------------------


@query("column_roles", "A7 I25", """
    select 'deterioration' as role, 1 as n, count(deterioration_a) as filled from wide union all select 'diagnoses', 2, count(diagnoses_a) + count(diagnoses_b) from wide
    union all select 'features', 11, 5 * count(*) + count(demographics_age) + count(biometrics_visits) + count(biometrics_spend) + count(labvalues_balance) + count(labvalues_low) + count(vitals_acuity) from wide
    union all select 'inputs', 7, null from (select 1) union all select 'masks', 1, count(vitals_acuity_m) from wide""")
def _(t):
    r = tabular.column_roles(t.wide.columns)
    roles = {"diagnoses": r.diagnoses, "deterioration": r.deterioration, "features": r.features, "masks": r.masks}
    filled = t.wide.agg(*[sum((F.count(c) for c in v), F.lit(0)).cast("bigint").alias(k) for k, v in roles.items()])
    rows = [F.struct(F.lit(k).alias("role"), F.lit(len(v)).alias("n"), F.col(k).alias("filled")) for k, v in roles.items()]
    inputs = len(tabular.input_columns(r.features))
    rows.append(F.struct(F.lit("inputs").alias("role"), F.lit(inputs).alias("n"), F.lit(None).cast("bigint").alias("filled")))
    return filled.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("retained_records", "B7", "select general_study_id from wide where general_strat_fold < 18 or general_ecg_no_within_stay = 0")
def _(t):
    return tabular.retained(t.wide).select("general_study_id")


@query("fold_splits", "I15", "select general_study_id, case when general_strat_fold < 18 then 'train' when general_strat_fold = 18 then 'val' else 'test' end as split from wide")
def _(t):
    return t.wide.select("general_study_id", tabular.fold_split(F.col("general_strat_fold")).alias("split"))


_FEATS = [f"demographics_ethnicity_{s.lower()}" for s in B.SEGMENTS]
_HOT = "case " + " ".join(f"when {f} = 1 then {i}" for i, f in enumerate(_FEATS)) + " end"
_DERIVED = f"""(select general_study_id, general_subject_id, general_strat_fold, general_ecg_no_within_stay, diagnoses_a, diagnoses_b, deterioration_a,
    demographics_age, biometrics_visits, biometrics_spend, labvalues_balance, labvalues_low, vitals_acuity - 1 as vitals_acuity, cast({_HOT} as double) as demographics_ethnicity
    from wide where general_strat_fold < 18 or general_ecg_no_within_stay = 0)"""
_INPUTS = ["demographics_age", "biometrics_visits", "biometrics_spend", "labvalues_balance", "labvalues_low", "vitals_acuity", "demographics_ethnicity"]


@query("one_hot_index", "H24", f"select general_study_id, cast({_HOT} as int) as segment, {R('vitals_acuity - 1')} as acuity from wide")
def _(t):
    return t.wide.select(
        "general_study_id",
        C.hot_index(F.array(*[F.col(f) for f in _FEATS])).alias("segment"),
        (F.col("vitals_acuity") - 1).alias("acuity"),
    )


@query("column_fit", "I13 D14 D15 D16", "\nunion all ".join(
    f"""select '{c}' as "column", {R(f"coalesce(median({c}) filter (general_strat_fold < 18), 0)")} as median,
        count(distinct {c}) as distinct_values, bool_or({c} is null) as missing_all, bool_or({c} is null and general_strat_fold < 18) as missing_train,
        case when count(distinct {c}) < 10 then string_agg(distinct cast(cast({c} as int) as varchar), ',' order by cast(cast({c} as int) as varchar)) end as value_set
        from {_DERIVED} x""" for c in _INPUTS))
def _(t):
    roles = tabular.column_roles(t.wide.columns)
    s = tabular.column_stats(t.wide, roles.features)
    text = F.array_join(F.array_sort(F.transform("value_set", lambda x: x.cast("int").cast("string"))), ",")
    return s.select("column", "median", "distinct_values", "missing_all", "missing_train", text.alias("value_set"))


_AGE_MED = f"(select median(demographics_age) from {_DERIVED} y where general_strat_fold < 18)"
_BAL_MED = f"(select median(labvalues_balance) from {_DERIVED} y where general_strat_fold < 18)"


@query("transformed_records", "I14 H25", f"""
    select general_study_id as study_id, general_subject_id as subject_id, cast(general_strat_fold as int) as fold,
           round(coalesce(labvalues_balance, {_BAL_MED}), 2) as balance, round(labvalues_low, 2) as low, cast(coalesce(demographics_age, {_AGE_MED}) as int) as age_code,
           cast(vitals_acuity as int) as acuity_code, cast(demographics_ethnicity as int) as segment_code, diagnoses_a as label_a, diagnoses_b as label_b from {_DERIVED} x""")
def _(t):
    spec = tabular.fit_table(t.wide)
    out = tabular.transform_table(t.wide, spec)
    cont = {n: i + 1 for i, n in enumerate(spec.continuous)}
    cat = {n: i + 1 for i, n in enumerate(spec.categories)}
    get = lambda n: F.round(F.element_at("cont", cont[n]).cast("double"), 2)
    code = lambda n: F.element_at("cat", cat[n])
    return out.select(
        "study_id", "subject_id", "fold", get("labvalues_balance").alias("balance"), get("labvalues_low").alias("low"),
        code("demographics_age").alias("age_code"), code("vitals_acuity").alias("acuity_code"),
        code("demographics_ethnicity").alias("segment_code"),
        F.element_at("labels", 1).cast("int").alias("label_a"), F.element_at("labels", 2).cast("int").alias("label_b"),
    )


@query("deterioration_labels", "I14", f"select general_study_id as study_id, cast(nullif(deterioration_a, -999) as double) as label from {_DERIVED} x")
def _(t):
    out = tabular.transform_table(t.wide, tabular.fit_table(t.wide), "deterioration")
    return out.select("study_id", F.element_at("labels", 1).cast("double").alias("label"))


@query("release_totals", "D20", """
    select count(*) as rows, count(distinct general_subject_id) as patients, count(distinct general_ed_stay_id) as visits,
           count(*) filter (diagnoses_a + diagnoses_b = 0) as zero_label_rows, count(distinct general_strat_fold) as folds from wide""")
def _(t):
    return tabular.release_totals(t.wide)


@query("release_audit", "J2", """
    select * from (values ('invalid integer', 0), ('id not positive', 0), ('negative record number', 0), ('diagnosis label not binary', 0), ('deterioration label invalid', 0),
      ('fold set differs', 0)) v("check", violations)
    union all select 'study listed twice', count(*) from (select general_study_id from wide group by 1 having count(*) > 1) x
    union all select 'subject in several folds', count(*) from (select general_subject_id from wide group by 1 having count(distinct general_strat_fold) > 1) x
    union all select 'visit in several folds', count(*) from (select general_ed_stay_id from wide group by 1 having count(distinct general_strat_fold) > 1) x""")
def _(t):
    base = audit.release_findings(t.wide, list(range(20)))
    # Two customers share a visit id, so the fold rule has something to find there.
    leak = checks.many_values_count(t.wide, "general_ed_stay_id", "general_strat_fold", "visit in several folds")
    return base.unionByName(leak)


@query("strict_integers", "H17", f"""
    select event_id, case when {_NUM} = floor({_NUM}) then cast({_NUM} as bigint) end as whole, case when value in ('1', '1.0') then 1 when value in ('0', '0.0') then 0 end as flag from raw_events""")
def _(t):
    return t.raw_events.select("event_id", C.whole_number(F.col("value")).alias("whole"), C.binary_flag(F.col("value")).alias("flag"))


@query("release_study_ids", "A17", "select distinct general_study_id as study_id from wide")
def _(t):
    return tabular.study_ids(t.wide.withColumn("general_study_id", F.concat(F.col("general_study_id").cast("string"), F.lit(".0"))))


# -- item metadata ----------------------------------------------------------------

_AGE = "case when trim(age) in ('', 'nao') then null when age = '1O' then 10.0::double else cast(replace(age, ',', '.') as double) end"


@query("locale_numbers", "H14", f"select item_id, {R(_AGE)} as age from img")
def _(t):
    return t.img.select("item_id", C.locale_number(F.col("age")).alias("age"))


@query("category_text", "H15", "select item_id, lower(trim(lang_raw)) as lang, trim(source) as source from img")
def _(t):
    return t.img.select("item_id", C.category_text(F.col("lang_raw"), True).alias("lang"), C.category_text(F.col("source")).alias("source"))


@query("comma_tokens", "H16", """
    select item_id, string_agg(tok, ';' order by tok) as tokens from (select distinct item_id, trim(unnest(string_split(lower(remarks), ','))) as tok from img) x
    where tok not in ('', '0') group by item_id""")
def _(t):
    return t.img.select("item_id", F.array_join(C.token_list(F.col("remarks")), ";").alias("tokens"))


@query("numeric_field_stats", "D17", f"select 'age' as field, {R('avg(a)')} as mean, {R('stddev_pop(a)')} as std from (select {_AGE} as a from img) x")
def _(t):
    return metadata.numeric_stats(t.img, B.META.numeric)


@query("field_vocabularies", "D18", """
    with s as (select distinct 'lang_raw' as field, lower(trim(lang_raw)) as value from img where trim(lang_raw) <> '' union select distinct 'source', trim(source) from img)
    select field, value, cast(row_number() over (partition by field order by value) + 1 as int) as ord from s union all
    select f, v, o from (values ('lang_raw'), ('source')) a(f) cross join (values ('<missing>', 0), ('<unknown>', 1)) b(v, o)""")
def _(t):
    return metadata.vocabularies(t.img, B.META.categorical, B.META.folded)


@query("token_vocabulary", "D19", """
    select tok as token, count(*) as n from (select distinct item_id, trim(unnest(string_split(lower(remarks), ','))) as tok from img) x where tok not in ('', '0') group by tok having count(*) >= 10""")
def _(t):
    return metadata.token_vocabulary(t.img, "remarks", 10)


@query("metadata_vectors", "I16 I17", f"""
    with tr as (select avg(a) as m, stddev_pop(a) as s from (select {_AGE} as a from img where l_en = 1) x),
    tok as (select tok, count(*) as n from (select distinct item_id, trim(unnest(string_split(lower(remarks), ','))) as tok from img where l_en = 1) x where tok not in ('', '0') group by tok having count(*) >= 10),
    have as (select item_id, count(*) as k from (select distinct item_id, trim(unnest(string_split(lower(remarks), ','))) as t from img) x where t in (select tok from tok) group by item_id)
    select i.item_id, {R(f'coalesce(({_AGE} - m) / s, 0)')} as z, case when {_AGE} is null then 1 else 0 end as missing,
           case when trim(lang_raw) = '' then '<missing>' when lower(trim(lang_raw)) in (select lower(trim(lang_raw)) from img where l_en = 1) then lower(trim(lang_raw)) else '<unknown>' end as lang,
           coalesce(k, 0) as tokens
    from img i cross join tr left join have h on i.item_id = h.item_id""")
def _(t):
    schema = metadata.fit_metadata(t.img.filter("l_en = 1"), B.META)
    names = metadata.vector_names(B.META, schema)
    out = metadata.vectorize(t.img, B.META, schema)
    at = lambda n: F.element_at("meta", names.index(n) + 1)
    lang = F.coalesce(*[F.when(at(f"lang_raw={v}") == 1, F.lit(v)) for v in schema.vocab["lang_raw"]])
    first = names.index("(no token)") + 2
    tokens = F.aggregate(F.slice("meta", first, max(len(schema.tokens), 1)), F.lit(0.0), lambda a, x: a + x.cast("double"))
    mean, std = schema.stats["age"]
    z = F.coalesce((C.locale_number(F.col("age")) - F.lit(mean)) / F.lit(std), F.lit(0.0))
    exact = F.when(F.abs(z - at("age").cast("double")) <= 1e-5 * (1 + F.abs(z)), z)
    return out.select("item_id", exact.alias("z"), at("age:missing").cast("int").alias("missing"), lang.alias("lang"), tokens.cast("bigint").alias("tokens"))


_TARGETS = "select group_id, " + ", ".join(f"max({c}) as {c}" for c in B.IMG_LABELS) + " from img group by group_id"


@query("group_targets", "D9", _TARGETS)
def _(t):
    return metadata.group_targets(t.img, B.IMG_LABELS)


@query("group_targets_of_selection", "D27", "select * from (" + _TARGETS + ") x where group_id in (select group_id from img where source = 'src3')")
def _(t):
    return metadata.targets_of(t.img, t.img.filter("source = 'src3'").select("group_id"), B.IMG_LABELS)


@query("items_of_groups", "C18", "select item_id, group_id from img where group_id in (select group_id from img where source = 'src3') order by item_id")
def _(t):
    return metadata.items_of(t.img, t.img.filter("source = 'src3'").select("group_id")).select("item_id", "group_id").orderBy("item_id")


@query("group_size_counts", "D21", "select items, count(*) as groups from (select group_id, count(*) as items from img group by group_id) x group by items")
def _(t):
    return metadata.group_sizes(t.img)


@query("label_load", "D21", """
    select count(*) as rows, count(*) filter (l_quality + l_toxic + l_en + l_fr = 0) as zero_label, count(*) filter (l_quality + l_toxic + l_en + l_fr > 1) as multi_label from img""")
def _(t):
    return metadata.label_load(t.img, B.IMG_LABELS)


_IMG = "age group_id item_id l_en l_fr l_quality l_toxic lang_raw remarks source".split()


@query("source_fingerprint", "D28", f"""
    with h as (select ('0x' || substr(md5(concat_ws('|', {", ".join(f"coalesce(cast({c} as varchar), '~')" for c in _IMG)})), 1, 13))::bigint as h from img)
    select count(*) as rows, coalesce(bit_xor(h), 0) as xor, coalesce(sum(h % 2147483647), 0)::bigint as total from h""")
def _(t):
    return metadata.fingerprint(t.img)


@query("inventory_difference", "C13 A9", """
    select coalesce(i.item_id, f.item_id) as item_id, case when f.item_id is null then 'missing' else 'extra' end as side
    from img i full outer join (select cast(doc_id + 25 as varchar) as item_id from documents) f on i.item_id = f.item_id where i.item_id is null or f.item_id is null""")
def _(t):
    listing = t.raw("documents").select((F.col("doc_id") + 25).cast("string").alias("item_id"))
    return metadata.one_sided(t.img, listing, "item_id")


@query("id_set_equality", "G5", """
    select 'only in left' as "check", count(*) as violations from (select item_id from img except all select cast(doc_id as varchar) from labels) x union all
    select 'only in right', count(*) from (select cast(doc_id as varchar) from labels except all select item_id from img) x""")
def _(t):
    return audit.same_ids_findings(t.img, t.raw("labels").select(F.col("doc_id").cast("string").alias("item_id")), "item_id")


@query("item_source_audit", "J4", """
    select * from (values ('empty item id', 0), ('empty group id', 0), ('label not binary', 0), ('item listed twice', 0), ('file without item', 25)) v("check", violations)
    union all select 'item without file', count(*) from documents where doc_id < 25""")
def _(t):
    listing = t.raw("documents").select((F.col("doc_id") + 25).cast("string").alias("item_id"))
    return audit.source_findings(t.img, B.IMG_LABELS, listing)


# The rarest label of each group, hash order inside the stratum, cumulative cuts.
_GSPLIT = f"""
    gt as ({_TARGETS}),
    gp as (select group_id, unnest(case when true then list_filter([case when l_quality = 1 then 'l_quality' end, case when l_toxic = 1 then 'l_toxic' end,
             case when l_en = 1 then 'l_en' end, case when l_fr = 1 then 'l_fr' end], lambda z: z is not null) end) as label from gt),
    cnt as (select label, count(*) as n from gp group by label),
    st as (select gp.group_id, arg_min(gp.label, {{'n': cnt.n, 'l': gp.label}}) as stratum from gp join cnt on gp.label = cnt.label group by gp.group_id),
    sr as (select gt.group_id, coalesce(stratum, '(none)') as stratum from gt left join st on gt.group_id = st.group_id),
    rk as (select *, row_number() over (partition by stratum order by {U(17, 'split', 'group_id')}, group_id) as r, count(*) over (partition by stratum) as n from sr),
    gs as (select group_id, stratum, case when (r - 0.5::double) / n < 0.6 then 'train' when (r - 0.5::double) / n < 0.8 then 'val' else 'test' end as partition from rk)"""


@query("group_stratified_split", "I18", f"with {_GSPLIT} select group_id, stratum, partition from gs")
def _(t):
    return t.groups


def _iterative_sql(rounds: int) -> str:
    """Rounds over the rarest label left, as common table expressions; the last is for no label."""
    by = f"floor({U(17, 'set', 'sets')} * 1048576.0::double) + {U(17, 'split', 'group_id')}"
    steps = [f"""g0 as (select gt.group_id, coalesce(l.labels, []) as labels from gt left join (select group_id, list_sort(list(label)) as labels from gp group by 1) l on gt.group_id = l.group_id),
    l0 as (select group_id, labels, {by} as b from (select *, array_to_string(labels, '|') as sets from g0) x),
    d0 as (select group_id, labels, '' as partition from l0 where false)"""]
    for r in range(1, rounds + 1):
        last = r == rounds
        pick = "select null::varchar as label" if last else f"select label from (select label, count(*) as n from (select unnest(labels) as label from l{r - 1}) u group by 1) v order by n, label limit 1"
        has = "true" if last else f"list_contains(labels, (select label from p{r}))"
        steps.append(f"""p{r} as ({pick}),
    m{r} as (select *, row_number() over (order by b, group_id) as place from l{r - 1} where {has}),
    w{r} as (select i, name, greatest(0, share * (select count(*) from l0 where {has}) - (select count(*) from d{r - 1} where partition = name and {has})) as w, (select count(*) from m{r}) as c
            from (values (0, 'train', 0.6::double), (1, 'val', 0.2::double), (2, 'test', 0.2::double)) v(i, name, share)),
    e{r} as (select i, name, c, c * w / (select sum(w) from w{r}) as e from w{r}),
    q{r} as (select i, name, floor(e)::bigint + case when row_number() over (order by floor(e) - e, i) <= c - sum(floor(e)) over () then 1 else 0 end as q from e{r}),
    b{r} as (select name, sum(q) over (order by i) as stop, sum(q) over (order by i) - q as start from q{r}),
    t{r} as (select group_id, labels, row_number() over (order by place * 0.6180339887498949::double - floor(place * 0.6180339887498949::double), group_id) as turn from m{r}),
    d{r} as (select * from d{r - 1} union all select group_id, labels, name as partition from t{r} join b{r} on turn > start and turn <= stop),
    l{r} as (select * from l{r - 1} where not ({has}))""")
    return ",\n    ".join(steps)


_ITERATIVE = f"{_GSPLIT}, {_iterative_sql(5)}"


def _iterative(t):
    return splits.iterative_split(t.img.select("group_id").distinct(), t.group_positives, B.SEED)


@query("iterative_split", "I18", f"with {_ITERATIVE} select group_id, partition from d5")
def _(t):
    return _iterative(t)


@query("iterative_split_deviation", "I18", f"""
    with {_ITERATIVE}, c as (select gp.label, d5.partition, count(*) as n from gp join d5 on gp.group_id = d5.group_id group by 1, 2)
    select a.label, a.name as partition, {R('abs(coalesce(n, 0) / total::double - share)')} as deviation
    from (select label, name, share, (select count(*) from gp where gp.label = l.label) as total from (select distinct label from gp) l cross join (values ('train', 0.6::double), ('val', 0.2::double), ('test', 0.2::double)) v(name, share)) a
    left join c on c.label = a.label and c.partition = a.name""")
def _(t):
    return splits.share_deviation(_iterative(t), t.group_positives)


@query("split_manifest", "I19 C14", f"with {_GSPLIT} select i.item_id, i.group_id, gs.partition from img i join gs on i.group_id = gs.group_id")
def _(t):
    return splits.split_manifest(t.img, t.groups, "item_id")


@query("manifest_audit_counts", "I19 D23", f"""
    with {_GSPLIT} select g.partition, g.label, coalesce(n, 0) as n from (select unnest(['l_quality', 'l_toxic', 'l_en', 'l_fr']) as label, p as partition from (values ('train'), ('val'), ('test')) v(p)) g
    left join (select gs.partition, gp.label, count(*) as n from gp join gs on gp.group_id = gs.group_id group by 1, 2) c on g.label = c.label and g.partition = c.partition""")
def _(t):
    names = t.group_positives.select("label").distinct()
    return labels.absent_labels(t.groups, t.group_positives, names, list(cohort.SPLITS), "group_id")


@query("prepared_audit", "J5", """
    select "check", violations::bigint as violations from (values ('source changed', 0), ('manifest differs from source', 0), ('unknown split', 0), ('group in several splits', 0)) v("check", violations)""")
def _(t):
    manifest = splits.split_manifest(t.img, t.groups, "item_id")
    return audit.prepared_findings(t.img, manifest, metadata.fingerprint(t.img))


# -- signals ----------------------------------------------------------------------

_REPAIR = """(
    select study_id, lead, t, greatest(least(case when mv is not null then mv when pt is null and nt is null then 0.0::double when pt is null then nv when nt is null then pv
           else pv + (t - pt) / (nt - pt)::double * (nv - pv) end, 3.0::double), -3.0::double) as mv, mv is null as repaired
    from (select *, last_value(case when mv is not null then t end ignore nulls) over b as pt, last_value(mv ignore nulls) over b as pv,
                 first_value(case when mv is not null then t end ignore nulls) over f as nt, first_value(mv ignore nulls) over f as nv
          from sig window b as (partition by study_id, lead order by t rows between unbounded preceding and current row),
                          f as (partition by study_id, lead order by t rows between current row and unbounded following)) x)"""


@query("repaired_signals", "I20", f"select study_id, lead, t, {R('mv')} as mv, repaired from {_REPAIR} r")
def _(t):
    return signals.repair(t.sig)


@query("signal_gap_counts", "I20", "select study_id, count(*) filter (mv is null) as gaps from sig group by study_id")
def _(t):
    return signals.gap_counts(t.sig)


@query("resampled_signals", "I21", f"select study_id, lead, cast(t // 2 as int) as t, {R('avg(mv)')} as mv from {_REPAIR} r group by study_id, lead, t // 2")
def _(t):
    return signals.resample(signals.repair(t.sig), 200.0, 100.0)


@query("upsampled_signals", "I21", f"""
    with r as (select study_id, lead, t, mv, lead(t) over w as nt, lead(mv) over w as nmv from {_REPAIR} r window w as (partition by study_id, lead order by t)),
    g as (select *, unnest(range(2 * t, coalesce(2 * nt, 2 * t + 1))) as k from r)
    select study_id, lead, cast(k as int) as t, {R('coalesce(mv + (k / 2.0::double - t) / (nt - t)::double * (nmv - mv), mv)')} as mv from g""")
def _(t):
    return signals.resample(signals.repair(t.sig), 100.0, 200.0)


_LEADIX = "case lower(lead) when 'i' then 0 when 'ii' then 1 when 'v1' then 2 when 'avr' then 9 end"


@query("lead_order", "I22", f"select study_id, cast({_LEADIX} as int) as lead_index, count(*) as n from sig where {_LEADIX} is not null group by 1, 2")
def _(t):
    return signals.lead_order(t.sig).groupBy("study_id", "lead_index").agg(F.count("*").alias("n"))


_PACKED = f"""(select s.study_id, cast(l as int) as lead_index, coalesce(x, 0) as total, coalesce(n, 0) as filled from (select distinct study_id from sig) s cross join (select unnest(range(0, 12)) as l) g
    left join (select study_id, {_LEADIX} as li, sum(cast(mv as float)::double) as x, count(*) as n from {_REPAIR} r group by 1, 2) p on p.study_id = s.study_id and p.li = g.l)"""


@query("packed_signals", "I22 C17", f"select study_id, lead_index, cast((select coalesce(max(t) + 1, 0) from sig where study_id = p.study_id and {_LEADIX} is not null) as int) as samples, {R('total')} as total from {_PACKED} p")
def _(t):
    rows = t.sig.select("study_id").distinct()
    out = signals.with_signal(rows, signals.packed(signals.repair(t.sig)))
    total = F.aggregate("mv", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.select("study_id", "lead_index", F.size("mv").alias("samples"), total.alias("total"))


@query("lead_statistics", "D12", f"select lead, {R('avg(mv)')} as mean, {R('stddev_pop(mv)')} as std from {_REPAIR} r group by lead")
def _(t):
    return signals.lead_stats(signals.repair(t.sig))


@query("record_statistics", "D13", f"select lead, {R('avg(m)')} as mean, {R('avg(s)')} as std from (select study_id, lead, avg(mv) as m, stddev_pop(mv) as s from {_REPAIR} r group by 1, 2) x group by lead")
def _(t):
    return signals.record_stats(signals.repair(t.sig))


_INDEX = """(select event_id as record_id, user_id as file_id, cast(value * 100 as bigint) as start, cast(50 as bigint) as length from events)"""


@query("overlapping_ranges", "E9", f"""
    select file_id, record_id, start, cast(b as bigint) as busy_until from (select *, max(start + length) over (partition by file_id order by start, record_id rows between unbounded preceding and 1 preceding) as b from {_INDEX} i) x where start < b""")
def _(t):
    index = t.raw("events").select(
        F.col("event_id").alias("record_id"), F.col("user_id").alias("file_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("start"), F.lit(50).cast("bigint").alias("length"),
    )
    return signals.interval_overlaps(index)


@query("range_index_audit", "J3 G6", f"""
    with i as (select * from {_INDEX} i), o as (select *, max(start + length) over (partition by file_id order by start, record_id rows between unbounded preceding and 1 preceding) as b from i)
    select * from (values ('unknown file', 0), ('negative start', 0), ('wrong length', 0), ('ids are not a full range', 0)) v("check", violations)
    union all select 'range beyond file', count(*) from i where start + length > 20000
    union all select 'overlapping ranges', count(*) from o where start < b""")
def _(t):
    index = t.raw("events").select(
        F.col("event_id").alias("record_id"), F.col("user_id").alias("file_id"),
        F.round(F.col("value") * 100).cast("bigint").alias("start"), F.lit(50).cast("bigint").alias("length"),
    )
    files = index.select("file_id").distinct().withColumn("file_length", F.lit(20000))
    return signals.index_findings(index, files, 50)


@query("first_record_per_study", "A8", "select l_orderkey as study_id, arg_min(l_suppkey, l_linenumber * 1000000 + l_partkey) as subject_id from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by l_orderkey order by 1")
def _(t):
    index = t.spark.read.parquet(f"{t.folder}/lineitem.parquet").select(
        F.col("l_orderkey").alias("study_id"), F.col("l_suppkey").alias("subject_id"),
        F.concat(F.lit("r"), F.col("l_partkey").cast("string")).alias("path"),
        (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("place"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
    )
    # The list is a file in which the first line of a study counts; of one place, the table's first row.
    path = scratch_path(t.spark, "records")
    in_order = index.repartitionByRange(8, "place").sortWithinPartitions("place", "file", "at")
    in_order.select("subject_id", "study_id", "path").write.option("header", True).csv(path)
    index = tables.record_index(t.spark, path)
    wanted = t.raw("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("study_id"))
    return signals.first_record(index, wanted).select("study_id", "subject_id")


@query("studies_without_record", "C12", "select o_orderkey as study_id from orders where o_orderkey not in (select l_orderkey from lineitem)")
def _(t):
    wanted = t.raw("orders").select(F.col("o_orderkey").alias("study_id"))
    return signals.missing_records(wanted, t.raw("lineitem").select(F.col("l_orderkey").alias("study_id")))


@query("record_findings", "C16", """
    select 'study with several records' as "check", count(*) as violations from (select l_orderkey from lineitem group by 1 having count(*) > 1) x
    union all select 'study without record', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)""")
def _(t):
    wanted = t.raw("orders").select(F.col("o_orderkey").alias("study_id"))
    return signals.record_findings(wanted, t.raw("lineitem").select(F.col("l_orderkey").alias("study_id")))


# -- schedule and scenarios -------------------------------------------------------


@query("label_budget_schedule", "N1", "select cast(r as int) as round, cast(floor(n * (0.1::double + 0.05::double * r) + 0.5) as bigint) as target from (select count(*) as n from orders) x cross join (select unnest(range(0, 6)) as r) g")
def _(t):
    return schedule_table(t.raw("orders"), 6, 0.10, 0.05)


def _train_positives(t):
    train = t.pp_rows.filter("partition = 'train'").select("id")
    return t.positives.join(train, "id", "left_semi")


_TRAINPOS = "(select h.n, count(*) as k from pairs25 h join pp_rows r on h.o_orderkey = r.id where partition = 'train' group by h.n)"


@query("label_subset", "K1", f"""
    select 'Brand#' || g.n as label, g.n - 1 as ord, coalesce(k, 0) as positives, rk as freq_rank, rk > 5 and coalesce(k, 0) >= 0 as kept from (
      select cast(g.n as int) as n, k, row_number() over (order by coalesce(k, 0) desc, g.n) as rk from (select unnest(range(1, 26)) as n) g left join {_TRAINPOS} c on g.n = c.n) g""")
def _(t):
    return scenario.label_subset(t.brand_names, _train_positives(t), drop_top=5)


@query("label_subset_report", "K1", f"""
    select count(*) filter (rk > 5) as kept_labels, count(*) filter (rk <= 5) as dropped_labels, {R('1.0 - sum(case when rk > 5 then k else 0 end) / greatest(sum(k), 1)::double')} as dropped_mass
    from (select coalesce(k, 0) as k, row_number() over (order by coalesce(k, 0) desc, g.n) as rk from (select unnest(range(1, 26)) as n) g left join {_TRAINPOS} c on g.n = c.n) x""")
def _(t):
    return scenario.subset_report(scenario.label_subset(t.brand_names, _train_positives(t), drop_top=5))


def _withheld_sql(name: str, rate: float, available: str, weight: str, splits: str, seed: int = 3) -> str:
    return f"""(with z as (select *, avg(positives) over (partition by partition) as m, stddev_pop(positives) over (partition by partition) as s from pp_rows where {available} and partition in ({splits})),
      k as (select id, partition, row_number() over (partition by partition order by -ln({U(seed, name + '-missing', 'id')}) / ({weight}), id) as r from z),
      w as (select partition, round_even({rate}::double * count(*), 0) - count(*) filter (not {available}) as wanted from pp_rows where partition in ({splits}) group by partition)
      select r.*, (not r.{available}) or k.id is not null as {name}_missing from pp_rows r left join (select k.id from k join w on k.partition = w.partition where k.r <= w.wanted) k on r.id = k.id)"""


_ALL = "'train', 'val', 'test'"
_NOTES = scenario.Withhold("notes", 0.4, "label_sparse", 1.0, 3)
_SERIES = scenario.Withhold("series", 0.2, "careunit", 2.0, 3, unit=1, splits=("train", "val"))
_NOTES_SQL = _withheld_sql("notes", 0.4, "notes_available", "case when s > 0 then exp(-1.0::double * (positives - m) / s) else 1.0::double end", _ALL)
_SERIES_SQL = _withheld_sql("series", 0.2, "series_available", "case when unit_code = 1 then 3.0::double else 1.0::double end", "'train', 'val'")


@query("withheld_notes", "K2 K3", f"select id, notes_missing from {_NOTES_SQL} x")
def _(t):
    return scenario.withheld(t.pp_rows, _NOTES, "notes_available").select("id", "notes_missing")


@query("withheld_series_by_unit", "K2 K3", f"select id, series_missing from {_SERIES_SQL} x")
def _(t):
    return scenario.withheld(t.pp_rows, _SERIES, "series_available").select("id", "series_missing")


@query("withheld_uniform", "K2 K3", f"select id, notes_missing from {_withheld_sql('notes', 0.25, 'notes_available', '1.0::double', _ALL, 5)} x")
def _(t):
    return scenario.withheld(t.pp_rows, scenario.Withhold("notes", 0.25, seed=5), "notes_available").select("id", "notes_missing")


_BOTH = f"""(select a.id, a.partition, a.positives, notes_missing, series_missing from {_NOTES_SQL} a join {_SERIES_SQL} b on a.id = b.id)"""


def _scenario(t):
    return scenario.resolve(t.pp_rows, t.brand_names, _train_positives(t), drop_top=5, notes=_NOTES, series=_SERIES)


@query("scenario_summary", "K4", f"""
    select count(*) as rows, count(*) filter (notes_missing) as notes_missing_rows, {R('avg(notes_missing::int)')} as notes_missing_rate,
           count(*) filter (series_missing) as series_missing_rows, {R('avg(series_missing::int)')} as series_missing_rate,
           count(*) filter (notes_missing and series_missing) as both_missing_rows from {_BOTH} x""")
def _(t):
    return scenario.scenario_summary(_scenario(t)[0], ["notes", "series"])


@query("scenario_view", "K5", f"""
    with keep as (select n from (select g.n, row_number() over (order by coalesce(k, 0) desc, g.n) as rk from (select unnest(range(1, 26)) as n) g left join {_TRAINPOS} c on g.n = c.n) x where rk > 5)
    select x.id, case when notes_missing then 101 else 7 end as first_token, {R('case when series_missing then 0 else positives end')} as series_value,
           20 as labels, coalesce(p.k, 0) as kept_positives from {_BOTH} x left join (select o_orderkey, count(*) as k from pairs25 where n in (select n from keep) group by 1) p on x.id = p.o_orderkey""")
def _(t):
    rows, subset = _scenario(t)
    sets = t.positives.groupBy("id").agg(F.collect_set("label").alias("s"))
    y = F.array(*[F.coalesce(F.array_contains("s", b), F.lit(False)).cast("int") for b in B.BRANDS])
    full = rows.join(sets, "id", "left").select(
        "id", "notes_missing", "series_missing", y.alias("labels"), F.array(F.col("positives").cast("float")).alias("x"),
        F.array_repeat(F.lit(7), 8).alias("input_ids"), F.array_repeat(F.lit(0), 8).alias("token_type_ids"), F.array_repeat(F.lit(1), 8).alias("attention_mask"),
    )
    out = scenario.apply_view(full, subset, 8)
    return out.select(
        "id", F.element_at("input_ids", 1).alias("first_token"), F.element_at("x", 1).cast("double").alias("series_value"),
        F.size("labels").alias("labels"), F.aggregate("labels", F.lit(0), lambda a, v: a + v).cast("bigint").alias("kept_positives"),
    )
