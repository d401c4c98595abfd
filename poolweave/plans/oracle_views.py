"""DuckDB counterparts of the composite views, used only by the SQL checks."""

from __future__ import annotations

from .dialect import Duck

_U = Duck().u


def sql_number(e: str) -> str:
    return (
        f"(case when regexp_full_match({e}, '\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*') "
        f"then try_cast(trim({e}) as double) end)"
    )


def sql_clean_note(e: str) -> str:
    body = f"replace(replace({e}, chr(10), ' '), chr(13), ' ')"
    body = f"lower(regexp_replace({body}, '^\\s+|\\s+$', '', 'g'))"
    for pattern, new in (
        ("\\[(.*?)]", ""), ("[0-9]+\\.", ""), ("dr\\.", "doctor"), ("m\\.d\\.", "md"),
        ("admission date:", ""), ("discharge date:", ""), ("--|__|==", ""),
    ):
        body = f"regexp_replace({body}, '{pattern}', '{new}', 'gs')"
    return body


def sql_group3(e: str) -> str:
    t = f"upper(trim({e}))"
    d = f"regexp_replace({t}, '[^0-9]', '', 'g')"
    return f"""case when {t}[1:1] = 'V' then case when length({d}) >= 2 then 'V' || {d}[1:2] end
                    when {t}[1:1] = 'E' then case when length({d}) >= 2 then 'E' || {d}[1:3] end
                    when length({d}) >= 3 then {d}[1:3] end"""


_V = sql_number("value")
_CLEANED = f"""case variable
    when 'Systolic blood pressure' then coalesce({_V}, try_cast(nullif(regexp_extract(value, '^(\\d+)/(\\d+)$', 1), '') as double))
    when 'Glucose' then {_V}
    when 'Temperature' then case when lower(coalesce(uom, '')) like '%f%' or lower(coalesce(item_label, '')) like '%f%' or {_V} >= 79
                            then ({_V} - 32.0::double) * 5.0::double / 9.0::double else {_V} end end"""
_HAS = "variable in ('Systolic blood pressure', 'Glucose', 'Temperature')"

ORACLE_VIEWS: dict[str, str] = {
    "stays_joined": """
        select s.*, a.ethnicity, p.gender, p.born from raw_stays s
        join raw_admissions a on s.subject_id = a.subject_id and s.hadm_id = a.hadm_id
        join raw_patients p on s.subject_id = p.subject_id
        where s.first_unit = s.last_unit and s.first_ward = s.last_ward""",
    "stays_single": """
        select *, (epoch_us(intime) - epoch_us(born)) / 3.6e9::double / 24.0::double / 365.0::double as raw_age
        from stays_joined where hadm_id in (select hadm_id from stays_joined group by hadm_id having count(*) = 1)""",
    "stays": """
        select subject_id, hadm_id, stay_id, last_unit as first_unit, dbsource, intime, outtime,
               (epoch_us(outtime) - epoch_us(intime)) / 3.6e9::double as los_hours,
               case when raw_age < 0 then 90.0::double else raw_age end as age, gender, ethnicity
        from stays_single where (case when raw_age < 0 then 90.0::double else raw_age end) >= 18""",
    "split_stays": """
        select s.*, case when l.flag = 1 then l.list else 'train' end as partition
        from stays s left join subject_lists l on s.subject_id = l.subject_id""",
    "dx_stays": """
        select d.*, c.title, s.stay_id from raw_dx d join dictionary c on d.code = c.code
        join stays s on d.subject_id = s.subject_id and d.hadm_id = s.hadm_id""",
    "coded": "select d.*, c.grp, c.use_flag from dx_stays d left join ccs c on d.code = c.code",
    "stay_labels": "select distinct stay_id, grp as label from coded where grp is not null",
    "dx_groups": f"select * from (select hadm_id, {sql_group3('code')} as grp, source_row from raw_dx) g where grp is not null",
    "usable_notes": "select * from raw_notes where iserror is null and charttime is not null",
    "timed_notes": """
        select n.*, s.stay_id, s.intime, s.outtime, (epoch_us(charttime) - epoch_us(intime)) / 3.6e9::double as hours
        from usable_notes n join note_stays s on n.subject_id = s.subject_id and n.hadm_id = s.hadm_id""",
    "note_offsets": "select stay_id, min(hours) as first_note_hours from timed_notes where hours >= 0 group by stay_id",
    "clean": f"""
        select * from (
          select e.*, i.variable, i.item_label, case when {_HAS} then {_CLEANED} else {_V} end as num,
                 case when {_HAS} then cast({_CLEANED} as varchar) else value end as txt
          from raw_events e join items i on e.item_id = i.item_id
          where charttime is not null and subject_id in (select subject_id from ev_stays)) c
        where case when {_HAS} then num is not null else value is not null end""",
    "attributed": """
        select s.stay_id, variable, (epoch_us(charttime) - epoch_us(intime)) / 3.6e9::double as hours, num, txt
        from clean c join ev_stays s on c.subject_id = s.subject_id
         and (coalesce(c.stay_id = s.stay_id, false) or charttime between intime and outtime)
        where (epoch_us(charttime) - epoch_us(intime)) / 3.6e9::double > -1e-6
          and (epoch_us(charttime) - epoch_us(intime)) / 3.6e9::double < los_hours + 1e-6""",
    "stay_events": """
        select stay_id, variable, hours,
               arg_max(num, {'a': coalesce(num, try_cast(txt as double), '-inf'::double), 'b': txt}) as num,
               arg_max(txt, {'a': coalesce(num, try_cast(txt as double), '-inf'::double), 'b': txt}) as txt
        from attributed group by stay_id, variable, hours""",
    "stay_bins": """
        select stay_id, cast(trunc(los_hours + 1.0::double - 1e-6) as int) as bins, partition from ev_stays""",
    "binned": """
        select e.stay_id, variable, cast(trunc(hours - 1e-6) as int) as bin, b.bins,
               case when variable <> 'Glascow coma scale total' then arg_max(num, hours) end as num,
               case when variable = 'Glascow coma scale total' then string_agg(distinct txt, ',' order by txt) end as cats
        from stay_events e join stay_bins b on e.stay_id = b.stay_id
        where trunc(hours - 1e-6) >= 0 and trunc(hours - 1e-6) < bins
        group by e.stay_id, variable, cast(trunc(hours - 1e-6) as int), b.bins""",
    "channel_list": """
        select * from (values ('Capillary refill rate', null::double, '0.0'), ('Diastolic blood pressure', 59.0, null),
          ('Fraction inspired oxygen', 0.21, null), ('Glascow coma scale eye opening', null, '4 Spontaneously'),
          ('Glascow coma scale motor response', null, '6 Obeys Commands'), ('Glascow coma scale total', null, '15'),
          ('Glascow coma scale verbal response', null, '5 Oriented'), ('Glucose', 128.0, null), ('Heart Rate', 86, null),
          ('Height', 170.0, null), ('Mean blood pressure', 77.0, null), ('Oxygen saturation', 98.0, null),
          ('Respiratory rate', 19, null), ('Systolic blood pressure', 118.0, null), ('Temperature', 36.6, null),
          ('Weight', 81.0, null), ('pH', 7.4, null)) t(variable, normal, normal_cat)""",
    "dense": """
        select g.stay_id, g.variable, g.step, normal, normal_cat, b.num, b.cats, b.bin is not null as observed, partition
        from (select stay_id, partition, variable, normal, normal_cat, cast(unnest(range(0, bins)) as int) as step
              from stay_bins cross join channel_list where bins > 0) g
        left join binned b on b.stay_id = g.stay_id and b.variable = g.variable and b.bin = g.step""",
    "frame": """
        select stay_id, variable, step, observed, partition,
               coalesce(last_value(num ignore nulls) over w, normal) as num,
               coalesce(last_value(cats ignore nulls) over w, normal_cat) as cats
        from dense window w as (partition by stay_id, variable order by step rows between unbounded preceding and current row)""",
    "pool_p": """
        select id, role, cast(i as int) - 1 as label, 1.0::double / (1.0::double + exp(-8.0::double * embedding[i])) as p
        from vec cross join (select unnest(range(1, 11)) as i) g""",
    "pool_y": """
        select id, role, group_id, cast(i as int) as label, case when i = main_label or i = second_label then 1 else 0 end as y
        from vec cross join (select unnest(range(0, 10)) as i) g""",
    "pool_tok": """
        select id, group_id, role, m as modality,
               [x::double for x in case when m = 0 then embedding[1:32] else embedding[33:64] end] as t
        from vec cross join (values (0), (1)) g(m)""",
    "pool_unit": """
        select id, role, [x::double / sqrt(list_inner_product([v::double for v in embedding], [v::double for v in embedding])) for x in embedding] as un
        from vec""",
    "score_counts": """
        select label, p, sum(y) as pos, sum(1 - y) as neg from cells where split = 'test' group by label, p""",
    "score_runs": """
        select *, sum(pos) over (partition by label order by p desc) as tp, sum(neg) over (partition by label order by p desc) as fp,
               sum(pos) over (partition by label) as np, sum(neg) over (partition by label) as nn from score_counts""",
    "label_areas": """
        select label, max(np) as positives, max(nn) as negatives,
               case when max(np) > 0 then sum(pos / np * (tp / (tp + fp))) end as auprc,
               case when max(np) * max(nn) > 0 then sum(neg * (tp - pos + pos / 2.0::double)) / (max(np) * max(nn)) end as auroc
        from score_runs group by label""",
    "pp_ranks": """
        select *, row_number() over (partition by id order by p desc, ord) as rk,
               row_number() over (partition by id order by q desc, ord) as rq from cells""",
    "grid26": "select unnest(range(0, 26)) / 25.0::double as t",
    "f1_grid": """
        select label, t, sum(case when y = 1 and p >= t then 1 else 0 end) as tp, sum(case when p >= t then 1 else 0 end) as pp,
               sum(y) as np, count(*) as n
        from cells cross join grid26 where split = 'val' group by label, t""",
    "best_t": """
        select label, case when max(np) = 0 or max(np) = max(n) then 0.5::double else
               arg_max(t, {'f': coalesce(2.0 * tp / nullif(np + pp, 0), 0.0), 'n': -abs(t - 0.5), 'l': -t}) end as threshold
        from f1_grid group by label""",
    "conf": """
        select c.label, threshold, sum(case when y = 1 and p >= threshold then 1 else 0 end) as tp,
               sum(case when y = 0 and p >= threshold then 1 else 0 end) as fp,
               sum(case when y = 1 and p < threshold then 1 else 0 end) as fn,
               sum(case when y = 0 and p < threshold then 1 else 0 end) as tn
        from cells c join best_t b on c.label = b.label where split = 'test' group by c.label, threshold""",
}


def R(e: str) -> str:
    """Six places, no negative zero: the rounding both sides apply."""
    return f"(round({e}, 6) + 0.0::double)"


def N(e: str) -> str:
    return f"cast({e} as bigint)"
