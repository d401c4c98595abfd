"""Views that give the shared test tables the shapes the operators expect.

One text per view, spelled for Spark or DuckDB by a dialect. Splits, roles, gaps and
faults come from the reproducible hash draw, so every row of a table takes part.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, events, frames, labels, metadata, notes, splits

LABELS = 10
MODALITIES = 2
TOKEN_WIDTH = 32
SEED = 17
BRANDS = [f"Brand#{i}" for i in range(1, 26)]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
IMG_LABELS = ["l_quality", "l_toxic", "l_en", "l_fr"]


def views(d) -> dict[str, str]:
    """View name to SQL; a view may use earlier ones by name."""
    u, txt, num = d.u, d.text, d.num
    v: dict[str, str] = {}
    hadm = d.idiv("o_orderkey", "2")
    v["raw_stays"] = f"""
        select o_orderkey as stay_id, o_custkey as subject_id, {hadm} as hadm_id,
               o_orderstatus as dbsource, o_orderpriority as first_unit,
               case when {u(1, 'unit', 'o_orderkey')} < 0.15 then 'MOVED' else o_orderpriority end as last_unit,
               {txt('o_orderkey % 5')} as first_ward,
               case when {u(1, 'ward', 'o_orderkey')} < 0.1 then 'X' else {txt('o_orderkey % 5')} end as last_ward,
               cast(o_orderdate as timestamp) as intime,
               {d.plus_hours('o_orderdate', f"o_totalprice / {num('1500')}")} as outtime
        from {d.t('orders')}"""
    v["raw_admissions"] = f"""
        select distinct o_custkey as subject_id, {hadm} as hadm_id,
               concat('ETH', {txt(hadm + ' % 3')}) as ethnicity
        from {d.t('orders')}"""
    v["raw_patients"] = f"""
        select c_custkey as subject_id, case when c_nationkey % 2 = 0 then 'F' else 'M' end as gender,
               {d.plus_hours("timestamp '1930-01-01 00:00:00'", f"floor({u(1, 'born', 'c_custkey')} * 27000) * 24")} as born
        from {d.t('customer')}"""
    v["subject_lists"] = f"""
        select c_custkey as subject_id,
               case when {u(1, 'list', 'c_custkey')} < 0.2 then 'test'
                    when {u(1, 'list', 'c_custkey')} < 0.3 then 'val' else 'train' end as list,
               case when {u(1, 'listed', 'c_custkey')} < 0.95 then 1 else 0 end as flag
        from {d.t('customer')}"""
    code = "lpad(" + txt("(p_partkey * 7919) % 1000000") + ", 6, '0')"
    v["parts"] = f"""
        select p_partkey, p_name as title, p_brand as grp, p_size,
               cast(replace(p_brand, 'Brand#', '') as int) as group_id,
               case when p_size <= 4 then concat('V', {code}) when p_size <= 7 then concat('E', {code})
                    else {code} end as code
        from {d.t('part')}"""
    v["dictionary"] = "select code, title from parts where p_size < 48"
    v["ccs"] = "select grp, group_id, group_id <= 12 as use_flag, code from parts where p_size >= 3"
    v["definitions"] = "select distinct grp, group_id, group_id <= 12 as use_flag from parts"
    v["raw_dx"] = f"""
        select o_custkey as subject_id, {d.idiv('l_orderkey', '2')} as hadm_id, l_linenumber as seq,
               p.code, l_orderkey * 10 + l_linenumber as source_row
        from {d.t('lineitem')} l join parts p on l.l_partkey = p.p_partkey
        join {d.t('orders')} o on l.l_orderkey = o.o_orderkey"""
    start = "timestamp '2024-01-01 00:00:00'"
    v["note_stays"] = f"""
        select conv_id as subject_id, conv_id + 1000000 as hadm_id, conv_id + 500 as stay_id,
               {d.plus_hours(start, 'conv_id')} as intime,
               {d.plus_hours(start, f"conv_id + 1 + {num('3')} * {u(1, 'stay', 'conv_id')}")} as outtime,
               1 + {num('3')} * {u(1, 'stay', 'conv_id')} as los_nominal
        from (select distinct conv_id from {d.t('conversations')}) c"""
    note = ("conv_id", "turn")
    v["raw_notes"] = f"""
        select conv_id as subject_id, conv_id + 1000000 as hadm_id,
               case when {u(1, 'untimed', *note)} < 0.05 then null else
               {d.plus_hours(start, f"conv_id + {d.idiv('turn', '2')} - case when {u(1, 'early', *note)} < 0.1 then 3 else 0 end")} end as charttime,
               case when {u(1, 'err', *note)} < 0.05 then '1' end as iserror,
               case role when 'user' then 'Nursing' when 'assistant' then 'Physician ' else 'Discharge summary' end as category,
               case when {u(1, 'desc', *note)} < 0.7 then 'Report' end as description,
               case when {u(1, 'head', *note)} < 0.5
                    then concat('  Admission Date: [**x y**] 3. Dr. A m.d. -- ', text) else text end as text,
               conv_id * 100 + turn as source_row
        from {d.t('conversations')}"""
    e = "event_id"
    v["items"] = f"""
        select distinct case event_type when 'click' then 1 when 'error' then 2 when 'purchase' then 3
                        when 'signup' then 4 else 5 end as item_id,
               case event_type when 'click' then 'Systolic blood pressure' when 'error' then 'Glascow coma scale total'
                    when 'purchase' then 'Glucose' when 'signup' then 'Temperature' else 'Heart Rate' end as variable,
               case event_type when 'signup' then 'Temp C' else 'Item' end as item_label
        from {d.t('events')}"""
    v["raw_events"] = f"""
        select event_id, user_id as subject_id,
               case when {u(1, 'byid', e)} < 0.3 then user_id * 2 + 1 end as stay_id,
               cast(ts as timestamp) as charttime,
               cast(case when {u(1, 'item', e)} < 0.05 then 99 else case event_type when 'click' then 1
                    when 'error' then 2 when 'purchase' then 3 when 'signup' then 4 else 5 end end as int) as item_id,
               case event_type
                    when 'click' then case when {u(1, 'slash', e)} < 0.3 then concat({txt(d.whole('value') + ' + 100')}, '/80')
                                           else {txt('value')} end
                    when 'error' then {txt('3 + ' + d.whole('value') + ' % 13')}
                    when 'purchase' then case when {u(1, 'bad', e)} < 0.1 then 'ERROR' else {txt('value')} end
                    else {txt('value')} end as value,
               case when event_type = 'signup' then case when {u(1, 'uom', e)} < 0.5 then 'Deg. F' else 'C' end end as uom
        from {d.t('events')}"""
    lo = "cast(min(ts) as timestamp)"
    v["ev_windows"] = f"""
        select user_id as subject_id, user_id * 2 as stay_id, {lo} as intime, {d.plus_hours('min(ts)', '240')} as outtime
        from {d.t('events')} group by user_id
        union all
        select user_id, user_id * 2 + 1, {d.plus_hours('min(ts)', '192')}, {d.plus_hours('min(ts)', '480.5')}
        from {d.t('events')} group by user_id"""
    v["ev_stays"] = f"""
        select subject_id, stay_id, intime, outtime, {d.hours('outtime', 'intime')} as los_hours,
               case when {u(1, 'evsplit', 'subject_id')} < 0.7 then 'train'
                    when {u(1, 'evsplit', 'subject_id')} < 0.85 then 'val' else 'test' end as partition
        from ev_windows"""
    v["vec"] = f"""
        select vec_id as id, {d.idiv('vec_id', '3')} as group_id, embedding, label as main_label,
               {d.whole(u(1, 'second', 'vec_id') + ' * 10')} as second_label,
               case when {u(1, 'role', 'vec_id')} < 0.2 then 'labeled'
                    when {u(1, 'role', 'vec_id')} < 0.3 then 'reference' else 'candidate' end as role
        from {d.t('embeddings')}"""
    y = "case when h.o_orderkey is null then 0 else 1 end"
    v["pairs25"] = f"""
        select distinct l_orderkey as o_orderkey, cast(replace(p_brand, 'Brand#', '') as int) as n
        from {d.t('lineitem')} l join {d.t('part')} p on l.l_partkey = p.p_partkey"""
    v["grid25"] = f"select o_orderkey, cast(n as int) as n from {d.t('orders')} {d.labels25()}"
    keys = ("g.o_orderkey", "g.n")
    v["cells"] = f"""
        select g.o_orderkey as id, concat('Brand#', {txt('g.n')}) as label, g.n - 1 as ord, {y} as y,
               {num('0.5')} * {u(1, 'p', *keys)} + {num('0.3')} * {y} as p,
               {num('0.5')} * {u(1, 'q', *keys)} + {num('0.35')} * {y} as q,
               case when {u(1, 'ppsplit', 'g.o_orderkey')} < 0.6 then 'train'
                    when {u(1, 'ppsplit', 'g.o_orderkey')} < 0.8 then 'val' else 'test' end as split
        from grid25 g left join pairs25 h on g.o_orderkey = h.o_orderkey and g.n = h.n"""
    if d.packs:
        # One row an order until the end: its brands travel as a set, not as rows of the grid.
        v["cells"] = f"""
        select o_orderkey as id, concat('Brand#', {txt('n')}) as label, n - 1 as ord, y,
               {num('0.5')} * {u(1, 'p', 'o_orderkey', 'n')} + {num('0.3')} * y as p,
               {num('0.5')} * {u(1, 'q', 'o_orderkey', 'n')} + {num('0.35')} * y as q, split
        from (select o_orderkey, cast(n as int) as n, split, case when array_contains(ns, cast(n as int)) then 1 else 0 end as y
              from (select o_orderkey, ns,
                           case when {u(1, 'ppsplit', 'o_orderkey')} < 0.6 then 'train'
                                when {u(1, 'ppsplit', 'o_orderkey')} < 0.8 then 'val' else 'test' end as split
                    from {d.t('orders')} left join
                         (select l_orderkey, collect_set(cast(replace(p_brand, 'Brand#', '') as int)) as ns
                          from {d.t('lineitem')} l join {d.t('part')} p on l.l_partkey = p.p_partkey group by l_orderkey) h
                         on o_orderkey = l_orderkey) o {d.labels25()}) c"""
    v["pp_rows"] = f"""
        select o_orderkey as id,
               case when {u(1, 'ppsplit', 'o_orderkey')} < 0.6 then 'train'
                    when {u(1, 'ppsplit', 'o_orderkey')} < 0.8 then 'val' else 'test' end as partition,
               cast(case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2
                    when '4-NOT SPECIFIED' then 3 else 4 end as int) as unit_code,
               {u(1, 'note-gap', 'o_orderkey')} >= 0.1 as notes_available,
               {u(1, 'series-gap', 'o_orderkey')} >= 0.05 as series_available,
               cast(coalesce(c.k, 0) as bigint) as positives
        from {d.t('orders')} left join (select o_orderkey as okey, count(*) as k from pairs25 group by o_orderkey) c
             on o_orderkey = c.okey"""
    flags = ", ".join(
        f"case when c_mktsegment = '{s}' then {num('1')} else {num('0')} end as demographics_ethnicity_{s.lower()}"
        for s in SEGMENTS
    )
    k = "c_custkey"
    v["wide"] = f"""
        select c_custkey + 1 as general_subject_id, c_custkey + 1000000 as general_study_id,
               cast(floor({u(1, 'fold', k)} * 20) as int) as general_strat_fold,
               cast(floor({u(1, 'ecgno', k)} * 3) as int) as general_ecg_no_within_stay,
               c_custkey as general_data, {d.idiv(k, '2')} as general_ed_stay_id,
               {flags},
               case when {u(1, 'gap1', k)} < 0.1 then null else cast(c_nationkey % 7 as double) end as demographics_age,
               cast(o.n as double) as biometrics_visits, o.spend as biometrics_spend,
               case when {u(1, 'gap2', k)} < 0.1 then null else c_acctbal end as labvalues_balance,
               cast(c_nationkey % 3 as double) as labvalues_low,
               cast(1 + c_nationkey % 4 as double) as vitals_acuity,
               cast(0 as double) as vitals_acuity_m,
               case when c_acctbal > 0 then 1 else 0 end as diagnoses_a,
               case when c_mktsegment = 'BUILDING' then 1 else 0 end as diagnoses_b,
               case when {u(1, 'gap3', k)} < 0.2 then -999 when c_acctbal > 5000 then 1 else 0 end as deterioration_a
        from {d.t('customer')} left join
             (select o_custkey, count(*) as n, {d.mean('o_totalprice')} as spend from {d.t('orders')} group by o_custkey) o
             on c_custkey = o.o_custkey"""
    v["sig"] = f"""
        select user_id as study_id,
               case event_type when 'click' then 'I' when 'error' then 'II' when 'purchase' then 'V1'
                    when 'signup' then 'aVR' else 'zz' end as lead,
               cast(row_number() over (partition by user_id, event_type order by ts, event_id) - 1 as int) as t,
               case when {u(1, 'siggap', e)} < 0.15 then null else (value - 50) / {num('20')} end as mv
        from {d.t('events')}"""
    doc = "d.doc_id"
    v["img"] = f"""
        select {txt(doc)} as item_id, {d.idiv(doc, '2')} as group_id,
               coalesce(quality, 0) as l_quality, coalesce(toxic, 0) as l_toxic,
               case when lang = 'en' then 1 else 0 end as l_en, case when lang = 'fr' then 1 else 0 end as l_fr,
               case when {u(1, 'age', doc)} < 0.05 then 'nao' when {u(1, 'age', doc)} < 0.1 then ' '
                    when {u(1, 'age', doc)} < 0.15 then '1O'
                    else replace({txt(f"n_chars / {num('10')}")}, '.', ',') end as age,
               case when {u(1, 'lang', doc)} < 0.1 then '' else concat(' ', upper(lang)) end as lang_raw,
               source,
               concat(lang, ', ', source, ',0,', lang) as remarks
        from {d.t('documents')} d left join {d.t('labels')} l on d.doc_id = l.doc_id"""
    return v


_WORD = re.compile(r"[a-z_][a-z0-9_]*")


def needed(text: str, texts: dict[str, str]) -> list[str]:
    """View names a text uses, each after the views it builds on."""
    order: list[str] = []

    def visit(body: str) -> None:
        words = set(_WORD.findall(body))
        for name in texts:
            if name in words and name not in order and texts[name] is not body:
                visit(texts[name])
                if name not in order:
                    order.append(name)

    visit(text)
    return order


def with_clause(text: str, texts: dict[str, str]) -> str:
    names = needed(text, texts)
    if not names:
        return text
    ctes = ",\n".join(f"{n} as ({texts[n]})" for n in names)
    body = text.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[15:]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


class Tables:
    """The views of one folder as DataFrames; derived ones go through the operators."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._dialect = Spark_(spark, folder)
        self._texts = views(self._dialect)

    def raw(self, name: str) -> DataFrame:
        return self.spark.table(self._dialect.t(name))

    def view(self, name: str) -> DataFrame:
        return self.spark.sql(with_clause(f"select * from {name}", self._texts))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._texts:
            raise AttributeError(name)
        frame = self.view(name)
        setattr(self, name, frame)
        return frame

    # -- composites -------------------------------------------------------------
    @cached_property
    def stays(self) -> DataFrame:
        return cohort.benchmark_stays(self.raw_stays, self.raw_admissions, self.raw_patients)

    @cached_property
    def split_stays(self) -> DataFrame:
        listed = self.subject_lists.filter("flag = 1")
        return cohort.assign_partitions(
            self.stays,
            listed.filter("list = 'test'").select("subject_id"),
            listed.filter("list = 'val'").select("subject_id"),
        )

    @cached_property
    def coded(self) -> DataFrame:
        known = labels.known_codes(self.raw_dx, self.dictionary)
        return labels.attach_groups(labels.to_stays(known, self.stays), self.ccs)

    @cached_property
    def dx_groups(self) -> DataFrame:
        from ..functions.columns import diagnosis_group3

        return self.raw_dx.select(
            "hadm_id", diagnosis_group3(F.col("code")).alias("grp"), "source_row"
        ).filter("grp is not null")

    @cached_property
    def clean(self) -> DataFrame:
        scan = events.event_scan(self.raw_events)
        return events.clean_events(events.in_scope(scan, self.ev_stays, self.items), self.items)

    @cached_property
    def stay_events(self) -> DataFrame:
        return events.largest_per_time(events.attribute(self.clean, self.ev_stays), frames.CATEGORIES)

    @cached_property
    def pool(self) -> DataFrame:
        wide = F.transform("embedding", lambda x: x.cast("double"))
        head = F.slice(wide, 1, LABELS)
        y = F.transform(
            F.sequence(F.lit(0), F.lit(LABELS - 1)),
            lambda i: ((i == F.col("main_label")) | (i == F.col("second_label"))).cast("int"),
        )
        return self.vec.select(
            "id",
            "group_id",
            "role",
            F.transform(head, lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-8.0) * x))).alias("p"),
            wide.alias("features"),
            F.array(F.slice(wide, 1, TOKEN_WIDTH), F.slice(wide, TOKEN_WIDTH + 1, TOKEN_WIDTH)).alias("tokens"),
            y.alias("y"),
        )

    def role(self, name: str) -> DataFrame:
        return self.pool.filter(F.col("role") == name)

    @cached_property
    def brand_names(self) -> DataFrame:
        brands = self.raw("part").select(F.col("p_brand").alias("label")).distinct()
        return brands.select("label", (F.regexp_extract("label", r"(\d+)", 1).cast("int") - 1).alias("ord"))

    @cached_property
    def positives(self) -> DataFrame:
        return self.pairs25.select(
            F.col("o_orderkey").alias("id"), F.concat(F.lit("Brand#"), F.col("n").cast("string")).alias("label")
        )

    def arm(self, column: str = "p", split: str | None = None) -> DataFrame:
        rows = self.cells if split is None else self.cells.filter(F.col("split") == split)
        return rows.select("id", "label", "ord", "y", F.col(column).alias("p"))

    @cached_property
    def groups(self) -> DataFrame:
        pos = self.group_positives
        return splits.group_split(self.img.select("group_id").distinct(), pos, SEED)

    @cached_property
    def group_positives(self) -> DataFrame:
        targets = metadata.group_targets(self.img, IMG_LABELS)
        pairs = F.explode(
            F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("y")) for n in IMG_LABELS])
        )
        return targets.select("group_id", pairs.alias("c")).filter("c.y = 1").select("group_id", "c.label")

    @cached_property
    def note_offsets(self) -> DataFrame:
        return notes.first_offsets(self.raw_notes, self.note_stays)


from .dialect import Duck, Spark as Spark_  # noqa: E402

META = metadata.MetaFields(
    numeric=("age",), categorical=("lang_raw", "source"), folded=("lang_raw",), tokens="remarks"
)
DUCK = Duck()
DUCK_VIEWS = views(DUCK)
