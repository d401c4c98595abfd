"""Queries over a candidate pool: prototypes, disagreement, mixup, design, rounds."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from ..functions.scalars import with_scalars
from ..functions import columns as C
from ..functions.ranks import rank_fraction, spearman, take_top
from ..functions.vectors import LinearFuser, vector_mean
from ..operators import audit, design, disagreement as dg, greedy, mixup, prototypes as pt, readouts, selection, splits
from ..session import cut_lineage, scratch_path
from . import bindings as B
from . import loop, methods
from .oracle_views import ORACLE_VIEWS, R
from .registry import query

U = B.DUCK.u
BUDGET, WORK, GRID = 40, 150, 8
LABEL_WEIGHTS = np.array([[0.6], [0.4]]) * np.ones((1, B.LABELS))
MODALITY_WEIGHTS = np.array([0.6, 0.4])


def _head() -> np.ndarray:
    """Linear head over the concatenated tokens: label c reads element c with weight 8."""
    return 8.0 * np.eye(B.LABELS, 2 * B.TOKEN_WIDTH)


def _readout_weights() -> np.ndarray:
    """Every modality's readout: label c reads the token's element c with weight 8."""
    one = 8.0 * np.eye(B.LABELS, B.TOKEN_WIDTH + 1)
    return np.stack([one] * B.MODALITIES)


FUSER = LinearFuser(_head())

ORACLE_VIEWS.update(
    {
        "cand_p": "select id, label, p from pool_p where role = 'candidate'",
        "q_cells": """
            select t.id, t.role, t.modality, cast(i - 1 as int) as label, 1.0::double / (1.0::double + exp(-8.0::double * t.t[i])) as q
            from pool_tok t cross join (select unnest(range(1, 11)) as i) g""",
        "prev": "select label, avg(y) as prevalence from pool_y where role = 'labeled' group by label",
        "thr_f": "select c.label, max(case when rn = floor(ppos) then p end) + (max(ppos) - floor(max(ppos))) * (max(case when rn = ceil(ppos) then p end) - max(case when rn = floor(ppos) then p end)) as threshold from (select c.*, row_number() over (partition by c.label order by p) - 1 as rn, (1.0 - prevalence) * (count(*) over (partition by c.label) - 1) as ppos from cand_p c join prev on c.label = prev.label) c group by c.label",
        "thr_m": "select modality, label, max(case when rn = floor(ppos) then q end) + (max(ppos) - floor(max(ppos))) * (max(case when rn = ceil(ppos) then q end) - max(case when rn = floor(ppos) then q end)) as threshold from (select c.*, row_number() over (partition by modality, c.label order by q) - 1 as rn, (1.0 - prevalence) * (count(*) over (partition by modality, c.label) - 1) as ppos from q_cells c join prev on c.label = prev.label where role = 'candidate') c group by modality, label",
        "dec_m": "select q.id, q.modality, q.label, q.q, q.q >= t.threshold - 1e-9 as mp from q_cells q join thr_m t on q.modality = t.modality and q.label = t.label where q.role = 'candidate'",
        "dec_f": "select c.id, c.label, c.p, c.p >= t.threshold - 1e-9 as fp from cand_p c join thr_f t on c.label = t.label",
        "support0": "select f.id, f.label, f.p, f.fp, f.fp or m.anyp as s0 from dec_f f join (select id, label, bool_or(mp) as anyp from dec_m group by id, label) m on f.id = m.id and f.label = m.label",
        "support": "select id, label, fp, s0 or (not bool_or(s0) over (partition by id) and row_number() over (partition by id order by p desc, label) = 1) as support from support0",
        "js_cells": """
            select id, label, greatest(-(mx * ln(mx) + (1 - mx) * ln(1 - mx)) - he, 0) as js from (
              select id, label, sum(w * q) as mx, sum(w * -(q * ln(q) + (1 - q) * ln(1 - q))) as he from (
                select id, label, case modality when 0 then 0.6::double else 0.4::double end as w, q from dec_m) a group by id, label) b""",
        "disagree": "select j.id, sum(case when support then js else 0 end) / greatest(count(*) filter (support), 1) as disagreement from js_cells j join support s on j.id = s.id and j.label = s.label group by j.id",
        "jacc": "select m.id, modality, coalesce(count(*) filter (mp and fp) / nullif(count(*) filter (mp or fp), 0)::double, 0.0) as jaccard from dec_m m join dec_f f on m.id = f.id and m.label = f.label group by m.id, modality",
        "suff": "select id, max(jaccard) as dominance, 1.0::double - max(jaccard) as penalty from jacc group by id",
        "measured": """
            select id, disagreement, dominance, penalty, rd * rp as screen from (
              select d.id, d.disagreement, s.dominance, s.penalty,
                (rank() over (order by d.disagreement) + (count(*) over (partition by d.disagreement) - 1) / 2.0::double) / count(*) over () as rd,
                (rank() over (order by s.penalty) + (count(*) over (partition by s.penalty) - 1) / 2.0::double) / count(*) over () as rp
              from disagree d join suff s on d.id = s.id) x""",
        "workset": f"select *, row_number() over (order by round(screen, 12) desc, id) as screen_rank from measured order by round(screen, 12) desc, id limit {WORK}",
        "proto0": "select modality, label, avg(t.t[label + 1]) as v from pool_tok t cross join (select cast(unnest(range(0, 10)) as int) as label) g where role = 'labeled' group by modality, label",
        "moves": f"""
            select w.id, m as modality, g, bool_or((1.0::double / (1.0::double + exp(-8.0::double * (case when m = 0 then (1.0::double - g / {GRID}.0::double) * t.t[f.label + 1] + (g / {GRID}.0::double) * pr.v else t.t[f.label + 1] end))) >= th.threshold - 1e-9) <> f.fp) as changed
            from workset w join pool_tok t on w.id = t.id and t.modality = 0 join dec_f f on w.id = f.id join thr_f th on th.label = f.label
            join proto0 pr on pr.label = f.label and pr.modality = 0
            cross join (values (0), (1)) mm(m) cross join (select unnest(range(1, {GRID + 1})) as g) gg group by w.id, m, g""",
        "alphas": f"select id, modality, coalesce(max(case when changed then 1.0::double - g / {GRID}.0::double end), 0.0) as alpha from moves group by id, modality",
        "instab": "select id, sum(case modality when 0 then 0.6::double else 0.4::double end * alpha) as instability from alphas group by id",
        "combined0": """
            select m.*, w.screen_rank, coalesce(i.instability, 0.0) as instability from measured m left join workset w on m.id = w.id left join instab i on m.id = i.id""",
        "combined": """
            select id, disagreement, penalty, dominance, screen, screen_rank, instability, case when screen_rank is null then 0.0 else exp(ln(r1) + ln(r2) + ln(r3)) end as combined from (
              select *, (rank() over (order by disagreement) + (count(*) over (partition by disagreement) - 1) / 2.0::double) / count(*) over () as r1,
                (rank() over (order by instability) + (count(*) over (partition by instability) - 1) / 2.0::double) / count(*) over () as r2,
                (rank() over (order by penalty) + (count(*) over (partition by penalty) - 1) / 2.0::double) / count(*) over () as r3 from combined0) x""",
        "unit_cells": "select id, role, cast(i as int) as pos, un[i] as v from pool_unit cross join (select unnest(range(1, 65)) as i) g",
        "proto_sums": """
            select case when y.y = 1 then y.label else -1 end as label, c.pos, sum(c.v) as s from unit_cells c join pool_y y on c.id = y.id where c.role = 'labeled' group by 1, 2""",
        "proto": "select label, pos, s / greatest(sqrt(sum(s * s) over (partition by label)), 1e-12) as v from proto_sums",
        "own_sim": "select c.id, c.role, p.label, sum(c.v * p.v) as s from unit_cells c join proto p on c.pos = p.pos group by c.id, c.role, p.label",
        "pos_thr": "select g.label, coalesce(t, 0.0) as threshold from (select cast(unnest(range(0, 10)) as int) as label) g left join (select s.label, (min(s.s) + max(s.s)) / 2 as t from own_sim s join pool_y y on s.id = y.id and s.label = y.label where s.role = 'labeled' and y.y = 1 group by s.label) x on g.label = x.label",
        "expect": "select avg(n) as e from (select id, sum(y)::double as n from pool_y where role = 'labeled' group by id) x",
        "evidence": """
            select s.id, 1.0::double / (sum(case when p.p >= 0.5 then greatest((s.s + 1) * 0.5, 1e-10) else 0 end) + 10 * 1e-10) as inverse_positive_evidence,
                   count(*) filter (s.s > t.threshold)::double as prototype_positive_count, abs(count(*) filter (s.s > t.threshold) - max(e)) as cardinality_mismatch
            from own_sim s join pool_p p on s.id = p.id and s.label = p.label join pos_thr t on s.label = t.label cross join expect where s.role = 'candidate' group by s.id""",
    }
)

# -- helpers ----------------------------------------------------------------------


@query("rank_fractions", "E5", f"select event_id as id, {R('(rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double) / count(*) over ()')} as r from events")
def _(t):
    return rank_fraction(t.raw("events").select(F.col("event_id").alias("id"), "value"), "value", "r").select("id", "r")


_GAPS = "(select event_id as id, user_id % 7 as k, case when event_id % 5 <> 0 then value end as v from events)"


def _gaps(t):
    e = t.raw("events")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 7).alias("k"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"))


@query("rank_fractions_with_gaps", "E5", f"""
    select id, {R('case when v is not null then (rank() over (partition by k order by v nulls last) + (count(*) over (partition by k, v) - 1) / 2.0::double) / count(v) over (partition by k) end')} as r from {_GAPS} g""")
def _(t):
    return rank_fraction(_gaps(t), "v", "r", ["k"]).select("id", "r")


@query("top_scores_with_gaps", "F2", f"""
    select id, row_number() over (order by v desc nulls last, id) as rank from {_GAPS} g order by v desc nulls last, id limit (select count(*) * 9 // 10 from events)""")
def _(t):
    rows = _gaps(t)
    return take_top(rows, "v", "id", rows.count() * 9 // 10).select("id", "rank")


@query("binary_entropy", "H20", f"select id, label, {R('-(p * ln(p) + (1 - p) * ln(1 - p))')} as entropy from pool_p")
def _(t):
    return t.pool.select("id", F.posexplode("p").alias("label", "p")).select("id", "label", C.binary_entropy(F.col("p")).alias("entropy"))


@query("linear_head_probabilities", "H21 U4", f"select id, label, {R('p')} as p from pool_p")
def _(t):
    out = selection.with_fused(t.pool.select("id", "tokens"), FUSER)
    return out.select("id", F.posexplode("p").alias("label", "p"))


@query("linear_head_sigmoid", "H21", f"select id, {R('1.0::double / (1.0::double + exp(-(list_inner_product([x::double for x in embedding], [x::double for x in embedding]))))')} as p from vec")
def _(t):
    return t.pool.select("id", C.sigmoid(C.dot(F.col("features"), F.col("features"))).alias("p"))


@query("biased_vectors", "H23", "select id, 65 as width, 1.0::double as last from vec")
def _(t):
    v = C.with_bias(F.col("features"))
    return t.pool.select("id", F.size(v).alias("width"), F.element_at(v, -1).alias("last"))


@query("own_prototype_cosine", "H22", f"select id, {R('list_cosine_similarity(a.t, b.t)')} as cosine from pool_tok a join (select id as bid, t from pool_tok where modality = 1) b on a.id = b.bid where modality = 0")
def _(t):
    return t.pool.select("id", C.cosine(F.element_at("tokens", 1), F.element_at("tokens", 2)).alias("cosine"))


@query("interpolated_tokens", "H28", f"""
    select id, cast(i - 1 as int) as pos, {R('0.25::double * t.t[i] + 0.75::double * m.v')} as v from pool_tok t cross join (select cast(unnest(range(1, 33)) as int) as i) g
    join (select cast(i as int) as j, avg(t[i]) as v from pool_tok cross join (select unnest(range(1, 33)) as i) g where modality = 0 group by 1) m on m.j = i where modality = 0""")
def _(t):
    center = t.pool.select(F.element_at("tokens", 1).alias("vec")).agg(vector_mean("vec").alias("c"))
    moved = with_scalars(t.pool, center).select("id", C.blend(F.element_at("tokens", 1), F.col("c"), 0.25).alias("m"))
    return moved.select("id", F.posexplode("m").alias("pos", "v"))


@query("coalition_members", "H29", "select id, (id % 4) & 1 = 1 as first, ((id % 4) >> 1) & 1 = 1 as second, bit_count((id % 4)::int)::int as members from vec")
def _(t):
    mask = (F.col("id") % 4).cast("int")
    m = C.coalition_members(mask, 2)
    return t.pool.select("id", F.element_at(m, 1).alias("first"), F.element_at(m, 2).alias("second"), F.bit_count(mask).alias("members"))


@query("pairwise_similarity", "H32", f"select a.id, {R('list_cosine_similarity(a.t, b.t)')} as similarity from pool_tok a join pool_tok b on a.id = b.id where a.modality = 0 and b.modality = 1")
def _(t):
    return design.pairwise_similarity(t.pool, 2).select("id", "similarity")


# -- pools and contracts ----------------------------------------------------------


@query("candidate_pool", "G1", "select id from vec where role <> 'labeled'")
def _(t):
    return selection.candidates(t.pool, t.role("labeled")).select("id")


@query("grown_labeled_set", "G2", "select id from vec where role in ('labeled', 'reference')")
def _(t):
    return selection.grown(t.role("labeled"), t.role("reference").unionByName(t.role("labeled")))


@query("pool_overlap", "G4", """
    select 'candidate/labeled' as "check", count(*) filter (role = 'labeled' and main_label = 3) as violations from vec union all select 'candidate/reference', 0 union all select 'labeled/reference', 0""")
def _(t):
    again = t.vec.filter("role = 'labeled' and main_label = 3").select("id", F.lit("candidate").alias("role"))
    return selection.pool_overlap(t.vec.select("id", "role").unionByName(again))


@query("random_selection", "L1 N7", f"""
    select id, row_number() over (order by {U(22, 'random', 'id')}, id) as rank from vec where role = 'candidate' order by {U(22, 'random', 'id')}, id limit {BUDGET}""")
def _(t):
    c = methods.Context(t.role("candidate"), t.role("labeled"), BUDGET, seed=20, round_index=2)
    return methods.acquire("random", c).select("id", "rank")


@query("initial_selection", "L2", f"select id from (select id from vec order by {U(17, 'initial', 'id')}, id limit 50) x order by id")
def _(t):
    return selection.initial_selection(t.pool, 50, B.SEED)


@query("initial_group_selection", "N9", f"select group_id from (select distinct group_id from vec) x order by {U(17, 'initial', 'group_id')}, group_id limit 30")
def _(t):
    return selection.initial_selection(t.pool.select("group_id").distinct(), 30, B.SEED, key="group_id")


@query("stable_top_scores", "F2", f"select id, row_number() over (order by p desc, id) as rank from cand_p where label = 0 order by p desc, id limit {BUDGET}")
def _(t):
    return take_top(t.role("candidate").select("id", F.element_at("p", 1).alias("s")), "s", "id", BUDGET).select("id", "rank")


@query("selection_contract", "L35", """
    select "check", violations::bigint as violations from (values ('budget differs', 0), ('id selected twice', 0), ('rank used twice', 0), ('id outside the pool', 0), ('id already labeled', 0)) v("check", violations)""")
def _(t):
    picked = selection.random_selection(t.role("candidate"), BUDGET, B.SEED)
    return selection.contract_findings(picked, t.role("candidate"), t.role("labeled"), BUDGET)


@query("group_selection_contract", "L42", f"""
    with g as (select group_id, bool_or(role = 'labeled') as l from vec group by group_id),
    s as (select group_id, l from g order by {U(17, 'random', 'group_id')}, group_id limit 30)
    select 'budget differs' as "check", 0 as violations union all select 'id selected twice', 0 union all select 'rank used twice', 0 union all select 'id outside the pool', 0
    union all select 'id already labeled', count(*) filter (l) from s""")
def _(t):
    groups = t.pool.select("group_id").distinct()
    picked = selection.random_selection(groups, 30, B.SEED, key="group_id")
    return selection.contract_findings(picked, groups, t.role("labeled").select("group_id").distinct(), 30, "group_id")


@query("output_findings", "J7", """
    select 'required value missing' as "check", 0 as violations union all select 'id listed twice', 0 union all select 'id not requested', count(*) filter (role = 'reference') from vec
    union all select 'id without output', count(*) filter (role = 'labeled') from vec""")
def _(t):
    return audit.output_findings(t.pool.filter("role <> 'labeled'"), t.pool.filter("role <> 'reference'"), ["p", "features", "tokens", "y"])


@query("requested_group_order", "G7", """
    select 'group requested twice' as "check", 0 as violations union all
    select 'requested group without rows', count(*) from (select group_id from vec group by 1 having not bool_or(role = 'candidate')) x union all select 'group not requested', 0""")
def _(t):
    return selection.order_findings(t.role("candidate"), t.pool.select("group_id").distinct())


@query("group_tokens", "D10", f"""
    select group_id, modality, cast(i - 1 as int) as pos, {R('avg(t[i])')} as v from pool_tok cross join (select cast(unnest(range(1, 33)) as int) as i) g group by 1, 2, 3""")
def _(t):
    out = selection.group_outputs(t.pool)
    return out.select("group_id", F.posexplode("tokens").alias("modality", "vec")).select("group_id", "modality", F.posexplode("vec").alias("pos", "v"))


@query("group_labels_and_counts", "D10", """
    select y.group_id, y.label, y.y, c.items from (select group_id, label, max(y) as y from pool_y group by 1, 2) y join (select group_id, count(*) as items from vec group by 1) c on y.group_id = c.group_id""")
def _(t):
    return selection.group_outputs(t.pool).select("group_id", "items", F.posexplode("y").alias("label", "y"))


@query("group_fused_outputs", "D10", f"""
    select group_id, label, {R('1.0::double / (1.0::double + exp(-8.0::double * avg(t[label + 1])))')} as p from pool_tok cross join (select cast(unnest(range(0, 10)) as int) as label) g where modality = 0 group by 1, 2""")
def _(t):
    return selection.group_outputs(t.pool, fuser=FUSER).select("group_id", F.posexplode("p").alias("label", "p"))


# -- prototypes -------------------------------------------------------------------


def _stacked(t, role):
    return pt.stacked_views(t.role(role), False)


def _bank(t):
    return pt.refresh_prototypes(_stacked(t, "labeled"))


@query("item_views", "L38", "select id, 3 as views, 32 as first_width, 64 as last_width from vec")
def _(t):
    v = pt.stacked_views(t.pool, True)
    return v.select("id", F.size("views").alias("views"), F.size(F.element_at("views", 1)).alias("first_width"), F.size(F.element_at("views", -1)).alias("last_width"))


@query("label_prototypes", "L3", f"select 0 as view, cast(label as int) as label, cast(pos - 1 as int) as pos, {R('v')} as v from proto")
def _(t):
    return _bank(t).select("view", "label", F.posexplode("vec").alias("pos", "v"))


@query("label_latent_prototypes", "L3 H22", f"select 0 as view, cast(label as int) as label, cast(pos - 1 as int) as pos, {R('v')} as v from proto")
def _(t):
    lat = t.role("labeled").select("id", "features", F.posexplode("y").alias("label", "y")).select("id", F.lit(0).alias("view"), "label", F.col("features").alias("vec"), "y")
    return pt.refresh_label_latents(lat).select("view", "label", F.posexplode("vec").alias("pos", "v"))


@query("prototype_similarities", "L4 L40", f"""
    select id, cast(label as int) as label, {R('s')} as own from own_sim where label >= 0 and role = 'candidate' union all
    select id, -1, {R('s')} from own_sim where label = -1 and role = 'candidate'""")
def _(t):
    out = pt.with_similarity(_stacked(t, "candidate"), _bank(t), B.LABELS)
    own = out.select("id", F.posexplode("own").alias("label", "own"))
    return own.unionByName(out.select("id", F.lit(-1).alias("label"), F.element_at("background", 1).alias("own")))


@query("labeled_prototype_similarities", "L39", f"select id, cast(label as int) as label, {R('s')} as own from own_sim where label >= 0 and role = 'labeled'")
def _(t):
    rows = _stacked(t, "labeled")
    return pt.with_similarity(rows, pt.refresh_prototypes(rows), B.LABELS).select("id", F.posexplode("own").alias("label", "own"))


@query("label_latent_similarities", "L4 H22", f"select id, cast(label as int) as label, {R('s')} as own from own_sim where label >= 0 and role = 'candidate'")
def _(t):
    lat = t.role("candidate").select("id", F.col("features").alias("vec"), F.posexplode("y").alias("label", "y")).withColumn("view", F.lit(0))
    return pt.label_latent_similarity(lat, _bank(t)).select("id", "label", "own")


def _measured(t):
    rows = _stacked(t, "labeled")
    return pt.with_similarity(rows, pt.refresh_prototypes(rows), B.LABELS)


@query("positive_thresholds", "L5", f"select cast(label as int) as label, {R('threshold')} as threshold from pos_thr")
def _(t):
    return pt.positive_thresholds(_measured(t))


@query("evidence_scores", "L6", f"""
    select id, {R('inverse_positive_evidence / 1e3')} as inverse_positive_evidence, {R('cardinality_mismatch')} as cardinality_mismatch, {R('prototype_positive_count')} as prototype_positive_count,
           {R('sqrt(inverse_positive_evidence) * sqrt(cardinality_mismatch)')} as combined from evidence""")
def _(t):
    s = pt.acquire(t.role("candidate"), t.role("labeled"), BUDGET, B.LABELS, scores=True)
    return s.withColumn("inverse_positive_evidence", F.col("inverse_positive_evidence") / 1e3)


@query("weighted_scores", "L7", f"""
    with c as (select s.id, s.label, s.s, p.p, p.p >= 0.5 or row_number() over (partition by s.id order by p.p desc, s.label) = 1 as ch from own_sim s join pool_p p on s.id = p.id and s.label = p.label where s.role = 'candidate' and s.label >= 0),
    a as (select id, avg(1 - abs(2 * p - 1)) as u, greatest(least((1 - sum(case when ch then s else 0 end) / greatest(count(*) filter (ch), 1)) * 0.5, 1), 0) as n, abs(sum(p) - max(e)) / 10.0 as k from c cross join expect group by id)
    select id, {R('u')} as uncertainty, {R('n')} as prototype_novelty, {R('k')} as cardinality_mismatch, {R('0.5 * u + 0.35 * n + 0.15 * k')} as combined from a""")
def _(t):
    lab = _stacked(t, "labeled")
    rows = pt.with_similarity(_stacked(t, "candidate"), pt.refresh_prototypes(lab), B.LABELS)
    out = pt.weighted_scores(rows, pt.expected_cardinality(lab))
    return out.select("id", "uncertainty", "prototype_novelty", "cardinality_mismatch", "combined")


@query("prototype_selection", "L8", f"""
    select id, row_number() over (order by sqrt(inverse_positive_evidence) * sqrt(cardinality_mismatch) desc, id) as rank from evidence order by 2 limit {BUDGET}""")
def _(t):
    return pt.acquire(t.role("candidate"), t.role("labeled"), BUDGET, B.LABELS).select("id", "rank")


@query("multi_view_prototype_selection", "L8 L38")
def _(t):
    return pt.acquire(t.role("candidate"), t.role("labeled"), BUDGET, B.LABELS, multi_view=True).select("id", "rank", "combined")


@query("score_summary", "L34", f"""
    with s as (select id, sqrt(inverse_positive_evidence) * sqrt(cardinality_mismatch) as combined, cardinality_mismatch, prototype_positive_count from evidence),
    b as (select *, row_number() over (order by combined desc, id) <= {BUDGET} as sel from s)
    select 'combined' as component, {R('avg(combined)')} as pool_mean, {R('avg(combined) filter (sel)')} as selected_mean from b union all
    select 'prototype_positive_count', {R('avg(prototype_positive_count)')}, {R('avg(prototype_positive_count) filter (sel)')} from b""")
def _(t):
    s = pt.acquire(t.role("candidate"), t.role("labeled"), BUDGET, B.LABELS, scores=True)
    return selection.score_summary(s, take_top(s, "combined", "id", BUDGET), ["combined", "prototype_positive_count"])


# -- disagreement -----------------------------------------------------------------


def _prev(t):
    return dg.label_prevalence(t.role("labeled"))


def _q(t, role="candidate"):
    return dg.readout(t.role(role), _readout_weights())


def _thresholds(t):
    pool = cut_lineage(_q(t))
    fused = dg.vector(dg.fused_thresholds(pool, _prev(t)), "threshold", B.LABELS)
    probe = dg.matrix(dg.modality_thresholds(pool, _prev(t)), "threshold", B.MODALITIES, B.LABELS)
    return pool, fused, probe


def _decided(t):
    pool, fused, probe = _thresholds(t)
    return dg.decisions(pool, fused, probe), fused


def _measures(t):
    pool, fused, probe = _thresholds(t)
    return dg.measures(pool, fused, probe, LABEL_WEIGHTS), fused


def _prototypes(t) -> np.ndarray:
    out = np.zeros((B.MODALITIES, B.TOKEN_WIDTH))
    for r in dg.modality_prototypes(t.role("labeled")).collect():
        out[r["modality"]] = r["vec"]
    return out


def _scored(t):
    measured, fused = _measures(t)
    measured = cut_lineage(measured)
    return cut_lineage(dg.screen(measured)), fused


def _worked(t):
    measured, fused = _scored(t)
    measured = measured.withColumn("screen", F.round("screen", 12))
    work = take_top(measured, "screen", "id", WORK, out="screen_rank")
    return dg.critical_instability(work, FUSER, _prototypes(t), fused, MODALITY_WEIGHTS, GRID)


@query("readout_probabilities", "L36", f"select id, modality, label, {R('q')} as q from q_cells")
def _(t):
    out = dg.readout(t.pool, _readout_weights())
    return out.select("id", F.posexplode("q").alias("modality", "a")).select("id", "modality", F.posexplode("a").alias("label", "q"))


@query("label_prevalence", "L37 N12", f"select label, {R('prevalence')} as prevalence from prev")
def _(t):
    return _prev(t)


@query("fused_thresholds", "E6", f"select label, {R('threshold')} as threshold from thr_f")
def _(t):
    return dg.fused_thresholds(t.role("candidate"), _prev(t))


@query("modality_thresholds", "E7", f"select modality, label, {R('threshold')} as threshold from thr_m")
def _(t):
    return dg.modality_thresholds(_q(t), _prev(t))


@query("decision_support", "L9", "select id, label, fp, support from support")
def _(t):
    pool, _f = _decided(t)
    return pool.select("id", F.posexplode(F.arrays_zip("fused_positive", "support")).alias("label", "c")).select("id", "label", F.col("c.fused_positive").alias("fp"), F.col("c.support").alias("support"))


@query("js_disagreement", "L10", f"select id, {R('disagreement')} as disagreement from disagree")
def _(t):
    return _measures(t)[0].select("id", "disagreement")


@query("modality_sufficiency", "L11", f"select id, {R('dominance')} as dominance, {R('penalty')} as penalty from suff")
def _(t):
    return _measures(t)[0].select("id", "dominance", "penalty")


@query("screened_workset", "F4", "select id, screen_rank from workset")
def _(t):
    measured = _scored(t)[0].withColumn("screen", F.round("screen", 12))
    return take_top(measured, "screen", "id", WORK, out="screen_rank").select("id", "screen_rank")


@query("component_spearman", "L12", f"""
    with r as (select (rank() over (order by disagreement) + (count(*) over (partition by disagreement) - 1) / 2.0::double) as a, (rank() over (order by penalty) + (count(*) over (partition by penalty) - 1) / 2.0::double) as b from measured)
    select {R('corr(a, b)')} as spearman from r""")
def _(t):
    return spearman(_scored(t)[0], "disagreement", "penalty")


@query("critical_instability", "L13", f"select a.id, a.modality, {R('alpha')} as alpha, {R('instability')} as instability from alphas a join instab i on a.id = i.id")
def _(t):
    return _worked(t).select("id", F.posexplode("alpha").alias("modality", "alpha"), "instability")


@query("flip_curves", "L13 E11", f"select modality, cast(g - 1 as int) as step, {R('avg(changed::int)')} as flip_rate from moves group by 1, 2")
def _(t):
    return dg.flip_curves(_worked(t))


@query("non_monotone_flips", "E11", f"""
    select modality, {R('avg(b::int)')} as rate from (select id, modality, bool_or(pc and not changed) as b from (
      select *, coalesce(lag(changed) over (partition by id, modality order by g), false) as pc from moves) x group by 1, 2) y group by 1""")
def _(t):
    return dg.non_monotone_rate(_worked(t))


@query("geometric_rank_score", "L14", f"""
    with r as (select id, (rank() over (order by disagreement) + (count(*) over (partition by disagreement) - 1) / 2.0::double) / count(*) over () as a,
      (rank() over (order by penalty) + (count(*) over (partition by penalty) - 1) / 2.0::double) / count(*) over () as b from measured)
    select id, {R('exp(ln(a) + 0.5 * ln(b))')} as combined from r""")
def _(t):
    return dg.geometric_rank_score(_scored(t)[0], ["disagreement", "penalty"], [1.0, 0.5]).select("id", "combined")


def _state(t):
    return dg.ReadoutState(_readout_weights(), LABEL_WEIGHTS, MODALITY_WEIGHTS, _prototypes(t), _prev(t), pt.expected_cardinality(t.role("labeled")))


@query("disagreement_scores", "L15", f"select id, {R('disagreement')} as disagreement, {R('penalty')} as penalty, {R('instability')} as instability, {R('combined')} as combined from combined")
def _(t):
    out = dg.acquire(t.role("candidate"), _state(t), FUSER, BUDGET, workset=WORK, grid=GRID)
    return out.scores.select("id", "disagreement", "penalty", "instability", "combined")


@query("disagreement_selection", "L15", f"select id, row_number() over (order by round(combined, 12) desc, screen_rank) as rank from combined where screen_rank is not null order by 2 limit {BUDGET}")
def _(t):
    return dg.acquire(t.role("candidate"), _state(t), FUSER, BUDGET, workset=WORK, grid=GRID).selection.select("id", "rank")


for _view in ("workset", "moves", "alphas", "instab", "combined0", "combined"):
    _whole = ORACLE_VIEWS[_view].replace(f" limit {WORK}", "")
    for _name in ("workset", "moves", "alphas", "instab", "combined0"):
        _whole = re.sub(rf"\b(from|join) {_name}\b", rf"\1 {_name}_whole", _whole)
    ORACLE_VIEWS[f"{_view}_whole"] = _whole


@query("disagreement_selection_whole", "L14 L15", f"""
    select id, row_number() over (order by round(combined, 12) desc, screen_rank) as rank, true as exact from combined_whole order by round(combined, 12) desc, screen_rank limit {BUDGET}""")
def _(t):
    return dg.acquire(t.role("candidate"), _state(t), FUSER, BUDGET, grid=GRID).selection.select("id", "rank", "exact")


@query("boundary_share", "E13", f"""
    with s as (select screen_rank from combined where screen_rank is not null order by round(combined, 12) desc, screen_rank limit {BUDGET})
    select {R(f'avg((screen_rank - 1 >= floor(0.9 * {WORK}))::int)')} as boundary_share from s""")
def _(t):
    return dg.boundary_share(dg.acquire(t.role("candidate"), _state(t), FUSER, BUDGET, workset=WORK, grid=GRID).selection, WORK)


@query("component_quantiles", "L16", "\nunion all ".join(f"select {q}::double as level, {R(f'quantile_cont(disagreement, {q})')} as value from measured" for q in (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)))
def _(t):
    return dg.component_quantiles(_scored(t)[0], "disagreement")


@query("largest_tie_share", "L16", f"select {R('max(n) / sum(n)::double')} as tie_share from (select dominance, count(*) as n from suff group by 1) x")
def _(t):
    return dg.largest_tie_share(_measures(t)[0], "dominance")


@query("disagreement_dominance_grid", "L17", """
    select cast(a as int) as d_bin, cast(b as int) as s_bin, coalesce(n, 0) as n from (select unnest(range(0, 10)) as a) x cross join (select unnest(range(0, 10)) as b) y
    left join (select least(greatest(trunc(disagreement / ln(2.0) * 10), 0), 9) as d, least(greatest(trunc(dominance * 10), 0), 9) as s, count(*) as n from measured group by 1, 2) c on c.d = a and c.s = b""")
def _(t):
    return dg.histogram_grid(_scored(t)[0], B.MODALITIES)


@query("modality_prototypes", "L18", f"""
    select modality, cast(i - 1 as int) as pos, {R('avg(t[i])')} as v from pool_tok cross join (select cast(unnest(range(1, 33)) as int) as i) g where role = 'labeled' group by 1, 2""")
def _(t):
    return dg.modality_prototypes(t.role("labeled")).select("modality", F.posexplode("vec").alias("pos", "v"))


@query("modality_medoids", "L18", f"""
    with c as (select modality, cast(i as int) as pos, avg(t[i]) as v from pool_tok cross join (select unnest(range(1, 33)) as i) g where role = 'labeled' group by 1, 2),
    d as (select t.id, t.modality, sqrt(sum((t.t[c.pos] - c.v) * (t.t[c.pos] - c.v))) as gap from pool_tok t join c on t.modality = c.modality where role = 'labeled' group by 1, 2)
    select modality, arg_min(id, {{'g': gap, 'i': id}}) as medoid_id, {R('min(gap)')} as medoid_gap from d group by modality""")
def _(t):
    return dg.modality_prototypes(t.role("labeled"), "medoid").select("modality", "medoid_id", "medoid_gap")


@query("prototype_norm_ratio", "L18", f"""
    with c as (select modality, cast(i as int) as pos, avg(t[i]) as v from pool_tok cross join (select unnest(range(1, 33)) as i) g where role = 'labeled' group by 1, 2)
    select a.modality, {R('a.n / b.n')} as norm_ratio from (select modality, sqrt(sum(v * v)) as n from c group by 1) a
    join (select modality, avg(sqrt(list_inner_product(t, t))) as n from pool_tok where role = 'labeled' group by 1) b on a.modality = b.modality""")
def _(t):
    lab = t.role("labeled")
    return dg.prototype_ratios(lab, dg.modality_prototypes(lab))


@query("grouped_folds", "L19", """
    with s as (select group_id, count(*) as size from vec where role = 'labeled' group by 1), r as (select *, row_number() over (order by size desc, group_id) - 1 as k from s)
    select group_id, size, cast(case when (k // 5) % 2 = 0 then k % 5 else 4 - k % 5 end as int) as fold from r""")
def _(t):
    sizes = t.role("labeled").groupBy("group_id").agg(F.count("*").alias("size"))
    return splits.serpentine_folds(sizes, "group_id", "size", 5).select("group_id", "size", "fold")


@query("balanced_folds", "L19", """
    with recursive s as (select group_id, count(*) as size from vec where role = 'labeled' group by 1),
    r as (select *, row_number() over (order by size desc, group_id) as k from s),
    g as (select 0::bigint as k, null::bigint as group_id, null::bigint as size, null::int as fold, 0::bigint as f0, 0::bigint as f1, 0::bigint as f2, 0::bigint as f3, 0::bigint as f4
          union all
          select k, group_id, size, fold, f0 + size * (fold = 0)::int, f1 + size * (fold = 1)::int, f2 + size * (fold = 2)::int, f3 + size * (fold = 3)::int, f4 + size * (fold = 4)::int
          from (select r.k, r.group_id, r.size, cast(case when f0 = least(f0, f1, f2, f3, f4) then 0 when f1 = least(f1, f2, f3, f4) then 1 when f2 = least(f2, f3, f4) then 2
                when f3 <= f4 then 3 else 4 end as int) as fold, f0, f1, f2, f3, f4 from g join r on r.k = g.k + 1) x)
    select group_id, size, fold from g where k > 0""")
def _(t):
    sizes = t.role("labeled").groupBy("group_id").agg(F.count("*").alias("size"))
    return splits.balanced_folds(sizes, "group_id", "size", 5)


@query("positive_weights", "L20", f"select label, {R('greatest(least((count(*) - sum(y)) / greatest(sum(y), 1)::double, 20), 1)')} as pos_weight from pool_y where role = 'labeled' group by label")
def _(t):
    return readouts.positive_weights(t.role("labeled"))


@query("out_of_fold_readouts", "L20")
def _(t):
    rows, n = readouts.with_folds(t.role("labeled"), 4)
    w = readouts.fit(rows, n, B.LABELS, B.MODALITIES, B.TOKEN_WIDTH, epochs=10)
    out = readouts.out_of_fold(rows, w)
    return out.select("id", F.posexplode("q").alias("modality", "a")).select("id", "modality", F.posexplode("a").alias("label", "q"))


# Two full-batch steps from zero, unrolled: gradients of all models (fold 0 is the full fit, fold f + 1
# leaves out fold f), moments, and the probabilities of the model that did not see a row's fold.
_TWO = 2


def _readout_sql(rate: float = 0.05, decay: float = 1e-4) -> str:
    err = lambda p: f"sum((({p}) * (1 + (posw - 1) * y) - posw * y) * x) / max(rows) / {B.LABELS * B.MODALITIES}.0::double"
    models = "m.f = 0 or m.f <> fold + 1"
    return f"""
    s as (select group_id, count(*) as size from vec where role = 'labeled' group by 1),
    r as (select *, row_number() over (order by size desc, group_id) as k from s),
    gf as (select 0::bigint as k, null::bigint as group_id, null::int as fold, 0::bigint as f0, 0::bigint as f1, 0::bigint as f2, 0::bigint as f3
          union all
          select k, group_id, fold, f0 + size * (fold = 0)::int, f1 + size * (fold = 1)::int, f2 + size * (fold = 2)::int, f3 + size * (fold = 3)::int
          from (select r.k, r.group_id, r.size, cast(case when f0 = least(f0, f1, f2, f3) then 0 when f1 = least(f1, f2, f3) then 1 when f2 <= f3 then 2 else 3 end as int) as fold, f0, f1, f2, f3
                from gf join r on r.k = gf.k + 1) x),
    xs as (select t.id, modality, fold, unnest(list_append(t.t, 1.0::double)) as x, unnest(range(0, {B.TOKEN_WIDTH + 1})) as j from pool_tok t join gf on gf.group_id = t.group_id where t.role = 'labeled'),
    ys as (select y.id, y.label, y.y::double as y, posw from pool_y y join (select label, greatest(least((count(*) - sum(y)) / greatest(sum(y), 1)::double, 20), 1) as posw from pool_y where role = 'labeled' group by label) w on w.label = y.label where y.role = 'labeled'),
    ms as (select unnest(range(0, 5)) as f),
    nr as (select m.f, count(distinct xs.id) as rows from ms m join xs on {models} group by m.f),
    g1 as (select m.f, modality, label, j, {err('0.5::double')} as g from ms m join xs on {models} join ys on ys.id = xs.id join nr on nr.f = m.f group by m.f, modality, label, j),
    w1 as (select f, modality, label, j, g, -{rate}::double * g / (abs(g) + 1e-8) as w from g1),
    p1 as (select m.f, xs.id, xs.modality, w1.label, 1 / (1 + exp(-sum(x * w))) as p from ms m join xs on {models} join w1 on w1.f = m.f and w1.modality = xs.modality and w1.j = xs.j group by m.f, xs.id, xs.modality, w1.label),
    g2 as (select p1.f, xs.modality, p1.label, j, {err('p1.p')} as g from p1 join xs on xs.id = p1.id and xs.modality = p1.modality join ys on ys.id = xs.id and ys.label = p1.label join nr on nr.f = p1.f group by p1.f, xs.modality, p1.label, j),
    w2 as (select w1.f, w1.modality, w1.label, w1.j, w1.w * (1 - {rate * decay}::double) - {rate}::double * ((0.09::double * w1.g + 0.1::double * g2.g) / (1 - 0.81::double)) / (sqrt((0.000999::double * w1.g * w1.g + 0.001::double * g2.g * g2.g) / (1 - 0.998001::double)) + 1e-8) as w
           from w1 join g2 on g2.f = w1.f and g2.modality = w1.modality and g2.label = w1.label and g2.j = w1.j)"""


@query("readouts_two_steps", "L20 L22 L37", f"""
    with recursive {_readout_sql()} select xs.id, cast(xs.modality as int) as modality, cast(w2.label as int) as label, {R('1 / (1 + exp(-sum(x * w)))')} as q
    from xs join w2 on w2.f = xs.fold + 1 and w2.modality = xs.modality and w2.j = xs.j group by xs.id, xs.modality, w2.label""")
def _(t):
    rows, n = readouts.with_folds(t.role("labeled"), 4)
    w = readouts.fit(rows, n, B.LABELS, B.MODALITIES, B.TOKEN_WIDTH, epochs=_TWO)
    out = readouts.out_of_fold(rows, w)
    return out.select("id", F.posexplode("q").alias("modality", "a")).select("id", "modality", F.posexplode("a").alias("label", "q"))


@query("converged_readouts", "L20")
def _(t):
    rows, n = readouts.with_folds(t.role("labeled"), 4)
    w = readouts.fit_converged(rows, n, B.LABELS, B.MODALITIES, B.TOKEN_WIDTH, decay=0.01).weights
    out = readouts.out_of_fold(rows, w)
    return out.select("id", F.posexplode("q").alias("modality", "a")).select("id", "modality", F.posexplode("a").alias("label", "q"))


_REL = """
    lab as (select q.modality, q.label, y.y::double as y, greatest(least(q.q, 1 - 1e-7), 1e-7) as q from q_cells q join pool_y y on q.id = y.id and q.label = y.label where q.role = 'labeled'),
    pv as (select label, greatest(least(avg(y), 1 - 1e-7), 1e-7) as r, sum(y)::double as pos from pool_y where role = 'labeled' group by label),
    gn as (select modality, lab.label, -(y * ln(r) + (1 - y) * ln(1 - r)) + (y * ln(q) + (1 - y) * ln(1 - q)) as g, greatest(-(r * ln(r) + (1 - r) * ln(1 - r)), 1e-7) as h, pos from lab join pv on lab.label = pv.label),
    pr as (select modality, label, avg(g) as ig, avg(g) / max(h) as skill, stddev_samp(g) / sqrt(count(*)) / max(h) as se, max(pos) as pos from gn group by 1, 2),
    md as (select modality, sum(skill * pos) / greatest(sum(pos), 1) as pooled, greatest(var_samp(skill) - avg(se * se), 0) as tv from pr group by 1),
    sh as (select pr.*, pooled, case when tv <= 1e-7 then pooled else tv / greatest(tv + se * se, 1e-7) * skill + (1 - tv / greatest(tv + se * se, 1e-7)) * pooled end as shrunk from pr join md on pr.modality = md.modality),
    lw as (select *, case when sum(greatest(shrunk, 0)) over (partition by label) > 1e-7 then greatest(shrunk, 0) / sum(greatest(shrunk, 0)) over (partition by label) else 0.5 end as lwt from sh)"""


@query("reliability_weights", "L21", f"""
    with {_REL} select modality, label, {R('ig')} as information_gain, {R('skill')} as skill, {R('se')} as skill_se, {R('pooled')} as pooled_skill, {R('shrunk')} as shrunk_skill, {R('lwt')} as label_weight,
      {R('sum(lwt * pos) over (partition by modality) / greatest(sum(pos) over (partition by modality), 1)')} as modality_weight from lw""")
def _(t):
    return readouts.reliability(_q(t, "labeled"))


@query("trained_disagreement_selection", "L22 L37")
def _(t):
    c = methods.Context(
        t.role("candidate"), t.role("labeled"), BUDGET, seed=B.SEED, fuser=FUSER, labels=B.LABELS, modalities=B.MODALITIES, width=B.TOKEN_WIDTH,
        options={"folds": 3, "epochs": 8, "workset": WORK},
    )
    return methods.acquire("fused_disagreement", c).select("id", "rank", "combined")


@query("prediction_entropy", "L15", f"select id, {R('avg(-(p * ln(p) + (1 - p) * ln(1 - p)))')} as entropy from cand_p group by id")
def _(t):
    return dg.prediction_entropy(t.role("candidate")).select("id", "entropy")


# -- mixup ------------------------------------------------------------------------

_RULE = mixup.Mixing(shape=1.0, sparse_share=0.5)
_MASS = "mass as (select id, sum(y)::double as positives, greatest(sum(y), 1)::double as mass from pool_y where role <> 'candidate' group by id)"
_ANCH = "an as (select id from mass where positives <= (select quantile_cont(positives, 0.5) from mass))"
_PLAN = f"""{_MASS}, {_ANCH},
    cl as (select mass, n, coalesce(sum(mass * n) over (order by mass rows between unbounded preceding and 1 preceding), 0) / sum(mass * n) over () as lo, mass * n / sum(mass * n) over () as width from (select mass, count(*) as n from mass group by mass) x),
    mem as (select id, mass, row_number() over (partition by mass order by id) as pos from mass),
    dr as (select an.id, cl.mass, least(floor(({U(17, 'partner', 'id')} - lo) / width * n), n - 1) + 1 as pos from an join cl on {U(17, 'partner', 'id')} >= lo and {U(17, 'partner', 'id')} < lo + width),
    pl as (select dr.id as anchor_id, mem.id as partner_id, greatest({U(17, 'lambda', 'dr.id')}, 1 - {U(17, 'lambda', 'dr.id')}) as lam from dr join mem on dr.mass = mem.mass and dr.pos = mem.pos where dr.id <> mem.id)"""


def _labeled_all(t):
    return t.pool.filter("role <> 'candidate'")


@query("mixup_anchors", "L23", f"with {_MASS}, {_ANCH} select id from an")
def _(t):
    return mixup.anchors(_labeled_all(t), 0.5).select("id")


@query("mixup_plan", "L23", f"with {_PLAN} select anchor_id, partner_id, {R('lam')} as lam from pl")
def _(t):
    return mixup.plan(_labeled_all(t), _RULE, B.SEED)


@query("mixup_plan_uniform", "L23", f"""
    with {_MASS}, {_ANCH}, ix as (select id, row_number() over (order by id) as pos, count(*) over () as n from mass),
    dr as (select ix.id, (pos - 1 + floor({U(17, 'partner', 'id')} * (n - 1)) + 1)::bigint % n + 1 as tgt from ix where id in (select id from an))
    select dr.id as anchor_id, ix.id as partner_id, {R(f"{U(17, 'lambda', 'dr.id')}")} as lam from dr join ix on dr.tgt = ix.pos""")
def _(t):
    return mixup.plan(_labeled_all(t), mixup.Mixing(1.0, False, 0.5, False), B.SEED)


@query("mixup_arcsine_weights", "L23", f"""
    with {_MASS}, {_ANCH}, ix as (select id, row_number() over (order by id) as pos, count(*) over () as n from mass),
    dr as (select ix.id, (pos - 1 + floor({U(17, 'partner', 'id')} * (n - 1)) + 1)::bigint % n + 1 as tgt from ix where id in (select id from an))
    select dr.id as anchor_id, ix.id as partner_id, round(pow(sin(pi() * {U(17, 'lambda', 'dr.id')} / 2), 2), 4) as lam from dr join ix on dr.tgt = ix.pos""")
def _(t):
    """A symmetric Beta of shape 1/2 has the quantile sin^2(pi u / 2)."""
    pairs = mixup.plan(_labeled_all(t), mixup.Mixing(0.5, False, 0.5, False), B.SEED)
    return pairs.withColumn("lam", F.round("lam", 4))


@query("mixup_feature_rows", "L24", f"""
    with {_PLAN} select anchor_id, cast(i - 1 as int) as pos, {R('lam * a.embedding[i]::double + (1 - lam) * b.embedding[i]::double')} as v from pl join vec a on a.id = anchor_id join vec b on b.id = partner_id cross join (select cast(unnest(range(1, 65)) as int) as i) g""")
def _(t):
    lab = _labeled_all(t)
    out = mixup.virtual_rows(lab, mixup.plan(lab, _RULE, B.SEED), ["features"])
    return out.select("anchor_id", F.posexplode("features").alias("pos", "v"))


@query("mixup_token_labels", "L24", f"""
    with {_PLAN} select anchor_id, a.label, {R('lam * a.y + (1 - lam) * b.y')} as y, {R('lam * ta.t[1] + (1 - lam) * tb.t[1]')} as second_first from pl join pool_y a on a.id = anchor_id join pool_y b on b.id = partner_id and a.label = b.label
    join pool_tok ta on ta.id = anchor_id and ta.modality = 1 join pool_tok tb on tb.id = partner_id and tb.modality = 1""")
def _(t):
    lab = _labeled_all(t)
    out = mixup.virtual_tokens(lab, mixup.plan(lab, _RULE, B.SEED), 2)
    return out.select("anchor_id", F.element_at(F.element_at("tokens", 2), 1).alias("second_first"), F.posexplode("y").alias("label", "y"))


@query("mixup_summary", "L23", f"""
    with {_PLAN} select count(*) as virtual_rows, {R('avg(lam)')} as mean_lambda, {R('avg(a.positives)')} as anchor_positive_mean, {R('avg(lam * a.positives + (1 - lam) * b.positives)')} as mixed_positive_mean,
      {R('count(*) / (select count(*) from mass)::double')} as anchor_fraction from pl join mass a on a.id = anchor_id join mass b on b.id = partner_id""")
def _(t):
    lab = _labeled_all(t)
    return mixup.plan_summary(lab, mixup.plan(lab, _RULE, B.SEED))


@query("mixup_beta_weights", "L23")
def _(t):
    return mixup.plan(_labeled_all(t), mixup.Mixing(0.4), B.SEED)


# -- design and lattice -----------------------------------------------------------

_WIDTH = 2 * B.TOKEN_WIDTH


def _design(t, damping=0.01):
    return design.build(t.role("labeled"), t.role("reference"), B.LABELS, _WIDTH, damping)


@query("design_information", "L25", f"""
    with tr as (select p.label, sum(p.p * (1 - p.p) * (list_inner_product([x::double for x in v.embedding], [x::double for x in v.embedding]) + 1)) + 0.01 * 65 as trace from pool_p p join vec v on p.id = v.id where p.role = 'labeled' group by p.label),
    gr as (select p.label, avg(p.p - y.y) as bias from pool_p p join pool_y y on p.id = y.id and p.label = y.label where p.role = 'reference' group by p.label),
    g1 as (select p.label, avg((p.p - y.y) * v.embedding[1]::double) as first from pool_p p join pool_y y on p.id = y.id and p.label = y.label join vec v on v.id = p.id where p.role = 'reference' group by p.label)
    select tr.label, {R('trace')} as trace, {R('bias')} as gradient_bias, {R('first')} as gradient_first from tr join gr on tr.label = gr.label join g1 on g1.label = tr.label""")
def _(t):
    return _design(t).blocks.select(
        "label", "trace", F.element_at("gradient", -1).alias("gradient_bias"), F.element_at("gradient", 1).alias("gradient_first")
    )


@query("design_upper_bound", "L26")
def _(t):
    return design.upper_bound(t.role("candidate"), _design(t))


@query("design_marginal_gain", "L27")
def _(t):
    return design.marginal_gain(t.role("candidate"), _design(t))


@query("design_deflated_gain", "L28")
def _(t):
    d = _design(t)
    pool = t.role("candidate")
    gains = design.marginal_gain(pool, d)
    best = take_top(gains, "gain", "id", 1).join(pool, "id").select("features", "p").first()
    state = design.Deflation.start(d)
    state.add(best["features"], best["p"])
    covered = design.coverage(pool.select("id", "features", "p"), ["id"], d)
    return design.gains(covered, ["id"], state.direction, state.steps)


# With one feature and the bias a label's block is 2 x 2, and its inverse can be written down.
def _narrow_steps(picks: int) -> str:
    """Inverse, direction and gains of step 0, and of each step after the best item so far is folded in."""
    out = [f"""
    nx as (select id, role, embedding[1]::double as x from vec),
    na as (select p.label, 0.01::double + sum(p.p * (1 - p.p) * x * x) as a, sum(p.p * (1 - p.p) * x) as b, 0.01::double + sum(p.p * (1 - p.p)) as c from pool_p p join nx on nx.id = p.id where p.role = 'labeled' group by p.label),
    ng as (select p.label, avg((p.p - y.y) * x) as g1, avg(p.p - y.y) as g0 from pool_p p join pool_y y on p.id = y.id and p.label = y.label join nx on nx.id = p.id where p.role = 'reference' group by p.label),
    n0 as (select na.label, a + c as trace, c / (a * c - b * b) as i11, -b / (a * c - b * b) as i12, a / (a * c - b * b) as i22, g1, g0 from na join ng on na.label = ng.label),
    nc as (select nx.id, p.label, x, p.p, greatest(p.p * (1 - p.p), 1e-8::double) as v from nx join pool_p p on p.id = nx.id where nx.role = 'candidate')"""]
    for k in range(picks + 1):
        done = "where false" if k == 0 else " union all ".join(f"select id from nb{j}" for j in range(k))
        done = "select 0 as id where false" if k == 0 else done
        out.append(f"""d{k} as (select *, i11 * g1 + i12 * g0 as d1, i12 * g1 + i22 * g0 as d0 from n{k}),
    gain{k} as (select nc.id, sum((x * d1 + d0) * (x * d1 + d0) / (1 / v + (x * x * i11 + 2 * x * i12 + i22))) as gain from nc join d{k} d on d.label = nc.label group by nc.id),
    nb{k} as (select id, gain from gain{k} where id not in ({done}) order by gain desc, id limit 1),
    u{k} as (select d.label, i11 * x + i12 as u1, i12 * x + i22 as u0, x, p * (1 - p) as w from nb{k} b join nc on nc.id = b.id join d{k} d on d.label = nc.label),
    n{k + 1} as (select d.label, trace, i11 - f * u1 * u1 as i11, i12 - f * u1 * u0 as i12, i22 - f * u0 * u0 as i22, g1, g0
            from (select *, w / (1 + w * (u1 * x + u0)) as f from u{k}) u join d{k} d on d.label = u.label)""")
    return ",\n    ".join(out)


def _narrow(t, role):
    return t.role(role).withColumn("features", F.slice("features", 1, 1))


def _narrow_design(t):
    return design.build(_narrow(t, "labeled"), _narrow(t, "reference"), B.LABELS, 1, 0.01)


@query("design_upper_bound_narrow", "L26", f"""
    with {_narrow_steps(0)} select nc.id, {R('sum((x * d1 + d0) * (x * d1 + d0) / (1 / v + (x * x + 1) / trace))')} as bound from nc join d0 d on d.label = nc.label group by nc.id""")
def _(t):
    return design.upper_bound(_narrow(t, "candidate"), _narrow_design(t))


@query("design_marginal_gain_narrow", "L27", f"with {_narrow_steps(0)} select id, {R('gain')} as gain from gain0")
def _(t):
    return design.marginal_gain(_narrow(t, "candidate"), _narrow_design(t))


@query("design_deflated_gain_narrow", "L28", f"with {_narrow_steps(1)} select id, {R('gain')} as gain from gain1")
def _(t):
    d, pool = _narrow_design(t), _narrow(t, "candidate")
    best = take_top(design.marginal_gain(pool, d), "gain", "id", 1).join(pool, "id").select("features", "p").first()
    state = design.Deflation.start(d)
    state.add(best["features"], best["p"])
    covered = design.coverage(pool.select("id", "features", "p"), ["id"], d)
    return design.gains(covered, ["id"], state.direction, state.steps)


@query("design_greedy_narrow", "F5 L28", f"""
    with {_narrow_steps(3)} select 1::bigint as rank, id, {R('gain')} as score from nb0 union all select 2, id, {R('gain')} from nb1 union all select 3, id, {R('gain')} from nb2 union all select 4, id, {R('gain')} from nb3""")
def _(t):
    return greedy.by_gain(_narrow(t, "candidate"), _narrow_design(t), 4, 2).selection


_BRANCH = f"""
    b as (select a.id, e.entropy, 1.0::double - list_cosine_similarity(a.t, c.t) as proxy from pool_tok a join pool_tok c on a.id = c.id and c.modality = 1
          join (select id, avg(-(p * ln(p) + (1 - p) * ln(1 - p))) as entropy from cand_p group by id) e on e.id = a.id where a.modality = 0),
    x as (select id, row_number() over (order by entropy desc, id) <= {WORK} as d, row_number() over (order by proxy desc, id) <= 60 as s from b)"""


def _union(t):
    pool = design.pairwise_similarity(dg.prediction_entropy(t.role("candidate")), 2)
    return design.rank_union(pool.withColumn("proxy", F.lit(1.0) - F.col("similarity")), "entropy", "proxy", WORK, 60)


@query("screening_union", "F3", f"with {_BRANCH} select id, d as design_branch, s as synergy_branch from x where d or s")
def _(t):
    return _union(t)


@query("screening_certificate", "F3", f"""
    with {_BRANCH} select count(*) filter (d) as design_branch, count(*) filter (s) as synergy_branch, count(*) filter (d and s) as intersection, count(*) filter (d or s) as "union" from x""")
def _(t):
    return design.union_certificate(_union(t))


_CF = f"""
    px as (select id, row_number() over (order by id) as pos, count(*) over () as n from vec where role = 'candidate'),
    ck as (select t.id, c::int as coalition, k::int as partner_no, t.modality, t.t as own, least(floor({U(17, 'partner', 't.id', 'c', 'k', 't.modality')} * (select max(n) from px)), (select max(n) from px) - 1) + 1 as pos
           from pool_tok t cross join (select unnest(range(0, 4)) as c) cc cross join (select unnest(range(0, 3)) as k) kk where t.role = 'reference'),
    cf as (select ck.id, coalition, partner_no, ck.modality, case when (coalition >> ck.modality) & 1 = 1 then own else o.t end as t from ck join px on px.pos = ck.pos join pool_tok o on o.id = px.id and o.modality = ck.modality),
    cp as (select id, coalition, partner_no, label, 1.0::double / (1.0::double + exp(-8.0::double * t[label + 1])) as p from cf cross join (select cast(unnest(range(0, 10)) as int) as label) g where modality = 0),
    cg as (select id, coalition, partner_no, sum(list_inner_product(t, t) * (modality + 1)) as gain from cf group by 1, 2, 3)"""


def _cf(t):
    return design.counterfactual_tokens(t.role("reference"), t.role("candidate"), 2, 3, B.SEED)


@query("counterfactual_tokens", "L29", f"with {_CF} select id, coalition, partner_no, modality, {R('t[1]')} as first, {R('t[32]')} as last from cf")
def _(t):
    out = _cf(t).select("id", "coalition", "partner_no", F.posexplode("tokens").alias("modality", "v"))
    return out.select("id", "coalition", "partner_no", "modality", F.element_at("v", 1).alias("first"), F.element_at("v", -1).alias("last"))


@query("counterfactual_features", "L41", f"with {_CF} select id, coalition, partner_no, label, {R('p')} as p from cp")
def _(t):
    out = selection.with_fused(_cf(t), FUSER)
    return out.select("id", "coalition", "partner_no", F.posexplode("p").alias("label", "p"))


def _gains(t):
    sq = lambda i: C.dot(F.element_at("tokens", i), F.element_at("tokens", i))
    return _cf(t).select("id", "coalition", "partner_no", (sq(1) + 2 * sq(2)).alias("gain"))


_LV = "lv as (select id, avg(avg(gain) filter (coalition = 0)) over () as v0, avg(gain) filter (coalition = 1) as v1, avg(gain) filter (coalition = 2) as v2, avg(gain) filter (coalition = 3) as v3 from cg group by id)"


@query("lattice_values", "L30", f"with {_CF}, {_LV} select id, {R('v0')} as v0, {R('v1')} as v1, {R('v2')} as v2, {R('v3')} as v3 from lv")
def _(t):
    return design.lattice_values(_gains(t), 2)


@query("lattice_scores", "L31", f"""
    with {_CF}, {_LV} select id, {R('v1 - v0 + v2 - v0')} as additive, {R('v3 - v1 - v2 + v0')} as synergy, {R('greatest(v3 - v1 - v2 + v0, 0) + 0.25 * (v1 - v0 + v2 - v0)')} as score from lv""")
def _(t):
    return design.lattice_scores(design.lattice_values(_gains(t), 2), 2, 0.25).select("id", "additive", "synergy", "score")


@query("closure_samples", "L32")
def _(t):
    out = design.closure_samples(t.role("labeled"), 2, 40, B.SEED, FUSER)
    return out.select(F.col("id").alias("sample"), F.posexplode("p").alias("label", "p"))


@query("design_synergy_selection", "L33 F5")
def _(t):
    c = methods.Context(
        t.role("candidate"), t.role("labeled"), 12, seed=B.SEED, reference=t.role("reference"), fuser=FUSER, labels=B.LABELS, modalities=2,
        feature_width=_WIDTH, options={"partners": 2, "closure": 20},
    )
    return methods.acquire("design_synergy", c)


# -- rounds -----------------------------------------------------------------------


def _run(t, rounds=3):
    state = loop.RunState(t.spark, scratch_path(t.spark, "rounds"))
    train = t.pool.filter("role <> 'reference'")
    plan = loop.label_targets(train.count(), rounds, 0.1, 0.05)
    s = loop.RunSettings("run", "random", B.SEED, tuple(plan))

    def pick(cand, labeled, budget, number):
        return selection.random_selection(cand, budget, B.SEED, number)

    def score(labeled, number):
        return labeled.agg(F.count("*").cast("double").alias("value")).select(F.lit("labeled").alias("metric"), "value")

    loop.run_rounds(state, s, train, pick, score)
    return state, s, train


_ROUNDS = f"""
    tr as (select id from vec where role <> 'reference'), n as (select count(*) as n from tr),
    r0 as (select id from tr order by {U(17, 'initial', 'id')}, id limit (select floor(n * 0.1::double + 0.5)::bigint from n)),
    r1 as (select id from tr where id not in (select id from r0) order by {U(18, 'random', 'id')}, id limit (select floor(n * (0.1::double + 0.05::double) + 0.5)::bigint - floor(n * 0.1::double + 0.5)::bigint from n)),
    r2 as (select id from tr where id not in (select id from r0) and id not in (select id from r1) order by {U(19, 'random', 'id')}, id limit (select floor(n * (0.1::double + 0.05::double * 2) + 0.5)::bigint - floor(n * (0.1::double + 0.05::double) + 0.5)::bigint from n)),
    lg as (select id, 0 as round, 'initial' as source from r0 union all select id, 1, 'query' from r1 union all select id, 2, 'query' from r2)"""


@query("labeled_log", "N2 N4", f"with {_ROUNDS} select id, round, source from lg")
def _(t):
    state, s, _train = _run(t)
    return state.labeled("run").select("id", F.col("round").cast("int").alias("round"), "source")


@query("resumed_labeled_log", "N3", f"with {_ROUNDS} select id, round from lg")
def _(t):
    state, s, train = _run(t)
    cut = loop.RunState(t.spark, scratch_path(t.spark, "rounds"))
    empty = t.spark.createDataFrame([("labeled", 0.0)], "metric string, value double")
    for number in range(2):
        ids = state.labeled("run").filter(F.col("round") == number).select("id")
        cut.write_round(s, number, ids, "initial" if number == 0 else "query", empty)
    loop.run_rounds(cut, s, train, lambda c, lab, b, n: selection.random_selection(c, b, B.SEED, n), lambda lab, n: empty)
    return cut.labeled("run").select("id", F.col("round").cast("int").alias("round"))


@query("data_usage", "N6", f"""
    with {_ROUNDS} select (select n from n) as pool, count(*) filter (source = 'initial') as initial, count(*) filter (source = 'query') as queried, count(*) as final, {R('count(*) / (select n from n)::double')} as final_fraction from lg""")
def _(t):
    state, _s, train = _run(t)
    return loop.data_usage(train, state.labeled("run"))


@query("group_usage", "N5", f"""
    with g as (select group_id, row_number() over (order by {U(17, 'initial', 'group_id')}, group_id) as r from (select distinct group_id from vec) x)
    select 0 as round, count(distinct v.group_id) as groups, count(*) as items from vec v join g on v.group_id = g.group_id where r <= 30""")
def _(t):
    first = selection.initial_selection(t.pool.select("group_id").distinct(), 30, B.SEED, key="group_id")
    log = first.select(F.col("group_id").alias("id"), F.lit(0).alias("round"))
    return loop.group_usage(t.pool, log)


@query("pool_roles", "N12", "select id, role from vec")
def _(t):
    train = t.pool.filter("role <> 'reference'")
    return loop.pool_roles(train, t.role("reference"), t.role("labeled"))


@query("initial_prevalence", "N12", f"with {_ROUNDS} select label, {R('avg(y)')} as prevalence from pool_y where id in (select id from r0) group by label")
def _(t):
    state, _s, _train = _run(t, rounds=1)
    return loop.initial_prevalence(t.pool, state.labeled("run"))


@query("final_outputs", "N11 A12", "select o_orderpriority as arm, cast(year(o_orderdate) as int) as round, o_orderkey as id from orders where (o_orderpriority, year(o_orderdate)) in (select o_orderpriority, max(year(o_orderdate)) from orders group by 1)")
def _(t):
    preds = t.raw("orders").select(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("round"), F.col("o_orderkey").alias("id"))
    return loop.final_outputs(preds)
