"""Queries on curve fits.

The checks of the group fits solve the same bounded problems another way: a
pattern search over b, c and d in recursive SQL, with the best level a in closed
form at every trial.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from catalog.base import (
    BACKWARD_FIRST,
    CURVE,
    ECM,
    FIT_ROWS,
    FORWARD_FIRST,
    INPUTS,
    MEDIAN,
    NAMES,
    RAW,
    RUN,
    SCALES,
    TO_FILL_1_399,
    check,
    inputs_of,
    query,
    rounded,
    tables,
)
from lactoscope.functions.expressions import PARAMETERS, group_name, level_too_low, no_convergence
from lactoscope.operators import fit, history
from lactoscope.operators.profile import summary
from lactoscope.operators.proof import proven_minimum
from lactoscope.operators.score import predict_each, select_fits, with_residual
from lactoscope.operators.search import Grid, constrained_minimum
from lactoscope.operators.search import global_search as search_globally
from lactoscope.operators.search import grid_search as search_grid
from lactoscope.plans import group_model as group_plan
from lactoscope.plans import lactation_model, median_model, sql_model
from lactoscope.settings import EARLY_MEDIAN_FIT, GROUP_FIT, LACTATION_FIT, SINGLE_ANIMAL_FIT, UNBOUNDED_FIT, FitSettings
from lactoscope.sources.sample_mapping import mapped_test_days
from lactoscope.sources.tables import cut_lineage, rename_test_days

LEVELS = """levels as (
  select LAGR, DIM, SIGMA, ECM from fit_rows union all select cast(0 as int), DIM, SIGMA, ECM from fit_rows)"""


def pattern_search(points: str, settings: FitSettings, steps: int = 260, starts: tuple[str, str, str] | None = None) -> str:
    """Recursive SQL for a bounded fit; ``points`` has columns g, t, w, y.

    ``starts`` may give b, c and d as expressions of g.
    """
    (b, c, d), (la, lb, lc, ld), (ha, hb, hc, hd) = starts or settings.start[1:], settings.lower, settings.upper
    return f"""points as materialized ({points}),
way as (select i.i as i, j.i as j, k.i as k from (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(i),
  (values (-1), (0), (1)) k(i)),
search as (
  select distinct g, 0 as turn, ({b})::double as b, ({c})::double as c, ({d})::double as d, 1e0 as h,
    1e308::double as loss, 0e0 as a from points
  union all
  select g, turn + 1, best.b, best.c, best.d,
    case when best.i = 0 and best.j = 0 and best.k = 0 then h / 2 else least(h * 1.5, 4) end, best.loss, best.a
  from (
    select g, any_value(turn) as turn, any_value(h) as h,
      arg_min(struct_pack(b := b, c := c, d := d, a := a, i := i, j := j, k := k, loss := loss),
              struct_pack(loss := loss, far := abs(i) + abs(j) + abs(k), i := i, j := j, k := k)) as best
    from (
      select g, i, j, k, turn, h, b, c, d, least(greatest(coalesce(yf / nullif(ff, 0), 0), {la}), {ha}) as a,
        yy - 2 * least(greatest(coalesce(yf / nullif(ff, 0), 0), {la}), {ha}) * yf
           + least(greatest(coalesce(yf / nullif(ff, 0), 0), {la}), {ha}) ^ 2 * ff as loss
      from (
        select g, i, j, k, any_value(turn) as turn, any_value(h) as h, any_value(b) as b, any_value(c) as c,
          any_value(d) as d, sum(w * y * f) as yf, sum(w * f * f) as ff, sum(w * y * y) as yy
        from (
          select v.*, w, y, (1 - exp((c - t) / b) / 2) * exp(-d * t) as f
          from (
            select s.g, turn, h, i, j, k, least(greatest(b + i * h, {lb}), {hb}) as b,
              least(greatest(c + j * h, {lc}), {hc}) as c, least(greatest(d + k * h * 1e-5, {ld}), {hd}) as d
            from search s, way where turn < {steps}) v
          join points p on p.g = v.g)
        group by g, i, j, k))
    group by g)),
fitted as (select * from search where turn = {steps})"""


def fitted(check_parts, points: str, settings: FitSettings, select: str, steps: int = 260, starts=None) -> str:
    return "with recursive " + ",\n".join([*check_parts, pattern_search(points, settings, steps, starts)]) + "\n" + select


def projected_search(points: str, settings: FitSettings, grid: tuple[int, int] = (72, 121), rounds: int = 36, limit: float | None = None) -> str:
    """Recursive SQL for the least loss inside bounds over all b and d; ``points`` has columns g, t, w, y.

    For fixed b and d the curve is linear in a and a * k, and the best two inside the bounds
    of a and c have a closed form. The loss left over is laid out on a fine grid of log b
    and d. From the floors along b, Newton's steps on a stencil of nine places follow, or
    the best of the nine where the ground is not bent upwards. With a limit on b * d, groups
    whose least loss breaks it have the least of many places on b * d = limit, where it lies.
    """
    low, high = settings.lower, settings.upper
    floor = max(low[1], 0.05)
    nb, nd = grid

    def best_pair(source: str, keep: str) -> str:
        edge = "greatest(least(coalesce((r1 - {k} * r2) / nullif(s11 - 2 * {k} * s12 + {k} * {k} * s22, 0), 0), {hi}), {lo})"
        sides = [edge.format(k=k, lo=repr(low[0]), hi=repr(high[0])) for k in ("k0", "k1")]
        level = "greatest(least(coalesce(({a} * s12 - r2) / nullif(s22, 0), 0), k1 * {a}), k0 * {a})"
        pairs = [
            ("if(inside, fa, 0)", "if(inside, fb, 0)", "if(inside, 0, 1e300)"),
            (sides[0], f"k0 * {sides[0]}", "0"),
            (sides[1], f"k1 * {sides[1]}", "0"),
            *[(repr(a), level.format(a=repr(a)), "0") for a in (low[0], high[0])],
        ]
        tried = ", ".join(f"{{'x': {x}, 'y': {y}, 'more': {more}}}" for x, y, more in pairs)
        return f"""select {keep}, list_min(list_transform([{tried}],
      lambda p: p.more + yy + p.x * (p.x * s11 - 2 * p.y * s12 - 2 * r1) + p.y * (p.y * s22 + 2 * r2))) as loss
    from (select *, det > 1e-11 * s11 * s22 and fa between {low[0]!r} and {high[0]!r} and fb >= k0 * fa and fb <= k1 * fa as inside
      from (select *, (r1 * s22 - r2 * s12) / nullif(det, 0) as fa, (r1 * s12 - r2 * s11) / nullif(det, 0) as fb
        from (select *, s11 * s22 - s12 * s12 as det, exp(least(greatest(({low[2]!r} - t0) / exp(u), -300), 300)) / 2 as k0,
          exp(least(greatest(({high[2]!r} - t0) / exp(u), -300), 300)) / 2 as k1 from ({source}))))"""

    sums = """sum(w * f * f) as s11, sum(w * f * f * h) as s12, sum(w * f * f * h * h) as s22, sum(w * y * f) as r1, sum(w * y * f * h) as r2"""
    on_grid = f"""select g, u, d, any_value(t0) as t0, any_value(yy) as yy, {sums}
      from (select p.*, u, d, exp(-d * t) as f, exp(-(t - t0) / exp(u)) as h from points p, us, ds) group by g, u, d"""
    around = f"""select g, v, i, j, any_value(t0) as t0, any_value(yy) as yy, any_value(turn) as turn, any_value(hu) as hu, any_value(hd) as hd,
        any_value(bu) as bu, any_value(bd) as bd, any_value(bl) as bl, any_value(cu) as cu, any_value(cd) as cd, any_value(u) as u, any_value(d) as d, {sums}
      from (select *, exp(-d * t) as f, exp(-(t - t0) / exp(u)) as h from (
        select p.*, s.v, s.turn, s.hu, s.hd, s.bu, s.bd, s.bl, s.cu, s.cd, i, j,
          least(greatest(s.cu + i * s.hu, ln({floor})), ln({high[1]!r}::double)) as u, least(greatest(s.cd + j * s.hd, {low[3]!r}), {high[3]!r}) as d
        from way, search s join points p on p.g = s.g where s.turn < {rounds})) group by g, v, i, j"""
    edge = f"""select g, u, d, any_value(t0) as t0, any_value(yy) as yy, {sums}
      from (select p.*, u, d, exp(-d * t) as f, exp(-(t - t0) / exp(u)) as h from points p, (
        select u, least({limit} / exp(u), {high[3]!r}) as d from (select ln({floor}) + (ln({high[1]!r}::double) - ln({floor})) * i / 4000 as u from range(4001) x(i)))) group by g, u, d"""
    along = "" if limit is None else f""",
limited as (
  select l.g, l.b * l.d > {limit} as binds, if(l.b * l.d > {limit}, e.loss, l.loss) as loss
  from least_loss l join (select g, min(loss) as loss from ({best_pair(edge, 'g, u, d')}) group by g) e on l.g = e.g)"""
    nine = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    names = {(i, j): f"f{'mop'[i + 1]}{'mop'[j + 1]}" for i, j in nine}
    pivots = ", ".join(f"max(loss) filter (i = {i} and j = {j}) as {names[i, j]}" for i, j in nine)
    return f"""raw_points as ({points}),
points as materialized (select *, min(t) over (partition by g) as t0, sum(w * y * y) over (partition by g) as yy from raw_points),
us as (select ln({floor}) + (ln({high[1]!r}::double) - ln({floor})) * i / {nb - 1} as u from range({nb}) x(i)),
ds as (select {low[3]!r} + ({high[3]!r} - {low[3]!r}) * i / {nd - 1} as d from range({nd}) x(i)),
floors as (select g, u, min_by(d, loss) as d, min(loss) as loss from ({best_pair(on_grid, 'g, u, d')}) group by g, u),
valleys as (
  select *, row_number() over (partition by g order by loss) as v from (
    select *, lag(loss) over w as before, lead(loss) over w as after from floors window w as (partition by g order by u))
  where (before is null or loss < before) and (after is null or loss <= after)),
way as (select i.i as i, j.i as j from (values (-1), (0), (1)) i(i), (values (-1), (0), (1)) j(i)),
search as (
  select g, v, 0 as turn, (ln({high[1]!r}::double) - ln({floor})) / {nb - 1} as hu, ({high[3]!r} - {low[3]!r}) / {nd - 1} as hd,
    u as bu, d as bd, 1e300::double as bl, u as cu, d as cd from valleys where v <= 4
  union all
  select g, v, turn + 1, hu * case when worse then 0.25 when newton then 0.5 when stays then 0.4 else 1 end,
    hd * case when worse then 0.25 when newton then 0.5 when stays then 0.4 else 1 end, nu, nd, least(bl, lowest),
    case when worse then nu when newton then least(greatest(cu + su * hu, ln({floor})), ln({high[1]!r}::double)) else nu end,
    case when worse then nd when newton then least(greatest(cd + sd * hd, {low[3]!r}), {high[3]!r}) else nd end
  from (
    select *, not worse and (bent and abs(su) <= 3 and abs(sd) <= 3) as newton, lowest >= foo as stays from (
      select *, lowest >= bl and turn > 0 and not (foo <= lowest and foo <= bl + 1e-13 * abs(bl)) as worse,
        if(lowest < bl, lu, bu) as nu, if(lowest < bl, ld, bd) as nd,
        if(flat_u, false, true) and if(flat_d, false, true) and huu > 0 and det > 1e-9 * huu * hdd
          or flat_u and not flat_d and hdd > 0 and fm >= foo or flat_d and not flat_u and huu > 0 and fn >= foo as bent,
        case when flat_u then 0 when flat_d then -gu / nullif(huu, 0) else -(hdd * gu - hud * gd) / nullif(det, 0) end as su,
        case when flat_d then 0 when flat_u then -gd / nullif(hdd, 0) else -(huu * gd - hud * gu) / nullif(det, 0) end as sd
      from (
        select *, huu * hdd - hud * hud as det, least(fpo, fmo) as fm, least(fop, fom) as fn from (
          select *, (fpo - fmo) / 2 as gu, (fop - fom) / 2 as gd, fpo + fmo - 2 * foo as huu, fop + fom - 2 * foo as hdd, (fpp - fpm - fmp + fmm) / 4 as hud,
            cu - hu < ln({floor}) or cu + hu > ln({high[1]!r}::double) as flat_u, cd - hd < {low[3]!r} or cd + hd > {high[3]!r} as flat_d
          from (
            select g, v, any_value(turn) as turn, any_value(hu) as hu, any_value(hd) as hd, any_value(bu) as bu, any_value(bd) as bd, any_value(bl) as bl,
              any_value(cu) as cu, any_value(cd) as cd, min(loss) as lowest, min_by(u, loss) as lu, min_by(d, loss) as ld, {pivots}
            from ({best_pair(around, 'g, v, i, j, turn, hu, hd, bu, bd, bl, cu, cd, u, d')}) group by g, v)))))),
least_loss as (select g, greatest(min(bl), 0) as loss, exp(min_by(bu, bl)) as b, min_by(bd, bl) as d from search where turn = {rounds} group by g){along}"""


_SHOWN = "round(a, 3) as a, round(b, 2) as b, round(c, 2) as c, round(d, 6) as d, round(loss, 1) as between_days"
_SHOWN_WIDE = _SHOWN.replace("round(b, 2)", "round(b, 1)").replace("round(c, 2)", "round(c, 1)")


def _shown(fits, digits=2):
    """Fits with the part of the loss that a curve can change."""
    between = F.col("weighted_sse") - F.col("within_days")
    return rounded(
        fits.select("LAGR", *PARAMETERS, between.alias("between_days")),
        3,
        b=digits,
        c=digits,
        d=6,
        between_days=1,
    )


@query(
    check(
        *INPUTS,
        FIT_ROWS,
        LEVELS,
        select="""select LAGR, DIM as t, SIGMA as sigma, count(*) as records, count(ECM) as n, round(avg(ECM) + 1e-8, 6) as mean,
  round(var_pop(ECM) * count(ECM) + 1e-6, 4) as spread, max(ECM) as peak from levels group by LAGR, DIM, SIGMA""",
    )
)
def day_points(spark, sf_dir):
    """Herd and group records reduced to one row per day."""
    points = group_plan.group_points(inputs_of(spark, sf_dir))
    # Yields have one decimal, so that means of 32 lie half-way between roundings.
    return rounded(points.withColumns({"mean": F.col("mean") + 1e-8, "spread": F.col("spread") + 1e-6}), spread=4)


@query(check(*INPUTS, FIT_ROWS, select="select LAGR, max(ECM) as peak from fit_rows group by LAGR"))
def peak_starts(spark, sf_dir):
    return fit.peak_starts(history.fit_records(inputs_of(spark, sf_dir)), ["LAGR"])


@query(
    fitted(
        [*INPUTS, FIT_ROWS, LEVELS],
        "select LAGR as g, DIM as t, count(*) / (SIGMA * SIGMA) as w, avg(ECM) as y from levels group by LAGR, DIM, SIGMA",
        GROUP_FIT,
        f"select {NAMES.replace('LAGR when', 'g when')} as grp, g as LAGR, {_SHOWN} from fitted",
    )
)
def fit_herd_and_groups(spark, sf_dir):
    """Curve of each lactation group and of all records together."""
    points = group_plan.group_points(inputs_of(spark, sf_dir))
    shown = _shown(fit.fit_points(points, ["LAGR"], GROUP_FIT))
    return shown.select(group_name().alias("grp"), "*")


_MEDIANS = "medians as (select LAGR, DIM, quantile_disc(ECM, 0.5) as y from with_history group by LAGR, DIM)"


@query(
    fitted(
        [*MEDIAN, _MEDIANS],
        "select LAGR as g, DIM as t, case when DIM < 15 then 1 / 2.25e0 else 1e0 end as w, y from medians",
        GROUP_FIT,
        f"select g as LAGR, {_SHOWN} from fitted",
    )
)
def fit_median_curve(spark, sf_dir):
    records = median_model.records_of(mapped_test_days(spark, sf_dir))
    points = fit.day_points(median_model.median_curve(records), ["LAGR"], "ECM_MEDIAN")
    return _shown(fit.fit_points(points, ["LAGR"], GROUP_FIT))


@query(
    fitted(
        [*MEDIAN, _MEDIANS],
        "select LAGR as g, DIM as t, 1e0 as w, y from medians",
        EARLY_MEDIAN_FIT,
        f"select g as LAGR, {_SHOWN_WIDE} from fitted",
    )
)
def fit_median_curve_wide(spark, sf_dir):
    """Unweighted median curve on wide bounds."""
    records = median_model.records_of(mapped_test_days(spark, sf_dir))
    medians = median_model.median_curve(records).withColumn("SIGMA", F.lit(1.0))
    points = fit.day_points(medians, ["LAGR"], "ECM_MEDIAN")
    return _shown(fit.fit_points(points, ["LAGR"], EARLY_MEDIAN_FIT), 1)


@query(
    fitted(
        MEDIAN,
        """select LAGR as g, DIM as t, count(*) / any_value(SIGMA * SIGMA) as w, avg(ECM) as y
           from with_history group by LAGR, DIM""",
        GROUP_FIT,
        f"select g as LAGR, {_SHOWN} from fitted",
    )
)
def fit_all_records(spark, sf_dir):
    """Group fits on all records of animals with long histories."""
    records = median_model.records_of(mapped_test_days(spark, sf_dir))
    points = fit.day_points(records, ["LAGR"])
    return _shown(fit.fit_points(points, ["LAGR"], GROUP_FIT))


_FREE = FitSettings(
    start=UNBOUNDED_FIT.start, lower=(-1e9, -1e9, -1e9, -1e9), upper=(1e9, 1e9, 1e9, 1e9)
)


@query(
    fitted(
        [*INPUTS, FIT_ROWS, LEVELS],
        "select LAGR as g, DIM as t, count(*) / (SIGMA * SIGMA) as w, avg(ECM) as y from levels group by LAGR, DIM, SIGMA",
        _FREE,
        f"select g as LAGR, {_SHOWN_WIDE} from fitted",
        steps=2000,
    )
)
def fit_unbounded(spark, sf_dir):
    points = group_plan.group_points(inputs_of(spark, sf_dir))
    return _shown(fit.fit_points(points, ["LAGR"], UNBOUNDED_FIT), 1)


def _minor(i: int, j: int) -> str:
    """Signed cofactor (i, j) of the symmetric 4 x 4 matrix with entries h00 to h33."""
    rows = [r for r in range(4) if r != i]
    cols = [c for c in range(4) if c != j]

    def h(r, c):
        return f"h{min(rows[r], cols[c])}{max(rows[r], cols[c])}"

    terms = [
        f"{h(0, x)} * ({h(1, y)} * {h(2, z)} - {h(1, z)} * {h(2, y)})" for x, y, z in ((0, 1, 2), (1, 0, 2), (2, 0, 1))
    ]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}({terms[0]} - {terms[1]} + {terms[2]})"


_GROUP_POINTS = (
    "select LAGR as g, DIM as t, count(*) / (SIGMA * SIGMA) as w, avg(ECM) as y from levels group by LAGR, DIM, SIGMA"
)
_SLOPES = """slopes as (select g, w, f as j0, a * (t - c) / (b * b) * -half * decay as j1, -a * half * decay / b as j2,
    -t * a * f as j3
  from (select *, (1 - half) * decay as f from (
    select p.g, t, w, a, b, c, exp((c - t) / b) / 2 as half, exp(-d * t) as decay from points p join fitted q on p.g = q.g)))"""
_NORMAL = "normal as (select g, {} from slopes group by g)".format(
    # Columns are scaled to like size before sums are multiplied.
    ", ".join(f"sum(w * j{i} * j{j}) * {(1, 1e1, 1e1, 1e-4)[i] * (1, 1e1, 1e1, 1e-4)[j]!r} as h{i}{j}" for i in range(4) for j in range(i, 4))
)
_CORRELATIONS = " union all ".join(
    f"select g as LAGR, {i} as i, {j} as j, round(({_minor(i, j)}) / sqrt(({_minor(i, i)}) * ({_minor(j, j)})), 3) as correlation from normal"
    for i in range(4)
    for j in range(4)
)


@query(
    "with recursive "
    + ",\n".join(
        [*INPUTS, FIT_ROWS, LEVELS, pattern_search(_GROUP_POINTS, GROUP_FIT, 1500), _SLOPES, _NORMAL]
    )
    + "\n"
    + _CORRELATIONS
)
def fit_correlations(spark, sf_dir):
    """Correlations of the parameters of each group fit."""
    return rounded(fit.correlations(group_plan.group_parameters(inputs_of(spark, sf_dir)), ["LAGR"]), 3)


_LACTATIONS = """select BDAT, ID as EarTag, LACT, count(*) as records,
  count(*) filter (PCTF is not null and PCTP is not null) as npoints,
  max(DIM) filter (PCTF is not null and PCTP is not null) as last_dim"""


@query(
    check(
        *RAW,
        TO_FILL_1_399,
        FORWARD_FIRST,
        select=f"""{_LACTATIONS} from filled group by BDAT, ID, LACT
having count(*) >= {LACTATION_FIT.min_points} and count(*) filter (PCTF is not null and PCTP is not null) > 0""",
    )
)
def fitted_lactations(spark, sf_dir):
    """Which lactations are fitted, on how many records and up to which day."""
    fits = lactation_model.fit_lactations(mapped_test_days(spark, sf_dir))
    return fits.select(*lactation_model.KEYS, "records", "npoints", "last_dim")


def _lactation_points(keys: str, sigma: str, rows: str, also: str = "") -> str:
    """Points per lactation for the search, named by a text of the keys."""
    return f"""select {keys} as g, DIM::double as t, count(*) / any_value({sigma} * {sigma}) as w, avg({ECM}) as y
  from {rows} where PCTF is not null and PCTP is not null {also} group by g, DIM"""


_KEY = "concat_ws('|', BDAT, ID, LACT)"
_SIGMA = "(case when DIM > 30 then 1e0 else 1.5e0 end)"


def _fit_losses(key: str, sigma: str) -> str:
    """Per lactation: counts, and the part of the loss that lies inside days."""
    return f"""days as (select {key} as g, DIM, count(*) as records, count(y) as n, var_pop(y) * count(y) / any_value({sigma} * {sigma}) as within
    from (select *, {ECM} as y from filled) group by g, DIM),
  counted as (select g, sum(records) as records, sum(n) as npoints, max(DIM) filter (n > 0) as last_dim, sum(within) as within from days group by g)"""


_NO_NULL_KEYS = "and BDAT is not null and ID is not null and LACT is not null"
_LACTATION_SEARCH = [
    *RAW,
    TO_FILL_1_399,
    FORWARD_FIRST,
    _fit_losses(_KEY, _SIGMA),
    projected_search(_lactation_points(_KEY, _SIGMA, "filled", _NO_NULL_KEYS), LACTATION_FIT, (24, 41)),
    f"fitted as (select c.*, sqrt((l.loss + c.within) / c.npoints) as error from counted c join least_loss l on c.g = l.g where records >= {LACTATION_FIT.min_points})",
]
_LACTATION_LOSSES = "with recursive " + ",\n".join(_LACTATION_SEARCH)


def _with_error(fits):
    """Fits with the weighted root mean square error of their curves."""
    return fits.withColumn("error", F.sqrt(F.col("weighted_sse") / F.col("npoints")))


@query(
    _LACTATION_LOSSES
    + """
select g, cast(records as bigint) as records, cast(npoints as bigint) as npoints, last_dim, round(error, 2) as error,
  cast(if(npoints <= 4, 2, 0) as int) as status, cast(0 as int) as no_convergence from fitted"""
)
def fit_lactations(spark, sf_dir):
    """Error and outcome of the best curve of every lactation."""
    fits = _with_error(lactation_model.fit_lactations(mapped_test_days(spark, sf_dir)))
    name = F.concat_ws("|", *lactation_model.KEYS).alias("g")
    return fits.select(name, "records", "npoints", "last_dim", F.round("error", 2).alias("error"), "status", no_convergence().alias("no_convergence"))


@query(
    _LACTATION_LOSSES
    + """, picked as (select unnest([('error > 15', error > 15), ('error < 5', error < 5), ('error > 20', error > 20), ('last_dim < 150', last_dim < 150),
  ('last_dim > 300', last_dim > 300), ('npoints < 6', npoints < 6), ('npoints > 10', npoints > 10)]) as p from fitted)
select p[1] as rule, count(*) filter (p[2]) as lactations from picked group by p[1]"""
)
def fit_error_selection(spark, sf_dir):
    """How many lactations each rule on the error or the coverage of their fits selects."""
    fits = _with_error(lactation_model.fit_lactations(mapped_test_days(spark, sf_dir)))
    rules = ("error > 15", "error < 5", "error > 20", "last_dim < 150", "last_dim > 300", "npoints < 6", "npoints > 10")
    counted = fits.agg(*[F.count_if(F.expr(rule)).alias(rule) for rule in rules])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("lactations")) for rule in rules])
    return counted.select(F.inline(pairs))


@query(
    _LACTATION_LOSSES
    + """
select cast(split_part(g, '|', 3) as int) as LACT, cast(sum(npoints) as bigint) as n, round(sqrt(sum(error * error * npoints) / sum(npoints)), 3) as error
from fitted where npoints > 0 group by 1"""
)
def fit_residuals_by_lactation(spark, sf_dir):
    """Weighted error per lactation number, from the residual of every record to its own fitted curve."""
    events = mapped_test_days(spark, sf_dir)
    rows = lactation_model.lactation_records(events, LACTATION_FIT.min_points).select(*lactation_model.KEYS, "DIM", "ECM", "SIGMA")
    residuals = with_residual(predict_each(rows, lactation_model.fit_lactations(events), lactation_model.KEYS))
    square = F.pow(F.col("error") / F.col("SIGMA"), 2)
    return residuals.groupBy("LACT").agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(square)), 3).alias("error"))


@query()
def fit_quality_selection(spark, sf_dir):
    """How many lactations each rule on fit quality or coverage selects."""
    fits = lactation_model.fit_lactations(mapped_test_days(spark, sf_dir))
    rules = ("rmse > 15", "rmse < 5", "rmse > 20", "a > 1", "b > 40", "last_dim < 150", "last_dim > 300", "npoints < 6", "npoints > 10")
    counted = fits.agg(*[F.count_if(F.expr(rule)).alias(rule) for rule in rules])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("lactations")) for rule in rules])
    return counted.select(F.inline(pairs))


@query()
def fit_residual_summary(spark, sf_dir):
    """Summary of the residuals of all converged lactation fits."""
    events = mapped_test_days(spark, sf_dir)
    fits = select_fits(lactation_model.fit_lactations(events), "a > 1")
    return rounded(summary(lactation_model.fit_residuals(events, fits), ["error"]))


def _file_records(spark, sf_dir):
    return rename_test_days(mapped_test_days(spark, sf_dir), "EarTag").where("MILK is not null")


@query(
    check(
        *RAW,
        "to_fill as (select * from named where MILK is not null)",
        BACKWARD_FIRST,
        select="""select count(*) as cases, count(*) filter (records < 4 or usable = 0) as too_few_points,
  count(*) filter (records >= 4 and usable between 1 and 4) as no_freedom from (
  select BDAT, ID, LACT, count(*) as records, count(*) filter (PCTF is not null and PCTP is not null) as usable
  from filled group by BDAT, ID, LACT)""",
    )
)
def fit_case_counts(spark, sf_dir):
    """Lactations of the herd file, those too short to fit and those fitted without freedom."""
    fits = lactation_model.herd_file_fits(_file_records(spark, sf_dir))
    return fits.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("status") == 3).alias("too_few_points"),
        F.count_if((F.col("status") != 3) & (F.col("npoints") <= 4)).alias("no_freedom"),
    )


_HERD_FILE_COUNTS = """(select BDAT, ID, LACT, count(*) as records, count({ECM}) as usable, bool_or(isinf({ECM})) as endless
  from filled where BDAT is not null and ID is not null and LACT is not null group by BDAT, ID, LACT)""".replace("{ECM}", ECM)


@query(
    check(
        *RAW,
        "to_fill as (select * from named where MILK is not null)",
        BACKWARD_FIRST,
        select=f"""select count(*) as cases, count(*) filter (records < 4 or usable = 0) as too_few_points, cast(0 as bigint) as failed,
  count(*) filter (records >= 4 and usable between 1 and 4) as no_covariance from {_HERD_FILE_COUNTS}""",
    )
)
def fit_outcomes(spark, sf_dir):
    """Outcome counts of the herd file fits: failed and without covariance, too."""
    return fit.fit_outcomes(lactation_model.herd_file_fits(_file_records(spark, sf_dir)))


_ENDLESS = "EarTag % 7 = 3 and DIM % 5 = 2"


@query(
    check(
        *RAW,
        f"to_fill as (select * replace (if({_ENDLESS.replace('EarTag', 'ID::int')}, 'inf'::double, MILK) as MILK) from named where MILK is not null)",
        BACKWARD_FIRST,
        select=f"""select cast(case when records < 4 or usable = 0 then 3 when endless then 1 when usable <= 4 then 2 else 0 end as int) as status,
  cast(case when records >= 4 and endless then 1 else 0 end as int) as no_convergence, count(*) as cases,
  cast(case when records < 4 or usable = 0 or not endless then null else 0 end as double) as a,
  cast(case when records < 4 or usable = 0 or not endless then null else 10 end as double) as b from {_HERD_FILE_COUNTS} group by all""",
    )
)
def failed_fits(spark, sf_dir):
    """Outcomes where some yields are endless: such fits fail, are flagged and get the fallback values."""
    rows = _file_records(spark, sf_dir)
    rows = rows.withColumn("MILK", F.when(F.expr(_ENDLESS), F.lit(float("inf"))).otherwise(F.col("MILK")))
    fits = lactation_model.herd_file_fits(rows)
    flag = F.when(F.col("status") == 1, 1).otherwise(0).alias("no_convergence")
    given = fit.with_fallback(fits)
    shown = [F.when(F.col("status") == 1, F.col(p)).alias(p) for p in ("a", "b")]
    return given.select("status", flag, *shown).groupBy("status", "no_convergence", "a", "b").agg(F.count(F.lit(1)).alias("cases"))


# Test days without noise: constant components, and the yield that puts ECM on a known curve.
_KNOWN_ECM = "(25 + 5 * (LactationNumber % 7)) * (1 - exp((LactationNumber % 4 - 2 - DIM) / (15 + 5 * (LactationNumber % 5))) / 2) * exp(-(0.0005 + 0.0003 * (LactationNumber % 4)) * DIM)"


def _known_test_days(spark, sf_dir):
    share = 3.1138 / (0.383 * 3.5 + 0.242 * 3.2 + 0.7832)
    return mapped_test_days(spark, sf_dir).withColumns(
        {
            "MilkWeight": F.when(F.col("MilkWeight").isNotNull(), F.expr(_KNOWN_ECM) * share),
            "PercentFat": F.when(F.col("PercentFat").isNotNull(), F.lit(3.5)),
            "PercentProtein": F.when(F.col("PercentProtein").isNotNull(), F.lit(3.2)),
        }
    )


def _with_worst_error(fits, errors, keys):
    """Outcome of each fit and its greatest distance from a record, to two decimals."""
    worst = errors.groupBy(*keys).agg(F.round(F.max(F.abs("error")), 2).alias("worst_error"))
    return fits.select(*keys, "records", "npoints", "status").join(worst, list(keys), "left")


_OUTCOME = """cast(case when records < {least} or npoints = 0 then 3 when npoints <= 4 then 2 else 0 end as int) as status,
  case when records >= {least} and npoints > 0 then 0e0 end as worst_error"""


@query(
    check(
        *RAW,
        TO_FILL_1_399,
        FORWARD_FIRST,
        f"lactations as ({_LACTATIONS} from filled where BDAT is not null and ID is not null and LACT is not null group by BDAT, ID, LACT)",
        select=f"""select BDAT, EarTag, LACT, records, npoints, {_OUTCOME.format(least=LACTATION_FIT.min_points)}
from lactations where records >= {LACTATION_FIT.min_points} and npoints > 0""",
    )
)
def known_lactation_curves(spark, sf_dir):
    """Lactation fits of every lactation's own days and gaps, with yields on a known curve."""
    events = _known_test_days(spark, sf_dir)
    # Read twice, for the outcomes and for the residuals.
    fits = cut_lineage(lactation_model.fit_lactations(events))
    return _with_worst_error(fits, lactation_model.fit_residuals(events, fits), lactation_model.KEYS)


_BIRTH_KEY, _LATE_SIGMA = "concat_ws('|', BDAT, LACT)", "(case when DIM > 60 then 1e0 else 1.5e0 end)"


@query(
    "with recursive "
    + ",\n".join(
        [
            *RAW,
            "filled as (select * from named where MILK is not null and BDAT is not null and LACT is not null and DIM is not null)",
            _fit_losses(_BIRTH_KEY, _LATE_SIGMA),
            projected_search(_lactation_points(_BIRTH_KEY, _LATE_SIGMA, "filled"), SINGLE_ANIMAL_FIT, (48, 81)),
        ]
    )
    + f"""
select c.g, cast(records as bigint) as records, cast(npoints as bigint) as npoints,
  cast(case when records < {SINGLE_ANIMAL_FIT.min_points} or npoints = 0 then 3 when npoints <= 4 then 2 else 0 end as int) as status,
  case when records >= {SINGLE_ANIMAL_FIT.min_points} and npoints > 0 then round(sqrt((loss + within) / npoints), 1) end as error
from counted c left join least_loss l on c.g = l.g"""
)
def fit_birth_dates(spark, sf_dir):
    """Error and outcome per birth date and lactation."""
    fits = _with_error(lactation_model.single_animal_fits(_file_records(spark, sf_dir)))
    return fits.select(F.concat_ws("|", "BDAT", "LACT").alias("g"), "records", "npoints", "status", F.round("error", 1).alias("error"))


SMALL_GRID = Grid(a=(50.0, 90.0, 5), b=(10.0, 30.0, 3), c=(-4.0, 0.0, 3), d=(0.0005, 0.0035, 4), product_limit=0.06)


def _axis_values(name: str) -> str:
    return ", ".join(f"({v!r}::double)" for v in SMALL_GRID.axis(name))


_CELLS = f"""cells as (select b, c, d from (values {_axis_values('b')}) b(b), (values {_axis_values('c')}) c(c),
  (values {_axis_values('d')}) d(d) where b * d <= {SMALL_GRID.product_limit}),
usable as (select LAGR, DIM, ECM as y from inputs where ECM is not null)"""


@query(
    check(
        *INPUTS,
        _CELLS,
        """sums as (select LAGR, b, c, d, count(*) as n, sum(y * f) as yf, sum(f * f) as ff, sum(y * y) as yy from (
  select LAGR, y, b, c, d, (1 - exp((c - DIM) / b) / 2) * exp(-d * DIM) as f from usable, cells)
  group by LAGR, b, c, d),
scored as (select *, (yy - 2 * a * yf + a * a * ff) / n as loss from (
  select *, least(greatest(yf / ff, 50), 90) as a from sums))""",
        select="""select LAGR, round(a, 6) as a, b, c, d, round(loss, 6) as loss from (
  select *, row_number() over (partition by LAGR order by loss) as place from scored) where place = 1""",
    )
)
def grid_search(spark, sf_dir):
    """Best grid cell per group for the squared loss, with the limit on b * d."""
    found = search_grid(inputs_of(spark, sf_dir), ["LAGR"], SMALL_GRID)
    return rounded(found)


@query(
    check(
        *INPUTS,
        _CELLS,
        f"""scored as (select LAGR, a, b, c, d, avg(abs(y - e)) as mae, avg(abs(y - e) / greatest(abs(y), 2.22e-16)) as mape,
    case when min(least(y, e)) >= 0 then avg((ln(1 + greatest(y, 0)) - ln(1 + greatest(e, 0))) ^ 2) end as msle
  from (select LAGR, y, a, b, c, d, a * (1 - exp((c - DIM) / b) / 2) * exp(-d * DIM) as e
        from usable, cells, (values {_axis_values('a')}) a(a))
  group by LAGR, a, b, c, d),
long as (select LAGR, a, b, c, d, 'mae' as loss_name, mae as loss from scored
  union all select LAGR, a, b, c, d, 'mape', mape from scored union all select LAGR, a, b, c, d, 'msle', msle from scored)""",
        select="""select loss_name, LAGR, a, b, c, d, round(loss, 6) as loss from (
  select *, row_number() over (partition by loss_name, LAGR order by loss) as place from long where loss is not null)
where place = 1""",
    )
)
def grid_search_by_loss(spark, sf_dir):
    """Best grid cell per group for the absolute, relative and squared-log losses."""
    rows = inputs_of(spark, sf_dir)
    found = [
        search_grid(rows, ["LAGR"], SMALL_GRID, loss).select(F.lit(loss).alias("loss_name"), "*")
        for loss in ("mae", "mape", "msle")
    ]
    return rounded(reduce(lambda x, y: x.unionByName(y), found))


_SEARCH_BOUNDS = Grid(a=(0.0, 150.0, 16), b=(5.0, 50.0, 4), c=(-10.0, 5.0, 4), d=(0.0, 0.004, 5), product_limit=0.1)
_SEARCH_FIT = FitSettings(
    start=(90.0, 20.0, -2.5, 0.001), lower=(0.0, 5.0, -10.0, 0.0), upper=(150.0, 50.0, 5.0, 0.004)
)
_SEARCH_CHECK = fitted(
    INPUTS,
    """select LAGR * 10 + s as g, DIM as t, count(*) as w, avg(ECM) as y from inputs, (values (0), (1), (2)) s(s)
       where ECM is not null group by LAGR, DIM, s""",
    _SEARCH_FIT,
    """select s.LAGR, round(a, 3) as a, round(b, 2) as b, round(c, 2) as c, round(d, 6) as d,
  round((f.loss + s.within) / s.n, 4) as loss
from (select *, row_number() over (partition by g // 10 order by loss) as place from fitted) f join (select LAGR, sum(n) as n, sum(v) as within from (
  select LAGR, count(ECM) as n, var_pop(ECM) * count(ECM) as v from inputs where ECM is not null group by LAGR, DIM)
  group by LAGR) s on f.g // 10 = s.LAGR and f.place = 1""",
    steps=400,
    starts=("10 + 15 * (g % 10)", "-8 + 4 * (g % 10)", "0.001"),
)


@query(_SEARCH_CHECK)
def constrained_search(spark, sf_dir):
    """Least squared loss under bounds and the limit on b * d, by zoomed grid and a fit."""
    found = constrained_minimum(inputs_of(spark, sf_dir), ["LAGR"], _SEARCH_BOUNDS, rounds=3)
    return rounded(found, 4, a=3, b=2, c=2, d=6)


_LIMIT = 0.0235


@query(
    "with recursive "
    + ",\n".join(
        [
            *INPUTS,
            projected_search("select LAGR as g, DIM as t, count(*) as w, avg(ECM) as y from inputs where ECM is not null group by LAGR, DIM", _SEARCH_FIT, limit=_LIMIT),
        ]
    )
    + """
select g as LAGR, binds, round((loss + within) / n, 3) as loss from limited join (
  select LAGR, sum(n) as n, sum(v) as within from (
    select LAGR, count(ECM) as n, var_pop(ECM) * count(ECM) as v from inputs where ECM is not null group by LAGR, DIM) group by LAGR) s on g = s.LAGR"""
)
def constrained_search_at_limit(spark, sf_dir):
    """Least squared loss under a limit on b * d that binds for some groups and not for others."""
    grid = replace(_SEARCH_BOUNDS, product_limit=_LIMIT)
    found = constrained_minimum(inputs_of(spark, sf_dir), ["LAGR"], grid)
    return found.select("LAGR", (F.col("b") * F.col("d") > _LIMIT * (1 - 1e-9)).alias("binds"), F.round("loss", 3).alias("loss"))


@query(_SEARCH_CHECK)
def global_search(spark, sf_dir):
    """Least squared loss inside bounds, by a grid over all of them and a fit."""
    found = search_globally(inputs_of(spark, sf_dir), ["LAGR"], _SEARCH_BOUNDS)
    loss = (F.col("weighted_sse") / F.col("npoints")).alias("loss")
    return rounded(found.select("LAGR", *PARAMETERS, loss), 4, a=3, b=2, c=2, d=6)


# Yields with a wave over the days: a short ramp and a long one both give a valley.
_WAVE = "ECM + 5 * cos(DIM / 20e0)"
_WAVE_BOUNDS = replace(_SEARCH_BOUNDS, b=(5.0, 200.0, 4))


def _least_losses(value: str, settings: FitSettings) -> str:
    """Groups with their least loss, all of them proven."""
    search = projected_search(
        f"select LAGR as g, DIM as t, count(*) as w, avg({value}) as y from inputs where ECM is not null group by LAGR, DIM", settings
    )
    within = f"select LAGR, count(ECM) as n, var_pop({value}) * count(ECM) as v from inputs where ECM is not null group by LAGR, DIM"
    return "with recursive " + ",\n".join([*INPUTS, search]) + f"""
select g as LAGR, round((loss + within) / n, 3) as loss, true as proven
from least_loss join (select LAGR, sum(n) as n, sum(v) as within from ({within}) group by LAGR) s on g = s.LAGR"""


def _proven(records, grid, tolerance):
    found = proven_minimum(records, ["LAGR"], grid, tolerance)
    return found.select("LAGR", F.round("loss", 3).alias("loss"), ((F.col("gap") <= tolerance) & (F.col("lower") <= F.col("loss"))).alias("proven"))


@query(_least_losses("ECM", _SEARCH_FIT))
def proven_global_minimum(spark, sf_dir):
    """Least squared loss with a proof that no curve inside the bounds is better by two percent."""
    return _proven(inputs_of(spark, sf_dir), _SEARCH_BOUNDS, 0.02)


@query(_least_losses(_WAVE, replace(_SEARCH_FIT, upper=(150.0, 200.0, 5.0, 0.004))))
def proven_minimum_of_two_valleys(spark, sf_dir):
    """The same where the loss has two valleys."""
    return _proven(inputs_of(spark, sf_dir).withColumn("ECM", F.expr(_WAVE)), _WAVE_BOUNDS, 0.02)


_MODEL_YIELDS = "with recursive " + ",\n".join(
    [
        *INPUTS,
        FIT_ROWS,
        LEVELS,
        pattern_search(_GROUP_POINTS, GROUP_FIT, 1500),
        "parameters as (select g as LAGR, a, b, c, d from fitted)",
        SCALES,
    ]
)
_MODEL_YIELDS += f"""
select {NAMES} as grp, BDAT, ID, LACT, round(sum({CURVE}) / 305, 1) as m305_per_day
from (select *, unnest(range(1, 306)) as DIM from scaled) group by LAGR, BDAT, ID, LACT"""


def _per_day(yields):
    # To one decimal, as yields are reported: two solvers differ in later digits.
    return yields.select("grp", "BDAT", "ID", "LACT", F.round(F.col("m305") / 305, 1).alias("m305_per_day"))


@query(_MODEL_YIELDS)
def group_model_yields(spark, sf_dir):
    """The whole model: selection, group fits, individual scale, 305-day yield per day."""
    model = group_plan.group_model(*tables(spark, sf_dir), RUN)
    return _per_day(model.yields)


@query(_MODEL_YIELDS)
def group_model_yields_by_sql(spark, sf_dir):
    """The same model run as SQL text."""
    yields = sql_model.sql_group_model(spark, inputs_of(spark, sf_dir))["yields"]
    return _per_day(yields)
