"""SQL counterparts of the registered queries, for DuckDB over the same tables.

They state each result directly (row-level joins, windows, one row per
dependency edge) and share none of the rewrites the Spark operators use.
"""

from __future__ import annotations

from math import isqrt

from fringeflow.config import NARROW_SNAPSHOT, WIDE_FACETS, WIDE_FACETS_TWELVE_SLOTS, ImagingConfig

def _mod(value: str, n: int) -> str:
    return f"cast((({value}) % {n} + {n}) % {n} as int)"


def _range(n: int, name: str) -> str:
    return f"(select cast(unnest(range({n})) as int) as {name}) {name}"


def _digest(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def _round_div(value: str, divisor: int) -> str:
    half = divisor // 2
    return (
        f"cast(case when {value} < 0 then -((-({value}) + {half}) // {divisor})"
        f" else (({value}) + {half}) // {divisor} end as bigint)"
    )


def _trunc_div(value: str, divisor: str | int) -> str:
    return f"(case when ({value}) < 0 then -((-({value})) // ({divisor})) else ({value}) // ({divisor}) end)"


def _rotate(re: str, im: str, table: str = "t") -> tuple[str, str]:
    wide = "cast({} as hugeint)".format
    return (
        f"sum({wide(re)} * {table}.c - {wide(im)} * {table}.s)",
        f"sum({wide(re)} * {table}.s + {wide(im)} * {table}.c)",
    )


EVENTS_WITHOUT_KEYS = """(select case when event_id % 10 = 0 then null else event_id end as event_id,
    case when event_id % 7 = 0 then null else ts end as ts, user_id, event_type, value, props from events)"""

CATALOGUE = """(select p_partkey as comp_id, cast(round(p_retailprice * 100) as bigint) as flux from part)"""


def _ctes(c: ImagingConfig, events: str = "events", lsm: str | None = None) -> list[str]:
    n = c.cells
    step = c.refinement
    width = c.slot_seconds * 1_000_000
    catalogue = f"""select comp_id, 0 as beam, {_mod('comp_id', c.facets)} as facet, flux,
        {_mod('comp_id', n)} as u, {_mod(f'comp_id // {n}', n)} as w from {CATALOGUE}"""
    cell_re, cell_im = _rotate("r.re", "r.im")
    model_re, model_im = _rotate("d.model_re", "d.model_im")
    response = f"""(1000000 + coalesce((select {_trunc_div('gain', 'n_in')} from tel), 0))"""
    deg = {
        part: _trunc_div(f"r.model_{part} * ({step} - i.i) + r.next_{part} * i.i", step) for part in ("re", "im")
    }
    seen = lambda v: f"cast({_trunc_div(f'cast({v} as hugeint) * {response}', 1000000)} as bigint)"
    mean = lambda v: f"cast({_trunc_div(v, 'cast(count(*) as hugeint) * 10000000000')} as bigint)"
    m, r, side = n * n, c.match_radius, isqrt(c.facets - 1) + 1
    amplitude = "(abs(residual_re) + coalesce(abs(residual_im), 0))"
    return [
        f"""vis as (select event_id, 0 as beam, {_mod('event_id', c.channels)} as frequency,
            cast(floor((epoch_us(ts) - epoch_us(timestamp '{c.start}')) / {width}) as int) as time,
            user_id as baseline, {_mod('user_id', c.facets)} as facet,
            {_mod(f'event_id // {c.channels}', c.polarisations)} as polarisation,
            cast(round(value * 100) as bigint) as re,
            try_cast(json_extract_string(props, '$.k') as bigint) as im from {events} e)""",
        f"""lsm as ({lsm or catalogue})""",
        """ext as (select * from lsm where flux is not null)""",
        """extb as (select beam, 0 as major_loop, count(*) as n_in, cast(sum(flux) as bigint) as flux
            from ext group by beam)""",
        """telescope as (select s_suppkey as antenna_id, 0 as beam,
            cast(round(s_acctbal * 100) as bigint) as gain from supplier)""",
        """tel as (select beam, 0 as frequency, 0 as time, 0 as baseline, count(*) as n_in,
            cast(sum(gain) as bigint) as gain from telescope group by beam)""",
        f"""tw as (select k.k, x.x, cast(round(cos(2 * pi() * k.k * x.x / {n}) * 1000000) as bigint) as c,
            cast(round(sin(2 * pi() * k.k * x.x / {n}) * 1000000) as bigint) as s
            from {_range(n, 'k')} cross join {_range(n, 'x')})""",
        f"""rep as (select frequency, facet, p.p as polarisation, {_round_div('re', 10**6)} * (100 - 5 * frequency)
            as model_re, {_round_div('im', 10**6)} * (100 - 5 * frequency) as model_im, n_in from (
            select c.c as frequency, l.facet, sum(cast(l.flux as hugeint) * t.c) as re,
            sum(cast(l.flux as hugeint) * t.s) as im, count(*) as n_in
            from ext l cross join {_range(c.coarse_channels, 'c')}
            join tw t on t.k = c.c and t.x = (l.u + l.facet) % {n} group by 1, 2) z
            cross join {_range(c.polarisations, 'p')})""",
        f"""deg as (select cast(r.frequency * {step} + i.i as int) as frequency, r.facet, r.polarisation,
            {seen(deg['re'])} as model_re, {seen(deg['im'])} as model_im
            from (select rep.*, coalesce(lead(model_re) over q, model_re) as next_re,
            coalesce(lead(model_im) over q, model_im) as next_im from rep
            window q as (partition by facet, polarisation order by frequency)) r cross join {_range(step, 'i')})""",
        f"""pha as (select d.frequency, {mean(model_re)}
            + coalesce((select {_trunc_div('flux', 'n_in')} from extb), 0) as model_re,
            {mean(model_im)} as model_im, count(*) + (select count(*) from extb) as n_in
            from deg d join tw t on t.k = d.frequency % {n} and t.x = d.facet % {n} group by d.frequency)""",
        """slots as (select v.time, v.frequency, v.re, v.im, p.model_re, p.model_im from vis v
            left join pha p on v.frequency = p.frequency)""",
        """sol as (select time, cast(coalesce(sum(cast(re as hugeint) * model_re), 0)
            + coalesce(sum(cast(im as hugeint) * model_im), 0) as double)
            / nullif(cast(sum(cast(model_re as hugeint) * model_re + cast(model_im as hugeint) * model_im)
            as double), 0) as gain, count(*) as n_in from slots group by time)""",
        """cor as (select v.event_id, v.frequency, v.time, v.facet, v.polarisation, v.re, v.im,
            s.gain * p.model_re as corrected_re, s.gain * p.model_im as corrected_im from vis v
            left join pha p on v.frequency = p.frequency left join sol s on v.time = s.time)""",
        """res as (select event_id, frequency, time, facet, polarisation,
            cast(round(re - corrected_re) as bigint) as residual_re,
            cast(round(im - corrected_im) as bigint) as residual_im from cor)""",
        f"""flagged as (select *, {amplitude} * count(*) over (partition by frequency)
            > 2 * sum({amplitude}) over (partition by frequency) as flag from res)""",
        f"""placed as (select *, {_mod('event_id', n)} as u, {_mod(f'event_id // {n}', n)} as w from flagged)""",
        f"""grid as (select facet, polarisation, u, w, {seen(_round_div('re', 10**6))} as re,
            {seen(_round_div('im', 10**6))} as im, n_in, n_flagged from (
            select r.facet, r.polarisation, r.u, r.w, {cell_re} as re, {cell_im} as im, count(*) as n_in,
            count(*) filter (where r.flag) as n_flagged from (
            select *, case when flag then 0 else coalesce(residual_re, 0) end as re,
            case when flag then 0 else coalesce(residual_im, 0) end as im from placed
            where facet is not null and polarisation is not null and u is not null and w is not null) r
            left join tw t on t.k = r.frequency % {n} and t.x = r.facet % {n} group by 1, 2, 3, 4) z)""",
        f"""fft1 as (select facet, polarisation, k, w, {_round_div('re', 1000)} as re,
            {_round_div('im', 1000)} as im from (select g.facet, g.polarisation, t.k, g.w,
            sum(cast(g.re as hugeint) * t.c + cast(g.im as hugeint) * t.s) as re,
            sum(cast(g.im as hugeint) * t.c - cast(g.re as hugeint) * t.s) as im
            from grid g join tw t on g.u = t.x group by 1, 2, 3, 4) z)""",
        f"""fft2 as (select facet, polarisation, k, l, {_round_div('re', 10**9)} as re,
            {_round_div('im', 10**9)} as im from (select f.facet, f.polarisation, f.k, t.k as l,
            sum(cast(f.re as hugeint) * t.c + cast(f.im as hugeint) * t.s) as re,
            sum(cast(f.im as hugeint) * t.c - cast(f.re as hugeint) * t.s) as im
            from fft1 f join tw t on f.w = t.x group by 1, 2, 3, 4) z)""",
        f"""ifft1 as (select facet, polarisation, k, w, {_round_div('re', 10**5)} as re,
            {_round_div('im', 10**5)} as im from (select f.facet, f.polarisation, f.k, t.x as w,
            sum(cast(f.re as hugeint) * t.c - cast(f.im as hugeint) * t.s) as re,
            sum(cast(f.re as hugeint) * t.s + cast(f.im as hugeint) * t.c) as im
            from fft2 f join tw t on f.l = t.k group by 1, 2, 3, 4) z)""",
        f"""ifft2 as (select facet, polarisation, u, w, {_round_div('re', 10**7 * n * n)} as re,
            {_round_div('im', 10**7 * n * n)} as im from (select f.facet, f.polarisation, t.x as u, f.w,
            sum(cast(f.re as hugeint) * t.c - cast(f.im as hugeint) * t.s) as re,
            sum(cast(f.re as hugeint) * t.s + cast(f.im as hugeint) * t.c) as im
            from ifft1 f join tw t on f.k = t.k group by 1, 2, 3, 4) z)""",
        f"""img as (select facet, polarisation, {_mod('k + facet', n)} as k, l,
            cast(sum(re) as bigint) as re, cast(sum(im) as bigint) as im from fft2 group by 1, 2, 3, 4)""",
        """sumf as (select facet, polarisation, cast(sum(abs(re) + abs(im)) as bigint) as flux,
            count(*) as n_cells from img group by 1, 2)""",
        """comp as (select facet, polarisation, k as u, l as w, cell from (select g.*, abs(re) + abs(im) as cell,
            row_number() over (partition by facet order by abs(re) + abs(im) desc, polarisation, k, l) as rn
            from img g) z where rn = 1)""",
        f"""src as (select facet, u, w, cell as flux from comp where cell > {c.peak_threshold})""",
        """sub as (select s.facet, s.polarisation, s.flux - coalesce(c.cell, 0) as residual from sumf s
            left join comp c on s.facet = c.facet and s.polarisation = c.polarisation)""",
        f"""bright as (select facet, k as u, l as w, cell, facet // {side} * {n} + k as x, facet % {side} * {n} + l as y,
            (facet // {side} * {n} + k) * {side * n}::bigint + facet % {side} * {n} + l as number
            from (select facet, k, l, cell, sum(cell) over (partition by facet) as total, count(*) over (partition by facet)
            as n from (select facet, k, l, cast(sum(abs(re) + abs(im)) as bigint) as cell from img group by 1, 2, 3) s) z
            where cell > {c.peak_threshold} and cell * n * 100 > {c.island_percent} * total)""",
        f"""touch as (select o.number as a, t.number as b from (select number, x + p.p - 1 as x, y + q.q - 1 as y
            from bright cross join {_range(3, 'p')} cross join {_range(3, 'q')}) o
            join bright t on o.x = t.x and o.y = t.y)""",
        """reach(a, b) as (select number, number from bright union select r.a, t.b from reach r join touch t on t.a = r.b)""",
        """labelled as (select t.*, r.island from bright t join (select a, min(b) as island from reach group by a) r
            on r.a = t.number)""",
        """isl as (select island, max(facet) filter (where rn = 1) as facet, max(u) filter (where rn = 1) as u,
            max(w) filter (where rn = 1) as w, max(cell) as peak, cast(sum(cell) as bigint) as flux, count(*) as n_cells,
            cast(sum(cell::hugeint * x * 1000) // sum(cell) as bigint) as x_milli,
            cast(sum(cell::hugeint * y * 1000) // sum(cell) as bigint) as y_milli,
            min(x) as x_first, max(x) as x_last, min(y) as y_first, max(y) as y_last
            from (select *, row_number() over (partition by island order by cell desc, x, y) as rn from labelled) z
            group by island)""",
        f"""close as (select i.island as source, l.comp_id, cast(l.du * l.du + l.dw * l.dw as int) as d2 from isl i
            join (select lsm.*, d.* from lsm cross join (select a.a - {r} as du, b.b - {r} as dw
            from {_range(2 * r + 1, 'a')} cross join {_range(2 * r + 1, 'b')}) d) l on i.facet = l.facet
            and l.u = (i.u + l.du + {n}) % {n} and l.w = (i.w + l.dw + {n}) % {n}
            where l.comp_id is not null and l.du * l.du + l.dw * l.dw <= {r * r})""",
        """matched as (select source, comp_id from (select *, row_number() over (partition by source order by d2, comp_id) as s,
            row_number() over (partition by comp_id order by d2, source) as c from close) z where s = 1 and c = 1)""",
        """upd as (select l.comp_id, l.beam, l.facet, case when i.flux is null then l.flux else coalesce(l.flux, 0) + i.flux end
            as flux, coalesce(i.u, l.u) as u, coalesce(i.w, l.w) as w from lsm l
            left join matched m on m.comp_id = l.comp_id left join isl i on i.island = m.source
            union all select coalesce((select least(min(comp_id), 0) from lsm), 0) - 1 - island, 0, facet, flux, u, w
            from isl where island not in (select source from matched))""",
        f"""psf1 as (select facet, polarisation, k, w, {_round_div('re', 1000)} as re, {_round_div('im', 1000)} as im from (
            select g.facet, g.polarisation, t.k, g.w, sum(cast(g.n_in - g.n_flagged as hugeint) * t.c) as re,
            -sum(cast(g.n_in - g.n_flagged as hugeint) * t.s) as im from grid g join tw t on g.u = t.x group by 1, 2, 3, 4) z)""",
        f"""psf as (select facet, polarisation, k, l, {_round_div('re', 10**9)} as re, {_round_div('im', 10**9)} as im from (
            select f.facet, f.polarisation, f.k, t.k as l, sum(cast(f.re as hugeint) * t.c + cast(f.im as hugeint) * t.s) as re,
            sum(cast(f.im as hugeint) * t.c - cast(f.re as hugeint) * t.s) as im
            from psf1 f join tw t on f.w = t.x group by 1, 2, 3, 4) z)""",
        f"""cubes as (select facet, list(re order by polarisation, k, l) as cube, list(polarisation order by polarisation, k, l)
            as pol from img group by facet)""",
        """shapes as (select facet, list(case when centre = 0 then 0 else case when re < 0 then -1 else 1 end
            * cast((2000000 * abs(re)::hugeint + abs(centre)) // (2 * abs(centre)::hugeint) as bigint) end
            order by polarisation, k, l) as shape from (select *, first_value(re) over (partition by facet, polarisation
            order by k, l) as centre from psf) z group by facet)""",
        f"""clean(facet, step, place, flux, lim, cube) as (
            select facet, 0, 0::bigint, 0::bigint, greatest({c.peak_threshold}, list_max([abs(v) for v in cube])
            * {c.minor_stop_percent} // 100), cube from cubes
            union all select p.facet, p.step, p.place, p.flux, p.lim, list_transform(p.cube, lambda v, i:
                v - case when (i - 1) // {m} <> p.image then 0 else {_round_div(f"""(p.flux::hugeint * s.shape[p.image * {m}
                + ((i - 1) % {m} // {n} - p.u + {n}) % {n} * {n} + ((i - 1) % {n} - p.w + {n}) % {n} + 1])""", 10**6)} end)
            from (select *, (place - 1) // {m} as image, (place - 1) % {m} // {n} as u, (place - 1) % {n} as w from (
                select facet, step + 1 as step, peak as place, lim, cube, case when cube[peak] < 0 then -1 else 1 end
                * (abs(cube[peak]) * {c.minor_gain_percent} // 100) as flux
                from (select facet, step, lim, cube, cast(list_position([abs(v) for v in cube],
                list_max([abs(v) for v in cube])) as bigint) as peak from clean) z
                where abs(cube[peak]) > lim and step < {c.minor_iterations}) y) p
            join shapes s on s.facet = p.facet where p.flux <> 0 and s.shape[p.image * {m} + 1] <> 0)""",
        f"""minor as (select e.facet, b.pol[e.place] as polarisation, cast((e.place - 1) % {m} // {n} as int) as u,
            cast((e.place - 1) % {n} as int) as w, e.step, e.flux from clean e join cubes b on b.facet = e.facet where e.step > 0)""",
        f"""left_over as (select facet, unnest(pol) as polarisation, cast(unnest(range(len(cube))) % {m} // {n} as int) as u,
            cast(unnest(range(len(cube))) % {n} as int) as w, unnest(cube) as residual from (select e.facet, b.pol, e.cube
            from clean e join cubes b on b.facet = e.facet join (select facet, max(step) as step from clean group by facet) t
            on t.facet = e.facet and t.step = e.step) z)""",
        f"""pair_sums as (select time, pair, cast(coalesce(sum(re::hugeint * model_re + im::hugeint * model_im), 0) as double) as cross_re,
            cast(coalesce(sum(im::hugeint * model_re - re::hugeint * model_im), 0) as double) as cross_im,
            cast(sum(case when re is null or im is null then 0 else 1 end * (model_re::hugeint * model_re
            + model_im::hugeint * model_im)) as double) as power, count(re + im) as n_in from (select v.time,
            {_mod('v.baseline', c.antenna_pairs)} as pair, p.model_re, p.model_im, case when v.re is null or v.im is null
            then null else v.re end as re, case when v.re is null or v.im is null then null else v.im end as im from vis v join pha p on p.frequency = v.frequency
            where v.time is not null and v.baseline is not null) z group by 1, 2)""",
        f"""sky as (select l.facet, p.p as polarisation, {_mod(f'l.u - l.facet % {n}', n)} as k, l.w as l, cast(sum(l.flux) as bigint) as re
            from lsm l cross join {_range(c.polarisations, 'p')} where flux is not null and u is not null and w is not null
            and facet is not null group by 1, 2, 3, 4)""",
        f"""sky1 as (select facet, polarisation, k, w, {_round_div('re', 10**5)} as re, {_round_div('im', 10**5)} as im from (
            select f.facet, f.polarisation, f.k, t.x as w, sum(cast(f.re as hugeint) * t.c) as re,
            sum(cast(f.re as hugeint) * t.s) as im from sky f join tw t on f.l = t.k group by 1, 2, 3, 4) z)""",
        f"""sky2 as (select facet, polarisation, u, w, {_round_div('re', 10**7 * n * n)} as re,
            {_round_div('im', 10**7 * n * n)} as im from (select f.facet, f.polarisation, t.x as u, f.w,
            sum(cast(f.re as hugeint) * t.c - cast(f.im as hugeint) * t.s) as re,
            sum(cast(f.re as hugeint) * t.s + cast(f.im as hugeint) * t.c) as im
            from sky1 f join tw t on f.k = t.k group by 1, 2, 3, 4) z)""",
        """kern as (select a.a - 1 as du, b.b - 1 as dw, (case when a.a = 1 then 2 else 1 end)
            * (case when b.b = 1 then 2 else 1 end) as wt
            from (select unnest(range(3)) as a) a cross join (select unnest(range(3)) as b) b)""",
        f"""around as (select g.facet, g.polarisation, {_mod('g.u + k.du', n)} as u, {_mod('g.w + k.dw', n)} as w,
            sum(cast(g.re as hugeint) * k.wt) as re, sum(cast(g.im as hugeint) * k.wt) as im
            from sky2 g cross join kern k group by 1, 2, 3, 4)""",
        f"""degridded as (select v.event_id, v.frequency, v.time, v.facet, v.polarisation, v.re, v.im,
            {_round_div('(a.re * t.c + a.im * t.s)', 16 * 10**6)} as model_re, {_round_div('(a.im * t.c - a.re * t.s)', 16 * 10**6)} as model_im
            from (select *, {_mod('event_id', n)} as u, {_mod(f'event_id // {n}', n)} as w from vis) v
            left join around a on a.facet = v.facet and a.polarisation = v.polarisation and a.u = v.u and a.w = v.w
            left join tw t on t.k = v.frequency % {n} and t.x = v.facet % {n})""",
        """degridded_sol as (select time, cast(coalesce(sum(cast(re as hugeint) * model_re), 0)
            + coalesce(sum(cast(im as hugeint) * model_im), 0) as double) / nullif(cast(coalesce(sum(cast(model_re as hugeint) * model_re), 0)
            + coalesce(sum(cast(model_im as hugeint) * model_im), 0) as double), 0) as gain, count(*) as n_in from degridded group by time)""",
        *_flag_runs(c),
        """visch as (select frequency, cast(sum(re) as bigint) as re, cast(sum(im) as bigint) as im,
            count(*) as n_in from vis group by frequency)""",
        f"""reproj as (select facet, polarisation, {_mod('u + facet', n)} as u, w, cast(sum(re) as bigint) as re,
            cast(sum(im) as bigint) as im from grid group by 1, 2, 3, 4)""",
    ]


def _flag_runs(c: ImagingConfig) -> list[str]:
    """Cells of timeslot and channel after each round, scale and direction in turn."""
    amplitude = "(abs(residual_re) + coalesce(abs(residual_im), 0))"
    tables = [
        f"""cells0 as materialized (select time, frequency, count(*) as n_in, cast(sum({amplitude}) // count(*) as bigint) as amplitude,
            false as flag from res where time is not null and frequency is not null and residual_re is not null group by 1, 2)"""
    ]
    for turn in range(c.flag_rounds):
        tables.append(
            f"""cells{len(tables)} as materialized (select time, frequency, n_in, amplitude, flag, (select cast(floor(median(amplitude))
            as bigint) from cells{len(tables) - 1} where not flag) as middle, (select cast(floor(median(abs(amplitude
            - (select cast(floor(median(amplitude)) as bigint) from cells{len(tables) - 1} where not flag))) * {c.flag_factor}) as bigint)
            from cells{len(tables) - 1} where not flag) as lim from cells{len(tables) - 1})"""
        )
        for power, m in enumerate((1, 2, 4, 8)):
            for along, across in (("time", "frequency"), ("frequency", "time")):
                here = f"cells{len(tables) - 1}"
                # A cell is in a run that starts at s where s <= it < s + m.
                tables.append(
                    f"""cells{len(tables)} as materialized (select e.time, e.frequency, e.n_in, e.amplitude, e.flag or exists (
                    select 1 from (select a.{across}, a.{along} as s from {here} a join {here} b on a.{across} = b.{across}
                    and b.{along} between a.{along} and a.{along} + {m - 1} group by 1, 2 having count(*) = {m}
                    and sum(case when b.flag then 0 else b.amplitude - b.middle end) * {3**power} > any_value(a.lim) * {2**power}
                    * count(*) filter (where not b.flag)) r where r.{across} = e.{across} and e.{along} between r.s and r.s + {m - 1})
                    as flag, e.middle, e.lim from {here} e)"""
                )
    return [*tables, f"run_flags as (select time, frequency, n_in, amplitude, flag from cells{len(tables) - 1})"]


def _with(ctes: list[str], select: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + select


# Stage, its rows and the columns that its digest covers.
DIGESTS = [
    ("extract_lsm", "ext", "comp_id flux"),
    ("local_sky_model", "lsm", "comp_id flux"),
    ("telescope_management", "telescope", "antenna_id gain"),
    ("visibility_buffer", "vis", "event_id re im"),
    ("reppre_ifft", "rep", "frequency facet polarisation model_re model_im"),
    ("telescope_data", "tel", "n_in gain"),
    ("degkerupd_deg", "deg", "frequency facet polarisation model_re model_im"),
    ("pharotpre_dft_sumvis", "pha", "frequency model_re model_im"),
    ("solve", "sol", "time n_in"),
    ("cor_subvis_flag", "flagged", "event_id residual_re residual_im"),
    ("grikerupd_pharot_grid_fft_rep", "grid", "facet polarisation u w re im"),
    ("sum_facets", "sumf", "facet polarisation flux"),
    ("identify_component", "comp", "facet u w cell"),
    ("source_find", "isl", "facet flux"),
    ("subimacom", "sub", "facet polarisation residual"),
    ("update_lsm", "upd", "comp_id flux"),
]


def _stage_digests() -> str:
    rows = []
    for stage, table, columns in DIGESTS:
        text = "concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in columns.split()) + ")"
        rows.append(f"select '{stage}' as stage, count(*) as n_rows, bit_xor({_digest(text)}) as digest from {table}")
    return " union all ".join(rows)


def _index_grid(c: ImagingConfig) -> str:
    return f"""select 0 as beam, 0 as major_loop, f.f as frequency, 0 as time, x.x as facet,
        p.p as polarisation, coalesce(l.n, 0) as n_in
        from {_range(c.coarse_channels, 'f')} cross join {_range(c.facets, 'x')}
        cross join {_range(c.polarisations, 'p')}
        left join (select facet, count(*) as n from lsm group by facet) l on l.facet = x.x"""


def _dep_edges(c: ImagingConfig) -> str:
    return f"""select f.f as frequency, x.x as facet, p.p as polarisation,
        cast(f.f // {c.refinement} as int) as src_frequency, cast(f.f // {c.channels} as int) as tel_frequency,
        coalesce(v.n, 0) as n_in
        from {_range(c.channels, 'f')} cross join {_range(c.facets, 'x')}
        cross join {_range(c.polarisations, 'p')}
        left join (select frequency, facet, polarisation, count(*) as n from vis group by 1, 2, 3) v
        on v.frequency = f.f and v.facet = x.x and v.polarisation = p.p"""


def _grid_planes(c: ImagingConfig) -> str:
    """One row per measurement and cell that it reaches."""
    n, over = c.cells, c.sub_cells
    along = "greatest(0, {o2} + r.plane - abs({o2} * {d} - (2 * r.{s} + 1 - {o})))".format
    weights = " * ".join(along(o2=2 * over, o=over, d=f"k.d{x}", s=f"s{x}") for x in "uw")
    return f"""select facet, polarisation, u, w, {_round_div('re', 10**6)} as re, {_round_div('im', 10**6)} as im, n_in from (
        select facet, polarisation, u, w, sum((re * c - im * s) * weight) as re, sum((re * s + im * c) * weight) as im,
        count(*) as n_in from (select r.facet, r.polarisation, {_mod('r.u + k.du', n)} as u, {_mod('r.w + k.dw', n)} as w,
        cast(r.re as hugeint) as re, cast(r.im as hugeint) as im, t.c, t.s, {weights} as weight from (
        select *, case when flag then 0 else coalesce(residual_re, 0) end as re,
        case when flag then 0 else coalesce(residual_im, 0) end as im, {_mod(f'event_id // {n * n}', over)} as su,
        {_mod(f'event_id // {n * n * over}', over)} as sw, coalesce({_mod('time', c.w_planes)}, 0) as plane
        from placed where facet is not null and polarisation is not null and event_id is not null) r cross join kern k
        left join tw t on t.k = r.frequency % {n} and t.x = r.facet % {n}) z where weight > 0 group by 1, 2, 3, 4) y"""


def _selects(c: ImagingConfig) -> dict[str, str]:
    n = c.cells
    label = "concat_ws('_', " + ", ".join(
        f"cast({k} as varchar)" for k in ("beam", "frequency", "time", "polarisation")
    ) + ")"
    gains = "cast(sum(cast(round(gain * 1000000) as bigint)) as bigint)"
    return {
        "extract_lsm": "select * from extb",
        "local_sky_model": "select * from lsm",
        "telescope_management": "select * from telescope",
        "visibility_buffer": "select * from vis",
        "reppre_ifft": "select * from rep",
        "telescope_data": "select * from tel",
        "degkerupd_deg": "select * from deg",
        "pharotpre_dft_sumvis": "select * from pha",
        "timeslots": "select * from slots",
        "solve": "select * from sol",
        "cor_subvis_flag": "select * from flagged",
        "grikerupd_pharot_grid_fft_rep": "select * from img",
        "sum_facets": "select * from sumf",
        "identify_component": "select * from comp",
        "find_sources": "select * from src",
        "source_find": """select 0 as beam, 0 as major_loop, count(*) as n_in,
            cast(sum(flux) as bigint) as flux from isl group by 1, 2""",
        "source_islands": "select * from isl",
        "near_components": "select * from close",
        "point_spread": "select * from psf",
        "minor_cycle_components": "select * from minor",
        "minor_cycle_residuals": "select * from left_over",
        "minor_cycle_model": """select facet, polarisation, u, w, cast(sum(flux) as bigint) as flux, count(*) as n_components
            from minor group by 1, 2, 3, 4""",
        "antenna_pair_sums": "select * from pair_sums",
        "subimacom": "select * from sub",
        "subimacom_facets": """select facet, cast(sum(residual) as bigint) as residual,
            count(*) as n_images from sub group by facet""",
        "update_lsm": "select * from upd",
        "reprojection": "select * from reproj",
        "dft_rows": "select * from fft1",
        "dft": "select * from fft2",
        "idft_columns": "select * from ifft1",
        "idft": "select * from ifft2",
        "degrid": f"""select v.event_id, m.model_re, m.model_im from placed v left join (
            select c.facet, c.polarisation, c.u, c.w, cast(sum(g.re * k.wt) as bigint) as model_re,
            cast(sum(g.im * k.wt) as bigint) as model_im from grid c cross join kern k join grid g on g.facet = c.facet
            and g.polarisation = c.polarisation and g.u = (c.u + k.du + {n}) % {n}
            and g.w = (c.w + k.dw + {n}) % {n} group by 1, 2, 3, 4) m
            on m.facet = v.facet and m.polarisation = v.polarisation and m.u = v.u and m.w = v.w""",
        "model_cells": "select * from sky2",
        "predict_degridded": "select * from degridded",
        "solve_degridded": "select * from degridded_sol",
        "subtract_degridded": """select v.event_id, v.frequency, v.time, v.facet, v.polarisation,
            cast(round(v.re - s.gain * v.model_re) as bigint) as residual_re,
            cast(round(v.im - s.gain * v.model_im) as bigint) as residual_im
            from degridded v left join degridded_sol s on s.time = v.time""",
        "phase_rotation": f"""select v.event_id, cast(v.re * t.c - v.im * t.s as bigint) as re,
            cast(v.re * t.s + v.im * t.c as bigint) as im from vis v
            left join tw t on v.frequency % {n} = t.k and v.facet % {n} = t.x""",
        "sum_visibilities": "select * from visch",
        "correct": "select * from cor",
        "subtract_visibility": "select * from res",
        "flag": """select frequency, count(*) as n_in, count(*) filter (where flag) as n_flagged
            from flagged group by frequency""",
        "flag_runs": "select * from run_flags",
        "flag_by_runs": """select r.*, f.flag from res r left join run_flags f on f.time = r.time
            and f.frequency = r.frequency""",
        "grid": "select * from grid",
        "grid_convolved": f"""select v.facet, v.polarisation, {_mod('v.u + k.du', n)} as u,
            {_mod('v.w + k.dw', n)} as w, cast(sum(v.re * k.wt) as bigint) as re,
            cast(sum(v.im * k.wt) as bigint) as im, cast(sum(v.n_in) as bigint) as n_in
            from grid v cross join kern k group by 1, 2, 3, 4""",
        "grid_planes": _grid_planes(c),
        "index_grid": _index_grid(c),
        "dep_edges": _dep_edges(c),
        "fan_out": f"select v.*, t.t as time from visch v cross join {_range(c.slots, 't')}",
        "refine": f"""select cast(r.frequency * {c.refinement} + i.i as int) as frequency, r.facet,
            r.polarisation, r.model_re, r.model_im, r.n_in, i.i as part from rep r cross join {_range(c.refinement, 'i')}""",
        "fan_in_group": """select facet, count(*) as n_in, cast(sum(re) as bigint) as re from vis
            group by facet""",
        "fan_in_union": f"""select frequency, count(*) as n_in, count(distinct src) as n_sources,
            cast(sum(val) as bigint) as val from (select frequency, 'model' as src, model_re as val from pha
            union all select frequency, 'vis', re from visch union all
            select f.f, 'solve', cast(round(s.gain * 1000000) as bigint) from sol s
            cross join {_range(c.channels, 'f')}) z group by frequency""",
        "fan_in_zip2": """select v.*, p.model_re, p.model_im from visch v
            join pha p on v.frequency = p.frequency""",
        "fan_in_zip3": f"""select v.*, p.model_re, p.model_im, s.gain_micro from visch v
            join pha p on v.frequency = p.frequency cross join (select {gains} as gain_micro from sol) s""",
        "fan_in_stored": """select v.event_id, v.re, v.im, d.model_re, d.model_im,
            cast(round(r.re - s.gain * r.model_re) as bigint) as residual_re,
            cast(round(r.im - s.gain * r.model_im) as bigint) as residual_im from vis v
            join degridded d on d.event_id = v.event_id join degridded r on r.event_id = v.event_id
            left join degridded_sol s on s.time = r.time""",
        "cogroup_merge": """select coalesce(l.facet, v.facet) as facet, l.n_components, l.flux,
            v.n_measured, v.re from (select facet, count(*) as n_components, cast(sum(flux) as bigint)
            as flux from lsm group by facet) l full outer join (select facet, count(*) as n_measured,
            cast(sum(re) as bigint) as re from vis group by facet) v on l.facet = v.facet""",
        "broadcast_lookup": """select v.event_id, v.frequency, v.re, v.im, p.model_re, p.model_im from vis v
            left join pha p on v.frequency = p.frequency""",
        "partition_by_dim": """select frequency, count(*) as n_in, cast(sum(re) as bigint) as re,
            cast(sum(im) as bigint) as im from vis group by frequency""",
        "partition_by_facet": """select facet, count(*) as n_in, cast(sum(re) as bigint) as re,
            cast(sum(im) as bigint) as im from vis group by facet""",
        "one_partition_per_key": """select facet, polarisation, count(*) as n_in, cast(sum(re) as bigint) as re,
            cast(sum(im) as bigint) as im from vis group by 1, 2""",
        "per_partition_map": """select frequency, cast(sum(re) as bigint) as re, max(re) as peak,
            count(*) as n_in from vis group by frequency""",
        "first_per_key": """select frequency, event_id, re from (select *, row_number() over
            (partition by frequency order by event_id) as rn from vis) z where rn = 1""",
        "per_row_map": f"""select event_id, time, facet, polarisation,
            cast(frequency // {c.refinement} as int) as src_frequency,
            cast(frequency % {c.refinement} as int) as part, greatest(re, 4) as amount from vis""",
        "collapse_global": """select count(*) as n_in, cast(sum(re) as bigint) as re,
            min(event_id) as first_id, max(event_id) as last_id from vis""",
        "stage_cache": """select * from visch union all select -1, cast(sum(re) as bigint),
            cast(sum(im) as bigint), cast(sum(n_in) as bigint) from visch""",
        "stage_lineage": _stage_digests(),
        "stage_count": " union all ".join(
            f"select '{stage}' as stage, count(*) as n_rows from {cte}"
            for stage, cte in (
                ("visibility_buffer", "vis"),
                ("local_sky_model", "lsm"),
                ("telescope_management", "telescope"),
                ("reppre_ifft", "rep"),
                ("degkerupd_deg", "deg"),
                ("pharotpre_dft_sumvis", "pha"),
                ("solve", "sol"),
            )
        ),
        "imaging_cycle": """select 'cor_subvis_flag' as stage, count(*) as n_rows,
            count(*) filter (where flag) as n_flagged, cast(sum(residual_re) as bigint) as total from flagged
            union all select 'grikerupd_pharot_grid_fft_rep', count(*), cast(sum(n_flagged) as bigint),
            cast(sum(re) as bigint) from grid
            union all select 'subimacom', count(distinct facet), 0, cast(sum(residual) as bigint) from sub
            union all select 'update_lsm', count(*), 0, cast(sum(flux) as bigint) from upd""",
        "lineage_digest": f"""select frequency, count(*) as n_in, bit_xor({_digest(
            "concat_ws('|', cast(event_id as varchar), cast(re as varchar))")}) as digest
            from vis group by frequency""",
        "input_volume": f"""select {_mod('event_id', c.channels)} as frequency, count(*) as n_in,
            cast(sum(strlen(props)) as bigint) as input_bytes from events group by 1""",
        "stage_report": """select stage, count(*) as n_tasks, cast(sum(n_in) as bigint) as n_in from (
            select 'reppre_ifft' as stage, n_in from rep
            union all select 'pharotpre_dft_sumvis', n_in from pha
            union all select 'solve', n_in from sol union all select 'grid', n_in from grid) z
            group by rollup(stage)""",
        "key_labels": f"""select event_id, label, upper(printf('%x', code)) as code,
            xor(code, event_id) as mixed, strlen(label) as n_bytes, substr(label, 1, 4) as head,
            cast(split_part(label, '_', 2) as int) as frequency, greatest(4, re) // 1000 as kilo
            from (select event_id, re, {label} as label, {_digest(label)} as code from vis) z""",
        "stored_by_channel": """select time, frequency, cast(sum(re) as bigint) as re,
            cast(sum(im) as bigint) as im, count(*) as n_in from vis group by 1, 2""",
        "stored_refreshed": """select frequency, re, im, n_in, case when frequency = 3 then 'changed' end as state
            from visch""",
        "stored_solve_by_time": "select * from sol",
        "stored_prediction_by_channel": "select * from pha where frequency = 7",
        "stored_model_by_key": "select * from rep where facet = 3",
        "stored_one_channel": "select * from visch where frequency = 3",
        "stored_replaced": f"""select frequency, facet, polarisation,
            case when frequency = {c.coarse_channels - 1} then -model_re else model_re end as model_re,
            case when frequency = {c.coarse_channels - 1} then -model_im else model_im end as model_im, n_in
            from rep""",
    }


def _oracle(c: ImagingConfig) -> dict[str, str]:
    ctes = _ctes(c)
    return {name: _with(ctes, select) for name, select in _selects(c).items()}


MISSING_KEYS = """select f.time, count(*) as n_in, count(f.residual_re) as n_residuals, count(f.flag) as n_flags,
    cast(sum(f.residual_re) as bigint) as residual, any_value(s.n_in) as n_solved
    from flagged f left join sol s on f.time is not distinct from s.time group by f.time"""


def _next_cycle(c: ImagingConfig) -> str:
    """The second cycle's tables read the first one's catalogue."""
    first = _with(_ctes(c), "select * from upd")
    return _with(_ctes(c, lsm=first), "select * from pha")


LOOP = """select {loop} as major_loop, (select count(*) from lsm) as n_before, (select count(*) from upd) as n_after,
    (select count(*) from isl) as n_sources, (select cast(coalesce(sum(flux), 0) as bigint) from isl) as source_flux,
    (select cast(coalesce(sum(case when flag then 0 else abs(residual_re) + coalesce(abs(residual_im), 0) end), 0) as bigint)
    from flagged) as residual"""


def _major_loops(c: ImagingConfig) -> str:
    first = _ctes(c)
    second = _ctes(c, lsm=_with(first, "select * from upd"))
    loops = [_with(ctes, LOOP.format(loop=i)) for i, ctes in enumerate((first, second))]
    return " union all ".join(f"select * from ({loop})" for loop in loops)


_NARROW, _WIDE, _TWELVE = (_oracle(c) for c in (NARROW_SNAPSHOT, WIDE_FACETS, WIDE_FACETS_TWELVE_SLOTS))

_OF_WIDE = (
    "index_grid",
    "dep_edges",
    "sum_facets",
    "identify_component",
    "subimacom",
    "update_lsm",
    "stage_lineage",
    "reppre_ifft",
    "degkerupd_deg",
    "pharotpre_dft_sumvis",
    "cor_subvis_flag",
    "grikerupd_pharot_grid_fft_rep",
    "source_find",
)

ORACLE_SQL: dict[str, str] = {
    **_NARROW,
    "missing_keys": _with(_ctes(NARROW_SNAPSHOT, EVENTS_WITHOUT_KEYS), MISSING_KEYS),
    "next_cycle": _next_cycle(NARROW_SNAPSHOT),
    "major_loops": _major_loops(NARROW_SNAPSHOT),
    **{f"{name}_81": _WIDE[name] for name in _OF_WIDE},
    **{f"{name}_120": _WIDE[name] for name in ("solve", "timeslots", "fan_out")},
    **{f"{name}_12": _TWELVE[name] for name in ("solve", "timeslots")},
}
