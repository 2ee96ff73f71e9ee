"""The registered queries in DuckDB's SQL, written from the definitions, not from the plans."""

from __future__ import annotations

PIXELS = """pixels as (
  select event_id // 2500 as image_id, event_id % 2500 as seq,
         cast(event_id % 2500 % 50 as int) as x, cast(event_id % 2500 // 50 as int) as y,
         cast(((event_id % 2500 % 50) // 10 * 51 + user_id % 16) % 256 as int) as r,
         cast(((event_id % 2500 // 50) // 10 * 51 + (event_id % 7) * 3) % 256 as int) as g,
         cast(floor(value) as int) % 256 as b,
         case event_type when 'error' then 0 when 'signup' then 200 else 255 end as a
  from events)"""

BOXED = """boxed as (
  select * replace (case when x between 7 and 31 and y between 5 and 40 then a else 0 end as a) from pixels)"""

PALETTE = """palette as (
  select p_brand as brand, 'P' || lpad(cast(p_partkey as varchar), 9, '0') as code, p_name as name, cast(p_partkey as int) as ord,
         cast((p_partkey * 97) % 256 as int) as r, cast((p_partkey * p_size * 11) % 256 as int) as g, cast((p_size * 29) % 256 as int) as b
  from part)"""


def lab(name: str, source: str) -> str:
    """A chain of CTEs that adds lab_l, lab_a, lab_b to the rows of ``source``."""
    lin = ", ".join(f"case when {c} / 255.0::double <= 0.04045::double then {c} / 255.0::double / 12.92::double else pow(({c} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) end as l{c}" for c in "rgb")
    rows = {"fx": ((0.4124564, 0.3575761, 0.1804375), 0.95047), "fy": ((0.2126729, 0.7151522, 0.0721750), 1.0), "fz": ((0.0193339, 0.1191920, 0.9503041), 1.08883)}
    xyz = ", ".join("(" + " + ".join(f"l{c} * {m}::double" for c, m in zip("rgb", ms, strict=True)) + f") / {w}::double as {k}" for k, (ms, w) in rows.items())
    f = ", ".join(f"case when {k} > 0.008856::double then cbrt({k}) else (903.3::double * {k} + 16) / 116 end as {k}" for k in rows)
    return f"""{name}_1 as (select *, {lin} from {source}),
{name}_2 as (select *, {xyz} from {name}_1),
{name}_3 as (select * replace ({f}) from {name}_2),
{name} as (select * exclude (lr, lg, lb, fx, fy, fz), 116 * fy - 16 as lab_l, 500 * (fx - fy) as lab_a, 200 * (fy - fz) as lab_b from {name}_3)"""


def delta_e(name: str, source: str) -> str:
    """A chain of CTEs that adds delta_e of (lab_l, lab_a, lab_b) and (p_l, p_a, p_b)."""
    hue = lambda b, a: f"case when {a} = 0 and {b} = 0 then 0 when atan2({b}, {a}) < 0 then degrees(atan2({b}, {a})) + 360 else degrees(atan2({b}, {a})) end"
    return f"""{name}_1 as (select *, (sqrt(lab_a * lab_a + lab_b * lab_b) + sqrt(p_a * p_a + p_b * p_b)) / 2 as e_cb from {source}),
{name}_2 as (select *, 0.5::double * (1 - sqrt(pow(e_cb, 7) / (pow(e_cb, 7) + 6103515625.0::double))) as e_g from {name}_1),
{name}_3 as (select *, lab_a * (1 + e_g) as e_a1, p_a * (1 + e_g) as e_a2 from {name}_2),
{name}_4 as (select *, sqrt(e_a1 * e_a1 + lab_b * lab_b) as e_c1, sqrt(e_a2 * e_a2 + p_b * p_b) as e_c2, {hue("lab_b", "e_a1")} as e_h1, {hue("p_b", "e_a2")} as e_h2 from {name}_3),
{name}_5 as (select *, (lab_l + p_l) / 2 as e_lm, (e_c1 + e_c2) / 2 as e_cm,
  case when e_c1 * e_c2 = 0 then 0 when abs(e_h2 - e_h1) <= 180 then e_h2 - e_h1 when e_h2 - e_h1 > 180 then e_h2 - e_h1 - 360 else e_h2 - e_h1 + 360 end as e_dh,
  case when e_c1 * e_c2 = 0 then e_h1 + e_h2 when abs(e_h2 - e_h1) <= 180 then (e_h1 + e_h2) / 2 when e_h1 + e_h2 < 360 then (e_h1 + e_h2 + 360) / 2 else (e_h1 + e_h2 - 360) / 2 end as e_hm from {name}_4),
{name}_6 as (select *, 1 - 0.17::double * cos(radians(e_hm - 30)) + 0.24::double * cos(radians(2 * e_hm)) + 0.32::double * cos(radians(3 * e_hm + 6)) - 0.20::double * cos(radians(4 * e_hm - 63)) as e_t from {name}_5),
{name}_7 as (select *,
  (p_l - lab_l) / (1 + 0.015::double * (e_lm - 50) * (e_lm - 50) / sqrt(20 + (e_lm - 50) * (e_lm - 50))) as e_kl,
  (e_c2 - e_c1) / (1 + 0.045::double * e_cm) as e_kc,
  2 * sqrt(e_c1 * e_c2) * sin(radians(e_dh / 2)) / (1 + 0.015::double * e_cm * e_t) as e_kh,
  -2 * sqrt(pow(e_cm, 7) / (pow(e_cm, 7) + 6103515625.0::double)) * sin(radians(60 * exp(-((e_hm - 275) / 25) * ((e_hm - 275) / 25)))) as e_rt from {name}_6),
{name} as (select *, sqrt(e_kl * e_kl + e_kc * e_kc + e_kh * e_kh + e_rt * e_kc * e_kh) as delta_e from {name}_7)"""


CELLS = """owned as (
  select image_id, x // 5 as cx, y // 5 as cy, seq, a, r & 240 as r, g & 240 as g, b & 240 as b from pixels),
tally as (
  select image_id, cx, cy, r, g, b, count(*) as n, min(seq) as first_seen from owned where a >= 128 group by all),
modes as (
  select *, row_number() over (partition by image_id, cx, cy order by n desc, first_seen) as k from tally),
shares as (
  select image_id, cx, cy, count(*) as total, count(*) filter (where a >= 128) as fg from owned group by all),
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from pixels group by all),
cells as (
  select s.image_id, s.cx, s.cy, m.r, m.g, m.b from shares s
  left join modes m on m.image_id = s.image_id and m.cx = s.cx and m.cy = s.cy and m.k = 1 and s.fg / s.total >= 0.7)"""

def nearest_of(brand: str) -> str:
    """Each distinct colour of ``cells`` with the nearest colour of one brand."""
    return f"""shade as (select * from palette where brand = '{brand}'),
{lab("pal", "shade")},
colors as (select distinct r, g, b from cells where r is not null),
{lab("col", "colors")},
against as (select c.r, c.g, c.b, c.lab_l, c.lab_a, c.lab_b, p.brand, p.code, p.ord, p.lab_l as p_l, p.lab_a as p_a, p.lab_b as p_b from col c cross join pal p),
{delta_e("measured", "against")},
nearest as (select r, g, b, brand, code, ord, delta_e from measured qualify row_number() over (partition by r, g, b order by delta_e, ord) = 1)"""

NEAREST = nearest_of("Brand#13")


def reduced_to(most: int, width: int) -> str:
    """Each image's ``most`` most frequent nearest colours; ``width`` cells a row."""
    return f"""matched as (select c.image_id, c.cy * {width} + c.cx as seq, n.ord from cells c join nearest n using (r, g, b)),
freq as (select image_id, ord, count(*) as n, min(seq) as first_seen from matched group by all),
placed as (select *, row_number() over (partition by image_id order by n desc, first_seen) as rank, count(*) over (partition by image_id) > {most} as dropped from freq),
reduced as (select p.image_id, p.rank, p.n, p.dropped, q.brand, q.code, p.ord, q.lab_l as p_l, q.lab_a as p_a, q.lab_b as p_b from placed p join pal q using (ord) where rank <= {most})"""


REDUCED = reduced_to(12, 10)

BEADS = f"""own as (select distinct image_id, c.r, c.g, c.b, lab_l, lab_a, lab_b from cells c join col using (r, g, b)),
again as (select o.*, d.brand, d.code, d.ord, d.rank, d.dropped, d.p_l, d.p_a, d.p_b from own o join reduced d using (image_id)),
{delta_e("remeasured", "again")},
chosen as (select image_id, r, g, b, brand, code, ord, delta_e from remeasured qualify row_number() over (partition by image_id, r, g, b order by delta_e, case when dropped then rank else ord end) = 1),
beads as (select c.image_id, c.cx, c.cy, c.r, c.g, c.b, k.brand, k.code, k.ord, k.delta_e from cells c left join chosen k on k.image_id = c.image_id and k.r = c.r and k.g = c.g and k.b = c.b)"""

SWAPS = """swaps as (
  select a.brand || ':' || a.code as color_key, b.brand as new_brand, b.code as new_code from palette a join palette b on b.ord = a.ord + 1 where a.ord % 7 = 0),
swapped as (
  select image_id, cx, cy, coalesce(new_brand, brand) as brand, coalesce(new_code, code) as code from beads left join swaps on brand || ':' || code = color_key)"""

NEAREST_OF_ALL = f"""{lab("pal", "palette")},
colors as (select distinct r, g, b from cells where r is not null),
{lab("col", "colors")},
against as (select c.r, c.g, c.b, c.lab_l, c.lab_a, c.lab_b, p.brand, p.code, p.ord, p.lab_l as p_l, p.lab_a as p_a, p.lab_b as p_b from col c cross join pal p),
{delta_e("measured", "against")}
select r, g, b, brand, code, ord, round(delta_e, 6) as delta_e from measured qualify row_number() over (partition by r, g, b order by delta_e, ord) = 1"""

WITH_CELLS = f"with {PIXELS},\n{CELLS}"
WITH_NEAREST = f"with {PIXELS},\n{PALETTE},\n{CELLS},\n{NEAREST}"
WITH_BEADS = f"{WITH_NEAREST},\n{REDUCED},\n{BEADS}"



def hexed(by: int = 0) -> str:
    return "'#' || " + " || ".join(f"printf('%02x', greatest(0, least(255, {c} + {by})))" for c in "rgb")


CARDS = f"""cards as (select replace(brand, '#', '-') as brand, code, case when ord % 7 <> 0 then name end as name, upper({hexed()}) as rgbHex, 'part' as source, ord % 3 = 0 as isApproximate, ord, r, g, b from palette)"""


def over(paint: str, alpha: str) -> str:
    """r, g, b painted over; ``paint`` has a place for the channel's letter and number."""
    return ", ".join(f"{c} + ({paint.format(c=c, k=k)} - {c}) * ({alpha}) as {c}" for k, c in enumerate("rgb"))


def _lines(name: str, source: str, along: str, across: str) -> str:
    """Grid lines of 8 pixels a cell, 10 x 10 cells behind a margin of 18; the lower of the two
    lines next to a pixel first."""
    step = lambda k: f"case when {across} between 18 and 97 and floor(({along} - 18) / 8.0) + {k} between 0 and 10 then greatest(0.0::double, least({along} + 1, (floor(({along} - 18) / 8.0) + {k}) * 8 + 18 + 0.5::double) - greatest({along}, (floor(({along} - 18) / 8.0) + {k}) * 8 + 18 - 0.5::double)) else 0 end"
    grey = "[156, 163, 175][{k} + 1]"
    return f"{name}_1 as (select * replace ({over(grey, step(0))}) from {source}), {name} as (select * replace ({over(grey, step(1))}) from {name}_1)"


_ROUNDED = ", ".join(f"cast(floor(greatest(0, least(255, round({c}, 6))) + 0.5) as int) as {c}" for c in "rgb")
_INKED = "inked as (select b.image_id, b.cx, b.cy, b.code, p.r::double as r, p.g::double as g, p.b::double as b from beads b left join palette p on p.brand = b.brand and p.code = b.code)"
SQUARES = f"""{_INKED},
canvas as (select image_id, x.range as x, y.range as y, (x.range - 18) // 8 as cx, (y.range - 18) // 8 as cy, x.range between 18 and 97 and y.range between 18 and 97 as inside from (select distinct image_id from beads), range(100) x, range(100) y),
filled as (select k.image_id, k.x, k.y, {", ".join(f"case when not inside then 255.0::double when i.{c} is null then {e}.0::double else i.{c} end as {c}" for c, e in zip("rgb", (249, 250, 251)))} from canvas k left join inked i on inside and i.image_id = k.image_id and i.cx = k.cx and i.cy = k.cy),
{_lines("upright_", "filled", "x", "y")},
{_lines("level_", "upright_", "y", "x")},
drawn as (select image_id, cast(x as int) as x, cast(y as int) as y, {_ROUNDED} from level_)"""

#: Round beads of 12 pixels a cell, radius 5, on a canvas of 122 x 122 without axes.
_STOPS = ((0.0, 20), (0.25, 0), (0.75, 0), (0.95, -20), (1.0, -35))


def _ramp(c: str) -> str:
    stop = lambda by: f"greatest(0, least(255, {c} + ({by})))"
    parts = [f"when t <= {high}::double then {stop(one)} + ({stop(two)} - {stop(one)}) * ((t - {low}::double) / {high - low}::double)" for (low, one), (high, two) in zip(_STOPS, _STOPS[1:])]
    return f"case {' '.join(parts)} else {stop(-35)} end"


_AT = "sqrt(pow(u - ({dx}), 2) + pow(v - ({dy}), 2)) <= {r}"
ROUND = f"""{_INKED},
canvas as (select image_id, x.range as x, y.range as y, x.range // 12 as cx, y.range // 12 as cy, x.range < 120 and y.range < 120 as inside, (x.range % 12 + 0.5::double - 6) / 5 as u, (y.range % 12 + 0.5::double - 6) / 5 as v from (select distinct image_id from beads), range(122) x, range(122) y),
cone as (select *, 0.3::double * (u + v + 0.6::double) + 0.08::double as kb, pow(u + 0.3::double, 2) + pow(v + 0.3::double, 2) - 0.01::double as kc from canvas),
shaded as (select k.image_id, k.x, k.y, inside, u, v, greatest(0, least(1, (sqrt(greatest(0, kb * kb + 0.46::double * kc)) - kb) / 0.46::double)) as t, i.r, i.g, i.b from cone k left join inked i on inside and i.image_id = k.image_id and i.cx = k.cx and i.cy = k.cy),
painted as (select *, {", ".join(f"case when {_AT.format(dx=0, dy=0, r=0.9)} then {_ramp(c)} when {_AT.format(dx=0.06, dy=0.1, r=0.92)} then 255 * 0.9::double else 255 end as p{c}" for c in "rgb")} from shaded),
shiny as (select image_id, x, y, {", ".join(f"case when not inside then 255 when {c} is null then {e} when {_AT.format(dx=-0.25, dy=-0.28, r=0.12)} then p{c} + (255 - p{c}) * 0.25::double else p{c} end as {c}" for c, e in zip("rgb", (249, 250, 251)))} from painted),
drawn as (select image_id, cast(x as int) as x, cast(y as int) as y, {_ROUNDED} from shiny)"""

GRADIENT_ID = "regexp_replace('bead-' || b.brand || '-' || b.code, '[^a-zA-Z0-9_-]', '-', 'g')"


def P_HEX(by: int) -> str:
    """The colour of a palette row that a left join found, else null."""
    own = hexed(by).replace("r +", "p.r +").replace("g +", "p.g +").replace("b +", "p.b +")
    return f"case when p.r is not null then {own} end"


def plain(value: str) -> str:
    return f"regexp_replace(cast({value} as varchar), '\\.0$', '')"


_X, _Y = "(cx * 12.0::double + 6)", "(cy * 12.0::double + 6)"
#: The circles of each bead, 12 pixels a cell; lengths as the shortest text of a double.
SVG_BEADS = f"""drawn as (
  select image_id, cx, cy, '<circle cx="' || {plain(f"({_X} + 12 * 0.035::double)")} || '" cy="' || {plain(f"({_Y} + 12 * 0.055::double)")} || '" r="5.04" fill="#000000" opacity="0.14"/>'
    || '<circle data-bead="' || brand || ':' || code || '" cx="' || {plain(_X)} || '" cy="' || {plain(_Y)} || '" r="5.04" fill="url(#' || {GRADIENT_ID} || ')"/>'
    || '<circle cx="' || {plain(f"({_X} - 12 * 0.18::double)")} || '" cy="' || {plain(f"({_Y} - 12 * 0.2::double)")} || '" r="0.96" fill="#ffffff" opacity="0.32"/>' as svg
  from beads b where code is not null)"""


def windows(aggregate: str) -> str:
    """Overlapping windows of a 7 x 9 grid."""
    return f"""with {PIXELS},
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from pixels group by all),
grid as (select image_id, w, h, cast(gx.range as int) as cx, cast(gy.range as int) as cy from extent, range(7) gx, range(9) gy)
select g.image_id, g.cx, g.cy, {aggregate}
from grid g join pixels p on p.image_id = g.image_id
  and p.x >= floor(g.cx * (g.w / 7.0::double)) and p.x < least(g.w, (g.cx + 1) * (g.w / 7.0::double))
  and p.y >= floor(g.cy * (g.h / 9.0::double)) and p.y < least(g.h, (g.cy + 1) * (g.h / 9.0::double))
group by all"""


def resized(fit: str) -> str:
    return f"""with {PIXELS},
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from pixels group by all),
scaled as (select *, {fit}(40.0::double / w, 28.0::double / h) as scale from extent),
plan as (select *, cast(floor((40 - greatest(1, floor(w * scale + 0.5))) / 2.0) as int) as ox, cast(floor((28 - greatest(1, floor(h * scale + 0.5))) / 2.0) as int) as oy from scaled),
target as (select image_id, cast(tx.range as int) as x, cast(ty.range as int) as y, cast(floor((tx.range - ox) / scale) as int) as sx, cast(floor((ty.range - oy) / scale) as int) as sy from plan, range(40) tx, range(28) ty)
select t.image_id, t.x, t.y, coalesce(p.r, 255) as r, coalesce(p.g, 255) as g, coalesce(p.b, 255) as b, coalesce(p.a, 255) as a
from target t left join pixels p on p.image_id = t.image_id and p.x = t.sx and p.y = t.sy"""


_KERNEL = "case when t = 0 then 1 when abs(t) < 3 then sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) else 0 end"


def lanczos(name: str, source: str, width: int, height: int) -> str:
    """A chain of CTEs that resamples the pixels of ``source`` by rows of weights an axis."""
    taps = lambda axis, side, n: f"""{name}_u{axis} as (select image_id, {side}, g.range as target, (g.range - floor(({n} - v{axis}) / 2.0) + 0.5::double) * ({side} / v{axis}) - 0.5::double as u, greatest(1.0::double, {side} / v{axis}) as k from {name}_virtual, range({n}) g),
{name}_w{axis} as (select image_id, target, greatest(0, least({side} - 1, tap)) as src, (tap - u) / k as t from (select *, unnest(generate_series(floor(u - 3 * k)::bigint, ceil(u + 3 * k)::bigint)) as tap from {name}_u{axis})),
{name}_{axis} as (select image_id, target, src, sum({_KERNEL}) as w from {name}_w{axis} group by all)"""  # noqa: E731
    sums = lambda values, w: ", ".join(f"sum({v} * {w}) / sum({w}) as {c}" for v, c in zip(values, "rgba", strict=True))
    channel = lambda v: f"cast(floor(greatest(0, least(255, round({v}, 6))) + 0.5) as int)"
    return f"""{name}_extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from {source} group by all),
{name}_virtual as (select *, greatest(1, floor(w * s + 0.5))::double as vx, greatest(1, floor(h * s + 0.5))::double as vy from (select *, greatest({width}.0::double / w, {height}.0::double / h) as s from {name}_extent)),
{taps("x", "w", width)},
{taps("y", "h", height)},
{name}_down as (select p.image_id, p.x, target as y, {sums(("p.r * p.a", "p.g * p.a", "p.b * p.a", "p.a"), "w")} from {source} p join {name}_y k on k.image_id = p.image_id and k.src = p.y group by p.image_id, p.x, target),
{name}_both as (select p.image_id, target as x, p.y, {sums(("p.r", "p.g", "p.b", "p.a"), "w")} from {name}_down p join {name}_x k on k.image_id = p.image_id and k.src = p.x group by p.image_id, target, p.y),
{name} as (select image_id, cast(x as int) as x, cast(y as int) as y, {", ".join(f"case when round(a, 6) > 0 then {channel(f'{c} / a')} else 0 end as {c}" for c in "rgb")}, {channel("a")} as a from {name}_both)"""


def rgb(name: str, source: str) -> str:
    """A chain of CTEs that replaces r, g, b by those of lab_l, lab_a, lab_b, clamped."""
    linear = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    cube = lambda f: f"case when {f} > 0.2068966::double then {f} * {f} * {f} else (116 * {f} - 16) / 903.3::double end"
    return f"""{name}_f as (select *, (lab_l + 16) / 116 as fy, lab_a / 500 + (lab_l + 16) / 116 as fx, (lab_l + 16) / 116 - lab_b / 200 as fz from {source}),
{name}_xyz as (select *, ({cube("fx")}) * 0.95047::double as cx_, (case when lab_l > 8 then fy * fy * fy else lab_l / 903.3::double end) as cy_, ({cube("fz")}) * 1.08883::double as cz_ from {name}_f),
{name}_lin as (select *, {", ".join(f"cx_ * {m[0]}::double + cy_ * {m[1]}::double + cz_ * {m[2]}::double as l{c}" for c, m in zip("rgb", linear, strict=True))} from {name}_xyz),
{name} as (select * replace ({", ".join(f"cast(greatest(0, least(255, floor((case when l{c} > 0.0031308::double then 1.055::double * pow(l{c}, 1 / 2.4::double) - 0.055::double else 12.92::double * l{c} end) * 255 + 0.5::double))) as int) as {c}" for c in "rgb")}) from {name}_lin)"""


def modulated(name: str, source: str, hue: float = 0.0) -> str:
    turned = lambda f: f"sqrt(lab_a * lab_a + lab_b * lab_b) * 1.22::double * {f}(atan2(lab_b, lab_a) + radians({hue}::double))"
    return f"""{lab(name + "_lab", source)},
{name}_moved as (select * replace (lab_l * 1.08::double as lab_l, {turned("cos")} as lab_a, {turned("sin")} as lab_b) from {name}_lab),
{rgb(name, name + "_moved")}"""


STEP_OF_8 = "(255.0::double / 7)"


def posterized(c: str) -> str:
    return f"case when a < 128 then {c} else cast(floor(floor({c} / {STEP_OF_8} + 0.5::double) * {STEP_OF_8} + 0.5::double) as int) end"


#: The subject preset on 16 x 12 cells: the opaque part over 62 of 64 pixels a side, posterised,
#: edges darkened, and the most frequent masked colours of cells.
SUBJECT_CELLS = f"""box as (select image_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pixels where a >= 128 group by all),
trimmed as (
  select p.image_id, p.x - coalesce(x0, 0) as x, p.y - coalesce(y0, 0) as y, r, g, b, a from pixels p left join box k on k.image_id = p.image_id
  where x0 is null or (p.x between x0 and x1 and p.y between y0 and y1)),
trimmed_size as (select image_id, max(x) + 1 as w, max(y) + 1 as h from trimmed group by all),
trimmed_scale as (select *, greatest(62.0::double / w, 62.0::double / h) as scale from trimmed_size),
trimmed_plan as (select *, 1 + floor((62 - greatest(1, floor(w * scale + 0.5))) / 2.0) as ox, 1 + floor((62 - greatest(1, floor(h * scale + 0.5))) / 2.0) as oy from trimmed_scale),
canvas as (
  select t.image_id, tx.range as x, ty.range as y, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b, coalesce(p.a, 0) as a
  from trimmed_plan t cross join range(64) tx cross join range(64) ty left join trimmed p on p.image_id = t.image_id and tx.range between 1 and 62 and ty.range between 1 and 62 and p.x = floor((tx.range - ox) / scale) and p.y = floor((ty.range - oy) / scale)),
poster as (select * replace ({", ".join(f"{posterized(c)} as {c}" for c in "rgb")}) from canvas),
grey as (select image_id, x, y, case when a < 128 then 255.0::double else r * 0.299::double + g * 0.587::double + b * 0.114::double end as v from poster),
kernel as (select dx.range - 1 as dx, dy.range - 1 as dy, (dx.range - 1) * (2 - abs(dy.range - 1)) as wx, (dy.range - 1) * (2 - abs(dx.range - 1)) as wy from range(3) dx, range(3) dy),
edges as (
  select c.image_id, c.x, c.y, sqrt(pow(sum(n.v * wx), 2) + pow(sum(n.v * wy), 2)) > 80 as edge
  from grey c cross join kernel k join grey n on n.image_id = c.image_id and n.x = c.x + dx and n.y = c.y + dy where c.x between 1 and 62 and c.y between 1 and 62 group by c.image_id, c.x, c.y),
lined as (select p.image_id, p.x, p.y, {", ".join(f"case when edge and a >= 128 then cast(floor({c} * 0.7::double + 0.5::double) as int) else {c} end as {c}" for c in "rgb")}, a from poster p left join edges e on e.image_id = p.image_id and e.x = p.x and e.y = p.y),
rows_of as (select y.range as y, max(g.range) as cy from range(64) y, range(12) g where floor(g.range * (64 / 12.0::double)) <= y.range group by y.range),
owned as (select image_id, x // 4 as cx, cy, y * 64 + x as seq, a, r & 240 as r, g & 240 as g, b & 240 as b from lined join rows_of using (y)),
tally as (select image_id, cx, cy, r, g, b, count(*) as n, min(seq) as first_seen from owned where a >= 128 group by all),
modes as (select *, row_number() over (partition by image_id, cx, cy order by n desc, first_seen) as k from tally),
shares as (select image_id, cx, cy, count(*) as total, count(*) filter (where a >= 128) as fg from owned group by all),
cells as (
  select s.image_id, s.cx, s.cy, m.r, m.g, m.b from shares s
  left join modes m on m.image_id = s.image_id and m.cx = s.cx and m.cy = s.cy and m.k = 1 and s.fg / s.total >= 0.2)"""


def subject_counts(brand: str, most: int) -> str:
    return f"""with {PIXELS}, {PALETTE}, {SUBJECT_CELLS}, {nearest_of(brand)}, {reduced_to(most, 16)}, {BEADS}
select image_id, brand, code, count(*) as n from beads where code is not null group by all"""


TURNED = """turning as (select p.*, image_id % 9 as o, max(x) over (partition by image_id) - x as right_, max(y) over (partition by image_id) - y as low from pixels p),
upright as (
  select image_id, case when o in (2, 3) then right_ when o in (5, 8) then y when o in (6, 7) then low else x end as x,
         case when o in (3, 4) then low when o in (5, 6) then x when o in (7, 8) then right_ else y end as y, r, g, b, a from turning)"""


def toned(name: str, source: str) -> str:
    """The tone of the photo preset and posterised cells, each pixel one."""
    return f"""{name}_1 as (select image_id, x, y, {", ".join(f"floor(greatest(0, least(255, {c} * {k}::double + {o}::double)) + 0.5) as {c}" for c, k, o in zip("rgb", (1.06, 1.02, 0.94), (10, 6, 0), strict=True))} from {source}),
{name} as (select image_id, x as cx, y as cy, {", ".join(f"cast(greatest(0, least(255, floor(floor({c} / (255.0::double / 9) + 0.5) * (255.0::double / 9) + 0.5))) as int) as {c}" for c in "rgb")} from {name}_1)"""


TRIMMED = f"""{PIXELS},
{BOXED},
box as (select image_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from boxed where a >= 128 group by all),
trimmed as (
  select p.image_id, p.x - coalesce(x0, 0) as x, p.y - coalesce(y0, 0) as y, r, g, b, a from boxed p left join box k on k.image_id = p.image_id
  where x0 is null or (p.x between x0 and x1 and p.y between y0 and y1))"""

GRADIENTS = f"""{PIXELS},
grey as (select image_id, x, y, case when a < 128 then 255.0::double else r * 0.299::double + g * 0.587::double + b * 0.114::double end as v from pixels),
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from pixels group by all),
kernel as (select dx.range - 1 as dx, dy.range - 1 as dy, (dx.range - 1) * (2 - abs(dy.range - 1)) as wx, (dy.range - 1) * (2 - abs(dx.range - 1)) as wy from range(3) dx, range(3) dy),
gradients as (
  select c.image_id, c.x, c.y, sqrt(pow(sum(n.v * wx), 2) + pow(sum(n.v * wy), 2)) as magnitude
  from grey c join extent e on e.image_id = c.image_id and c.x between 1 and w - 2 and c.y between 1 and h - 2
  cross join kernel k join grey n on n.image_id = c.image_id and n.x = c.x + dx and n.y = c.y + dy
  group by c.image_id, c.x, c.y)"""


def oracle_sql() -> dict[str, str]:
    post = ", ".join(f"{posterized(c)} as {c}" for c in "rgb")
    ratios = {"21:9": 0, "16:9": 1, "3:2": 2, "4:3": 3, "1:1": 4, "3:4": 5, "2:3": 6, "9:16": 7}
    ratio_rows = ", ".join(f"('{k}', {k.split(':')[0]}::double / {k.split(':')[1]}, {v})" for k, v in ratios.items())
    widths = {  # fixed values: width and height by resolution, in the order of ratios
        "1k": [(2016, 846), (1664, 936), (1584, 1056), (1472, 1104), (1328, 1328), (1104, 1472), (1056, 1584), (936, 1664)],
        "2k": [(3024, 1296), (2560, 1440), (2496, 1664), (2304, 1728), (2048, 2048), (1728, 2304), (1664, 2496), (1440, 2560)],
        "4k": [(6197, 2656), (5404, 3040), (4992, 3328), (4693, 3520), (4096, 4096), (3520, 4693), (3328, 4992), (3040, 5404)],
    }
    dimension_rows = ", ".join(f"('{scale}', '{ratio}', '{w}x{h}')" for scale, own in widths.items() for ratio, (w, h) in zip(ratios, own, strict=True))
    return {
        "hex_rgb_roundtrip": f"with {PALETTE} select ord, {hexed()} as hex, r, g, b from palette",
        "rgb_to_lab": f"with {PALETTE}, {lab('pal', 'palette')} select ord, round(lab_l, 6) as lab_l, round(lab_a, 6) as lab_a, round(lab_b, 6) as lab_b from pal",
        "lab_to_rgb": f"with {PALETTE} select ord, r, g, b from palette",
        "delta_e_pairs": f"""with {PALETTE}, {lab("pal", "palette")},
pairs as (select a.ord as one, b.ord as two, a.lab_l, a.lab_a, a.lab_b, b.lab_l as p_l, b.lab_a as p_a, b.lab_b as p_b from pal a join pal b on b.ord - a.ord between 1 and 3),
{delta_e("m", "pairs")} select one, two, round(delta_e, 6) as delta_e from m""",
        "posterize": f"with {PIXELS} select image_id, seq, {post}, a from pixels",
        "mask_quantize": f"with {PIXELS} select image_id, seq, r & 248 as r, g & 248 as g, b & 248 as b from pixels",
        "luma_contrast": f"with {PIXELS}, lumas as (select *, r * 0.299::double + g * 0.587::double + b * 0.114::double as v from pixels) select image_id, seq, round(case when a < 128 then 255.0::double else v end, 6) as grey, case when v > 128 then '#000000' else '#ffffff' end as text_hex from lumas",
        "adjust_color": f"with {PALETTE} select ord, {hexed(20)} as light_hex, {hexed(-35)} as dark_hex, brand || ':' || code as color_key, upper(brand) || ' ' || code || ' ' || name as label from palette",
        "palette_by_brand": f"with {PALETTE} select brand, code, name, ord from palette where brand = 'Brand#13' order by code",
        "palette_fallback_brand": f"with {PALETTE} select brand, code, ord from palette where brand = (select brand from palette order by ord limit 1)",
        "palette_upsert": f"""with {PALETTE},
fresh as (select brand, code, 'new ' || name as name, ord + 100000000 as ord from palette where ord % 5 = 0 union all select brand, code || 'x', name, ord + 200000000 from palette where ord % 50 = 1)
select * from fresh union all select brand, code, name, ord from palette where (brand, code) not in (select (brand, code) from fresh)""",
        "foreground_bounds": f"with {PIXELS} select image_id, min(x) as min_x, min(y) as min_y, max(x) as max_x, max(y) as max_y from pixels where x between 7 and 31 and y > 4 and a >= 128 group by image_id",
        "trim_foreground": f"with {TRIMMED} select image_id, x, y, r, g, b, a from trimmed",
        "resize_cover_nearest": resized("greatest"),
        "resize_contain_nearest": resized("least"),
        "resize_cover_lanczos": f"with {PIXELS}, {lanczos('small', 'pixels', 40, 28)} select * from small",
        "oriented": f"with {PIXELS}, {TURNED} select * from upright",
        "modulate": f"with {PIXELS}, {modulated('vivid', 'pixels', 30.0)} select image_id, seq, r, g, b, a from vivid",
        "photo_to_pattern": subject_counts("Brand#13", 10),
        "requantize": subject_counts("Brand#24", 4),
        "photo_cells": f"with {PIXELS}, {TURNED}, {lanczos('small', 'upright', 24, 18)}, {modulated('vivid', 'small')}, {toned('cells', 'vivid')} select * from cells",
        "subject_fill": f"""with {TRIMMED},
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from trimmed group by all),
scaled as (select *, greatest(34.0::double / w, 34.0::double / h) as scale from extent),
plan as (select *, cast(1 + floor((34 - greatest(1, floor(w * scale + 0.5))) / 2.0) as int) as ox, cast(1 + floor((34 - greatest(1, floor(h * scale + 0.5))) / 2.0) as int) as oy from scaled),
target as (select image_id, cast(tx.range as int) as x, cast(ty.range as int) as y, scale, ox, oy from plan, range(36) tx, range(36) ty)
select t.image_id, t.x, t.y, coalesce(p.r, 0) as r, coalesce(p.g, 0) as g, coalesce(p.b, 0) as b, coalesce(p.a, 0) as a
from target t left join trimmed p on p.image_id = t.image_id and t.x between 1 and 34 and t.y between 1 and 34 and p.x = floor((t.x - ox) / scale) and p.y = floor((t.y - oy) / scale)""",
        "sobel_edges": f"with {GRADIENTS} select image_id, x, y, round(magnitude, 6) as magnitude from gradients",
        "enhance_edges": f"""with {GRADIENTS},
marked as (select p.*, coalesce(magnitude > 80 and a >= 128, false) as edge from pixels p left join gradients e on e.image_id = p.image_id and e.x = p.x and e.y = p.y)
select image_id, x, y, {", ".join(f"case when edge then cast(floor({c} * 0.7::double + 0.5::double) as int) else {c} end as {c}" for c in "rgb")}, a from marked""",
        "mode_downsample": f"""{WITH_CELLS}
select e.image_id, cast(gx.range as int) as cx, cast(gy.range as int) as cy, c.r, c.g, c.b from extent e, range(10) gx, range(10) gy left join cells c on c.image_id = e.image_id and c.cx = gx.range and c.cy = gy.range""",
        "foreground_ratio": f"""with {PIXELS},
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from pixels group by all),
grid as (select image_id, w, h, cast(gx.range as int) as cx, cast(gy.range as int) as cy from extent, range(7) gx, range(9) gy)
select g.image_id, g.cx, g.cy, count(*) filter (where a >= 128) as fg, count(*) as total
from grid g join pixels p on p.image_id = g.image_id and p.x >= floor(g.cx * (g.w / 7.0::double)) and p.x < floor((g.cx + 1) * (g.w / 7.0::double)) and p.y >= floor(g.cy * (g.h / 9.0::double)) and p.y < floor((g.cy + 1) * (g.h / 9.0::double))
group by all""",
        "area_downsample": windows(", ".join(f"cast(floor(avg(p.{c}) + 0.5) as int) as {c}" for c in "rgb")),
        "alpha_downsample": windows("cast(floor(avg(p.a) + 0.5) as int) as a"),
        "nearest_color": f"{WITH_NEAREST} select r, g, b, brand, code, ord, round(delta_e, 6) as delta_e from nearest",
        "nearest_color_pruned": f"with {PIXELS}, {PALETTE}, {CELLS}, {NEAREST_OF_ALL}",
        "reduced_palette_topk": f"{WITH_NEAREST}, {REDUCED} select image_id, cast(rank as int) as rank, n, brand, code from reduced",
        "quantize_grid": f"{WITH_BEADS} select image_id, cx, cy, brand, code from beads",
        "bead_counts": f"{WITH_BEADS} select image_id, brand, code, count(*) as n from beads where code is not null group by all",
        "bead_summary": f"{WITH_BEADS} select image_id, count(code) as total, count(distinct brand || ':' || code) as actual_colors, round(coalesce(avg(delta_e), 0), 6) as avg_delta_e from beads group by image_id",
        "confetti_cleanup": f"""{WITH_BEADS},
usage as (select image_id, ord, count(*) as n, min(cy * 10 + cx) as first_seen from beads where ord is not null group by all),
share as (select u.*, n / sum(n) over (partition by image_id) >= 0.08 as kept, p.lab_l, p.lab_a, p.lab_b from usage u join pal p using (ord)),
homeless as (select o.image_id, o.ord as orphan, o.lab_l, o.lab_a, o.lab_b, k.ord, k.first_seen, k.lab_l as p_l, k.lab_a as p_a, k.lab_b as p_b from share o join share k on k.image_id = o.image_id and k.kept where not o.kept),
{delta_e("moving", "homeless")},
moved as (select image_id, orphan, ord from moving qualify row_number() over (partition by image_id, orphan order by delta_e, first_seen) = 1),
final as (select b.image_id, b.cx, b.cy, coalesce(m.ord, b.ord) as ord from beads b left join moved m on m.image_id = b.image_id and m.orphan = b.ord)
select f.image_id, f.cx, f.cy, p.brand, p.code from final f left join palette p on p.ord = f.ord""",
        "color_replacements": f"{WITH_BEADS}, {SWAPS} select image_id, cx, cy, brand, code from swapped",
        "replacement_stats": f"{WITH_BEADS}, {SWAPS}, before as (select image_id, coalesce(avg(delta_e), 0) as d from beads group by all) select s.image_id, count(code) as total, count(distinct brand || ':' || code) as actual_colors, round(any_value(d), 6) as avg_delta_e from swapped s join before using (image_id) group by s.image_id",
        "board_regions": f"""{WITH_BEADS}, grids as (select image_id, max(cx) + 1 as w, max(cy) + 1 as h from beads group by all)
select image_id, cast(r.range * ((w + 3) // 4) + c.range as int) as board_index, cast(r.range as int) as board_row, cast(c.range as int) as board_col, cast(c.range * 4 as int) as x, cast(r.range * 4 as int) as y, cast(least(4, w - c.range * 4) as int) as width, cast(least(4, h - r.range * 4) as int) as height
from grids, range(3) r, range(3) c where r.range * 4 < h and c.range * 4 < w""",
        "board_size_options": f"""with {PALETTE}, grids as (select ord, r + 1 as w, b + 1 as h, size from palette, (values (29), (57), (80)) s(size))
select ord, size, cast(r.range * ((w + size - 1) // size) + c.range as int) as board_index, cast(r.range as int) as board_row, cast(c.range as int) as board_col, cast(c.range * size as int) as x, cast(r.range * size as int) as y, cast(least(size, w - c.range * size) as int) as width, cast(least(size, h - r.range * size) as int) as height
from grids, range(9) r, range(9) c where r.range * size < h and c.range * size < w""",
        "cell_sizes": f"with {PALETTE} select ord, cast(greatest(12, least(30, floor((greatest(240, ord * 37 % 1500 + 100 - 32) - 28) / (r + 1)))) as int) as cell, case when r + g > 0 then cast(floor(g * 100 / (r + g) + 0.5) as int) else 0 end as percent from palette",
        "board_color_stats": f"""{WITH_BEADS},
stats as (select image_id, brand || ':' || code as color_key, brand, code, count(*) as total, count(*) filter (where (cy // 4) * 3 + cx // 4 = 4) as board_count from beads where code is not null group by all)
select *, cast(row_number() over (partition by image_id order by total desc, color_key) as int) as by_total, cast(row_number() over (partition by image_id order by board_count desc, total desc, color_key) as int) as by_board from stats""",
        "board_totals": f"{WITH_BEADS} select image_id, cast((cy // 4) * 3 + cx // 4 as int) as board_index, count(code) as beads from beads group by all",
        "row_bead_counts": f"{WITH_BEADS} select image_id, brand, code, count(*) as n, cast(min(cx) as int) as first_x from beads where cy = 3 and code is not null group by all",
        "remaining_beads": f"{WITH_BEADS} select image_id, cx, cy, code from beads where code is not null and (cx + cy) % 3 <> 0",
        "count_report": f"{WITH_BEADS} select image_id, b.brand, b.code, coalesce(p.name, '') as name, count(*) as n, cast(row_number() over (partition by image_id order by count(*) desc, min(cy * 10 + cx)) as int) as place from beads b left join palette p on p.brand = b.brand and p.code = b.code where b.code is not null group by image_id, b.brand, b.code, p.name",
        "isolated_points_at_once": f"""{WITH_BEADS},
around(k, dx, dy) as (values (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)),
near as (select c.image_id, c.cx, c.cy, c.brand as own_brand, c.code as own_code, n.brand, n.code, k from beads c cross join around join beads n on n.image_id = c.image_id and n.cx = c.cx + dx and n.cy = c.cy + dy where c.code is not null and n.code is not null),
votes as (select image_id, cx, cy, own_brand, own_code, brand, code, count(*) as n, min(k) as k from near group by all),
lone as (select image_id, cx, cy from votes group by all having not bool_or(brand = own_brand and code = own_code)),
winner as (select v.image_id, v.cx, v.cy, v.brand, v.code from votes v join lone using (image_id, cx, cy) qualify row_number() over (partition by v.image_id, v.cx, v.cy order by v.n desc, v.k) = 1)
select b.image_id, b.cx, b.cy, coalesce(w.brand, b.brand) as brand, coalesce(w.code, b.code) as code from beads b left join winner w on w.image_id = b.image_id and w.cx = b.cx and w.cy = b.cy""",
        "svg_documents": f"""{WITH_BEADS},
{SVG_BEADS},
body as (select image_id, string_agg(svg, '' order by cy, cx) as body from drawn group by image_id),
gradients as (select image_id, {GRADIENT_ID} as id, min(b.cy * 10 + b.cx) as first, arg_min('<radialGradient id="' || {GRADIENT_ID} || '" cx="32%" cy="28%" r="68%"><stop offset="0%" stop-color="' || {P_HEX(34)} || '"/><stop offset="36%" stop-color="' || {P_HEX(0)} || '"/><stop offset="76%" stop-color="' || {P_HEX(0)} || '"/><stop offset="100%" stop-color="' || {P_HEX(-36)} || '"/></radialGradient>', b.cy * 10 + b.cx) as def
  from beads b join palette p on p.brand = b.brand and p.code = b.code group by image_id, {GRADIENT_ID}),
defs as (select image_id, string_agg(def, '' order by first) as defs from gradients group by image_id),
rules as (select string_agg('<path d="M' || cast(r.range * 12 as varchar) || '.5 0V120" stroke="#bfa883" stroke-width="1" opacity="0.42"/>', '' order by r.range) || string_agg('<path d="M0 ' || cast(r.range * 12 as varchar) || '.5H120" stroke="#bfa883" stroke-width="1" opacity="0.42"/>', '' order by r.range) as rules from range(11) r)
select i.image_id, '<svg xmlns="http://www.w3.org/2000/svg" width="120" height="120" viewBox="0 0 120 120"><defs>' || coalesce(defs, '') || '</defs><rect width="100%" height="100%" fill="#f4dfb7"/><g shape-rendering="crispEdges">' || rules || '</g><g>' || coalesce(body, '') || '</g><desc>Generated from photo with 10x10 cells</desc></svg>' as svg
from (select distinct image_id from beads) i cross join rules left join body using (image_id) left join defs using (image_id)""",
        "pattern_frame": f"""{WITH_BEADS}, grids as (select image_id, max(cx) + 1 as w, max(cy) + 1 as h from beads group by all),
steps as (select image_id, w, h, r.range as k, r.range * 24.0::double as spot from grids, range(11) r)
select image_id, 'line' as kind, cast(null as varchar) as text, spot + 24 as x1, 24.0::double as y1, spot + 24 as x2, h * 24.0::double + 24 as y2, 1.0::double as size, '#9ca3af' as color_hex from steps where k <= w
union all select image_id, 'line', null, 24.0, spot + 24, w * 24.0 + 24, spot + 24, 1.0, '#9ca3af' from steps where k <= h
union all select image_id, 'x_label', cast(k + 1 as varchar), spot + 36, 12.0, spot + 36, 12.0, 24::double / 1.4::double, '#374151' from steps where k < w
union all select image_id, 'y_label', cast(k + 1 as varchar), 12.0, spot + 36, 12.0, spot + 36, 24::double / 1.4::double, '#374151' from steps where k < h""",
        "pattern_raster": f"{WITH_BEADS}, {SQUARES} select image_id, x, y, r, g, b, 255 as a from drawn",
        "bead_raster": f"{WITH_BEADS}, {ROUND} select image_id, x, y, r, g, b, 255 as a from drawn",
        "report_pages": f"""with {PALETTE},
own as (select cast(substr(brand, 7, 2) as int) as image_id, brand, code, name, r + g as n, ord from palette),
report as (select *, row_number() over (partition by image_id order by n desc, ord) as place from own),
sized as (select image_id, max(n) + 100 as w, min(n) + 200 as h from own group by all),
fixed as (select 20.35::double / (72 / 25.4::double) as line, 40 / (72 / 25.4::double) as margin),
paged as (select *, case when w > h then 297.0::double else 210.0::double end as pw, case when w > h then 210.0::double else 297.0::double end as ph from sized),
laid as (select image_id, line, margin, 41.0::double + h * least((pw - 30) / w, ph * 0.55::double / h) as begin, ph - margin as bottom from paged, fixed),
room as (select *, greatest(0, cast(floor((bottom - begin) / line) as int) - 1) as first, cast(floor((bottom - margin) / line) as int) - 1 as later from laid),
pages as (select *, k.range + 1 as page, case when k.range = 0 then 0 else first + (k.range - 1) * later end as before, case when k.range = 0 then first else later end as held, case when k.range = 0 then begin else margin end as top from room, range(300) k),
placed as (select p.image_id, p.page, p.top, p.line, r.place - p.before as nth, r.place, r.brand, r.code, r.name, r.n from report r join pages p on p.image_id = r.image_id and r.place > p.before and r.place <= p.before + p.held)
select image_id, cast(page as int) as page, round(top + nth * line, 6) as y, 'row' as kind, cast(place as int) as place, brand, code, name, n from placed
union all select image_id, cast(page as int), round(top, 6), 'head', null, null, null, null, null from placed where nth = 1""",
        "page_layouts": f"""with {PALETTE},
sized as (select ord, r + 1 as width, g + 1 as height, case when r > g then 297.0::double else 210.0::double end as page_width, case when r > g then 210.0::double else 297.0::double end as page_height from palette),
scaled as (select *, least((page_width - 30) / width, page_height * 0.55::double / height) as s from sized)
select ord, width, height, page_width, page_height, round(width * s, 6) as image_width, round(height * s, 6) as image_height from scaled""",
        "lab_grid_to_rgb": f"""with {PALETTE}, {lab("pal", "palette")},
strong as (select * replace (lab_a * strength as lab_a, lab_b * strength as lab_b) from pal, (values (1.0::double), (1.5::double)) s(strength)),
{rgb("back", "strong")}
select ord, strength, """ + ", ".join(f"cast(floor((case when l{c} > 0.0031308::double then 1.055::double * pow(l{c}, 1 / 2.4::double) - 0.055::double else 12.92::double * l{c} end) * 255 + 0.5::double) as int) as {c}" for c in "rgb") + " from back_lin",
        "json_cards": f"with {PALETTE}, {CARDS} select cast(row_number() over (order by brand, ord) as int) as id, brand, code, name, source, isApproximate, cast(row_number() over (partition by brand order by ord) - 1 as int) as ord, r, g, b from cards",
        "csv_cards": f"with {PALETTE} select 'acme' as brand, code, name, upper({hexed()}) as rgbHex, 'csv' as source, false as isApproximate from palette",
        "json_array_cards": f"with {PALETTE}, {CARDS} select ord as id, brand, code, name, rgbHex, source, isApproximate from cards",
        "palette_table": f"""with {PALETTE}, {CARDS}
select brand, code, case when brand < 'Brand-3' and ord % 5 = 0 then 'new ' || code else name end as name, rgbHex, ord, case when max(brand < 'Brand-3' and ord % 5 = 0) over (partition by brand) then 2 else 1 end::bigint as version from cards""",
        "collated_ranks": f"""with {PALETTE},
keyed as (select cast(substr(brand, 7, 2) as int) as image_id, case ord % 3 when 0 then upper(name) when 1 then array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(name, ' ')], ' ') else name end || ':' || r || ' ' || ord as color_key, b % 4 as total, g % 3 as board_count from palette)
select *, cast(row_number() over (partition by image_id order by total desc, color_key collate en) as int) as by_total, cast(row_number() over (partition by image_id order by board_count desc, total desc, color_key collate en) as int) as by_board from keyed""",
        "draw_list": f"""{WITH_BEADS}
select image_id, cx, cy, cx * 24 + 24 as px, cy * 24 + 24 as py, coalesce({P_HEX(0)}, '#f9fafb') as fill_hex, b.code as label,
  case when b.code is not null then case when p.r * 0.299::double + p.g * 0.587::double + p.b * 0.114::double > 128 then '#000000' else '#ffffff' end end as text_hex,
  {P_HEX(20)} as light_hex, {P_HEX(-35)} as dark_hex
from beads b left join palette p on p.brand = b.brand and p.code = b.code""",
        "board_draw_list": f"""{WITH_BEADS}
select image_id, cx, cy, cx * 12 - 48 as px, cy * 12 - 48 as py, coalesce({P_HEX(0)}, '#f9fafb') as fill_hex, b.code as label,
  case when b.code is not null then case when p.r * 0.299::double + p.g * 0.587::double + p.b * 0.114::double > 128 then '#000000' else '#ffffff' end end as text_hex, cx + 1 as x_label, cy + 1 as y_label, true as highlighted
from beads b left join palette p on p.brand = b.brand and p.code = b.code where cx // 4 = 1 and cy // 4 = 1""",
        "svg_cells": f"""{WITH_BEADS}, {SVG_BEADS} select image_id, cx, cy, svg from drawn""",
        "bilateral_filter": f"""with {PIXELS},
extent as (select image_id, max(x) + 1 as w, max(y) + 1 as h from pixels group by all),
near as (select dx.range - 2 as dx, dy.range - 2 as dy from range(5) dx, range(5) dy),
asked as (select p.*, greatest(0, least(w - 1, x + dx)) as nx, greatest(0, least(h - 1, y + dy)) as ny, exp(-(dx * dx + dy * dy) / 2.0::double) as s from pixels p join extent using (image_id) cross join near),
met as (select c.image_id, c.x, c.y, c.a, n.r, n.g, n.b, s * exp(-((c.r - n.r) * (c.r - n.r) + (c.g - n.g) * (c.g - n.g) + (c.b - n.b) * (c.b - n.b)) / 1800.0::double) as w from asked c join pixels n on n.image_id = c.image_id and n.x = c.nx and n.y = c.ny)
select image_id, x, y, {", ".join(f"cast(floor(sum({c} * w) / sum(w) + 0.5) as int) as {c}" for c in "rgb")}, any_value(a) as a from met group by image_id, x, y""",
        "size_ratio_infer": f"""with {PALETTE},
sized as (select ord, cast(r * 17 + 5 as varchar) || case when g % 2 = 0 then 'x' else 'X' end || cast(b * 19 + 3 as varchar) as size from palette),
parsed as (select *, cast(nullif(regexp_extract(size, '(?i)^(\\d{{2,5}})x(\\d{{2,5}})$', 1), '') as int) as width, cast(nullif(regexp_extract(size, '(?i)^(\\d{{2,5}})x(\\d{{2,5}})$', 2), '') as int) as height from sized),
offered(ratio, v, k) as (values {ratio_rows})
select ord, size, width, height, case when width is null then '2k' when greatest(width, height) >= 3500 then '4k' when greatest(width, height) >= 1800 then '2k' else '1k' end as resolution,
  case when width is null then '1:1' else (select ratio from offered order by abs(width::double / height - v), k limit 1) end as ratio from parsed""",
        "text_digests": f"""with {PALETTE} select ord, sha256(name) as sha256, md5(name) as md5, '&lt;a b=&quot;&amp;&quot;&gt;' || name as xml, regexp_replace('bead-' || brand || '-' || code, '[^a-zA-Z0-9_-]', '-', 'g') as gradient, name as trimmed, code as bare from palette""",
        "signed_messages": f"""with {PALETTE},
asked as (select ord, {", ".join(f"case when octet_length({k}::blob) > 64 then sha256({k}) else lower(hex({k}::blob)) end as {n}, {m} as m{n}" for n, k, m in (("k1", "brand", "name"), ("k2", "repeat(name, 4)", "brand")))}, name, code from palette),
mixed as (select *, {", ".join(f"array_to_string([lpad(hex(xor(case when b * 2 < length({k}) then ('0x' || substr({k}, b * 2 + 1, 2))::int else 0 end, {c})), 2, '0') for b in range(64)], '') as {k}_{c}" for k in ("k1", "k2") for c in (0x36, 0x5C))} from asked)
select ord, {", ".join(f"sha256(unhex({k}_92 || sha256(unhex({k}_54 || hex(m{k}::blob))))) as {n}" for k, n in (("k1", "mac"), ("k2", "mac_long")))},
  'data:text/plain;base64,' || base64(name::blob) as url, name as back, 'name=' || replace(name, ' ', '+') || '&code=' || code as query,
  case when ord % 3 = 0 then null else ord + 0.5::double end as number from mixed""",
        "tone_low_res": f"""with {PIXELS}, toned as (select image_id, x, y, {", ".join(f"floor(greatest(0, least(255, {c} * {k}::double + {o}::double)) + 0.5) as {c}" for c, k, o in zip("rgb", (1.06, 1.02, 0.94), (10, 6, 0), strict=True))} from pixels)
select image_id, x as cx, y as cy, {", ".join(f"cast(greatest(0, least(255, floor(floor({c} / (255.0::double / 9) + 0.5) * (255.0::double / 9) + 0.5))) as int) as {c}" for c in "rgb")} from toned""",
        "output_dimensions": f"""with {PALETTE},
sizes(scale, ratio, size) as (values {dimension_rows}),
asked as (select ord, case when ord % 11 = 0 then '1:1' else ['21:9', '16:9', '3:2', '4:3', '1:1', '3:4', '2:3', '9:16'][ord % 8 + 1] end as ratio, ['1k', '2k', '4k'][ord % 3 + 1] as scale from palette)
select ord, size, ['png', 'jpeg', 'webp', 'jpeg'][ord % 4 + 1] as format, ord % 2 = 0 as usable from asked join sizes using (scale, ratio)""",
        "event_json_path": "select event_id, props::json ->> '$.k' as k, props::json ->> '$.missing[0].x' as missing from events",
    }
