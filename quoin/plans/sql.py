"""SQL views that the queries' SQL shares: the same relations as in sources.relations."""

ELEMENTS = """elements as (select l_orderkey as page_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as int) as element_id,
  cast((l_partkey * 7 + l_linenumber * 131) % 1000 as int) as l, cast((l_suppkey * 13 + l_linenumber * 97) % 780 as int) as t,
  cast((l_partkey * 7 + l_linenumber * 131) % 1000 + 20 + cast(l_quantity as int) * 3 as int) as r,
  cast((l_suppkey * 13 + l_linenumber * 97) % 780 + 12 + (l_partkey % 9) * 12 as int) as b,
  case l_returnflag when 'R' then 'Text' when 'N' then 'Compo' else 'Block' end as uied_class from lineitem)"""
ROLES = (
    ELEMENTS
    + """, roles as (select *, case when uied_class = 'Text' then 'foreground'
  when uied_class = 'Block' then case when (r - l) * (b - t) / 1080000.0 >= 0.5 or ((r - l) / 1200.0 >= 0.9 and (b - t) / 900.0 >= 0.4) then 'background' else 'container' end
  when (r - l) / 1200.0 >= 0.9 or (r - l) * (b - t) / 1080000.0 >= 0.15 or ((r - l) / 1200.0 >= 0.65 and (b - t) / 900.0 >= 0.15) then 'container' else 'foreground' end as role from elements)"""
)
LINES = """lines as (select o_orderkey as page_id, case when o_orderstatus = 'O' then 'vertical' else 'horizontal' end as direction,
  cast(case when o_orderstatus = 'O' then (o_custkey * 17) % 1000 + 50 else (o_custkey * 13) % 700 + 50 end as int) as position,
  0 as "start", case when o_orderstatus = 'O' then 900 else 1200 end as "end",
  case when o_orderkey % 2 = 0 then 'lsd' else 'whitespace' end as source from orders)"""
SCORES = "scores as (select event_type as method, user_id as sample, round(avg(value), 6) as score from events group by event_type, user_id)"
RECORDS = """records as (select event_id as record_id, 'b' || cast(user_id % 3 as varchar) as segmenter, case when event_type = 'error' then 'failed' else 'ok' end as status,
  value as elapsed, cast(json_extract(props, '$.k') as int) as leaf_count from events)"""
PAIRS = """pairs as (select a.sample, a.score as baseline, b.score as candidate, round(b.score - a.score, 6) as delta from scores a join scores b on a.sample = b.sample where a.method = 'view' and b.method = 'click')"""
REGIONS = """regions as (select page_id, region_id, l, t, l + 600 as r, t + 450 as b from (select distinct page_id from elements), (values (0, 0, 0), (1, 600, 0), (2, 0, 450), (3, 600, 450)) q(region_id, l, t))"""
INTERVALS = """both_axes as (select page_id, 'x' as axis, l as lo, r as hi from elements union all select page_id, 'y', t, b from elements),
 reach as (select *, max(hi) over (partition by page_id, axis order by lo, hi rows between unbounded preceding and 1 preceding) as m from both_axes where hi > lo),
 runs as (select *, sum(case when m is null or m < lo then 1 else 0 end) over (partition by page_id, axis order by lo, hi rows between unbounded preceding and current row) as run from reach),
 intervals as (select page_id, axis, cast(min(lo) as int) as "start", cast(max(hi) as int) as "end" from runs group by page_id, axis, run)"""
GAPS = (
    INTERVALS
    + """, nexts as (select page_id, axis, "end" as gap_start, lead("start") over (partition by page_id, axis order by "start") as gap_end from intervals),
 gaps as (select page_id, axis, gap_start, gap_end, cast(gap_end - gap_start as int) as size, cast(round_even((gap_start + gap_end) / 2.0, 0) as int) as cut from nexts where gap_end - gap_start >= 8)"""
)
ADJACENT = """adjacent as (select a.page_id, a.element_id as a, b.element_id as b, a.l as a_l, a.t as a_t, a.r as a_r, a.b as a_b, b.l as b_l, b.t as b_t, b.r as b_r, b.b as b_b,
  case when a.t < b.b and b.t < a.b and a.r <= b.l then 'right' when a.t < b.b and b.t < a.b and b.r <= a.l then 'left'
       when a.l < b.r and b.l < a.r and a.b <= b.t then 'bottom' when a.l < b.r and b.l < a.r and b.b <= a.t then 'top' end as side
  from elements a join elements b on a.page_id = b.page_id and a.element_id <> b.element_id)"""
UNBLOCKED = (
    ADJACENT
    + """, unblocked as (select p.* from adjacent p where side is not null and not exists (select 1 from elements c where c.page_id = p.page_id and c.element_id <> p.a and c.element_id <> p.b and
  case when side in ('right', 'left') then greatest(a_t, b_t) < c.b and least(a_b, b_b) > c.t else greatest(a_l, b_l) < c.r and least(a_r, b_r) > c.l end and
  case side when 'right' then c.l >= a_r and c.l < b_l when 'left' then c.r <= a_l and c.r > b_r when 'bottom' then c.t >= a_b and c.t < b_t else c.b <= a_t and c.b > b_b end))"""
)
CROSS = """case when direction = 'vertical' then e.l < position and position < e.r and "start" < e.b and "end" > e.t else e.t < position and position < e.b and "start" < e.r and "end" > e.l end"""
NODES = """nodes as materialized (select page_id, 0 as node_id, null::int as parent_id, 0 as ordinal, min(l) as l, min(t) as t, max(r) as r, max(b) as b, 'column' as layout_type from elements group by page_id
  union all select page_id, element_id + 1, 0, element_id, l, t, r, b, 'atomic' from elements)"""
INSIDE = """inside as (select e.*, g.region_id, g.l as g_l, g.t as g_t, g.r as g_r, g.b as g_b, (greatest(0, least(e.r, g.r) - greatest(e.l, g.l)) * greatest(0, least(e.b, g.b) - greatest(e.t, g.t))) * 1.0::double as common
  from roles e join regions g on e.page_id = g.page_id and e.l < g.r and g.l < e.r and e.t < g.b and g.t < e.b)"""
FEATURES = (
    INSIDE
    + """, base as (select page_id, region_id,
  round(max(g_r - g_l) / 1200.0::double, 6) as width_ratio, round(max(g_b - g_t) / 900.0::double, 6) as height_ratio, round(max(g_r - g_l) * max(g_b - g_t) / 1080000.0::double, 6) as page_area,
  max(case when (g_t + g_b) / 2.0 / 900 <= 0.2 then 'header' when (g_t + g_b) / 2.0 / 900 >= 0.82 then 'footer' else 'content' end) as position,
  count(*) filter (role = 'foreground') as foreground_count, count(*) filter (role = 'foreground' and uied_class = 'Text') as text_count,
  count(*) filter (role = 'foreground' and uied_class <> 'Text') as nontext_count, count(*) filter (role <> 'foreground') as container_count,
  round(coalesce(count(*) filter (role = 'foreground' and uied_class = 'Text') / nullif(count(*) filter (role = 'foreground'), 0)::double, 0), 6) as text_ratio,
  round(least(1, coalesce(sum(common) filter (role = 'foreground'), 0) / 270000.0::double), 6) as density, round(least(1, coalesce(max(common) filter (role <> 'foreground' or uied_class <> 'Text'), 0) / 270000.0::double), 6) as largest,
  round(least(1, coalesce(sum(common) filter (role <> 'foreground'), 0) / 270000.0::double), 6) as container_ratio,
  case when count(*) filter (role = 'foreground') >= 2 then round(greatest(0, least(1, ((1 - stddev_pop(r - l) filter (role = 'foreground') / greatest(1, avg(r - l) filter (role = 'foreground'))) + (1 - stddev_pop(b - t) filter (role = 'foreground') / greatest(1, avg(b - t) filter (role = 'foreground')))) / 2)), 6) else 0 end as repeated_size,
  case when count(*) filter (uied_class = 'Text') >= 2 then round(greatest(0, least(1, (max((l + r) / 2.0::double) filter (uied_class = 'Text') - min((l + r) / 2.0::double) filter (uied_class = 'Text')) / 600.0::double)), 6) else 0 end as horizontal_spread,
  case when count(*) filter (uied_class = 'Text') >= 2 then round(greatest(0, least(1, (max((t + b) / 2.0::double) filter (uied_class = 'Text') - min((t + b) / 2.0::double) filter (uied_class = 'Text')) / 450.0::double)), 6) else 0 end as vertical_spread,
  round(greatest(0, least(1, coalesce(median(b - t) filter (uied_class = 'Text'), 0) / 450.0::double)), 6) as median_text_height, greatest(2, median(b - t) filter (uied_class = 'Text') * 0.6::double) as line_step
  from inside group by page_id, region_id),
 front as (select * from inside where role = 'foreground'),
 steps as (select *, greatest(0, lead(t) over (partition by page_id, region_id order by t, l, element_id) - b) as down, greatest(0, lead(l) over (partition by page_id, region_id order by l, t, element_id) - r) as over_,
   (l + r) / 2.0::double - lag((l + r) / 2.0::double) over (partition by page_id, region_id order by l + r) as dx, (t + b) / 2.0::double - lag((t + b) / 2.0::double) over (partition by page_id, region_id order by t + b) as dy from front),
 gap as (select page_id, region_id, round(least(1, coalesce(max(case when down is not null then down end), 0) / 450.0::double), 6) as horizontal_gap, round(least(1, coalesce(max(over_), 0) / 600.0::double), 6) as vertical_gap,
   case when count(*) >= 3 then round(greatest(0, least(1, coalesce(greatest(case when count(*) filter (dx > 1) >= 2 then 1 - stddev_pop(dx) filter (dx > 1) / greatest(1, avg(dx) filter (dx > 1)) end, case when count(*) filter (dy > 1) >= 2 then 1 - stddev_pop(dy) filter (dy > 1) / greatest(1, avg(dy) filter (dy > 1)) end), 0))), 6) else 0 end as repeated_gap
   from steps group by page_id, region_id),
 lined as (select i.page_id, i.region_id, line_step, (t + b) / 2.0::double - lag((t + b) / 2.0::double) over (partition by i.page_id, i.region_id order by t + b) as dy from inside i join base using (page_id, region_id) where uied_class = 'Text'),
 line_counts as (select page_id, region_id, 1 + count(*) filter (dy > line_step) as text_line_count from lined group by page_id, region_id),
 sep as (select g.page_id, g.region_id, round(greatest(0, least(1, coalesce(max((least(g.r, "end") - greatest(g.l, "start")) / 600.0::double) filter (direction = 'horizontal' and g.t < position and position < g.b), 0))), 6) as horizontal_separator,
   round(greatest(0, least(1, coalesce(max((least(g.b, "end") - greatest(g.t, "start")) / 450.0::double) filter (direction = 'vertical' and g.l < position and position < g.r), 0))), 6) as vertical_separator
   from regions g join lines on g.page_id = lines.page_id group by g.page_id, g.region_id),
 features as (select base.*, coalesce(horizontal_gap, 0) as horizontal_gap, coalesce(vertical_gap, 0) as vertical_gap, coalesce(repeated_gap, 0) as repeated_gap, coalesce(horizontal_separator, 0) as horizontal_separator, coalesce(vertical_separator, 0) as vertical_separator, coalesce(text_line_count, 0) as text_line_count, 1.0::double as background_continuity
   from base left join line_counts using (page_id, region_id) left join gap using (page_id, region_id) left join sep using (page_id, region_id))"""
)
PROFILES = """measured as (select *, (repeated_size + repeated_gap) / 2 as rep, greatest(vertical_gap, vertical_separator) as vp, greatest(horizontal_gap, horizontal_separator) as hp from features),
 typed as (select *, greatest(0, least(1, (0.20 * page_area + 0.25 * largest + 0.20 * (1 - least(1, text_count / 8.0::double)) + 0.20 * background_continuity + 0.15 * (1 - rep)) * case when largest < 0.2 and container_ratio < 0.35 then 0.35 else 1 end)) as hero,
  greatest(0, least(1, (0.25 * vp + 0.25 * vp / greatest(0.01, vp + hp) + 0.15 * least(1, foreground_count / 4.0::double) + 0.25 * greatest(0, 1 - abs(height_ratio - 0.55) / 0.45) + 0.10 * (1 - hp)) * case when foreground_count < 4 or vp < 0.15 or vp <= hp then 0.4 else 1 end)) as two_column,
  greatest(0, least(1, 0.25 * (position = 'header')::int + 0.20 * (1 - least(1, height_ratio / 0.25)) + 0.20 * horizontal_spread + 0.15 * text_ratio + 0.20 * background_continuity)) as navigation,
  greatest(0, least(1, 0.35 * text_ratio + 0.20 * (1 - least(1, nontext_count / 3.0::double)) + 0.20 * vertical_spread + 0.15 * (1 - hp) + 0.10 * background_continuity)) as text_section,
  greatest(0, least(1, 0.35 * rep + 0.20 * least(1, foreground_count / 6.0::double) + 0.15 * greatest(hp, vp))) as card_grid,
  greatest(0, least(1, 0.30 * repeated_gap + 0.20 * repeated_size + 0.20 * vertical_spread + 0.15 * text_ratio)) as list,
  greatest(0, least(1, 0.30 * (position = 'footer')::int + 0.20 * text_ratio + 0.15 * least(1, foreground_count / 6.0::double) + 0.15 * background_continuity)) as footer,
  greatest(0, least(1, 0.25 * least(1, foreground_count / 8.0::double) + 0.15 * (1 - text_ratio) + 0.15 * (1 - rep) + 0.25 * greatest(hp, vp))) as mixed from measured),
 long as (select page_id, region_id, unnest([{'s': hero, 'k': 0, 'n': 'hero'}, {'s': navigation, 'k': 1, 'n': 'navigation'}, {'s': footer, 'k': 2, 'n': 'footer'}, {'s': card_grid, 'k': 3, 'n': 'card_grid'}, {'s': two_column, 'k': 4, 'n': 'two_column'}, {'s': list, 'k': 5, 'n': 'list'}, {'s': text_section, 'k': 6, 'n': 'text_section'}, {'s': mixed, 'k': 7, 'n': 'mixed'}]) as x from typed),
 placed as (select page_id, region_id, x.s as s, x.n as n, row_number() over (partition by page_id, region_id order by x.s desc, x.k) as place from long),
 top_kind as (select page_id, region_id, max(case when s < 0.42 then 'mixed' else n end) as kind from placed where place = 1 group by page_id, region_id),
 kinds as (select page_id, region_id, max(kind) as region_type, round(greatest(0, least(1, 0.7 * max(s) filter (n = kind) + 0.3 * greatest(0, max(s) filter (n = kind) - max(s) filter (n <> kind)))), 6) as confidence from placed join top_kind using (page_id, region_id) group by page_id, region_id)"""
