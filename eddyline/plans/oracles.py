"""DuckDB SQL for the registered queries: common tables, and a last SELECT for each."""

from __future__ import annotations

import re

from .queries import HOLE, PART, RING

#: Tables in the order in which they may build on each other.
TABLES = {
    "spine": "select a.d, b.y, c.x from (select cast(unnest(range(30)) as int) d) a, (select cast(unnest(range(24)) as int) y) b, (select cast(unnest(range(24)) as int) x) c",
    "bins": "select cast(datediff('day', date '2024-01-01', cast(ts as date)) as int) d, cast((user_id * 7 + event_id) % 24 as int) y, cast((event_id // 7) % 24 as int) x, cast(sum(cast(round(value * 100) as bigint)) as bigint) v from events group by 1, 2, 3",
    "raw": "select s.d, s.y, s.x, coalesce(b.v, 0) v, b.v is not null has from spine s left join bins b using (d, y, x)",
    "near": "select a.d, a.y, a.x, sum(b.v) v, bool_or(b.has) has from raw a join raw b on a.d = b.d and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by 1, 2, 3",
    "ras": "select d, y, x, cast(sum(v) over w as bigint) v, bool_or(has) over w has from near window w as (partition by y, x order by d rows between 2 preceding and current row)",
    "mask": "select d, y, x from ras where v * 172800 >= 11 * (select sum(v) from ras)",
    "lab8": "select d, y, x, y * 24 + x c from mask union select m.d, m.y, m.x, l.c from lab8 l join mask m on m.d = l.d and abs(m.y - l.y) <= 1 and abs(m.x - l.x) <= 1",
    "comp": "select d, y, x, min(c) c from lab8 group by 1, 2, 3",
    "lab4": "select d, y, x, y * 24 + x p from mask union select m.d, m.y, m.x, l.p from lab4 l join mask m on m.d = l.d and abs(m.y - l.y) + abs(m.x - l.x) = 1",
    "piece": "select d, y, x, min(p) p from lab4 group by 1, 2, 3",
    "psize": "select d, p, count(*) n from piece group by 1, 2",
    "kept": "select d, y, x, c, p from comp join piece using (d, y, x) join psize using (d, p) where n >= 5",
    "csize": "select d, c, count(*) sz from kept group by 1, 2",
    "ov": "select a.d, b.c pc, a.c cc, count(*) inter, min(a.y * 24 + a.x) fc from kept a join kept b on b.d = a.d - 1 and b.y = a.y and b.x = a.x group by 1, 2, 3",
    "s": "select w, d, c, sz from csize join wins on d between w0 and w1 union all select w, d, -1, 0 from wins, (select distinct d from spine) where d between w0 and w1",
    "tr": """select w, d, c, sz, w * 17592186044416 + (d + 19723) * 576 + c label from s join wins using (w) where d = w0
        union all
        select cur.w, cur.d, cur.c, cur.sz, coalesce(best.label, cur.w * 17592186044416 + (cur.d + 19723) * 576 + cur.c)
        from (select s.* from s join (select w, max(d) d from tr group by w) k on s.w = k.w and s.d = k.d + 1) cur
        left join (
            select x.w, x.d, x.c, x.label from (
                select u.w, u.d, u.c, u.sz, t.label, sum(o.inter) inter, min(o.fc) fc
                from (select s.* from s join (select w, max(d) d from tr group by w) k on s.w = k.w and s.d = k.d + 1) u
                join ov o on o.d = u.d and o.cc = u.c join tr t on t.w = u.w and t.c = o.pc where t.c >= 0 group by 1, 2, 3, 4, 5) x
            join (select w, label, sum(sz) psz from tr where c >= 0 group by 1, 2) g on g.w = x.w and g.label = x.label
            where {gate}
            qualify row_number() over (partition by x.w, x.d, x.c order by x.inter desc, x.fc) = 1) best
        on best.w = cur.w and best.d = cur.d and best.c = cur.c""",
    "tcells": "select w, d, y, x, p, label from kept join tr using (d, c)",
    "node": "select w, d, p, label, count(*) n from tcells group by 1, 2, 3, 4",
    "edge": "select distinct a.w, a.d d1, a.p p1, b.d d2, b.p p2 from tcells a join tcells b on a.w = b.w and a.label = b.label and b.d = a.d + 1 and a.y = b.y and a.x = b.x",
    "edges": "select * from edge union all select w, d2, p2, d1, p1 from edge",
    "vol": "select w, d, p, d * 576 + p v from node union select e.w, e.d2, e.p2, l.v from vol l join edges e on e.w = l.w and e.d1 = l.d and e.p1 = l.p",
    "volume": "select w, d, p, min(v) v from vol group by 1, 2, 3",
    "vsize": "select w, v, sum(n) n from volume join node using (w, d, p) group by 1, 2",
    "cells": "select w, d, y, x, label from tcells join volume using (w, d, p) join vsize using (w, v) where n >= 20",
    "days": "select distinct label, d from cells",
    "isl": "select label, d, d - row_number() over (partition by label order by d) g from days",
    "span": "select label, min(d) i0, max(d) e from isl group by label, g",
    "life": "select label, cast(row_number() over (partition by label order by e) as int) seq, min(i0) over (partition by label) f, e, coalesce(lag(e) over (partition by label order by e) + 1, min(i0) over (partition by label)) st from span",
    "sums": "select l.label, seq, f, st, e, count(*) px from life l join cells c on c.label = l.label and c.d between st and e where e - st >= 3 group by 1, 2, 3, 4, 5 having count(*) >= 20",
    "ev": """select 'EV_' || lpad(cast(n as varchar), 6, '0') || '_' || upper(strftime(date '2024-01-01' + st, '%b')) || '_' || cast(year(date '2024-01-01' + st) as varchar) id, n, label, st, e, px
        from (select *, cast(row_number() over (order by f, label, e) as int) n from sums)""",
    "ecells": "select id, n, d, y, x from cells c join ev on ev.label = c.label and d between st and e",
    "n3": "select d, p, count(*) n from piece group by 1, 2",
    "e3": "select distinct a.d d1, a.p p1, b.d d2, b.p p2 from piece a join piece b on b.d = a.d + 1 and a.y = b.y and a.x = b.x",
    "v3": "select d, p, (d + 19723) * 576 + p v from n3 union select e.d2, e.p2, l.v from v3 l join (select * from e3 union all select d2, p2, d1, p1 from e3) e on e.d1 = l.d and e.p1 = l.p",
    "vol3": "select d, p, min(v) v from v3 group by 1, 2",
    "lsize": "select d, label, count(*) sz from cells group by 1, 2",
    "lself": "select a.d, a.label, count(*) i from cells a join cells b on b.d = a.d + 1 and a.y = b.y and a.x = b.x and a.label = b.label group by 1, 2",
    "pairs": "select distinct a, b from pairsw",
    "pairsw": """select distinct w, coalesce(a.label, b.label) a, coalesce(b.label, a.label) b
        from (select c.* from cells c join wspan n on n.w = c.w + 1 where c.d >= n.lo) a
        full join (select c.w - 1 w, c.d, c.y, c.x, c.label from cells c join wspan n on n.w = c.w - 1 where c.d <= n.hi) b using (w, d, y, x)""",
    "wspan": "select w, w0 lo, w1 hi from wins",
    "mroot": "select a n, a m from pairs union select b, b from pairs union select case when p.a = l.n then p.b else p.a end, l.m from mroot l join pairs p on p.a = l.n or p.b = l.n",
    "vroot": "select v.w v, a n, a m from pairsw p join wins v on p.w < v.w union select v.w, b, b from pairsw p join wins v on p.w < v.w union select l.v, case when p.a = l.n then p.b else p.a end, l.m from vroot l join pairsw p on p.w < l.v and (p.a = l.n or p.b = l.n)",
    "vmap": "select v, n child, min(m) mother from vroot group by 1, 2",
    "writer": "select s.d, max(w) k from (select distinct d from spine) s join wins on w0 <= s.d group by 1",
    "mp": "select n child, min(m) mother from mroot group by 1",
    "stitched": "select d, y, x, min(coalesce(mother, label)) label from cells left join mp on child = label group by 1, 2, 3",
}
#: The same steps from days to events, after windows are reconciled.
_STEPS = ("days", "isl", "span", "life", "sums", "ev")
for _n in _STEPS:
    _text = TABLES[_n].replace("from cells", "from stitched").replace("join cells", "join stitched")
    for _m in _STEPS:
        _text = re.sub(rf"\b(from|join) {_m}\b", rf"\1 st_{_m}", _text)
    TABLES[f"st_{_n}"] = _text
#: Small holes (ten cells at most) in the labels of a table: free cells next to a label, what ten steps reach from them, and regions that end there.
_FINE = "select d, n label, a.y, b.x from ecells e join (select cast(unnest(range(30)) as int) y) a on e.y = cast(round_even(a.y * 0.8, 0) as int) join (select cast(unnest(range(30)) as int) x) b on e.x = cast(round_even(b.x * 0.8, 0) as int)"
for _p, _source, _n in (("k", "select d, c label, y, x from kept", 24), ("e", "select d, n label, y, x from ecells", 24), ("f", _FINE, 30)):
    TABLES |= {
        f"{_p}lab": _source,
        f"{_p}free": f"select k.d, k.label, b.y, c.x from (select distinct d, label from {_p}lab) k, (select cast(unnest(range({_n})) as int) y) b, (select cast(unnest(range({_n})) as int) x) c where not exists (select 1 from {_p}lab l where l.d = k.d and l.label = k.label and l.y = b.y and l.x = c.x)",
        f"{_p}reach": f"""select f.d, f.label, f.y * {_n} + f.x r, f.y, f.x, 0 k from {_p}free f join {_p}lab l on l.d = f.d and l.label = f.label and abs(l.y - f.y) + abs(l.x - f.x) = 1
            union select r.d, r.label, r.r, f.y, f.x, r.k + 1 from {_p}reach r join {_p}free f on f.d = r.d and f.label = r.label and abs(f.y - r.y) + abs(f.x - r.x) = 1 where r.k < 10""",
        f"{_p}hole": f"select d, label, r from {_p}reach group by 1, 2, 3 having count(distinct y * {_n} + x) <= 10",
        f"{_p}new": f"select d, y, x, max(label) filled from {_p}reach join {_p}hole using (d, label, r) group by 1, 2, 3",
        f"{_p}full": f"select d, y, x, coalesce(filled, label) label from {_p}lab full join {_p}new using (d, y, x)",
    }
#: The sinusoidal grid over the raster, on the ellipsoid: places, bounds, cells, where they lie in the raster, and values; then back.
_A, _E2 = "6378137.0", "0.00669437999014"
_C0 = f"(1 - {_E2} / 4 - 3 * pow({_E2}, 2) / 64 - 5 * pow({_E2}, 3) / 256)"
_E1 = f"((1 - sqrt(1 - {_E2})) / (1 + sqrt(1 - {_E2})))"
_CORNERS = "(select cast(unnest(range(2)) as int) dy) dy, (select cast(unnest(range(2)) as int) dx) dx"
TABLES |= {
    "place": "select y, x, radians(y * 2.5 - 20) phi, radians(x * 3.0 - 30) lam from (select cast(unnest(range(24)) as int) y) a, (select cast(unnest(range(24)) as int) x) b",
    "pxy": f"""select y, x, {_A} * lam * cos(phi) / sqrt(1 - {_E2} * pow(sin(phi), 2)) px, {_A} * ({_C0} * phi - (3 * {_E2} / 8 + 3 * pow({_E2}, 2) / 32 + 45 * pow({_E2}, 3) / 1024) * sin(2 * phi)
        + (15 * pow({_E2}, 2) / 256 + 45 * pow({_E2}, 3) / 1024) * sin(4 * phi) - 35 * pow({_E2}, 3) / 3072 * sin(6 * phi)) py from place""",
    "bounds": "select min(px) x0, max(px) x1, min(py) y0, max(py) y1 from pxy",
    "gcell": "select i, j, y0 + i * 400000.0 gy, x0 + j * 400000.0 gx from bounds, (select unnest(range(100)) i) a, (select unnest(range(100)) j) b where i < ceil((y1 - y0) / 400000.0 - 1e-9) and j < ceil((x1 - x0) / 400000.0 - 1e-9)",
    "gmu": f"select i, j, gx, gy / ({_A} * {_C0}) mu from gcell",
    "gphi": f"select i, j, gx, mu + (3 * {_E1} / 2 - 27 * pow({_E1}, 3) / 32) * sin(2 * mu) + (21 * pow({_E1}, 2) / 16 - 55 * pow({_E1}, 4) / 32) * sin(4 * mu) + 151 * pow({_E1}, 3) / 96 * sin(6 * mu) + 1097 * pow({_E1}, 4) / 512 * sin(8 * mu) phi from gmu",
    "gat": f"select i, j, round((degrees(phi) + 20) / 2.5, 9) fy, round((degrees(gx * sqrt(1 - {_E2} * pow(sin(phi), 2)) / ({_A} * cos(phi))) + 30) / 3.0, 9) fx from gphi",
    "gw": f"select i, j, cast(least(floor(fy), 22) as int) + dy y, cast(least(floor(fx), 22) as int) + dx x, (case when dy = 1 then fy - least(floor(fy), 22) else 1 - (fy - least(floor(fy), 22)) end) * (case when dx = 1 then fx - least(floor(fx), 22) else 1 - (fx - least(floor(fx), 22)) end) w from gat, {_CORNERS} where fy between 0 and 23 and fx between 0 and 23",
    "gval": "select d, i, j, sum(w * v) v from gw join ras using (y, x) where w > 0 group by 1, 2, 3",
    "gsize": "select max(i) + 1 h, max(j) + 1 n from gcell",
    "bat": "select y, x, (py - y0) / 400000.0 fy, (px - x0) / 400000.0 fx, h, n from pxy, bounds, gsize",
    "bw": f"select y, x, least(floor(fy), h - 2) + dy i, least(floor(fx), n - 2) + dx j, (case when dy = 1 then fy - least(floor(fy), h - 2) else 1 - (fy - least(floor(fy), h - 2)) end) * (case when dx = 1 then fx - least(floor(fx), n - 2) else 1 - (fx - least(floor(fx), n - 2)) end) w from (select y, x, round(fy, 9) fy, round(fx, 9) fx, h, n from bat), {_CORNERS} where fy between 0 and h - 1 and fx between 0 and n - 1",
}
#: Triangles between neighbouring rows of projected points: a segment's third corner follows from the order of middles. Then each target's triangle, and its plane.
TABLES |= {
    "seg": "select a.y r, a.x n, a.px p, b.px q, (a.px + b.px) / 2 m from pxy a join pxy b on b.y = a.y and b.x = a.x + 1",
    "tri": """select s.r, true low, s.n, s.p, s.q, (select count(*) from seg u where u.r = s.r + 1 and u.m < s.m) apex from seg s where s.r < 23
        union all select s.r - 1, false, s.n, s.p, s.q, (select count(*) from seg u where u.r = s.r - 1 and u.m <= s.m) from seg s where s.r > 0""",
    "trow": "select i, j, gx, gy, least(22, max(y)) r from gcell join pxy on py <= gy group by 1, 2, 3, 4",
    "tgt": "select i, j, gx, r, (gy - l.py) / (h.py - l.py) s from trow join pxy l on l.y = r and l.x = 0 join pxy h on h.y = r + 1 and h.x = 0",
    "tplace": """select i, j, r, s, low, n, apex, (case when low then (gx - s * a.px) / nullif(1 - s, 0) else (gx - (1 - s) * a.px) / nullif(s, 0) end - p) / (q - p) w
        from tgt join tri using (r) join pxy a on a.x = apex and a.y = case when low then r + 1 else r end""",
    "tone": "select * from tplace where w between 0 and 1 qualify row_number() over (partition by i, j order by low, n) = 1",
    "tcorner": """select i, j, case when low then r else r + 1 end y, n x, (1 - w) * (case when low then 1 - s else s end) w from tone
        union all select i, j, case when low then r else r + 1 end, n + 1, w * (case when low then 1 - s else s end) from tone
        union all select i, j, case when low then r + 1 else r end, apex, case when low then s else 1 - s end from tone""",
}
ORDER = ["wspan", "pairsw", "pairs", "mroot", "vroot", "vmap", "writer", "mp", "stitched", *(f"st_{n}" for n in _STEPS)]
ONE, THREE = "select 0 w, 0 w0, 29 w1", "values (0, 0, 12), (1, 9, 21), (2, 18, 29)"
GATE = "x.inter * 5 > g.psz + x.sz - x.inter"


def sql(last: str, windows: bool = False, gate: str = GATE) -> str:
    """WITH the tables that a query needs, directly or by others."""
    names = [n for n in TABLES if n not in ORDER] + ORDER
    text = {n: TABLES[n].replace("{gate}", gate) for n in names}
    needed, grown = {last_word for last_word in names if re.search(rf"\b{last_word}\b", last)}, True
    while grown:
        more = {m for n in needed for m in names if re.search(rf"(?:from|join|,)\s+{m}\b", text[n])} - needed
        needed |= more
        grown = bool(more)
    parts = [f"wins(w, w0, w1) as ({THREE if windows else ONE})"]
    for n in names:
        if n in needed:
            # Recursive tables can't be told to be kept.
            parts.append(f"{n} as {'' if re.search(rf'(?:from|join) {n}\b', text[n]) else 'materialized '}({text[n]})")
    return "with recursive " + ",\n".join(parts) + "\n" + last


_T = "d + 19723 as t"
_YX = "y as yi, x as xi"


def _edges(*rings) -> str:
    return ", ".join(f"({x1}::double, {y1}::double, {x2}::double, {y2}::double)" for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))


_RING = _edges(RING)
_EVENTS = "select id, n as serial, label, st + 19723 as start_t, e + 19723 as end_t, cast(cast(date '2024-01-01' + st as date) as varchar) as start, cast(cast(date '2024-01-01' + e as date) as varchar) as \"end\", px as pixel_sum, px * 100 as area_km2 from ev"
_CHANGES = "select d, label, sz, coalesce(nx, 0) nx, coalesce(i, 0) i from lsize left join (select d - 1 d, label, sz nx from lsize) using (d, label) left join lself using (d, label)"

SQL = {
    "events_table": sql(_EVENTS),
    "raster_dense": sql(f"select {_T}, {_YX}, v as value from ras"),
    "slice_bbox_time": sql(f"select {_T}, {_YX}, v as value from ras where has and d between 5 and 12 and y between 3 and 15 and x between 4 and 20"),
    "stride_sample": sql(f"select {_T}, y // 3 as yi, x // 3 as xi, v as value from ras where has and y % 3 = 0 and x % 3 = 0"),
    "coarsen_block": sql(f"select {_T}, y // 5 as yi, x // 5 as xi, cast(sum(v) as bigint) as total, count(*) as n from ras where y < 20 and x < 20 group by 1, 2, 3"),
    "upsample_repeat": sql(f"select {_T}, y * 2 + a as yi, x * 2 + b as xi, v as value from ras, (values (0), (1)) p(a), (values (0), (1)) q(b) where has"),
    "quantize_mask": sql(f"select {_T}, {_YX}, case when v >= 60000 then 1 else 0 end as bit from ras"),
    "frame_components": sql(f"select {_T}, {_YX}, c as component, count(*) over (partition by d, c) as size from comp"),
    "component_sizes": sql(f"select {_T}, c as component, count(*) as size from comp group by 1, 2"),
    "dust_frame": sql(f"select {_T}, {_YX}, c as component, count(*) over (partition by d, c) as size from kept"),
    "overlap_pairs": sql(f"select {_T}, pc as prev, cc as cur, inter, fc as first_cell from ov"),
    "overlap_iou": sql("select o.d + 19723 as t, pc as prev, cc as cur, inter, p.sz + q.sz - inter as in_union, inter * 5 > p.sz + q.sz - inter as fits from ov o join csize q on q.d = o.d and q.c = cc join csize p on p.d = o.d - 1 and p.c = pc"),
    "pair_diagnostics": sql(f"select {_T}, label, sz as size, nx as next_size, i as inter, sz + nx - i as in_union from ({_CHANGES})"),
    "closing_days": sql(f"select label, {_T} from ({_CHANGES}) where nx > 0 and i * 2 < sz + nx - i"),
    "cantor_roundtrip": sql("select distinct pc as prev, cc as cur, (pc + cc) * (pc + cc + 1) // 2 + cc as code, pc as a, cc as b from ov"),
    "track_labels": sql(f"select {_T}, c as component, label, sz as size from tr where c >= 0"),
    "track_labels_legacy": sql(f"select {_T}, c as component, label, sz as size from tr where c >= 0", gate="true"),
    "dust_volume": sql(f"select {_T}, {_YX}, label from cells"),
    "components_3d": sql(f"select {_T}, {_YX}, v as volume, n as volume_size from piece join vol3 using (d, p) join (select v, cast(sum(n) as bigint) n from vol3 join n3 using (d, p) group by 1) using (v) where n >= 20"),
    "renumber_labels": sql(f"select {_T}, label, dense_rank() over (order by label) as number from days"),
    "window_assign": "select w as window_id, a as first, b as last, e as emit_last, f as is_last, cast(unnest(range(a, b + 1)) as int) as t from (values (0, 19723, 19735, 19731, false), (1, 19732, 19744, 19740, false), (2, 19741, 19752, 19752, true)) v(w, a, b, e, f)",
    "window_emit": sql("select w as window_id, d + 19723 as t, count(*) as n from mask join (values (0, 0, 8), (1, 9, 17), (2, 18, 29)) v(w, a, b) on d between a and b group by 1, 2"),
    "window_tracks": sql("select w as window_id, d + 19723 as t, label, count(*) as n from cells group by 1, 2, 3", True),
    "label_pairs": sql("select a, b from pairs", True),
    "label_map": sql("select child, mother from mp", True),
    "full_label_map": sql("select distinct label as child, coalesce(mother, label) as mother from cells left join mp on child = label", True),
    "relabel_overlap": sql(f"select {_T}, {_YX}, min(coalesce(mother, label)) as label from cells left join mp on child = label group by 1, 2, 3", True),
    "labels_as_written": sql(f"select {_T}, {_YX}, min(coalesce(mother, label)) as label from cells join writer using (d) left join vmap on child = label and v = k where w <= k group by 1, 2, 3", True),
    "incremental_map": sql("select distinct label as child, coalesce(mother, label) as mother from cells left join mp on child = label", True),
    "lifetimes": sql("select label, seq, f + 19723 as first, e + 19723 as \"end\" from life"),
    "lifetime_intervals": sql("select label, seq, f + 19723 as first_day, st + 19723 as start, e + 19723 as \"end\" from life"),
    "event_cells": sql(f"select id, n as serial, {_T}, {_YX} from ecells"),
    "period_overlay": sql(f"select {_T}, {_YX}, coalesce(v, 0) as value from spine left join (select d, y, x, cast(sum(n) as bigint) v from ecells group by 1, 2, 3) using (d, y, x) where d between 8 and 20"),
    "mask_join": sql(f"select {_T}, {_YX}, case when (y + x) % 7 <> 0 then v end as value from ras where has"),
    "event_values": sql("select id, count(v) as n, cast(sum(v) as bigint) as total from ecells left join (select d, y, x, case when (y + x) % 7 <> 0 then v end v from ras where has) using (d, y, x) group by 1"),
    "polygon_mask": f"with p as (select cast(unnest(range(24)) as int) y), q as (select cast(unnest(range(24)) as int) x), e(x1, y1, x2, y2) as (values {_RING}) select 'A' as region, y as yi, x as xi from p, q join e on y >= least(y1, y2) and y < greatest(y1, y2) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x group by 2, 3 having count(*) % 2 = 1",
    "centroids": sql("select id, d + 19723 as t, cast(floor(avg(y)) as int) as cy, cast(floor(avg(x)) as int) as cx from ecells group by 1, 2"),
    "label_places": sql("select id, d + 19723 as t, cast(round_even(least(24 - 24 // 20, greatest(24 // 20, avg(y))), 0) as int) as cy, cast(round_even(least(24 - 24 // 10, greatest(24 // 10, avg(x))), 0) as int) as cx from ecells group by 1, 2"),
    "box_text": sql("""select id, printf('%d°%s to %d°%s, %d°%s to %d°%s', cast(round_even(abs(a), 0) as int), if(a < 0, 'S', 'N'), cast(round_even(abs(b), 0) as int), if(b < 0, 'S', 'N'), cast(round_even(abs(e), 0) as int), if(e < 0, 'W', 'E'), cast(round_even(abs(f), 0) as int), if(f < 0, 'W', 'E')) as box
        from (select id, min(y * 2.5 - 20) a, max(y * 2.5 - 20) b, min(x * 3.0 - 30) e, max(x * 3.0 - 30) f from ecells group by 1)"""),
    "input_path": sql("""select d + 19723 as t, cast((y - my) // 2 as int) as yi, cast((x - mx) // 2 as int) as xi, cast(y * 2.5 - 20 as double) as lat, cast(x * 3.0 - 30 as double) as lon, cast(v as double) as value
        from ras, (select min(y) my, min(x) mx from spine where y * 2.5 - 20 between -11 and 20 and x * 3.0 - 30 between -20 and 31)
        where has and d between 5 and 20 and y * 2.5 - 20 between -11 and 20 and x * 3.0 - 30 between -20 and 31 and (y - my) % 2 = 0 and (x - mx) % 2 = 0"""),
    "preprocess_province": sql("select d + 19723 as t, y as yi, x as xi from ras join (POLYGON) p on p.yi = y and p.xi = x where has and v >= 60000"),
    "project_raster": sql("select d + 19723 as t, cast(i as int) as yi, cast(j as int) as xi, round(v, 0) as value from gval"),
    "project_triangles": sql("select d + 19723 as t, cast(i as int) as yi, cast(j as int) as xi, round(sum(w * v), 0) as value from tcorner join ras using (y, x) group by 1, 2, 3"),
    "project_back": sql("select d + 19723 as t, y as yi, x as xi, round(case when sum(w) > 1 - 1e-9 then sum(w * v) end, 0) as value from bw join gval using (i, j) where w > 0 group by 1, 2, 3"),
    "labels_back": sql("select d + 19723 as t, y as yi, x as xi, cast(i * 1000 + j as bigint) as label from (select y, x, round_even(fy, 0) i, round_even(fx, 0) j from bat) join gval using (i, j) where v >= 60000"),
    "saved_windows": sql("select w as window_id, d + 19723 as t, count(*) as n from cells group by 1, 2", True),
    "named_tables": sql("select case when d < 10 then 'mask_0_to_9' else 'mask_10_to_19' end as name, count(*) as n from mask where d < 20 group by 1"),
    "saved_events": sql("select id, cast(right(id, 4) as int) as year, d + 19723 as t, y as yi, x as xi from efull join (select id, n from ev) on n = label"),
    "netcdf_scan": sql("select 'days_' || (d // 10) || '.nc' as file, d + 19723 as t, y as yi, x as xi, y * 2.5::double - 20 as lat, x * 3::double - 30 as lon, v::double as value from ras where has and d between 4 and 23 and y * 2.5 - 20 between -11 and 20 and x * 3.0 - 30 > -18"),
    "netcdf_events": sql("select id || '.nc' as file, d + 19723 as t, y as yi, x as xi, y * 2::double - 20 as lat, -30 + x * 2.4::double as lon from ffull join (select id, n from ev) on n = label"),
    "newest_year": sql(f"select 2000 + d // 7 as year, {_T}, {_YX}, v as value from ras where has and d // 7 = (select max(d // 7) from ras where has)"),
    "appended_days": sql("select d + 19723 as t, cast(sum(v) as bigint) as total from ras group by 1"),
    "joined_stretches": sql("select y as yi, x as xi, count(*) as n, cast(sum(v) as bigint) as total from ras group by 1, 2"),
    "shared_spans": sql("select a.id, b.id as next_id, greatest(a.st, b.st) + 19723 as first, least(a.e, b.e) + 19723 as last from ev a join ev b on b.n = a.n + 1 where greatest(a.st, b.st) < least(a.e, b.e)"),
    "extended_batches": sql(f"select {_T}, {_YX}, label from stitched", True),
    "nearest_rows": sql(f"select {_T}, {_YX}, cast(y * 2.5 - 20 as double) as lat, v as value from ras where has and y = (select y from ras where has order by abs(y * 2.5 - 20 - 7.1), y limit 1)"),
    "stream_tracks": sql(f"select {_T}, c as component, label, sz as size from tr where c >= 0"),
    "vector_mask": f"""with c as (select cast(unnest(range(24)) as int) y), b as (select cast(unnest(range(24)) as int) x), e(x1, y1, x2, y2) as (values {_edges(RING, HOLE, PART)}),
        i as (select y, x from c, b join e on y >= least(y1, y2) and y < greatest(y1, y2) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) > x group by 1, 2 having count(*) % 2 = 1),
        -- An edge meets a cell where the stretches of it between the cell's sides overlap.
        s as (select y, x, (x - 0.5 - x1) / (x2 - x1) a, (x + 0.5 - x1) / (x2 - x1) a2, (y - 0.5 - y1) / (y2 - y1) b, (y + 0.5 - y1) / (y2 - y1) b2 from c, b, e),
        u as (select distinct y, x from s where greatest(least(a, a2), least(b, b2), 0) <= least(greatest(a, a2), greatest(b, b2), 1))
        select 'A' as region, coalesce(i.y, u.y) as yi, coalesce(i.x, u.x) as xi, case when i.y is null then 0 else 1 end as inside, case when u.y is null then 0 else 1 end as touched from i full join u on i.y = u.y and i.x = u.x""",
    "affine_corners": "select 3.0::double as a, 0.0::double as b, -31.5::double as c, 0.0::double as d, 2.5::double as e, -21.25::double as f",
    "all_codes": sql("select distinct b.d + 19723 as t, a.c as prev, b.c as cur, (a.c + b.c) * (a.c + b.c + 1) // 2 + b.c as code from csize a join csize b on b.d = a.d + 1"),
    "dissolved_regions": sql(f"select {_T}, {_YX} from mask where y // 6 = 0 or x // 6 = 2"),
    "last_label": sql("select coalesce(max(label), 1) as label from cells"),
    "events_windowed": sql(_EVENTS.replace("from ev", "from st_ev"), True),
    "fill_small_holes": sql(f"select {_T}, {_YX}, cast(label as bigint) as label from kfull"),
    "value_range": sql("select round(avg(v), 3) as mean, round(stddev_pop(v), 3) as spread, round(avg(v) - stddev_pop(v), 3) as low, round(avg(v) + stddev_pop(v), 3) as high, min(v) as least, max(v) as largest from ras"),
    "frame_norm": sql(f"select {_T}, {_YX}, case when max(v) over (partition by d) > 0 then cast(floor(v / max(v) over (partition by d) * 255) as int) else 0 end as level from ras where has"),
    "file_name_parts": """select name, coalesce(try_cast(nullif(regexp_extract(name, '_(\\d{4})_[\\w-]+_', 1), '') as int), -1) as year, coalesce(try_cast(nullif(regexp_extract(name, '_(\\d+)_', 1), '') as int), -1) as serial,
        try_cast(nullif(regexp_extract(name, '\\b((?:19|20)\\d{2})\\b', 1), '') as int) as file_year, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as base
        from (values ('EV_000012_JAN_2018'), ('out/EV_2019_x-y_z.nc'), ('mhw_2018.nc'), ('mhw 1999.nc'), ('none'), ('a_77_b_2020_c_d')) v(name)""",
    "month_batches": "select cast(cast(m as date) as varchar) as first, cast(least(last_day(cast(m as date)), date '2024-12-15') as varchar) as last from (select unnest(generate_series(date '2024-01-01', date '2024-12-15', interval 1 month)) m)",
    "sinusoidal_xy": "select y as yi, x as xi, round(6371000.0 * radians(x * 3.0 - 30) * cos(radians(y * 2.5 - 20)), 2) as x, round(6371000.0 * radians(y * 2.5 - 20), 2) as y from (select cast(unnest(range(24)) as int) y), (select cast(unnest(range(24)) as int) x)",
    "reproject_bilinear": sql("""select d + 19723 as t, fy as yi, fx as xi, round(cast(sum((1 - abs(fy * 0.5 - y)) * (1 - abs(fx * 0.5 - x)) * v) as double), 3) as value
        from ras join (select cast(unnest(range(47)) as int) fy) on abs(fy * 0.5 - y) < 1 join (select cast(unnest(range(47)) as int) fx) on abs(fx * 0.5 - x) < 1 group by 1, 2, 3"""),
    "labels_nearest": sql("select d + 19723 as t, cy as yi, cx as xi, c as label from kept join (select cast(unnest(range(10)) as int) cy) on y = cast(round_even(cy * 2.3, 0) as int) join (select cast(unnest(range(10)) as int) cx) on x = cast(round_even(cx * 2.3, 0) as int)"),
}
SQL["preprocess_province"] = SQL["preprocess_province"].replace("POLYGON", SQL["polygon_mask"])
