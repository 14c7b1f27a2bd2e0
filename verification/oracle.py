"""Plain SQL for every named query that SQL can express, for DuckDB.

Each text starts from the same derived inputs as the Spark side (the adapter
expressions) and computes everything after that on its own.
"""

from __future__ import annotations

from trialmart.functions.columns import TIE_SHIFT
from trialmart.plans import adapter

TEXT = "varchar"
START, END = (f"timestamp '{d} 00:00:00'" for d in adapter.WINDOW)
RATE, COST, REDEEM = "0.23::double", "10.0::double", "0.30::double"

_FORMATS = ("%Y-%m-%dT%H:%M:%S.%gZ", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


def _parse(col: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({col}, '{f}')" for f in _FORMATS) + ")"


def _utc(col: str) -> str:
    """UTC of a wall time; when clocks go back and it occurs twice, the first one."""
    zone = "coalesce(merchant_timezone, 'America/Sao_Paulo')"
    late = f"timezone({zone}, {col})"
    early = f"({late} - interval 1 hour)"
    instant = f"case when timezone({zone}, {early}) = {col} then {early} else {late} end"
    return f"(({instant}) at time zone 'UTC')"


def _basket(col: str = "items") -> str:
    return (
        f"case when regexp_matches({col}, '^\\s*\\[') and json_valid({col}) "
        f"then cast(json_array_length({col}) as int) end"
    )


# name -> (needs, body)
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "lines": ((), adapter.LINE_SUMMARY.format(lineitem="lineitem")),
    "base": (
        ("lines",),
        "select o.*, lines.m, lines.n, "
        + adapter.select_list(adapter.ORDER_HELPERS, TEXT)
        + " from orders o left join lines on o.o_orderkey = lines.l_orderkey",
    ),
    "raw_orders": (
        ("base",),
        f"select {adapter.select_list(adapter.ORDERS, TEXT)} from base union all "
        f"select {adapter.select_list(adapter.ORDER_COPIES, TEXT)} from base "
        f"where {adapter.COPIED} union all "
        f"select {adapter.select_list(adapter.ORDER_TWINS, TEXT)} from base "
        f"where {adapter.TWINNED}",
    ),
    "raw_consumers": ((), f"select {adapter.select_list(adapter.CONSUMERS, TEXT)} from customer"),
    "raw_restaurants": (
        (), f"select {adapter.select_list(adapter.RESTAURANTS, TEXT)} from supplier",
    ),
    "raw_abmap": (
        (),
        f"select {adapter.select_list(adapter.ABMAP, TEXT)} from customer "
        f"where {adapter.ASSIGNED}",
    ),
    "parsed": (
        ("raw_orders",),
        f"select *, {_parse('order_created_at')} as created, "
        f"{_parse('order_scheduled_date')} as scheduled from raw_orders",
    ),
    "timed": (
        ("parsed",),
        f"select *, {_utc('created')} as created_utc, {_utc('scheduled')} as scheduled_utc "
        "from parsed",
    ),
    "events": (
        ("timed",),
        "select *, case when order_scheduled and scheduled_utc >= created_utc "
        "then scheduled_utc else created_utc end as event_ts_utc from timed",
    ),
    "dated": (
        ("events",),
        "select *, cast(timezone('America/Sao_Paulo', timezone('UTC', event_ts_utc)) as date) "
        "as event_date_brt from events",
    ),
    # Copies never share a creation time here, so further ties do not arise.
    "typed": (
        ("dated",),
        f"select *, lower(origin_platform) as platform, {_basket()} as basket_size from dated "
        "where order_id is not null and customer_id is not null "
        "qualify row_number() over (partition by order_id "
        "order by created asc nulls last, order_total_amount asc nulls last) = 1",
    ),
    "clean": (("typed",), "select * from typed "
              "where order_total_amount is null or order_total_amount >= 0"),
    "consumers": (
        ("raw_consumers",),
        "select customer_id, lower(language) as language, cast(active as boolean) as active, "
        "sha256(concat_ws('-', customer_phone_area, customer_phone_number)) as phone_hash, "
        "try_strptime(created_at, '%Y-%m-%d %H:%M:%S') as consumer_created_at "
        "from raw_consumers where customer_id is not null",
    ),
    "restaurants": (
        ("raw_restaurants",),
        "select id as merchant_id, cast(enabled as boolean) as enabled, "
        "cast(price_range as int) as price_range, "
        "case when average_ticket >= 0 then average_ticket end as average_ticket, "
        "case when delivery_time >= 0 then delivery_time end as delivery_time, "
        "case when minimum_order_value >= 0 then minimum_order_value end as minimum_order_value, "
        "merchant_zip_code, merchant_city, merchant_state, merchant_country, "
        "try_strptime(created_at, '%Y-%m-%d %H:%M:%S') as merchant_created_at "
        "from raw_restaurants where id is not null",
    ),
    "abmap": (
        ("raw_abmap",),
        "select customer_id, min(case "
        "when lower(ab_group) in ('treatment', 'teste', 'b', '1') then 1 "
        "when lower(ab_group) in ('control', 'controle', 'a', '0') then 0 "
        "else try_cast(ab_group as int) end) as is_target from raw_abmap group by customer_id",
    ),
    "silver": (
        ("clean", "consumers", "restaurants", "abmap"),
        "select c.order_id, c.customer_id, c.merchant_id, c.event_ts_utc, c.event_date_brt, "
        "c.created as order_created_at, c.order_scheduled, c.order_total_amount, "
        "c.platform as origin_platform, c.basket_size, a.is_target, p.language, p.active, "
        "p.consumer_created_at, r.enabled, r.price_range, r.average_ticket, r.delivery_time, "
        "r.minimum_order_value, r.merchant_city, r.merchant_state, r.merchant_country, "
        "r.merchant_created_at, p.phone_hash from clean c "
        "join abmap a on a.customer_id = c.customer_id and a.is_target is not null "
        "left join consumers p on p.customer_id = c.customer_id "
        "left join restaurants r on r.merchant_id = c.merchant_id "
        f"where c.event_ts_utc >= {START} and c.event_ts_utc < {END}",
    ),
    "means": (
        ("silver",),
        "select price_range, avg(minimum_order_value) as mov, avg(delivery_time) as dlv "
        "from silver group by price_range",
    ),
    "enriched": (
        ("silver", "means"),
        "select s.*, coalesce(s.origin_platform, 'unknown') as origin_platform_clean, "
        "coalesce(lower(s.language), 'unknown') as language_clean, "
        "case when s.active is null then 'unknown' when s.active then 'true' else 'false' end "
        "as active_clean, "
        "coalesce(s.minimum_order_value, m.mov) as minimum_order_value_imputed, "
        "coalesce(s.delivery_time, m.dlv) as delivery_time_imputed "
        "from silver s left join means m on m.price_range = s.price_range",
    ),
    "users": (
        ("silver",),
        "select customer_id, max(event_ts_utc) as last_order, count(*) as frequency, "
        "sum(order_total_amount) as monetary, min(is_target) as is_target, "
        "min(consumer_created_at) as consumer_created_at, "
        "last(origin_platform order by event_ts_utc, order_id) "
        "filter (where origin_platform is not null) as origin_platform, "
        "bool_or(active) as active, "
        f"cast(date_diff('day', cast(max(event_ts_utc) as date), cast({END} as date)) as int) "
        "as recency, "
        f"(min(consumer_created_at) >= {START} and min(consumer_created_at) < {END}) "
        "as is_new_customer, count(*) >= 3 as heavy_user, "
        "case when count(*) > 0 then sum(order_total_amount) / count(*) end as aov_user "
        "from silver group by customer_id",
    ),
    "recent": (
        ("users",),
        "select * replace (cast(date_diff('day', cast(last_order as date), "
        "cast((select max(last_order) from users) as date)) as int) as recency) from users",
    ),
    "cuts": (
        ("recent",),
        "select "
        + ", ".join(
            f"quantile_disc({c}, [0.2, 0.4, 0.6, 0.8]) as {c[0]}q"
            for c in ("recency", "frequency", "monetary")
        )
        + " from recent",
    ),
    "scored": (
        ("recent", "cuts"),
        "select *, concat(r_score, f_score, m_score) as rfm_segment from (select recent.*, "
        + ", ".join(
            f"case when {c} is null then 3 else {v} end as {c[0]}_score"
            for c, v in {
                "recency": "5 - (recency > rq[1])::int - (recency > rq[2])::int "
                           "- (recency > rq[3])::int - (recency > rq[4])::int",
                "frequency": "1 + (frequency > fq[1])::int + (frequency > fq[2])::int "
                             "+ (frequency > fq[3])::int + (frequency > fq[4])::int",
                "monetary": "1 + (monetary > mq[1])::int + (monetary > mq[2])::int "
                            "+ (monetary > mq[3])::int + (monetary > mq[4])::int",
            }.items()
        )
        + " from recent cross join cuts)",
    ),
    "long": (
        ("scored",),
        "select *, 'monetary' as metric, monetary as v from scored union all "
        "select *, 'frequency', frequency::double from scored union all "
        "select *, 'aov_user', aov_user from scored",
    ),
}


def _query(needs: str | tuple[str, ...], body: str) -> str:
    """A statement with the steps it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in _STEPS[name][0]:
                visit(need)
            order.append(name)

    for name in (needs,) if isinstance(needs, str) else needs:
        visit(name)
    steps = ",\n".join(f"{n} as (\n{_STEPS[n][1]}\n)" for n in order)
    return f"with {steps}\n{body}"


def _r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) as {name or expr}"


MEANS = ", ".join(
    [
        "count(distinct customer_id) as usuarios",
        _r("avg(frequency)", "pedidos_user"),
        _r("avg(monetary)", "gmv_user"),
        _r("avg((frequency > 0)::int::double)", "conversao"),
        _r("avg(aov_user)", "aov"),
    ]
)

_ROBUST = {"monetary": "gmv_user", "frequency": "pedidos_user", "aov_user": "aov_user"}


def _robust(keys: str, method: str = "disc", where: str = "true") -> str:
    def one(stat: str, p: str, metric: str, name: str) -> str:
        expr = f"quantile_{method}({metric}, {p})"
        if method == "disc" and metric == "frequency":
            return f"{expr} as {stat}_{name}"
        return _r(expr, f"{stat}_{name}")

    stats = ", ".join(
        one(stat, p, m, n) for stat, p in (("median", "0.5"), ("p95", "0.95"))
        for m, n in _ROBUST.items()
    )
    heavy = _r("sum((coalesce(frequency, 0) >= 3)::int)::double / count(customer_id)",
               "heavy_users_rate")
    group = ", ".join(k.split(" as ")[0] for k in keys.split(", "))
    return (
        f"select {keys}, count(distinct customer_id) as usuarios, {stats}, {heavy}, "
        f"3 as heavy_threshold from scored where {where} group by {group}"
    )


def _arms(segment: str | None, source: str = "scored", more: str = "") -> str:
    """Both arms per segment, joined the long way round."""
    key = f"{segment}" if segment else "'ALL'"

    def side(arm: int) -> str:
        return (
            f"(select {key} as segment{more}, count(distinct customer_id) as n, "
            f"avg(monetary) as gmv from {source} where is_target = {arm} "
            f"group by all)"
        )

    extra = "".join(f" and t.{c.strip()} = c.{c.strip()}" for c in more.split(",") if c.strip())
    columns = "".join(f", t.{c.strip()}" for c in more.split(",") if c.strip())
    return (
        f"select t.segment{columns}, t.n as nt, c.n as nc, t.gmv as gt, c.gmv as gc "
        f"from {side(1)} t join {side(0)} c on t.segment = c.segment{extra}"
    )


def _money(arms: str, cost: str = COST, more: str = "") -> str:
    inner = (
        f"select *, gt - gc as up, {RATE} * (gt - gc) * nt as rev, {cost} * {REDEEM} * nt as cst, "
        f"{cost} * {REDEEM} / {RATE} as needed from ({arms}){more}"
    )
    return f"select *, rev - cst as profit from ({inner})"


BREAK_EVEN = ", ".join(
    [
        "segment",
        "nt as usuarios_trat",
        _r("gc", "gmv_ctrl"),
        _r("gt", "gmv_trat"),
        _r("up", "uplift_gmv_user"),
        _r("needed", "uplift_needed"),
        _r("up - needed", "gap_uplift"),
        _r("rev", "receita_total"),
        _r("cst", "custo_total"),
        _r("profit", "lucro_total"),
        _r("profit / nt", "lucro_por_usuario"),
        _r("profit / cst", "roi_percent"),
        "case when profit / nt >= 0 then 'OK' else 'NEG' end as status",
    ]
)
STATUS = "case when profit / nt >= 0 then 'OK' else 'NEG' end"
PREMISES = f"{RATE} as take_rate, {COST} as coupon_cost, {REDEEM} as redemption_rate"
FINANCE = ", ".join(
    [
        "segment",
        "nt as n_treated",
        _r("gt", "gmv_user_treat"),
        _r("gc", "gmv_user_ctrl"),
        _r("up", "uplift_gmv_user"),
        PREMISES,
        _r("rev", "receita_incremental_total"),
        _r("cst", "custo_total"),
        _r("profit", "lucro_incremental_total"),
        _r("profit / nt", "roi_por_usuario"),
        _r("profit / cst", "roi_percent"),
    ]
)


def _z_tails(z: str) -> str:
    """Two-sided normal tail: one less the midpoint sum of the density inside."""
    inside = f"list_sum(list_transform(range(0, 4000), lambda i: exp(-pow((i + 0.5::double) * abs({z}) / 4000, 2) / 2)))"
    tails = f"greatest(0::double, 1 - {inside} * abs({z}) / 4000 * sqrt(2 / pi()))"
    return f"case when ({z}) is not null then {tails} end"


def _t_tails(t: str, df: str) -> str:
    """Two-sided t tail in the same way, with the constant from the gamma function."""
    inside = (
        f"list_sum(list_transform(range(0, 4000), lambda i: "
        f"pow(1 + pow((i + 0.5::double) * abs({t}) / 4000, 2) / ({df}), -(({df}) + 1) / 2)))"
    )
    scale = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi())"
    tails = f"greatest(0::double, 1 - 2 * {inside} * abs({t}) / 4000 * {scale})"
    return f"case when ({t}) is not null then {tails} end"


def _nonparam(keys: str, metrics: dict[str, str], segment: str | None) -> str:
    """Mann-Whitney by counting, per value, the controls below."""
    seg = f"{segment} as segment, " if segment else ""
    part = "segment, metric" if segment else "metric"
    keep = f"and {segment} is not null" if segment else ""
    names = "case metric " + " ".join(f"when '{m}' then '{n}'" for m, n in metrics.items()) + " end"
    wanted = ", ".join(f"'{m}'" for m in metrics)
    return f"""
, vals as (
  select {seg}metric, v, count(*) filter (where is_target = 1) as n1,
         count(*) filter (where is_target = 0) as n0
  from long where v is not null and is_target in (0, 1) and metric in ({wanted}) {keep}
  group by all
), ranked as (
  select *, coalesce(sum(n0) over (partition by {part} order by v
    rows between unbounded preceding and 1 preceding), 0)::double as below from vals
), sums as (
  select {part}, sum(n1)::bigint as n1, sum(n0)::bigint as n0,
         sum(n1 * (below + n0 / 2.0::double)) as u,
         sum(pow(n1 + n0, 3) - (n1 + n0)) as ties
  from ranked group by all
), tested as (
  select *, n1::double * n0 as pairs, (n1 + n0)::double as n from sums
), zed as (
  select *, case when n1 > 0 and n0 > 0 and n > 1 then
      pairs / 12 * ((n + 1) - ties / (n * (n - 1))) end as spread,
    case when n1 > 0 and n0 > 0 and n > 1 then (greatest(u, pairs - u) - pairs / 2 - 0.5::double)
      / nullif(sqrt(pairs / 12 * ((n + 1) - ties / (n * (n - 1)))), 0) end as z0
  from tested
)
select {"segment, " if segment else ""}{names} as metric, n1 as n_treat, n0 as n_ctrl,
  round(case when n1 > 0 and n0 > 0 then u end, 6) as "U",
  round(z0, 6) as z,
  round(case when spread <= 0 or z0 < 0 then 1 else {_z_tails("z0")} end, 6) as pval,
  case when n1 > 0 and n0 > 0 then 'asymptotic' end as method
from zed"""


def _nonparam_auto(keys: str, metrics: dict[str, str], segment: str) -> str:
    """The same with the exact p where it applies: U counted over all lattice paths.

    A path adds one value after the other in rising order; a treated value scores the
    controls below it. Paths are counted by (treated, controls, U) step by step.
    """
    plain = _nonparam(keys, metrics, segment).partition("select segment, case metric")
    return plain[0].replace("zed as (", "zed as materialized (") + f"""
, wanted as (
  select distinct least(n1, n0) as m, greatest(n1, n0) as n from zed
  where n1 > 0 and n0 > 0 and ties = 0 and least(n1, n0) <= 8
), paths as (
  with recursive c as (
    select 0::bigint as m, 0::bigint as n, 0::bigint as u, 1::double as w
    union all
    select m, n, u, sum(w) from (
      select m + 1 as m, n, u + n as u, w from c where m < (select max(m) from wanted)
      union all
      select m, n + 1, u, w from c where n < (select max(n) from wanted)
    ) group by m, n, u
  )
  select c.* from c join wanted using (m, n)
), exact as (
  select z.segment, z.metric,
    least(1, 2 * sum(w) filter (where u2 <= least(z.u, z.pairs - z.u)) / sum(w)) as p
  from zed z join (select m, n, u as u2, w from paths) x
    on x.m = least(z.n1, z.n0) and x.n = greatest(z.n1, z.n0)
  where z.ties = 0 and z.n1 > 0 and z.n0 > 0
  group by z.segment, z.metric
), told as (
  select segment, case metric{plain[2].rpartition("from zed")[0]} , metric as m0 from zed
)
select t.segment, t.metric, n_treat, n_ctrl, "U", z, round(coalesce(e.p, pval), 6) as pval,
  case when e.p is not null then 'exact' else method end as method
from told t left join exact e on e.segment = t.segment and e.metric = t.m0"""


_RANKED = {"monetary": "gmv_user_mw", "frequency": "pedidos_user_mw", "aov_user": "aov_user_mw"}

_MOMENTS = """
, m as (
  select metric, count(v) filter (where is_target = 1) as n1,
    count(v) filter (where is_target = 0) as n0,
    avg(v) filter (where is_target = 1) as m1, avg(v) filter (where is_target = 0) as m0,
    var_samp(v) filter (where is_target = 1) as v1,
    var_samp(v) filter (where is_target = 0) as v0
  from {src} group by metric
), w as (
  select *, v1 / n1 as s1, v0 / n0 as s0 from m
), tests as (
  select *, (m1 - m0) / sqrt(s1 + s0) as t0,
    pow(s1 + s0, 2) / (s1 * s1 / (n1 - 1) + s0 * s0 / (n0 - 1)) as df0 from w
)
"""
_WELCH = f"round(t0, 6) as t, round(df0, 6) as df, round({_t_tails('t0', 'df0')}, 6) as pval"


def _ztest(flag: str, name: str) -> str:
    return f"""
, p as (
  select count(*) filter (where is_target = 1) as n1, count(*) filter (where is_target = 0) as n0,
    avg({flag}) filter (where is_target = 1) as p1, avg({flag}) filter (where is_target = 0) as p0
  from users
), e as (
  select *, (p1 * n1 + p0 * n0) / (n1 + n0) as pool from p
), s as (
  select *, sqrt(pool * (1 - pool) * (1.0::double / n1 + 1.0::double / n0)) as se from e
)
select '{name}' as metric, n1 as n_treat, n0 as n_ctrl, {_r('p1', 'p_treat')},
  {_r('p0', 'p_ctrl')}, round(case when se > 0 then (p1 - p0) / se end, 6) as z,
  round(case when se > 0 then {_z_tails("((p1 - p0) / se)")} end, 6) as pval from s"""


def _winsor(p: str) -> str:
    clipped = ", ".join(
        f"round(case when {c} is not null then least(greatest({c}::double, {c}_lo), {c}_hi) end, 6) "
        f"as {c}"
        for c in _ROBUST
    )
    bounds = ", ".join(
        f"quantile_cont({c}::double, {p}) as {c}_lo, quantile_cont({c}::double, 1 - {p}) as {c}_hi"
        for c in _ROBUST
    )
    return f"select customer_id, is_target, {clipped} from users, (select {bounds} from users) b"


def _by_arm_bounds() -> str:
    clipped = ", ".join(
        f"round(case when {c} is not null then least(greatest({c}::double, {c}_lo), {c}_hi) end, 6) "
        f"as {c}"
        for c in _ROBUST
    )
    bounds = ", ".join(
        f"quantile_cont({c}::double, 0.01) as {c}_lo, quantile_cont({c}::double, 0.99) as {c}_hi"
        for c in _ROBUST
    )
    return (
        f"select customer_id, is_target, {clipped} from users join "
        f"(select is_target, {bounds} from users group by is_target) b using (is_target) "
        "where is_target in (0, 1)"
    )


_CLIPPED_LONG = """
, vals as (
  select is_target, metric, least(greatest(v, lo), hi) as v from long join (
    select is_target, metric, quantile_cont(v, 0.01) as lo, quantile_cont(v, 0.99) as hi
    from long where v is not null group by all) b using (is_target, metric)
  where v is not null
)
"""
_PLATFORM_LONG = """
, vals as (
  select origin_platform, is_target, metric, v from long where v is not null and metric = 'monetary'
)
"""


def _box(keys: str, on: str) -> str:
    return f"""
, q as (
  select {keys}, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as med,
    quantile_cont(v, 0.75) as q3 from vals group by all
), f as (
  select *, q1 - 1.5::double * (q3 - q1) as lo, q3 + 1.5::double * (q3 - q1) as hi from q
)
select {", ".join("vals." + k.strip() for k in keys.split(","))}, count(*) as n,
  {_r("any_value(q1)", "q1")}, {_r("any_value(med)", "median")}, {_r("any_value(q3)", "q3")},
  {_r("least(min(v) filter (where v between lo and hi), any_value(q1))", "whisker_lo")},
  {_r("greatest(max(v) filter (where v between lo and hi), any_value(q3))", "whisker_hi")},
  count(*) filter (where not (v between lo and hi)) as n_outliers
from vals join f on {on} group by all"""


def _hist(keys: str, on: str, bins: int) -> str:
    return f"""
, s0 as (
  select {keys}, min(v) as a, max(v) as b, count(*) as total from vals group by all
), s as (
  select * exclude (a, b), case when a = b then a - 0.5 else a end as lo,
    case when a = b then b + 0.5 else b end as hi from s0
), b as (
  select {", ".join("vals." + k.strip() for k in keys.split(","))}, lo, hi, total,
    least(cast(floor((v - lo) * {bins} / (hi - lo)) as int), {bins - 1}) as bin
  from vals join s on {on}
)
select {keys}, bin, round(lo + bin * ((hi - lo) / {bins}), 6) as bin_lo,
  round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) as bin_hi, count(*) as n,
  round(count(*) / (total * ((hi - lo) / {bins})), 6) as density
from b group by {keys}, bin, lo, hi, total"""


_SAME_PLATFORM = (
    "vals.origin_platform is not distinct from {t}.origin_platform "
    "and vals.is_target = {t}.is_target and vals.metric = {t}.metric"
)
_SAME_ARM = "vals.is_target = {t}.is_target and vals.metric = {t}.metric"
_HASH = "('0x' || substr(md5(customer_id || ':42'), 1, 8))::bigint"
_DUP = "merchant_id, event_date_brt, origin_platform"


def _bars(which: str) -> str:
    return (
        f"select segment, is_target, {which}_gmv_user as gmv_user, "
        f"{which}_pedidos_user as pedidos_user, {which}_aov_user as aov from ("
        + _robust("heavy_user as segment, is_target")
        + ")"
    )


def _group_name(col: str = "is_target") -> str:
    return f"case {col} when 0 then 'Controle' when 1 then 'Tratamento' end"


def _projection(profit: str, factor: str, share: str) -> str:
    return (
        f"select round_even({profit}, 0) as lucro_periodo_selecionados, "
        f"round_even({profit} * {factor} * {share}, 0) as projecao_anual, "
        f"round({factor}, 6) as fator_anual, round_even({share}, 3) as cobertura_aplicada"
    )


def _platform_money() -> str:
    return (
        f", be as (select *, {STATUS} as status from ({_money(_arms('origin_platform'))})), "
        f"hv as (select *, {STATUS} as status from ({_money(_arms('heavy_user'))})) "
    )


_KEPT_PROFIT = "coalesce((select sum(profit) from be where status = 'OK'), 0::double)"


def _coverage(where: str = "true", status: str = "OK") -> str:
    base = f"from scored where is_target = 1 and {where}"
    return (
        f"((select count(*) {base} and origin_platform in "
        f"(select segment from be where status = '{status}'))::double / "
        f"greatest((select count(*) {base}), 1))"
    )


_NULL_COLUMNS = (
    "order_id", "customer_id", "merchant_id", "event_ts_utc", "order_total_amount", "is_target",
    "price_range", "language", "active", "delivery_time_imputed", "minimum_order_value_imputed",
)
_SILVER = (
    "order_id, customer_id, merchant_id, event_ts_utc, event_date_brt, order_created_at, "
    "order_scheduled, round(order_total_amount, 6) as order_total_amount, origin_platform, "
    "basket_size, is_target, language, active, consumer_created_at, enabled, price_range, "
    "round(average_ticket, 6) as average_ticket, round(delivery_time, 6) as delivery_time, "
    "round(minimum_order_value, 6) as minimum_order_value, merchant_city, merchant_state, "
    "merchant_country, merchant_created_at"
)
_USER = (
    "customer_id, last_order, frequency, round(monetary, 6) as monetary, is_target, "
    "consumer_created_at, origin_platform, active, recency, is_new_customer, heavy_user"
)


def _window(lo: str, hi: str) -> str:
    return (
        f"select cast({lo} as date) as window_start, cast({hi} as date) + 1 as window_end "
        "from clean"
    )


_EPOCH = "epoch(event_ts_utc)::bigint"
_Q01 = f"to_timestamp(quantile_disc(floor(epoch(event_ts_utc))::bigint, 0.01)) at time zone 'UTC'"
_Q99 = _Q01.replace("0.01", "0.99")


def sql() -> dict[str, str]:
    q = _query
    out = {
        "parse_timestamps": q("parsed", "select order_id, order_created_at, created, scheduled from parsed"),
        "utc_normalize": q("timed", "select order_id, merchant_timezone, created as order_created_at, created_utc, scheduled_utc from timed"),
        "event_time": q("dated", "select order_id, order_scheduled, event_ts_utc, event_date_brt from dated"),
        "basket_size": q("raw_orders", f"select order_id, {_basket()} as basket_size from raw_orders"),
        "pii_hash": q("raw_orders", f"select order_id, {_r('order_total_amount')}, sha256(cpf) as cpf_hash from raw_orders"),
        "conform_orders": q("clean", f"""select order_id, customer_id, merchant_id,
            {_r('order_total_amount')}, created as order_created_at, order_scheduled,
            scheduled as order_scheduled_date, platform as origin_platform, merchant_timezone,
            case when merchant_latitude between -90 and 90 then merchant_latitude end as merchant_latitude,
            case when merchant_longitude between -180 and 180 then merchant_longitude end as merchant_longitude,
            items, created_utc, scheduled_utc, event_ts_utc, event_date_brt, basket_size,
            sha256(cpf) as cpf_hash from clean"""),
        "dedup_orders": q("parsed", f"""select order_id, {_r('order_total_amount')}, created from parsed
            qualify row_number() over (partition by order_id order by created asc nulls last,
            parsed.order_total_amount asc nulls last) = 1"""),
        **dict.fromkeys(
            ("orders_from_json_shards", "orders_from_json_array", "orders_from_gzip_array", "orders_from_gzip_lines"),
            q("raw_orders", """select order_id, customer_id, merchant_id, order_created_at,
            cast(order_scheduled as varchar) as order_scheduled, origin_platform, items, cpf from raw_orders"""),
        ),
        "consumers_from_csv": q("consumers", "select * from consumers"),
        "abmap_from_folder": q("abmap", "select customer_id, is_target from abmap"),
        "abmap_mixed_headers": q("abmap", "select customer_id, is_target from abmap"),
        "raw_manifest": q(("raw_orders", "raw_consumers", "raw_abmap"), """
            select 'orders' as raw, 'gzip' as kind, 3::bigint as n_files, 3::bigint as n_whole, count(*) as n_lines from raw_orders
            union all select 'consumers', 'gzip', 2, 2, count(*) from raw_consumers
            union all select 'abmap', 'plain', 2, 2, count(*) from raw_abmap"""),
        "load_raw_folder": q(("raw_orders", "raw_consumers", "raw_restaurants", "raw_abmap"), """
            select 'orders' as raw, count(*) as n_rows, count(distinct order_id) as n_keys from raw_orders
            union all select 'consumers', count(*), count(distinct customer_id) from raw_consumers
            union all select 'restaurants', count(*), count(distinct id) from raw_restaurants
            union all select 'abmap', count(*), count(distinct customer_id) from raw_abmap"""),
        "preflight_report": q(("raw_orders", "raw_consumers", "raw_restaurants", "raw_abmap"), """
            select key, true as exists, lines_read, null::varchar as problem, 4::bigint as n_maps,
              'ndjson_or_objects' as orders_format
            from (select 'orders' as key, count(*) as lines_read from raw_orders
              union all select 'consumers', count(*) + 1 from raw_consumers
              union all select 'restaurants', count(*) + 1 from raw_restaurants
              union all select 'ab_tar', null union all select 'ab_csv', null)"""),
        "abmap_from_tar": q("abmap", "select customer_id, is_target from abmap"),
        "tar_lines": q("raw_abmap", "select customer_id from raw_abmap"),
        "silver_by_date": q("silver", f"""select order_id, event_ts_utc, {_r('order_total_amount')} from silver
            where event_ts_utc >= timestamp '1997-06-01 00:00:00' and event_ts_utc < timestamp '1997-09-01 00:00:00'"""),
        "silver_days_replaced": q("silver", f"select order_id, event_ts_utc, {_r('order_total_amount')} from silver"),
        "users_folded": q("users", f"select {_USER} from users"),
        "robust_from_sketches": q("users", """select is_target, metric, count(v) as n, true as median_in_bound, true as p95_in_bound
            from (select is_target, unnest(['monetary', 'frequency', 'aov_user']) as metric,
                  unnest([monetary, frequency::double, aov_user]) as v from users)
            where v is not null and not isnan(v) group by 1, 2"""),
        "distinct_users_from_sketches": q("silver", """select origin_platform, count(distinct customer_id) as n_exact, true as in_bound
            from silver group by 1"""),
        "shared_users_from_sketches": q("silver", """select count(*) filter (where a and i) as n_both, count(*) filter (where a or i) as n_either,
            true as both_in_bound, true as either_in_bound
            from (select customer_id, coalesce(bool_or(origin_platform = 'android'), false) as a,
                  coalesce(bool_or(origin_platform = 'ios'), false) as i from silver group by 1)"""),
        "break_even_from_csv": q("scored", f"""select segment, nt as usuarios_trat, {STATUS} as status
            from ({_money(_arms('origin_platform'))})"""),
        "projection_selected_segments": q("scored", _platform_money() + _projection(
            "coalesce((select sum(profit) from be where segment in ('android', 'ios')), 0::double)", "12.0::double",
            "((select count(*) from scored where is_target = 1 and origin_platform in ('android', 'ios'))::double"
            " / greatest((select count(*) from scored where is_target = 1), 1))")),
        "conform_consumers": q("consumers", "select * from consumers"),
        "conform_restaurants": q("restaurants", "select * replace (round(average_ticket, 6) as average_ticket) from restaurants"),
        "conform_abmap": q("abmap", "select customer_id, is_target from abmap"),
        "infer_window_minmax": q("clean", _window("min(event_ts_utc)", "max(event_ts_utc)")),
        "infer_window_quantile": q("clean", _window(_Q01, _Q99)),
        "experiment_window": q("clean", f"""select order_id, event_ts_utc, {_r('order_total_amount')}
            from clean where event_ts_utc >= {START} and event_ts_utc < {END}"""),
        "fact_join": q(("clean", "consumers", "restaurants", "abmap"), f"""
            , win as ({_window(_Q01, _Q99)})
            select c.order_id, c.customer_id, c.merchant_id, c.event_ts_utc, a.is_target, p.language,
            p.phone_hash, r.price_range, r.merchant_city from clean c
            join abmap a on a.customer_id = c.customer_id and a.is_target is not null
            left join consumers p on p.customer_id = c.customer_id
            left join restaurants r on r.merchant_id = c.merchant_id, win
            where c.event_ts_utc >= window_start and c.event_ts_utc < window_end"""),
        "assignment_policy": q(("clean", "abmap"), f"""select coalesce(a.is_target, 0) as is_target,
            count(*) as n_orders, {_r('sum(c.order_total_amount)', 'gmv')} from clean c
            left join abmap a on a.customer_id = c.customer_id
            where c.event_ts_utc >= {START} and c.event_ts_utc < {END} group by 1"""),
        "orders_silver": q("silver", f"select {_SILVER} from silver"),
        "enrich_orders": q("enriched", f"""select order_id, origin_platform_clean, language_clean, active_clean,
            {_r('minimum_order_value_imputed')}, {_r('delivery_time_imputed')} from enriched"""),
        "impute_by_range": q("enriched", f"""select order_id, price_range, {_r('minimum_order_value')},
            {_r('minimum_order_value_imputed')}, {_r('delivery_time')}, {_r('delivery_time_imputed')} from enriched"""),
        "user_aggregates": q("users", f"select {_USER} from users"),
        "users_from_raw": q("users", f"select {_USER} from users"),
        "recency_last_event": q("recent", "select customer_id, last_order, recency from recent"),
        "orders_per_customer": q("clean", "select customer_id, count(*) as n_orders from clean group by customer_id"),
        "user_metrics": q("users", f"select customer_id, is_target, frequency, {_r('monetary')}, {_r('aov_user')}, (frequency > 0)::int as conv_flag from users"),
        "period_days": q("users", "select coalesce(nullif(date_diff('day', cast(min(last_order) as date), cast(max(last_order) as date)), 0), 30)::int as period_days from users"),
        "ab_summary": q("users", f"select is_target, {MEANS} from users group by is_target"),
        "ab_robust": q("scored", _robust("is_target")),
        "ab_robust_exact": q("scored", _robust("is_target", "cont")),
        "ab_by_heavy": q("scored", f"select heavy_user, is_target, {MEANS} from scored group by 1, 2"),
        "ab_by_new": q("scored", f"select is_new_customer, is_target, {MEANS} from scored group by 1, 2"),
        "ab_by_platform": q("scored", f"select origin_platform, is_target, {MEANS} from scored group by 1, 2"),
        "ab_by_rfm_top10": q("scored", f"""select rfm_segment, is_target, {MEANS} from scored
            where rfm_segment in (select rfm_segment from scored group by 1
            order by count(distinct customer_id) desc, rfm_segment limit 10) group by 1, 2"""),
        "ab_by_all_segments": q("scored", " union all ".join(
            f"select '{c}' as segment_name, cast({c} as varchar) as segment, is_target, {MEANS} from scored group by all"
            for c in ("heavy_user", "is_new_customer", "origin_platform", "rfm_segment"))),
        "robust_by_heavy": q("scored", _robust("heavy_user as segment, is_target")),
        "robust_by_new": q("scored", _robust("is_new_customer as segment, is_target")),
        "robust_by_platform": q("scored", _robust("origin_platform as segment, is_target")),
        "robust_by_rfm": q("scored", _robust("rfm_segment as segment, is_target")),
        "robust_by_platform_exact": q("scored", _robust("origin_platform as segment, is_target", "cont", "origin_platform is not null")),
        "heavy_rate_pivot": q("scored", """select origin_platform as segment,
            round(avg((frequency >= 3)::int) filter (where is_target = 0), 6) as "Controle",
            round(avg((frequency >= 3)::int) filter (where is_target = 1), 6) as "Tratamento"
            from scored group by 1"""),
        "bars_median": q("scored", _bars("median")),
        "bars_p95": q("scored", _bars("p95")),
        "segment_bars_long": q("scored", f"""
            , t as (select rfm_segment as segment, is_target, avg(monetary) as gmv_user,
              avg(frequency) as pedidos_user, avg(aov_user) as aov from scored where is_target in (0, 1) group by 1, 2),
            cells as (select s.segment, g.is_target, m.metric from (select distinct segment from t) s,
              (values (0), (1)) g(is_target), (values ('gmv_user'), ('pedidos_user'), ('aov')) m(metric))
            select c.segment, c.is_target, {_group_name('c.is_target')} as grupo, c.metric,
              round(case c.metric when 'gmv_user' then gmv_user when 'pedidos_user' then pedidos_user else aov end, 6) as value
            from cells c left join t on t.segment = c.segment and t.is_target = c.is_target"""),
        "group_bars_long": q("users", f"""
            , t as (select is_target, avg(monetary) as gmv_user, avg(frequency) as pedidos_user, avg(aov_user) as aov from users group by 1)
            select is_target, {_group_name()} as grupo, metric, round(v, 6) as value from (
            select is_target, 'gmv_user' as metric, gmv_user as v from t union all
            select is_target, 'pedidos_user', pedidos_user from t union all select is_target, 'aov', aov from t)"""),
        "rfm_scores": q("scored", "select customer_id, r_score, f_score, m_score, rfm_segment from scored"),
        "rfm_tiers": q("scored", f"""select case when r_score + f_score + m_score <= 7 then 'low'
            when r_score + f_score + m_score <= 11 then 'mid' else 'high' end as rfm_tier, is_target,
            count(*) as usuarios, {_r('avg(monetary)', 'gmv_user')} from scored group by 1, 2"""),
        "hash_sample": q("users", f"""select customer_id, is_target, frequency, {_r('monetary')}, {_r('aov_user')},
            (frequency > 0)::int as conv_flag, heavy_user, is_new_customer, origin_platform
            from users where {_HASH} < cast(floor(0.15 * 4294967296) as bigint)"""),
        "hash_sample_capped": q("users", f"""select customer_id, is_target, {_r('monetary')} from users
            where {_HASH} < 2147483648 order by {_HASH}, customer_id limit 100"""),
        "rfm_for_sample": q("scored", f"""select customer_id, rfm_segment from scored
            where {_HASH} < cast(floor(0.15 * 4294967296) as bigint)"""),
        "winsorize_global": q("users", _winsor("0.01")),
        "winsorize_2pct": q("users", _winsor("0.02")),
        "winsorize_by_group": q("users", _by_arm_bounds()),
        "winsorized_means": q("users", f"""select is_target, {_r('avg(monetary)', 'monetary')},
            {_r('avg(frequency)', 'frequency')}, {_r('avg(aov_user)', 'aov_user')} from ("""
            + _winsor("0.01").replace("round(", "(").replace(" end, 6)", " end)") + ") group by is_target"),
        "welch_ttest": q("long", _MOMENTS.format(src="long") + f"""select metric, n1 as n_treat, n0 as n_ctrl,
            {_r('m1', 'mean_treat')}, {_r('m0', 'mean_ctrl')}, {_WELCH} from tests"""),
        "mann_whitney": q("long", _nonparam("metric", {"monetary": "monetary"}, None)),
        "ztest_conversion": q("users", _ztest("(frequency > 0)::int", "conv_flag")),
        "ztest_heavy_rate": q("users", _ztest("heavy_user::int", "heavy")),
        "ab_tests": q("long", _MOMENTS.format(src="long") + f"""select case metric when 'monetary' then 'gmv_user'
            when 'frequency' then 'pedidos_user' else 'aov' end as metric, 'welch' as method, n1 as n_treat,
            n0 as n_ctrl, {_WELCH}, cast(null as double) as z from tests
            union all select 'conversao', 'z', count(*) filter (where is_target = 1),
            count(*) filter (where is_target = 0), null, null, null, null from scored"""),
        "nonparam_tests": q("long", _nonparam("metric", _RANKED, None)),
        "nonparam_by_heavy": q("long", _nonparam("metric", _RANKED, "heavy_user")),
        "nonparam_by_new": q("long", _nonparam("metric", _RANKED, "is_new_customer")),
        "nonparam_by_platform": q("long", _nonparam("metric", _RANKED, "origin_platform")),
        "nonparam_by_rfm": q("long", _nonparam("metric", _RANKED, "rfm_segment")),
        "nonparam_by_rfm_auto": q("long", _nonparam_auto("metric", _RANKED, "rfm_segment")),
        "financial_viability": q("scored", f"""select nt as n_treated, {_r('gt', 'gmv_user_treat')},
            {_r('gc', 'gmv_user_ctrl')}, {_r('up', 'uplift_gmv_user')}, {PREMISES},
            {_r('rev', 'receita_incremental_total')}, {_r('cst', 'custo_total')}, {_r('profit', 'roi_absoluto')},
            {_r('profit / nt', 'roi_por_usuario')}, {_r(f'{RATE} * gt', 'ltv')}, {COST} as cac,
            {_r(f'{RATE} * gt / {COST}', 'ltv_cac')}, {_r('profit / cst', 'roi_percent')}
            from ({_money(_arms(None))})"""),
        "finance_by_heavy": q("scored", f"select {FINANCE} from ({_money(_arms('heavy_user'))})"),
        "finance_by_platform": q("scored", f"select {FINANCE} from ({_money(_arms('origin_platform'))})"),
        "break_even_overall": q("scored", f"select {BREAK_EVEN} from ({_money(_arms(None))})"),
        "break_even_heavy": q("scored", f"select {BREAK_EVEN} from ({_money(_arms('heavy_user'))})"),
        "break_even_platform": q("scored", f"select {BREAK_EVEN} from ({_money(_arms('origin_platform'))})"),
        "break_even_rounded": q("scored", f"""select segment, nt as usuarios_trat, round_even(gc, 2) as gmv_ctrl,
            round_even(gt, 2) as gmv_trat, round_even(up, 2) as uplift_gmv_user, round_even(needed, 2) as uplift_needed,
            round_even(up - needed, 2) as gap_uplift, round_even(rev, 0) as receita_total, round_even(cst, 0) as custo_total,
            round_even(profit, 0) as lucro_total, round_even(profit / nt, 2) as lucro_por_usuario,
            round_even(profit / cst, 3) as roi_percent, {STATUS} as status from ({_money(_arms('origin_platform'))})"""),
        "coverage_share": q("scored", _platform_money() + f"""select
            (select count(*) from scored where is_target = 1 and origin_platform in (select segment from be where status = 'NEG')) as covered,
            (select count(*) from scored where is_target = 1) as treated, round({_coverage(status='NEG')}, 6) as coverage"""),
        "projection_platform": q("scored", _platform_money() + _projection(_KEPT_PROFIT, "12.0::double", _coverage())),
        "projection_continuous": q("scored", _platform_money() + _projection(_KEPT_PROFIT,
            "(365.0::double / (select coalesce(nullif(date_diff('day', cast(min(last_order) as date), cast(max(last_order) as date)), 0), 30) from users))",
            "1.0::double")),
        "projection_excluding_neg": q("scored", _platform_money() + _projection(_KEPT_PROFIT, "12.0::double",
            _coverage("heavy_user not in (select segment from hv where status = 'NEG')"))),
        "dq_time_range": q("silver", "select min(event_ts_utc) as min_utc, max(event_ts_utc) as max_utc from silver"),
        "dq_ab_split": q("users", "select is_target, count(*) as n_users from users group by is_target"),
        "dq_null_counts": q("enriched", " union all ".join(
            f"select '{c}' as column_name, count(*) - count({c}) as n_nulls from enriched" for c in _NULL_COLUMNS)),
        "dq_null_counts_all": q("silver", " union all ".join(
            f"select '{c}' as column_name, count(*) - count({c}) as n_nulls from silver"
            for c in [x.strip().split(" as ")[-1] for x in _SILVER.replace(", 6)", ")").split(", ")])),
        "dq_semantic_dups": q("silver", """select customer_id, merchant_id, event_ts_utc,
            round(order_total_amount, 6) as order_total_amount, count(distinct order_id) as n_orders
            from silver group by customer_id, merchant_id, event_ts_utc, silver.order_total_amount
            having count(distinct order_id) > 1"""),
        "dq_duplicate_groups_coarse": q("silver", f"""select {_DUP}, count(distinct order_id) as n_orders from silver
            group by all having count(distinct order_id) > 1 order by n_orders desc, merchant_id nulls last,
            event_date_brt nulls last, origin_platform nulls last limit 10"""),
        "dq_duplicate_members": q("silver", f"""select {_DUP}, count(distinct order_id) as n_orders, 1 as n_parts, 0 as part,
            string_agg(order_id, ',' order by order_id) as order_ids from silver group by {_DUP}
            having count(distinct order_id) > 1"""),
        "dq_duplicate_total": q("silver", f"""select count(*) as n_combinations from (select {_DUP} from silver
            group by all having count(distinct order_id) > 1)"""),
        "dq_profile": q(("raw_orders", "raw_consumers", "raw_restaurants", "raw_abmap"), """
            select 'orders' as table_name, count(*) as n_rows, min(order_created_at) as min_time, max(order_created_at) as max_time from raw_orders
            union all select 'consumers', count(*), null, null from raw_consumers
            union all select 'restaurants', count(*), null, null from raw_restaurants
            union all select 'abmap', count(*), null, null from raw_abmap"""),
        "dq_raw_groups": q("raw_abmap", "select ab_group as group_label, count(*) as n_rows from raw_abmap group by 1"),
        "boxplot_ab": q("long", _CLIPPED_LONG + _box("is_target, metric", _SAME_ARM.format(t="f"))),
        "boxplot_by_platform": q("long", _PLATFORM_LONG + _box("origin_platform, is_target, metric", _SAME_PLATFORM.format(t="f"))),
        "hist_ab": q("long", _CLIPPED_LONG + _hist("is_target, metric", _SAME_ARM.format(t="s"), 50)),
        "hist_by_platform": q("long", _PLATFORM_LONG + _hist("origin_platform, is_target, metric", _SAME_PLATFORM.format(t="s"), 40)),
        "break_even_grid": q("scored", f"select cost as coupon_cost, {BREAK_EVEN} from (" + _money(
            _arms("origin_platform"), "cost",
            ", (values (3.0::double), (6.0::double), (9.0::double), (12.0::double), (15.0::double)) g(cost)") + ")"),
        "break_even_status3": q("scored", "select " + BREAK_EVEN.rsplit("case when", 1)[0] + f"""
            case when abs(up - needed) < 2 then 'No limite' when up - needed >= 0 and profit >= 0 then 'OK'
            else 'NEG' end as status from ({_money(_arms('origin_platform'))})"""),
        "governance_checkpoint": q("silver", f"""
            , weekly as (select cast(date_trunc('week', event_ts_utc) as date) as week, customer_id,
              sum(order_total_amount) as monetary, max(is_target) as is_target,
              last(origin_platform order by event_ts_utc, order_id) filter (where origin_platform is not null) as origin_platform
              from silver group by 1, 2),
            be as (select *, {STATUS} as status, {STATUS} = 'NEG' and nt >= 3 as failing
              from ({_money(_arms('origin_platform', 'weekly', ', week'))}))
            select segment, week, nt as usuarios_trat, {_r('up - needed', 'gap_uplift')},
              {_r('profit / nt', 'lucro_por_usuario')}, status,
              failing and coalesce(lag(failing) over (partition by segment order by week), false) as suspend from be"""),
        "cuped_ttest": q(("clean", "abmap"), f"""
            , cu as (select c.customer_id, a.is_target,
              sum(coalesce(order_total_amount, 0::double)) filter (where event_ts_utc >= {START}) as monetary,
              coalesce(sum(coalesce(order_total_amount, 0::double)) filter (where event_ts_utc < {START}), 0) as pre
              from clean c join abmap a on a.customer_id = c.customer_id and a.is_target in (0, 1)
              where event_ts_utc < {END} group by 1, 2 having count(*) filter (where event_ts_utc >= {START}) > 0),
            fit as (select covar_samp(monetary, pre) / var_samp(pre) as theta, avg(pre) as mu from cu),
            cv as (select is_target, 'monetary' as metric, monetary as v from cu union all
              select is_target, 'monetary_cuped', monetary - theta * (pre - mu) from cu, fit)
            """ + _MOMENTS.format(src="cv") + f"""select metric, n1 as n_treat, n0 as n_ctrl,
            {_r('m1', 'mean_treat')}, {_r('m0', 'mean_ctrl')}, {_WELCH} from tests"""),
        "assigned_conversion": q(("abmap", "users"), f"""select a.is_target, count(*) as assigned,
            count(u.customer_id) as converted, {_r('count(u.customer_id)::double / count(*)', 'conversion')}
            from abmap a left join users u on u.customer_id = a.customer_id where a.is_target is not null group by 1"""),
        "poststratified_uplift": q("scored", f"""select sum(nt + nc)::bigint as usuarios,
            {_r('sum((gt - gc) * (nt + nc)) / sum(nt + nc)', 'uplift_adjusted')} from ({_arms('heavy_user')})"""),
    }
    out["ab_tests_pvalues"] = out["ab_tests"]
    out["nonparam_tests_pvalues"] = out["nonparam_tests"]
    # The same tie rule as on the Spark side: midway values go up.
    return {name: text.replace(", 6)", f" + {TIE_SHIFT}, 6)") for name, text in out.items()}
