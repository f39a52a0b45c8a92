"""DuckDB SQL of the folds: recursive queries that take the n-th row of every key in the n-th step."""

from __future__ import annotations

from weblathe.plans.captures import ATTEMPT_LIMITS
from weblathe.plans.streams import paced_sql

PACED = {"base": 1.0, "threshold": 2, "cooldown": 86400.0, "max_wait": 5.0}
PACING_FOLD = f"""with recursive q as (select cast(user_id as varchar) as domain, epoch_us(ts) / 1000000.0::double as now, event_id as sequence, event_id, case event_type when 'error' then 'transient' when 'signup' then 'success' else 'reserve' end as event,
 case when event_type = 'error' then 60 end as amount, row_number() over k as rn, row_number() over k = 1 as fresh from events window k as (partition by user_id order by ts, event_id)),
{paced_sql("domain", PACED, "q")}
select domain, q.now as at, sequence, q.event, decision, wait, nxt as next_allowed_at, failures, circuit as circuit_until from f join q using (domain, rn)"""

GATE = """with recursive e as (select 'u' || user_id as run_id, event_id as n, event_type = 'click' as third, cast(round(value * 100) as bigint) as cents, event_type, value, row_number() over (partition by user_id order by event_id) as rn from events),
f as (select distinct run_id, 0::bigint as rn, 0::bigint as n, null::varchar as decision, 0 as total, 0 as others from e
 union all select run_id, rn, n, decision, total + case when decision = 'allowed' then 1 else 0 end, others + case when decision = 'allowed' and third then 1 else 0 end
 from (select e.*, f.total, f.others, case when value > 90 then 'wall_time' when total >= 20 then 'request_cap' when event_type = 'error' then 'not_permitted' when cents % 5 = 0 and third then 'cross_site_navigation'
  when third and others >= 5 then 'third_party_cap' when cents % 7 = 0 then 'not_public' else 'allowed' end as decision from f join e on e.run_id = f.run_id and e.rn = f.rn + 1))
select run_id, n, decision from f where rn > 0"""

LEASES = """with recursive e as (select 'u' || user_id as run_id, epoch_us(ts) / 1000000.0::double as tm, event_id as n, case event_type when 'error' then 'release' when 'click' then 'renew' else 'acquire' end as event, case when event_id % 2 = 0 then 'a' else 'b' end as owner,
 row_number() over (partition by user_id order by ts, event_id) as rn from events),
f as (select distinct run_id, 0::bigint as rn, null::double as tm, 0::bigint as n, null::varchar as event, null::varchar as owner, false as granted, null::varchar as holder, 0::double as expires from e
 union all select run_id, rn, tm, n, event, owner, granted, case when granted then case when event = 'release' then null else owner end else holder end, case when granted then case when event = 'release' then 0 else tm + 20000 end else expires end
 from (select e.*, f.holder, f.expires, case when e.event = 'acquire' then not coalesce(f.holder is not null and f.expires > e.tm, false) or f.holder = e.owner else f.holder is not null and f.expires > e.tm and f.holder = e.owner end as granted
  from f join e on e.run_id = f.run_id and e.rn = f.rn + 1))
select run_id, tm as at, n, event, owner, granted, expires from f where rn > 0"""

L = ATTEMPT_LIMITS
CIRCUITS = f"""with recursive a as (select l_suppkey, l_orderkey, l_linenumber as n, max(l_returnflag) as flag, max(l_quantity) as q from lineitem group by all),
e as (select 's' || l_suppkey as domain, lpad(cast(l_orderkey as varchar), 12, '0') as run_id, cast(n // 4 as bigint) as request, cast(n as bigint) as n, cast(l_orderkey * 100 + n * 3 as double) as tm,
 case flag when 'R' then case when q > 45 then null else 503 end when 'A' then 301 else 200 end as status, case when q % 3 = 0 then q / 3 end as after, row_number() over (partition by l_suppkey order by l_orderkey * 100 + n * 3, l_orderkey, n) as rn from a),
f as (select distinct domain, 0::bigint as rn, ''::varchar as run_id, -1::bigint as request, 0::bigint as n, false as made, null::varchar as follow, 0 as spent, 0 as redirects, 0 as retries, 0::double as nxt, 0 as failures, 0::double as circuit, 0::double as updated from e
 union all select domain, rn, run_id, request, n, made, follow, spent, redirects + case when follow = 'redirect' then 1 else 0 end, retries + case when follow = 'retry' then 1 else 0 end, nxt, failures, circuit, updated
 from (select *, case when refused then 'budget_exhausted' when not made then turned when transient then case when circuit > 0 then 'circuit_open' when retries >= 1 then 'gave_up' when spent >= 3 then 'budget_exhausted' when delay > {L["max_wait"]} then 'deferred' else 'retry' end
   when status <> 301 then 'done' when redirects >= 1 then 'too_many_redirects' else 'redirect' end as follow
  from (select domain, rn, run_id, request, n, status, delay, transient, refused, turned, made, redirects, retries, spent0 + case when made then 1 else 0 end as spent,
    case when made and transient then blocked when made then slot else nxt end as nxt, case when made then case when transient then tries else 0 end else failures end as failures,
    case when made then case when transient then case when tries >= {L["threshold"]} then greatest(circuit, blocked, tm + {L["cooldown"]}) else circuit end else 0 end else circuit end as circuit, case when made then tm else updated end as updated
   from (select *, not refused and turned is null as made, greatest(slot, tm + delay) as blocked
    from (select e.*, e.status is null or e.status = 503 as transient, coalesce(e.after, {L["base"]}) as delay, case when e.run_id = f.run_id then f.spent else 0 end as spent0, case when e.run_id = f.run_id then f.spent else 0 end >= 3 as refused,
      case when e.run_id = f.run_id and e.request = f.request then f.redirects else 0 end as redirects, case when e.run_id = f.run_id and e.request = f.request then f.retries else 0 end as retries,
      case when f.circuit > e.tm then 'rejected' when f.nxt - e.tm > {L["max_wait"]} then 'deferred' end as turned, greatest(e.tm, f.nxt) + {L["base"]} as slot, case when e.tm - f.updated <= {L["cooldown"]} then f.failures + 1 else 1 end as tries,
      f.nxt, f.failures, f.circuit, f.updated from f join e on e.domain = f.domain and e.rn = f.rn + 1)))))
select domain, run_id, request, n, made, follow, spent, failures, nxt as next_allowed_at, circuit as circuit_until from f where rn > 0"""

SQL = {"pacing_fold": PACING_FOLD, "stream_pacing": PACING_FOLD, "browser_gate": GATE, "lease_log": LEASES, "attempt_circuits": CIRCUITS}
