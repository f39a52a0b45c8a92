"""DuckDB SQL for the queries of ``corpus``."""

OBS = """
e as (select 'u' || user_id as domain, strftime(ts, '%Y%m%d') as day, 'act.' || event_type as signal, event_id, ts,
        case event_id % 5 when 0 then 'observed' when 1 then 'observed' when 2 then 'no_evidence' when 3 then 'skipped' else 'error' end as outcome,
        cast(regexp_extract(props, '(\\d+)', 1) as integer) as k from events),
w as (select *, row_number() over (partition by domain, day, signal order by ts desc, event_id desc) as rn, max(ts) over (partition by domain, day) as done from e),
obs as (select domain || '-' || day as run_id, domain, strftime(done, '%Y-%m-%d %H:%M:%S') as completed_at, signal, outcome,
        case outcome when 'observed' then 'confirmed' when 'no_evidence' then 'no_evidence' else 'unknown' end as confidence,
        case when outcome in ('observed', 'no_evidence') then 1.0::double else 0.0::double end as confidence_score,
        case when outcome = 'observed' then '{"k":' || (k // 50) || '}' else 'null' end as value_json, 'last event of the day' as method, 1 as evidence_count
        from w where rn = 1)
"""
CHANGES = f"""{OBS},
runs as (select distinct domain, run_id, completed_at from obs),
ranked as (select *, row_number() over (partition by domain order by completed_at desc, run_id desc) as r from runs),
changes as (select a.domain, a.signal, a.run_id as previous_run_id, a.completed_at as previous_completed_at, a.outcome as previous_outcome, a.value_json as previous_value_json,
        b.run_id as current_run_id, b.completed_at as current_completed_at, b.outcome as current_outcome, b.value_json as current_value_json,
        (a.outcome <> b.outcome or a.value_json <> b.value_json) as changed
        from obs a join ranked ra on a.run_id = ra.run_id and ra.r = 2 join ranked rb on ra.domain = rb.domain and rb.r = 1 join obs b on b.run_id = rb.run_id and b.signal = a.signal)
"""
COUNTS = "count(*) filter (outcome = 'observed') as {0}, count(*) filter (outcome = 'no_evidence') as no_evidence, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'error') as {1}"
FRAME = """
frame as (select c_name as domain, 'list' || (c_custkey % 3) as source, c_mktsegment as sector, r_name as geography,
        case when c_acctbal >= 6000 then 'head' when c_acctbal >= 2500 then 'mid' else 'tail' end as popularity_band, c_acctbal >= 0 as eligible,
        case when c_acctbal < 0 then 'negative balance' end as exclusion_reason, c_acctbal as balance
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
drawn as (select domain, cast(row_number() over (partition by sector, geography, popularity_band order by sha256('pilot-1' || chr(0) || domain), domain) as integer) as random_order,
        count(*) over (partition by sector, geography, popularity_band) as stratum_size from frame where eligible),
smp as (select f.*, d.random_order, coalesce(d.stratum_size, 0) as stratum_size, coalesce(d.random_order <= 4, false) as selected,
        case when f.eligible then least(4, d.stratum_size) / d.stratum_size else 0.0::double end as inclusion_probability from frame f left join drawn d using (domain))
"""
JOBS = """
jobs as (select o_custkey % 10 as run_id, o_orderkey as ordinal, o_custkey as registrable_domain, o_orderkey % 7 as late, cast(o_orderdate as date) + 1 as not_before,
        case o_orderstatus when 'P' then 'pending' when 'O' then case o_orderkey % 7 when 0 then 'running' when 1 then 'deferred' else 'pending' end
        else case o_orderkey % 7 when 0 then 'failed' when 1 then 'completed_with_notes' when 2 then 'ceased' else 'completed' end end as status from orders),
progress as (select run_id, count(*) as total, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'running') as running, count(*) filter (status = 'completed') as completed,
        count(*) filter (status = 'completed_with_notes') as completed_with_notes, count(*) filter (status = 'deferred') as deferred, count(*) filter (status = 'ceased') as ceased,
        count(*) filter (status = 'failed') as failed, cast(sum(late) as bigint) as requests,
        count(*) filter (status in ('completed', 'completed_with_notes', 'ceased', 'failed')) / count(*) as fraction_finished from jobs group by run_id)
"""
LINES = """
att as (select l_orderkey as run_id, case when l_returnflag = 'R' then case when l_linenumber = 1 then 403 else 429 end when l_linestatus = 'O' then 200 when l_linenumber > 2 then 404 end as status_code from lineitem)
"""
HOSTS = "hosts as (select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages)"

SQL = {
    "analysis_observations": f"with {OBS} select * from obs",
    "analysis_runs": f"with {OBS} select run_id, domain, completed_at, count(*) as observations, {COUNTS.format('observed', 'errors')} from obs group by all",
    "analysis_changes": f"with {CHANGES} select * from changes",
    "analysis_summary": f"with {OBS} select case when grouping(signal) = 1 then 'all' else signal end as scope, signal, outcome, count(*) as n from obs group by grouping sets ((outcome), (signal, outcome))",
    "analysis_totals": f"with {CHANGES} select (select count(distinct run_id) from obs) as snapshots, (select count(distinct domain) from obs) as domains, (select count(distinct signal) from obs) as signals, (select count(*) from changes) as comparisons, (select count(*) from changes where changed) as changed, (select count(*) from changes where not changed) as unchanged",
    "transition_matrix": f"with {CHANGES} select split_part(signal, '.', 1) as family, previous_outcome, current_outcome, count(*) as n from changes group by all",
    "coverage_heatmap": f"with {OBS}, g as (select signal, outcome, count(*) as n from obs group by all) select signal, outcome, n, n / sum(n) over (partition by signal) as share from g",
    "catalog_left_join": f"with {OBS}, c as (select 'act.' || unnest(['view', 'click', 'signup', 'purchase', 'refund']) as signal), r as (select distinct run_id, domain from obs) select r.run_id, r.domain, c.signal, coalesce(o.outcome, 'skipped') as outcome, o.value_json from r cross join c left join obs o on o.run_id = r.run_id and o.signal = c.signal",
    "missing_signals_anti": f"with {OBS} select run_id, signal, outcome from obs where signal not in ('act.view', 'act.click', 'act.signup', 'act.purchase', 'act.refund')",
    "report_status_counts": f"with {OBS} select domain, {COUNTS.format('collected', 'error')} from obs group by domain",
    "report_common_statuses": f"with {OBS}, t as (select signal, outcome, count(*) as n from obs group by all), u as (select *, sum(n) over (partition by signal) as total from t) select outcome, cast(row_number() over (partition by outcome order by n desc, signal) as integer) as rank, signal || ' (' || n || '/' || total || ')' as label from u",
    "dimension_scores": f"with {OBS}, x as (select run_id, split_part(signal, '.', 1) as family, outcome, length(signal)::double as w, case when outcome = 'observed' then cast(regexp_extract(value_json, '(\\d+)', 1) as double) end as x from obs), g as (select run_id, family, sum(w * x) filter (outcome = 'observed') as wx, sum(w) filter (outcome = 'observed') as w, count(*) filter (outcome = 'observed') / count(*) as coverage from x group by all) select run_id, family, coverage, case when coverage >= 0.5 then wx / nullif(w, 0) end as score from g",
    "signal_cooccurrence": f"with {OBS}, o as (select distinct domain, signal from obs where outcome = 'observed') select a.signal as signal_a, b.signal as signal_b, count(*) as domains from o a join o b on a.domain = b.domain and a.signal < b.signal group by all",
    "frame_sample": f"with {FRAME} select domain, sector, geography, popularity_band, eligible, exclusion_reason, random_order, stratum_size, selected, inclusion_probability from smp",
    "frame_strata": f"with {FRAME} select sector, geography, popularity_band, count(*) as frame_size, least(4::bigint, count(*)) as selected_size from frame where eligible group by all",
    "frame_manifest": f"with {FRAME} select 'pilot-1' as seed, 4 as per_stratum, count(*) as frame_size, count(*) filter (eligible) as eligible_size, count(*) filter (selected) as selected_size, (select string_agg(source, ',' order by source) from (select distinct source from frame)) as sources from smp",
    "frame_panel": f"with {FRAME}, s as (select *, count(*) over (partition by sector, geography, popularity_band) as n from smp where selected) select domain, sector, geography, popularity_band, random_order, case when random_order * 10 <= n * 8 then 'panel' else 'refresh' end as part from s",
    "frame_merge": "with r as (select 's' || (s_suppkey % 60) as domain, 'list' || (s_suppkey % 4) as source, s_acctbal > 0 as b, s_suppkey % 60 % 5 as g from supplier) select domain, (select string_agg(source, ',' order by source) from (select distinct source from r r2 where r2.domain = r.domain)) as sources, count(distinct (b, g)) > 1 as conflict from r group by domain",
    "design_weighted_mean": f"with {FRAME}, b as (select sector, geography, popularity_band, stratum_size as s, count(*) as n, avg(balance) as m, coalesce(var_samp(balance), 0) as v from smp where selected group by all) select cast(sum(n) as bigint) as n, cast(sum(s) as bigint) as population, round(sum(s * m) / sum(s), 6) as weighted_mean, round(sqrt(sum(s * s * (1 - n / s) * v / n)) / sum(s), 6) as standard_error from b",
    "quality_gates": f"with {FRAME}, c as (select *, balance - 10 * floor(balance / 10) >= 1 as complete from smp where selected), g as (select case when grouping(sector) = 1 then 'overall' else sector || '/' || geography || '/' || popularity_band end as stratum, count(*) as n, count(*) filter (complete) as complete from c group by grouping sets ((), (sector, geography, popularity_band))) select stratum, n, complete, complete / n as share, case when stratum = 'overall' then complete / n >= 0.9 else n < 5 or complete / n >= 0.75 end as passed from g",
    "job_progress": f"with {JOBS} select * from progress",
    "run_statuses": f"with {JOBS} select run_id, case when run_id = 4 and pending + running > 0 then 'stopped' when failed > 0 then 'completed_with_errors' when deferred > 0 then 'completed_with_deferred' when completed_with_notes > 0 then 'completed_with_notes' else 'completed' end as run_status from progress",
    "claimable_jobs": f"with {JOBS}, c as (select *, row_number() over (partition by registrable_domain order by run_id, ordinal) as rn from jobs j where status = 'pending' and run_id % 2 = 0 and run_id < 8 and run_id <> 4 and not exists (select 1 from jobs k where k.status = 'running' and k.run_id < 8 and k.registrable_domain = j.registrable_domain)) select run_id, ordinal, registrable_domain, 'running' as status, 1 as attempts from c where rn = 1",
    "resume_jobs": f"with {JOBS} select run_id, ordinal, case when status in ('running', 'failed') or (status = 'deferred' and not_before <= date '1996-01-01') then 'pending' else status end as status from jobs",
    "http_status_distribution": f"with {LINES} select run_id, status_code, count(*) as n from att where status_code is not null group by all",
    "http_403_rate": f"with {LINES}, g as (select run_id, count(*) filter (status_code = 403) as forbidden, count(*) filter (status_code = 429) as limited, count(status_code) as responses from att group by run_id) select *, case when responses > 0 then forbidden / responses end as rate_403, case when responses > 0 then limited / responses end as rate_429, case when responses = 0 then 'no_evidence' else 'observed' end as outcome from g",
    "registrable_hosts": f"with {HOSTS} select page_id, host, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) as registrable from hosts",
    "cease_filter": f"with {HOSTS}, l as (select distinct host as d from hosts where length(host) % 5 = 0 union select 'example.net'), m as (select h.host, arg_max(d, length(d)) as ceased_by from (select distinct host from hosts) h join l on h.host = d or ends_with(h.host, '.' || d) group by h.host) select page_id, hosts.host, ceased_by from hosts left join m on m.host = hosts.host",
    "provider_suffix_join": f"with {HOSTS}, t as (select * from (values ('org', 'example.org'), ('net', 'example.net'), ('mobile', 'm.'), ('www', 'www-')) v(provider, suffix)) select page_id, provider from hosts join t on case when ends_with(suffix, '-') then contains(host, suffix) else host = suffix or ends_with(host, '.' || suffix) end",
    "page_metadata": "select page_id, cast(length(regexp_extract(html, '<title>([^<]*)</title>', 1)) as integer) as title_chars, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang, cast(len(regexp_extract_all(html, '<a href=\"')) as bigint) as links from pages",
    "page_link_words": "with l as (select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages), w as (select *, regexp_extract_all(lower(href), '[a-z0-9]+') as w from l) select page_id, count(*) as links, count(*) filter (list_contains(w, 'the') or list_contains(w, 'of') or contains(array_to_string(w, '-'), 'in-of')) as marked, count(distinct href) as distinct_links from w group by page_id",
    "title_words": "select word, count(*) as n from (select unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z0-9]+')) as word from pages) group by word",
    "policy_text_rules": "select doc_id, 'licensed' as rule from documents where regexp_matches(text, '(?i)\\b(?:is )?licensed under\\b') union all select doc_id, 'released' from documents where regexp_matches(text, '(?i)\\breleased under the [a-z]+ license\\b') union all select doc_id, 'reserved' from documents where regexp_matches(text, '(?i)\\ball rights reserved\\b')",
    "license_lines": "with l as (select distinct doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '(?i)licen[sc]ed? ')) select line, count(*) as documents, min(doc_id) as first_doc from l group by line",
    "detector_scores": "with j as (select lang, case when len(string_split(text, ' ')) < 20 then null else regexp_matches(text, '[#*$%&]{3}') end as flag, quality = 0 as truth from documents join labels using (doc_id)), g as (select lang, count(*) filter (flag and truth) as tp, count(*) filter (flag and not truth) as fp, count(*) filter (not coalesce(flag, false) and truth) as fn, count(*) filter (flag is null) as a, count(*) as n from j group by lang) select lang, tp, fp, fn, tp / nullif(tp + fp, 0) as precision, tp / nullif(tp + fn, 0) as recall, a / n as abstention from g",
    "dedup_first_seen": "select min(doc_id) as doc_id, sha256(text) as digest from documents group by sha256(text)",
    "content_change": "with l as (select doc_id, source, sha256(text) as d, lag(sha256(text)) over (partition by source order by doc_id) as b from documents) select doc_id, source, case when b is null then 'not_comparable' when b = d then 'unchanged' else 'changed' end as result from l",
    "set_operations": "with b as (select distinct o_custkey as k from orders), r as (select c_custkey as k from customer where c_acctbal > 5000), u as (select 'intersect' as op, k from (select k from b intersect select k from r) union all select 'except', k from (select k from r except select k from b) union all select 'union', k from (select k from b union select k from r)) select op, count(*) as n, cast(sum(k) as bigint) as k_sum from u group by op",
    "outcome_windows": "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n from events group by all",
    "outcome_sliding_windows": "with w as (select epoch_us(ts) // 86400000000 as day from events), s as (select day - (day % 1) - unnest([0, 1]) as start from w) select strftime(make_timestamp(start * 86400000000), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as n from s group by all",
    "user_sessions": "with l as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as b from events), s as (select *, sum(case when b is null or ts >= b + interval 6 hour then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as g from l) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, g",
    "observation_values": """with e as (select event_id, event_type, event_id % 9 as n, regexp_extract(props, '(\\d+)', 1) as k from events)
select event_id, case n when 0 then 'object' when 1 then 'integer' when 2 then 'number' when 3 then 'object' when 4 then case when cast(k as integer) % 2 = 0 then 'boolean' else 'null' end when 5 then 'string' when 7 then 'object' when 8 then 'array' end as kind,
case when n in (0, 3) then 'integer' when n = 7 then 'number' end as kind_of_k, case when n = 1 then '-7' || k || '00000000000000000000' || k end as whole, case n when 0 then k when 3 then cast(event_id as varchar) || '0000000000' end as k,
case n when 0 then '{"k":' || k || '}' when 1 then '-7' || k || '00000000000000000000' || k when 2 then k || '.5' when 3 then '{"k":' || event_id || '0000000000,"z":[' || k || ',true]}' when 4 then case when cast(k as integer) % 2 = 0 then 'true' else 'null' end when 5 then '"' || event_type || '"' when 7 then '{"k":' || k || '.5}' when 8 then '[1,' || k || ']' end as canonical from e""",
    "running_caps": "select event_id, user_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as nth, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) <= 30 as within_cap from events",
    "asof_prices": "with e as (select * from events where event_type in ('view', 'purchase')), l as (select *, last_value(case when event_type = 'view' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_view from e) select event_id, user_id, last_view from l where event_type = 'purchase'",
}
