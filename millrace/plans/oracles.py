"""SQL oracles of the catalogue: common table expressions put together, doubles rounded to eight places, dates as text."""

from __future__ import annotations


def nearest(x: str, q: float) -> str:
    return f"list_extract(list_sort(list({x}) filter ({x} is not null)), cast(round((count({x}) - 1) * {q}::double) as int) + 1)::double"


def median(x: str) -> str:
    return f"quantile_cont({x}::double, 0.5)"


def mode(value: str) -> str:
    """Most frequent value of a group, the smallest of equals, from rows (value, n)."""
    return f"arg_min({value}, row(-n, {value}))"


K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"
FLOW = """case item_category when '3-way match, invoice after GR' then '3way_invoice_after_gr' when '3-way match, invoice before GR' then '3way_invoice_before_gr'
 when '2-way match' then '2way' when 'Consignment' then 'consignment' else '3way_invoice_after_gr' end"""
STAGE = "case {0} when 'signup' then 'S1' when 'view' then 'S4' when 'click' then 'S5' when 'purchase' then 'S7' when 'error' then 'S8' else 'S0_UNKNOWN' end"
STAGE_NAME = ("case {0} when 'signup' then 'Requisition & Creation' when 'view' then 'Goods & Services Receipt' when 'click' then 'Invoice Processing' "
              "when 'purchase' then 'Payment & Clearing' when 'error' then 'Exception & Rework' else 'S0_UNKNOWN' end")

PARTS: dict[str, tuple[str, str]] = {  # name -> (names it needs, query)
    "ev": ("", f"""select concat(cast(user_id as string), '_', cast(cast(ts as date) as string)) as case_id, event_type as activity, ts, event_id as event_seq,
      case when {K} < 15 then concat('batch_', lpad(cast({K} as string), 2, '0')) when {K} < 75 then concat('user_', lpad(cast({K} as string), 3, '0')) else 'NONE' end as resource,
      value as event_value from events"""),
    "att": ("", """select distinct concat(cast(user_id as string), '_', cast(cast(ts as date) as string)) as case_id, concat('DOC', cast(user_id % 100 as string)) as purchasing_document,
      ['Consignment','Limit','Service','Standard','Subcontracting','Third-party'][user_id % 6 + 1] as item_type, user_id % 2 = 0 as gr_based_iv, user_id % 3 = 0 as goods_receipt,
      r_name as company, n_name as vendor, lower(n_name) as vendor_name, ['EC Purchase order','Framework order','Standard PO'][user_id % 3 + 1] as document_type,
      case c_mktsegment when 'AUTOMOBILE' then '3-way match, invoice after GR' when 'BUILDING' then '3-way match, invoice before GR' when 'FURNITURE' then '2-way match'
        when 'HOUSEHOLD' then 'Consignment' when 'MACHINERY' then 'Framework' end as item_category
      from events left join (customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) on c_custkey = user_id"""),
    "lg": ("ev", f"""select *, case when starts_with(lower(resource), 'batch_') then 'batch' when starts_with(lower(resource), 'user_') then 'human' else 'unknown' end as resource_type,
      cast(ts as date) as date, cast(hour(ts) as int) as hour, cast(isodow(ts) as int) as day_of_week, year(ts) < 2015 as is_timestamp_anomaly, isodow(ts) >= 5 as is_weekend,
      hour(ts) >= 8 and hour(ts) < 18 and not isodow(ts) >= 5 as is_business_hours, {STAGE.format('activity')} as process_stage,
      row_number() over w as event_order, lag(ts) over w as prev_ts, lead(ts) over w as next_ts, lag(activity) over w as prev_activity, lead(activity) over w as next_activity,
      lag(resource) over w as prev_resource, date_sub('second', ts, lead(ts) over w) as seconds_to_next,
      date_sub('microsecond', lag(ts) over w, ts) / 1e6 as time_since_prev_event, date_sub('microsecond', min(ts) over (partition by case_id), ts) / 1e6 as time_since_case_start
      from ev window w as (partition by case_id order by ts, event_seq)"""),
    "cm": ("lg", """select case_id, min(ts) as case_start, max(ts) as case_end, count(*) as event_count, count(distinct activity) as activity_count, count(distinct resource) as resource_count,
      bool_or(resource_type = 'batch') as has_batch_activity, string_agg(activity, '|' order by ts, event_seq) as activities,
      date_sub('second', min(ts), max(ts)) / 86400.0::double as case_duration_days, substr(md5(string_agg(activity, '|' order by ts, event_seq)), 1, 12) as variant_id from lg group by case_id"""),
    "ct": ("att,cm", f"select att.*, {FLOW} as flow_type, cm.* exclude (case_id) from att left join cm using (case_id)"),
    "rw": ("lg", """select case_id, cast(sum(case when n > 1 then 1 else 0 end) as bigint) as rework_count, cast(sum(case when n > 1 then n - 1 else 0 end) as bigint) as loop_count,
      bool_or(n > 1) as has_rework, max(n) as max_repeat from (select case_id, activity, count(*) as n from lg group by all) group by case_id"""),
    "tr": ("lg", """select case_id, activity as from_activity, next_activity as to_activity, ts as from_ts, next_ts as to_ts, seconds_to_next / 3600.0::double as wait_hours, is_business_hours
      from lg where next_ts is not null and seconds_to_next >= 0"""),
    "dfg": ("tr", f"""select from_activity, to_activity, count(*) as transition_count, max(wait_hours) as max_wait_hours, {median('wait_hours')} as median_wait_hours,
      {nearest('wait_hours', 0.9)} as p90_wait_hours from tr group by all"""),
    "ge": ("dfg", """select from_activity, to_activity, transition_count, row_number() over (order by transition_count desc, from_activity, to_activity) as k
      from dfg where from_activity <> to_activity"""),
    "st": ("ge", """select cast(0 as bigint) as k, cast([] as bigint[]) as kept, cast([] as varchar[]) as pairs union all
      select ge.k, case when list_contains(pairs, to_activity || '>' || from_activity) then kept else list_append(kept, ge.k) end,
        case when list_contains(pairs, to_activity || '>' || from_activity) then pairs else list_distinct(list_concat(pairs, flatten(list_transform(
          list_append(list_transform(list_filter(pairs, lambda p: split_part(p, '>', 2) = from_activity), lambda p: split_part(p, '>', 1)), from_activity),
          lambda x: list_transform(list_append(list_transform(list_filter(pairs, lambda p: split_part(p, '>', 1) = to_activity), lambda p: split_part(p, '>', 2)), to_activity),
            lambda y: x || '>' || y))))) end
      from st join ge on ge.k = st.k + 1"""),
    "bn": ("dfg", """select *, p90_wait_hours > 12 as is_bottleneck, case when p90_wait_hours > 12 then cast(row_number() over (order by p90_wait_hours desc, from_activity, to_activity) as int) end
      as bottleneck_rank from dfg where transition_count >= 50"""),
    "dom": ("ct", f"select variant_id, {mode('flow_type')} as dominant_flow_type from (select variant_id, flow_type, count(*) as n from ct group by all) group by variant_id"),
    "hap": ("ct", f"select flow_type, {mode('variant_id')} as variant_id from (select variant_id, flow_type, count(*) as n from ct group by all) group by flow_type"),
    "vs": ("ct,dom,hap", f"""select v.*, dominant_flow_type, exists (select 1 from hap where hap.flow_type = dominant_flow_type and hap.variant_id = v.variant_id) as is_happy_path from
      (select variant_id, count(*) as case_count, min(activities) as activities, {median('case_duration_days')} as median_duration_days, {nearest('case_duration_days', 0.9)} as p90_duration_days,
       100.0::double * count(*) / (select count(*) from ct) as case_percentage, cast(len(string_split(min(activities), '|')) as int) as variant_length from ct group by variant_id) v
      join dom using (variant_id)"""),
    "ri": ("lg", """select case_id, min(ts) filter (activity = 'view') as gr, min(ts) filter (activity = 'click') as ir, min(ts) filter (activity = 'purchase') as cl,
      arg_min(activity, row(ts, event_seq)) as first_activity, bool_or(activity = 'signup') as has_create, bool_or(activity = 'purchase') as has_clear,
      count(*) filter (activity in ('click', 'purchase')) as inv, arg_min(activity, row(ts, event_seq)) filter (activity in ('click', 'purchase')) as first_inv,
      arg_min(activity, row(ts, event_seq)) filter (activity in ('purchase', 'error')) as term from lg group by case_id"""),
    "p95": ("ct", f"select flow_type, {nearest('case_duration_days', 0.95)} as p95 from ct group by 1"),
    "dv": ("ct", "select purchasing_document, count(distinct vendor) as nv from ct group by 1"),
    "rr": ("ct,ri,rw,p95,dv", "select * from ct left join ri using (case_id) left join rw using (case_id) left join p95 using (flow_type) left join dv using (purchasing_document)"),
    "ch": ("rr", """
      select case_id, 'CR-001' as rule_id, 'GR before invoice clearance' as rule_name, case when gr is null then false when cl is null then true else gr < cl end as passed, 'critical' as severity,
        case when gr is null then 'No goods receipt found before invoice clearance' when cl is null then 'No invoice clearance yet (compliant)' when gr < cl then 'GR precedes clearance (compliant)'
        else 'Invoice cleared before goods receipt' end as detail from rr where flow_type = '3way_invoice_after_gr'
      union all select case_id, 'CR-002', 'GR required before payment (invoice-before-GR flow)', case when cl is null then true when gr is null then false else gr < cl end, 'critical',
        case when cl is null then 'No invoice clearance yet (compliant)' when gr is null then 'Invoice cleared without any goods receipt' when gr < cl then 'GR precedes clearance (compliant)'
        else 'Invoice cleared before goods receipt' end from rr where flow_type = '3way_invoice_before_gr'
      union all select case_id, 'CR-003', 'No invoice activities on consignment', inv = 0, 'warning', case when inv = 0 then 'No invoice activities (compliant)'
        else concat('Found ', inv, ' invoice events (e.g. ', first_inv, ')') end from rr where flow_type = 'consignment'
      union all select case_id, 'CR-005', 'Create PO Item is first event', first_activity = 'signup', 'warning', case when first_activity = 'signup' then 'Create PO Item is first event (compliant)'
        else concat('First event is ''', first_activity, '''') end from rr where has_create
      union all select case_id, 'CR-006', 'Invoice received before clearance', case when ir is null then false else ir <= cl end, 'critical',
        case when ir is null then 'Invoice cleared without any Record Invoice Receipt event' when ir <= cl then 'Invoice receipt precedes clearance (compliant)'
        else 'Invoice cleared before invoice was recorded' end from rr where has_clear
      union all select case_id, 'CR-007', 'Single vendor per purchasing document', nv = 1, 'info', case when nv = 1 then 'Single vendor per document (compliant)'
        else concat('Document has ', nv, ' different vendors') end from rr
      union all select case_id, 'CR-008', 'Throughput time within P95', case_duration_days <= p95, 'warning', case when case_duration_days <= p95 then 'Duration within P95 (compliant)'
        else printf('Duration %.1fd exceeds P95 %.1fd', case_duration_days, p95) end from rr
      union all select case_id, 'CR-009', 'No excessive rework (activity repeated > 2 times)', max_repeat <= 2, 'warning', case when max_repeat <= 2 then 'No excessive rework (compliant)'
        else concat('An activity repeats ', max_repeat, ' times') end from rr
      union all select case_id, 'CR-010', 'Proper closure (terminal activity present)', term is not null, 'info', case when term is not null then concat('Terminal activity ''', term, ''' present')
        else 'No terminal activity found (case may be open)' end from rr"""),
    "pl": ("lg,ri", """select case_id, min(event_order) filter (activity = 'purchase') as o_cl, min(event_order) filter (activity = 'click') as o_ir,
      min(event_order) filter (ts > cl) as o_after, min(event_order) filter (activity in ('click', 'purchase')) as o_inv, min(event_order) filter (activity = 'signup') as o_create,
      min(event_order) filter (activity in ('purchase', 'error')) as o_term, min(event_order) filter (nth = 3) as o_third, any_value(ir <= cl) as received
      from (select *, row_number() over (partition by case_id, activity order by ts, event_seq) as nth from lg) join ri using (case_id) group by case_id"""),
    "dc": ("ch,pl,lg", """select c.*, e.activity as decided_activity from (select ch.*, case when rule_id in ('CR-001', 'CR-002') then o_cl when rule_id = 'CR-003' then o_inv
        when rule_id = 'CR-005' then o_create when rule_id = 'CR-006' and received then greatest(o_ir, o_cl) when rule_id = 'CR-006' then o_after
        when rule_id = 'CR-009' then o_third when rule_id = 'CR-010' then o_term end as decided_order from ch left join pl using (case_id) where rule_id not in ('CR-007', 'CR-008')) c
      left join lg e on e.case_id = c.case_id and e.event_order = c.decided_order"""),
    "sc": ("ch", """select case_id, cast(sum(case when passed then 1 else 0 end) as bigint) as passed_checks, count(*) as total_checks, count(*) filter (not passed and severity = 'critical') as critical_violations,
      coalesce(string_agg(rule_name, '|' order by rule_name) filter (not passed), '') as compliance_flags, sum(case when passed then 1 else 0 end)::double / count(*) as compliance_score from ch group by case_id"""),
    "ho": ("lg", "select case_id, count(*) filter (prev_resource is not null and resource <> prev_resource) as handoff_count from lg group by case_id"),
    "tl": ("lg", "select case_id, avg((resource_type = 'batch')::int) as touchless_ratio from lg group by case_id"),
    "p75": ("ct", f"select flow_type, {nearest('case_duration_days', 0.75)} as p from ct group by 1"),
    "sb": ("ct,p75", "select case_id, flow_type, case when case_duration_days > 1.5 * p then 'high' when case_duration_days > p then 'medium' else 'low' end as sla_risk from ct join p75 using (flow_type)"),
    "fs": ("ct,rw,sc,tl,vs,ho,sb", """select ct.*, rework_count, loop_count, has_rework, compliance_score, compliance_flags, touchless_ratio, is_happy_path, handoff_count, sla_risk
      from ct join rw using (case_id) join sc using (case_id) join tl using (case_id) join (select variant_id, is_happy_path from vs) using (variant_id)
      join ho using (case_id) join (select case_id, sla_risk from sb) using (case_id)"""),
    "ap": ("lg", f"""select activity, count(*) as frequency, count(distinct case_id)::double / (select count(distinct case_id) from lg) as case_coverage,
      avg((resource_type = 'batch')::int) > 0.5 as typically_batch, avg((resource_type = 'human')::int) > 0.5 as typically_human, {median('seconds_to_next')} as median_duration_to_next,
      {nearest('seconds_to_next', 0.9)} as p90_duration_to_next from lg group by activity"""),
    "ab": ("lg", f"""select activity, count(*) as total_count, count(*) filter (resource_type = 'batch') as batch_count, count(*) filter (resource_type = 'human') as human_count,
      count(distinct case_id) as case_count, avg(w) as avg_wait_minutes, stddev_samp(w) as std_wait_minutes, {median('w')} as median_wait_minutes,
      (count(*) filter (resource_type = 'batch'))::double / count(*) as batch_ratio from (select *, time_since_prev_event / 60 as w from lg) group by activity"""),
    "pe": ("lg", "select activity, case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end as predecessor_entropy from (select activity, prev_activity, count(*)::double / sum(count(*)) over (partition by activity) as p from lg where prev_activity is not null group by activity, prev_activity) group by activity"),
    "se": ("lg", "select activity, case when count(*) > 1 then -sum(p * log2(p)) / log2(count(*)) else 0 end as successor_entropy from (select activity, next_activity, count(*)::double / sum(count(*)) over (partition by activity) as p from lg where next_activity is not null group by activity, next_activity) group by activity"),
    "pc": ("lg", "select activity, stddev_samp(p) / avg(p) as position_cv from (select activity, case_id, avg(event_order) as p from lg group by all) group by activity"),
    "er": ("lg,rw", "select activity, avg(has_rework::int) as error_rate from lg join rw using (case_id) group by activity"),
    "au": ("ab,pe,se,pc,er", """select *, case when batch_ratio >= 0.8 then 'not_recommended' when automation_score >= 0.7 then 'quick_win' when automation_score >= 0.5 then 'medium_effort'
      when automation_score >= 0.3 then 'complex' else 'not_recommended' end as automation_tier, human_count / 1.0::double * least(greatest(median_wait_minutes, 0), 30) / 60 as hours_saved_per_month from
      (select *, 0.25 * volume_score + 0.20 * batch_gap_score + 0.20 * input_uniformity_score + 0.15 * timing_regularity_score + 0.10 * error_reduction_score + 0.10 * wait_reduction_score as automation_score from
      (select *, (total_count - min(total_count) over ())::double / (max(total_count) over () - min(total_count) over ()) as volume_score, 1 - batch_ratio as batch_gap_score,
       1 - least(greatest((predecessor_entropy + successor_entropy + position_cv) / 3, 0), 1) as input_uniformity_score,
       case when median_wait_minutes <= 0 or median_wait_minutes is null then 1.0 else 1 - least(greatest(std_wait_minutes / median_wait_minutes, 0), 1) end as timing_regularity_score,
       least(greatest(error_rate * 2, 0), 1) as error_reduction_score, avg_wait_minutes / max(avg_wait_minutes) over () as wait_reduction_score
       from ab join pe using (activity) join se using (activity) join pc using (activity) join er using (activity)))"""),
    "cv": ("", "select cast(conv_id as string) as case_id, role as activity, turn as event_seq from conversations"),
    "sp": ("fs", """select case_id, cast(sla_risk <> 'low' as int) as target, row_number() over (partition by cast(sla_risk <> 'low' as int) order by md5(concat(case_id, '42')), case_id)
      > round(0.8::double * count(*) over (partition by cast(sla_risk <> 'low' as int))) as in_test_set from fs where year(case_start) >= 2018"""),
}


def build(final: str, needs: str, doubles: tuple[str, ...] = ()) -> str:
    """WITH the parts that ``needs`` names and what they need, then ``final``, its doubles rounded."""
    order: list[str] = []

    def add(name: str) -> None:
        if name and name not in order:
            for n in PARTS[name][0].split(","):
                add(n)
            order.append(name)

    for name in needs.split(","):
        add(name)
    rounded = ", ".join(f"round({d}, 8) as {d}" for d in doubles)
    body = f"select * replace ({rounded}) from ({final})" if doubles else final
    return "with " + ",\n".join(f"{n} as {'' if n == 'st' else 'materialized '}({PARTS[n][1]})" for n in order) + "\n" + body


def dimension(keys: str) -> str:
    return (f"select {keys}, count(*) as case_count, avg(case_duration_days) as avg_duration_days, {median('case_duration_days')} as median_duration_days, any_value(m) as primary_flow_type from ct join "
            f"(select {keys}, {mode('flow_type')} as m from (select {keys}, flow_type, count(*) as n from ct group by all) group by {keys}) using ({keys}) group by {keys}")


def pct(x: str) -> str:
    return f"round(avg(({x})::int) * 100, 1)"


RULE_IDS = ("CR-001", "CR-002", "CR-003", "CR-005", "CR-006", "CR-007", "CR-008", "CR-009", "CR-010")
WAITS = ("max_wait_hours", "median_wait_hours", "p90_wait_hours")
CASE_COLUMNS = ("case_id, purchasing_document, item_type, gr_based_iv, goods_receipt, company, vendor, vendor_name, document_type, item_category, flow_type, case_start, case_end, "
                "event_count, activity_count, resource_count, has_batch_activity, activities, case_duration_days, variant_id")

FEATURE_ROWS = """select case_id, in_test_set, target, case flow_type when '2way' then 0 when '3way_invoice_after_gr' then 1 when '3way_invoice_before_gr' then 2 when 'consignment' then 3 else -1 end as flow_type_enc,
        case item_type when 'Consignment' then 0 when 'Limit' then 1 when 'Service' then 2 when 'Standard' then 3 when 'Subcontracting' then 4 when 'Third-party' then 5 else -1 end as item_type_enc,
        case document_type when 'EC Purchase order' then 0 when 'Framework order' then 1 when 'Standard PO' then 2 else -1 end as document_type_enc, -1 as company_enc,
        cast(coalesce(vf, 1) as int) as vendor_freq, cast(gr_based_iv as int) as gr_based_iv, cast(goods_receipt as int) as goods_receipt, cast(month(case_start) as int) as start_month,
        cast(quarter(case_start) as int) as start_quarter, cast(isodow(case_start) as int) as start_dow
        from sp join ct using (case_id) left join (select vendor, count(*) as vf from sp join ct using (case_id) where not in_test_set group by 1) using (vendor)"""
MODEL_INPUTS = ("flow_type_enc", "company_enc", "vendor_freq", "item_type_enc", "document_type_enc", "gr_based_iv", "goods_receipt", "start_month", "start_quarter", "start_dow")
LOG_COLUMNS = ("case_id", "activity", "ts", "event_seq", "resource", "event_value", "date", "hour", "day_of_week", "is_timestamp_anomaly", "is_weekend", "is_business_hours", "resource_type",
               "process_stage", "event_order", "prev_ts", "next_ts", "prev_activity", "next_activity", "prev_resource", "time_since_case_start", "time_since_prev_event", "seconds_to_next")

ORACLES: dict[str, str] = {
    "resource_class": build("select event_seq, resource, resource_type from lg", "lg"),
    "flow_type": build(f"select case_id, item_category, {FLOW} as flow_type from att", "att"),
    "temporal_flags": build("select event_seq, cast(date as varchar) as date, hour, day_of_week, is_timestamp_anomaly, is_weekend, is_business_hours from lg", "lg"),
    "event_order": build("select case_id, event_seq, event_order, time_since_case_start, time_since_prev_event from lg", "lg", ("time_since_case_start", "time_since_prev_event")),
    "case_metrics": build("select * from cm", "cm", ("case_duration_days",)),
    "resource_profile": build("""select resource, min(resource_type) as resource_type, min(ts) as first_seen, max(ts) as last_seen, count(*) as event_count, count(distinct case_id) as case_count,
        array_to_string(list_sort(list(distinct activity)), '|') as activity_set, array_to_string(list_slice(list_sort(list(distinct activity)), 1, 3), ', ') as primary_activities from lg group by resource""", "lg"),
    "activity_profile": build("select * from ap", "ap", ("case_coverage", "median_duration_to_next", "p90_duration_to_next")),
    "variant_stats": build("select * from vs", "vs", ("median_duration_days", "p90_duration_days", "case_percentage")),
    "case_happy_path": build("select case_id, is_happy_path from ct join vs using (variant_id)", "vs"),
    "transitions": build("select * from tr", "tr", ("wait_hours",)),
    "dfg_edges": build("select * from dfg", "dfg", WAITS),
    "dfg_nodes": build(f"""select activity, frequency, median_duration_to_next, {STAGE.format('activity')} as stage, {STAGE_NAME.format('activity')} as stage_name
        from (select from_activity as activity from dfg union select to_activity from dfg) join ap using (activity)""", "dfg,ap", ("median_duration_to_next",)),
    "dfg_by_flow": build(f"""select flow_type, activity as from_activity, next_activity as to_activity, count(*) as transition_count, round(max(w), 6) as max_wait_hours, round({median('w')}, 6) as median_wait_hours,
        round({nearest('w', 0.9)}, 6) as p90_wait_hours from (select *, date_sub('microsecond', ts, next_ts) / 3.6e9 as w from lg join (select case_id, flow_type from ct) using (case_id) where next_ts is not null)
        group by all having count(*) >= 10""", "lg,ct", WAITS),
    # the edges in their order, one a step, beside all pairs that the kept ones connect
    "dfg_acyclic": "with recursive" + build("""select from_activity, to_activity, transition_count from ge where list_contains((select kept from st order by k desc limit 1), k)""", "st")[4:],
    "bottlenecks": build("select * from bn", "bn", WAITS),
    "bottlenecks_by_flow": build(f"""select flow_type, from_activity, to_activity, count(*) as transition_count, max(wait_hours) as max_wait_hours, {median('wait_hours')} as median_wait_hours,
        {nearest('wait_hours', 0.9)} as p90_wait_hours from tr join (select case_id, flow_type from ct) using (case_id) group by all having count(*) >= 10""", "tr,ct", WAITS),
    "waiting_split": build("""select case_id, sum(wait_hours) as total_wait_hours, coalesce(sum(wait_hours) filter (is_business_hours), 0) as business_wait_hours from tr group by case_id""", "tr",
                           ("total_wait_hours", "business_wait_hours")),
    "rework": build("select * from rw", "rw"),
    "predecessor_entropy": build("select * from pe", "pe", ("predecessor_entropy",)),
    "successor_entropy": build("select * from se", "se", ("successor_entropy",)),
    "position_cv": build("select * from pc", "pc", ("position_cv",)),
    "error_rate": build("select * from er", "er", ("error_rate",)),
    "handoffs": build("select * from ho", "ho"),
    "touchless": build("select * from tl", "tl", ("touchless_ratio",)),
    "sla_band": build("select * from sb", "sb"),
    "automation_base": build("select * from ab", "ab", ("avg_wait_minutes", "std_wait_minutes", "median_wait_minutes", "batch_ratio")),
    "automation_score": build("""select activity, total_count, batch_ratio, human_count, case_count, median_wait_minutes, volume_score, batch_gap_score, input_uniformity_score, timing_regularity_score,
        error_reduction_score, wait_reduction_score, error_rate, automation_score, automation_tier, hours_saved_per_month from au""", "au",
        ("batch_ratio", "median_wait_minutes", "volume_score", "batch_gap_score", "input_uniformity_score", "timing_regularity_score", "error_reduction_score", "wait_reduction_score", "error_rate",
         "automation_score", "hours_saved_per_month")),
    "variant_ids": build("""select case_id, variant_id, event_count as variant_length, array_to_string(string_split(activities, '|')[1:3], '|') as first_activities from cm""", "cm"),
    "variant_frequencies": build("""select variant_id, count(*) as case_count, min(event_count) as variant_length, min(array_to_string(string_split(activities, '|')[1:3], '|')) as first_activities
        from cm group by variant_id""", "cm"),
    "automation_candidates": build(f"""select activity, {STAGE.format('activity')} as stage, total_count as total_executions, human_count as human_executions, round(batch_ratio, 3) as batch_ratio,
        round(volume_score, 3) as volume_score, round(batch_gap_score, 3) as batch_gap_score, round(input_uniformity_score, 3) as input_uniformity, round(timing_regularity_score, 3) as timing_regularity,
        round(error_reduction_score, 3) as error_reduction, round(wait_reduction_score, 3) as wait_reduction, round(automation_score, 3) as automation_score, automation_tier,
        round(hours_saved_per_month, 0) as estimated_hours_saved_monthly from au""", "au"),
    "tier_histogram": build("select automation_tier, count(*) as activities from au group by 1", "au"),
    **{r.lower().replace("-", ""): build(f"select case_id, rule_name, passed, severity, detail from ch where rule_id = '{r}'", "ch") for r in RULE_IDS},
    "compliance_checks": build("select * from ch", "ch"),
    "ordered_checks": build("select * from dc", "dc"),
    "compliance_scores": build("select * from sc", "sc", ("compliance_score",)),
    "fact_event_log": build("""select case_id, activity, ts, event_seq, cast(date as varchar) as date, hour, day_of_week, is_weekend, is_business_hours, resource, resource_type, event_value, event_order, time_since_prev_event,
        process_stage, flow_type, company, vendor from lg join (select case_id, flow_type, company, vendor from ct) using (case_id)""", "lg,ct", ("event_value", "time_since_prev_event")),
    "fact_case_summary": build(f"select {CASE_COLUMNS}, rework_count, loop_count, has_rework, compliance_score, compliance_flags, touchless_ratio, is_happy_path, handoff_count, sla_risk from fs", "fs",
                               ("case_duration_days", "compliance_score", "touchless_ratio")),
    "dim_activity": build(f"select *, {STAGE.format('activity')} as stage, {STAGE_NAME.format('activity')} as stage_name from ap", "ap", ("case_coverage", "median_duration_to_next", "p90_duration_to_next")),
    "dim_company": build(dimension("company"), "ct", ("avg_duration_days", "median_duration_days")),
    "dim_vendor": build(dimension("vendor, vendor_name"), "ct", ("avg_duration_days", "median_duration_days")),
    "dim_calendar": build("""select cast(d as varchar) as date, cast(year(d) as int) as year, cast(month(d) as int) as month, cast(quarter(d) as int) as quarter, cast(isodow(d) as int) as day_of_week, isodow(d) >= 5 as is_weekend,
        isodow(d) < 5 as is_business_day from (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as d from lg)""", "lg"),
    "exec_kpis": build(f"""select count(*) as total_cases, cast(sum(event_count) as bigint) as total_events, round(avg(case_duration_days), 1) as avg_case_duration_days, {pct('has_rework')} as rework_rate,
        {pct('is_happy_path')} as happy_path_rate, {pct('touchless_ratio = 1')} as touchless_rate, round(avg(touchless_ratio) * 100, 1) as automation_coverage, {pct("sla_risk = 'high'")} as high_sla_risk_rate,
        round(100 * sum(touchless_ratio * event_count) / sum(event_count), 1) as batch_event_share, (select {pct('passed')} from ch) as compliance_rate from fs""", "fs,ch"),
    "monthly_trend": build("""select strftime(case_start, '%Y-%m') as month, count(*) as cases, round(avg(compliance_score) * 100, 1) as compliance_rate, round(avg(case_duration_days), 1) as avg_duration
        from fs where year(case_start) >= 2018 group by 1""", "fs"),
    "sla_distribution": build("select sla_risk, count(*) as case_count from fs group by 1", "fs"),
    "top_variants": build("""select variant_id, case_count, case_percentage, variant_length, is_happy_path, dominant_flow_type, median_duration_days, activities, variant_compliance,
        (select sum(passed_checks)::double / sum(total_checks) from sc) as compliance_rate from vs join (select variant_id, avg(compliance_score) as variant_compliance from ct join sc using (case_id)
        group by 1) using (variant_id) order by case_count desc, variant_id limit 50""", "vs,ct,sc", ("case_percentage", "median_duration_days", "variant_compliance", "compliance_rate")),
    "variant_concentration": build("""select k as top_n, cast(sum(case_count) as bigint) as covered_cases, 100.0::double * sum(case_count) / (select sum(case_count) from vs) as concentration_pct from
        (select case_count, row_number() over (order by case_count desc, variant_id) as r from vs) join (select unnest([5, 10, 20])::int as k) on r <= k group by k""", "vs", ("concentration_pct",)),
    "compliance_by_rule": build("select rule_id, rule_name, severity, avg(passed::int) as compliance_rate, count(*) filter (not passed) as violations from ch group by all", "ch", ("compliance_rate",)),
    **{f"compliance_{n}": build(f"""select {k}, avg(compliance_score) as compliance_rate, cast(sum(critical_violations) as bigint) as critical_violations, count(*) as case_count
        from ct join sc using (case_id) group by {k}""", "ct,sc", ("compliance_rate",)) for n, k in (("by_company", "company"), ("by_flow", "flow_type"), ("heatmap", "company, flow_type"))},
    "top_violating_vendors": build("""select vendor, vendor_name, count(*) filter (compliance_score < 0.5) as violations, count(*) as case_count,
        (count(*) filter (compliance_score < 0.5))::double / count(*) as violation_rate from ct join sc using (case_id) group by 1, 2 order by violations desc, vendor, vendor_name limit 20""", "ct,sc", ("violation_rate",)),
    "top_bottlenecks": build("""select from_activity, to_activity, transition_count, p90_wait_hours, round(transition_count * median_wait_hours, 0) as impact_score from bn where is_bottleneck
        order by p90_wait_hours desc, from_activity, to_activity limit 15""", "bn", ("p90_wait_hours",)),
    "bottleneck_stages": build(f"select *, {STAGE.format('from_activity')} as from_stage, {STAGE.format('to_activity')} as to_stage from bn", "bn", WAITS),
    "chart_cap": build("""select * from (select from_activity, to_activity, transition_count, p90_wait_hours, round(transition_count * median_wait_hours, 0) as impact_score from bn where is_bottleneck
        order by p90_wait_hours desc, from_activity, to_activity limit 15) where p90_wait_hours <= 20 * (select list_extract(list_sort(list(p90_wait_hours), 'desc'), cast(floor(count(*) / 2) as int) + 1) from
        (select p90_wait_hours from bn where is_bottleneck order by p90_wait_hours desc, from_activity, to_activity limit 15)) order by p90_wait_hours desc, from_activity, to_activity limit 10""", "bn", ("p90_wait_hours",)),
    "process_counts": build("select count(*) filter (is_bottleneck) as bottlenecks, count(*) as edges, cast(sum(transition_count) as bigint) as transitions from bn", "bn"),
    "case_timelines": build("""select case_id, flow_type, company, vendor, vendor_name, round(case_duration_days, 1) as duration_days, event_count, round(compliance_score, 3) as compliance_score, has_rework, variant_id,
        is_happy_path, sla_risk, string_agg(concat(event_order, ':', activity, ':', resource, ':', resource_type, ':', process_stage, ':', printf('%.2f', round(coalesce(time_since_prev_event, 0) / 3600, 2))), '|' order by event_order) as events
        from (select * from fs order by md5(case_id), case_id limit 1000) join (select case_id, event_order, activity, resource, resource_type, process_stage, time_since_prev_event from lg) using (case_id) group by all""", "fs,lg"),
    "company_radar": build("""select *, 1 - avg_duration_days / max(avg_duration_days) over () as speed, 1 - rework_rate as efficiency, case_count::double / max(case_count) over () as volume from
        (select company, count(*) as case_count, avg(case_duration_days) as avg_duration_days, avg(has_rework::int) as rework_rate, avg(touchless_ratio) as mean_touchless_ratio,
         avg(is_happy_path::int) as happy_path_rate, avg(compliance_score) as compliance_rate from fs group by 1)""", "fs",
        ("avg_duration_days", "rework_rate", "mean_touchless_ratio", "happy_path_rate", "compliance_rate", "speed", "efficiency", "volume")),
    "case_drilldown": build("""select case_id, flow_type, company, sla_risk, has_rework, event_count, case_duration_days from fs where flow_type = '2way' and sla_risk = 'low' and has_rework
        order by case_id limit 100""", "fs", ("case_duration_days",)),
    "sorted_cases": build("""select case_id, flow_type, event_count, case_duration_days from ct order by case_duration_days desc, case_id limit 100""", "ct", ("case_duration_days",)),
    "stratified_split": build("select * from sp", "sp"),
    "sla_features": build(FEATURE_ROWS, "sp,ct"),
    "sla_first_splits": build(f"""select feature, cast(v as double) as threshold, cast(nl as bigint) as rows_left,
        power(((nl - pl) * g0 + pl * g1) / 16777216, 2) / (((nl - pl) * h0 + pl * h1) / 16777216)
        + power(((n - p - nl + pl) * g0 + (p - pl) * g1) / 16777216, 2) / (((n - p - nl + pl) * h0 + (p - pl) * h1) / 16777216)
        - power(((n - p) * g0 + p * g1) / 16777216, 2) / (((n - p) * h0 + p * h1) / 16777216) as gain from
        (select feature, v, sum(m) over w as nl, sum(q) over w as pl from (select feature, v, count(*) as m, sum(target) as q from
          (select unnest([{", ".join(f"'{f}'" for f in MODEL_INPUTS)}]) as feature, unnest([{", ".join(MODEL_INPUTS)}]) as v, target from rw) group by 1, 2)
         window w as (partition by feature order by v)),
        (select n, p, round(r * 16777216::double) as g0, round(r * (1 - r) * 16777216::double) as h0, round((n - p) / p * (r - 1) * 16777216::double) as g1,
                round((n - p) / p * r * (1 - r) * 16777216::double) as h1 from
          (select n, p, 1 / (1 + exp(-ln((p / n) / (1 - p / n)))) as r from (select count(*)::double as n, sum(target)::double as p from rw)))
        where nl >= 20 and n - nl >= 20""".replace("from rw", f"from ({FEATURE_ROWS}) where not in_test_set"), "sp,ct", ("gain",)),
    "score_metrics": build("""select (sum(p * (below + (n + 1) / 2.0::double)) - sum(p) * (sum(p) + 1) / 2.0::double) / (sum(p) * (sum(n) - sum(p))) as auc_roc, sum(p * pf::double / nf) / sum(p) as average_precision,
        sum(p) filter (s >= 0.5)::double / sum(n) filter (s >= 0.5) as precision, sum(p) filter (s >= 0.5)::double / sum(p) as recall,
        2.0::double * sum(p) filter (s >= 0.5) / (sum(n) filter (s >= 0.5) + sum(p)) as f1 from
        (select s, n, p, sum(n) over (order by s) - n as below, sum(n) over (order by s desc) as nf, sum(p) over (order by s desc) as pf from
        (select s, count(*) as n, sum(target) as p from (select cast(sla_risk <> 'low' as int) as target, round(event_count / 6.0::double, 6) as s from fs) group by s))""", "fs",
        ("auc_roc", "average_precision", "precision", "recall", "f1")),
    "orphan_cases": build("select distinct case_id from lg where case_id not in (select case_id from ct where flow_type <> 'consignment')", "lg,ct"),
    "null_rates": build("select unnest(" + str(list(LOG_COLUMNS)) + ") as column_name, unnest([" + ", ".join(f"avg(({c} is null)::int)" for c in LOG_COLUMNS) + "]) as null_rate from lg",
                        "lg", ("null_rate",)),
    "quality_gates": build("""select unnest(['case_id_not_null', 'activity_not_null', 'timestamp_null_rate', 'enough_activities', 'resource_type_not_null', 'resource_type_known', 'event_order_positive', 'flow_type_not_null',
        'flow_type_known', 'duration_not_negative', 'variant_not_null']) as gate, unnest([g1, g2, g3, g4, g5, g6, g7, g8, g9, g10, g11]) as passed from
        (select count(*) filter (case_id is null) = 0 as g1, count(*) filter (activity is null) = 0 as g2, avg((ts is null)::int) <= 0.001 as g3, count(distinct activity) >= 5 as g4,
         count(*) filter (resource_type is null) = 0 as g5, count(*) filter (resource_type not in ('human', 'batch', 'unknown')) = 0 as g6, min(event_order) >= 1 as g7 from lg),
        (select count(*) filter (flow_type is null) = 0 as g8, count(*) filter (flow_type not in ('3way_invoice_after_gr', '3way_invoice_before_gr', '2way', 'consignment')) = 0 as g9,
         min(case_duration_days) >= 0 as g10, count(*) filter (variant_id is null) = 0 as g11 from ct)""", "lg,ct"),
    "log_profile": build(f"""select count(*) as event_count, count(distinct case_id) as case_count, count(distinct activity) as activity_count, count(distinct resource) as resource_count, min(ts) as first_ts, max(ts) as last_ts,
        count(*) filter (is_timestamp_anomaly) as anomaly_count, min(event_value) as min_value, max(event_value) as max_value, avg(event_value) as mean_value, any_value(m) as median_case_length, any_value(p) as p90_case_length,
        any_value(q) as p99_case_length from lg, (select {median('n')} as m, {nearest('n', 0.9)} as p, {nearest('n', 0.99)} as q from (select count(*) as n from lg group by case_id))""", "lg",
        ("min_value", "max_value", "mean_value")),
    "sketch_profile": build("select c as \"column\", n as rows, u as nulls, true as distinct_within, m as median_within from (" + " union all ".join(
        f"select '{c}' as c, count(*) as n, count(*) filter ({c} is null) as u, {m} as m from lg" for c, m in (
            ("case_id", "cast(null as boolean)"), ("activity", "cast(null as boolean)"), ("resource", "cast(null as boolean)"), ("event_value", "true"),
            ("time_since_prev_event", "true"))) + ")", "lg"),
    "activity_frequency": build("select activity as value, count(*) as n from lg group by 1 order by n desc, value limit 20", "lg"),
    "bronze_dedupe": build("select arg_min(event_type, row(ts, event_id)) as event_type, user_id, min(row(ts, event_id)).ts as ts from (select event_type, user_id, ts, event_id from events) group by user_id".replace(
        "min(row(ts, event_id)).ts", "min(ts)"), "ev"),
    "conversation_variants": build("""select variant_id, count(*) as case_count, min(activities) as activities from (select case_id, string_agg(activity, '|' order by event_seq) as activities,
        substr(md5(string_agg(activity, '|' order by event_seq)), 1, 12) as variant_id from cv group by case_id) group by variant_id""", "cv"),
    "conversation_dfg": build("""select activity as from_activity, b as to_activity, count(*) as transition_count from (select activity, lead(activity) over (partition by case_id order by event_seq) as b from cv)
        where b is not null group by all""", "cv"),
    "xes_roundtrip": build("""select case_id, activity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, resource, event_value,
        row_number() over (partition by case_id order by ts, event_seq) - 1 as event_seq from ev""", "ev", ("event_value",)),
    "xes_format": build("""select case_id, activity, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts, resource, event_value,
        row_number() over (partition by case_id order by ts, event_seq) - 1 as event_seq from ev""", "ev", ("event_value",)),
    "user_sessions": """with g as (select user_id, ts, case when date_sub('microsecond', lag(ts) over w, ts) < 6 * 3600 * 1000000::bigint then 0 else 1 end as n from events window w as (partition by user_id order by ts, event_id)),
        s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows unbounded preceding) as k from g)
        select user_id, min(ts) as session_start, max(ts) + interval 6 hour as session_end, count(*) as events from s group by user_id, k""",
}
