"""The same queries in SQL, written against the plain test tables."""

from __future__ import annotations

ID = "concat('TARA_', lpad(cast({} as varchar), 10, '0'))"

# Derived tables; each may use those above it.
VIEWS = {
    "context": f"""
        select {ID.format('c_custkey')} as sample_id_pangaea,
          concat('SAMEA', c_custkey) as sample_id_biosamples, concat('ERS', c_custkey) as sample_id_ena,
          c_mktsegment as sample_material, first_order as event_date,
          cast(c_custkey % 181 - 90 as double) as event_latitude,
          cast(c_custkey * 7 % 361 - 180 as double) as event_longitude,
          case when c_custkey % 5 = 0 then '0-100' else cast(c_custkey % 1000 as varchar) end as depth_nominal,
          concat(r_name, ' Biome') as marine_biome,
          concat('[', substr(r_name, 1, 2), '] ', r_name) as ocean_region,
          concat(r_name, '/', n_name) as biogeo_province, n_name as station,
          case c_mktsegment when 'BUILDING' then 'SRF' when 'AUTOMOBILE' then 'DCM'
            when 'MACHINERY' then 'MES' when 'HOUSEHOLD' then 'MIX' else 'FSW' end as depth,
          case when c_custkey % 11 = 0 then null when c_nationkey % 3 = 0 then '0.8-5'
            when c_nationkey % 3 = 1 then '5-20' else '20-180' end as size_fraction,
          cast(case c_nationkey % 3 when 0 then 0.8 when 1 then 5 else 20 end as double) as lower_size_fraction,
          cast(case when c_custkey % 13 = 0 then null when c_nationkey % 3 = 0 then 5
            when c_nationkey % 3 = 1 then 20 else 180 end as double) as upper_size_fraction,
          case when c_custkey % 17 <> 0 then c_mktsegment end as depthplot,
          case when c_custkey % 19 = 0 then null when c_nationkey % 3 = 0 then 'pico'
            when c_nationkey % 3 = 1 then 'nano' else 'micro' end as sizeplot,
          n_name as station_plot, r_name as biomeplot,
          case when abs(c_custkey % 181 - 90) >= 60 then 'Polar' else 'Non polar' end as polar,
          cast(abs(c_custkey % 181 - 90) as double) as abs_lat,
          case when c_custkey % 2 = 0 then 'yes' else 'no' end as uniq,
          case when c_custkey % 3 = 0 then 'no' else 'yes' end as complete,
          case when c_custkey % 29 = 0 then 'yes' else 'no' end as coral_station,
          case when c_custkey % 23 <> 0 then c_acctbal / 100 end as par,
          cast(-(c_custkey % 5000) as integer) as depth_bathy,
          cast(c_custkey % 97 as double) / 100 as lyapunov_exp,
          case when c_custkey % 7 <> 0 then c_acctbal end as temperature,
          case when c_custkey % 9 <> 0 then cast(c_custkey % 211 as double) / 50 end as chla,
          cast(c_custkey % 53 as double) / 1000 as backscattering,
          cast(case when c_custkey % 10 <> 3 then c_custkey % 150 end as integer) as depth_chl_max,
          cast(c_custkey % 200 as integer) as mixed_layer_depth_sigma,
          cast(case when c_custkey % 8 <> 1 then c_custkey % 300 end as integer) as "depth_max_brunt_väisälä",
          cast(c_custkey % 101 as double) / 10 as nitrite, cast(c_custkey % 37 as double) / 10 as phosphate,
          case when c_custkey % 6 <> 5 then cast(c_custkey % 43 as double) / 10 end as nitrate_nitrite,
          cast(c_custkey % 59 as double) / 10 as silicate, cast(c_custkey % 41 - 20 as double) / 2 as nstar
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
          left join (select o_custkey, min(o_orderdate) as first_order from orders group by 1)
            on o_custkey = c_custkey""",
    "counts": f"""
        select marker, md5(cast(l_partkey as varchar)) as amplicon, {ID.format('o_custkey')} as sample_id,
          cast(sum(case when o_custkey % 97 = 0 then 0 else quantity end) as bigint) as reads
        from (select l_orderkey, l_partkey, cast(l_quantity as bigint) as quantity,
                case l_linestatus when 'O' then 'v4' when 'F' then 'v9' end as marker from lineitem)
          join orders on l_orderkey = o_orderkey
        where (marker = 'v4' and o_custkey % 10 < 7) or (marker = 'v9' and o_custkey % 10 between 3 and 8)
        group by marker, l_partkey, o_custkey""",
    "cells": "select * from counts where reads > 0",
    "metadata": """
        select m.marker, md5(cast(p_partkey as varchar)) as amplicon,
          concat('Root;Eukaryota;', p_type, ';', p_brand, ';', p_name) as taxonomy,
          concat('100;99;98;97;', p_size) as confidence, coalesce(t.total, 0) as total,
          coalesce(t.spread, 0) as spread,
          translate(md5(cast(p_partkey as varchar)), '0123456789abcdef', 'ACGTACGTACGTACGT') as sequence
        from part, (values ('v4'), ('v9')) m(marker)
          left join (select marker, amplicon, cast(sum(reads) as bigint) as total, count(*) as spread
                     from cells group by 1, 2) t
            on t.marker = m.marker and t.amplicon = md5(cast(p_partkey as varchar))""",
    "marker_samples": """
        select marker, sample_id, row_number() over (partition by marker order by sample_id) - 1 as ordinal
        from (select distinct marker, sample_id from counts)""",
    "wide": f"""
        select marker, md5(cast(l_partkey as varchar)) as amplicon, g.sample_id,
          cast(sum(cast(l_quantity as bigint)) as bigint) as reads
        from (select *, case l_linestatus when 'O' then 'v4' when 'F' then 'v9' end as marker from lineitem)
          join orders on l_orderkey = o_orderkey join customer c on o_custkey = c.c_custkey
          join (select c_nationkey, c_mktsegment, {ID.format('min(c_custkey)')} as sample_id
                from customer group by 1, 2) g
            on g.c_nationkey = c.c_nationkey and g.c_mktsegment = c.c_mktsegment
        group by 1, 2, 3""",
    "width": "select count(*) as n from (select distinct c_nationkey, c_mktsegment from customer)",
    "flawed": """
        select marker, case when total % 17 = 0 then upper(amplicon) else amplicon end as amplicon,
          case when total % 10 = 0 then concat(taxonomy, '; ') else taxonomy end as taxonomy,
          case when total % 7 = 0 then '100;99;98;97' when total % 11 = 0 then concat(confidence, ';101')
            when total % 13 = 0 then replace(confidence, '99', ' 5 ') else confidence end as confidence,
          total, spread, case when total % 19 = 0 then concat(sequence, 'X') else sequence end as sequence
        from metadata""",
    "shifted": """
        select marker, amplicon, case when spread % 5 = 0 then total + 1 else total end as total,
          case when total % 23 = 0 then spread - 1 else spread end as spread from metadata""",
    "abundance": """
        select s.sample_id, coalesce(r.hits, 0) as taxon_read_count, coalesce(r.library, 0) as sample_total_read_count,
          case when coalesce(r.library, 0) > 0 then coalesce(r.hits, 0) / r.library end as relative_abundance
        from marker_samples s left join (
          select sample_id, cast(sum(reads) as bigint) as library,
            cast(sum(case when list_contains(string_split(lower(taxonomy), ';'), '{taxon}') then reads else 0 end)
              as bigint) as hits
          from cells join metadata using (marker, amplicon) where marker = 'v4' group by 1) r using (sample_id)
        where s.marker = 'v4'""",
    "observed": """
        select s.sample_id, coalesce(r.n, 0) as analysis_read_count, coalesce(r.kinds, 0) as observed_asv_richness,
          case when r.kinds = 1 then 0.0 when r.n > 0 then greatest(0.0, ln(r.n) - r.nlogn / r.n) end as shannon_index
        from marker_samples s left join (
          select sample_id, cast(sum(reads) as bigint) as n, count(*) as kinds, sum(reads * ln(reads)) as nlogn
          from cells {restriction} where marker = 'v9' group by 1) r using (sample_id)
        where s.marker = 'v9'""",
    "points": """
        select sample_id, temperature as environment_value, relative_abundance
        from abundance join context on sample_id = sample_id_pangaea
        where temperature is not null and relative_abundance is not null""",
    "ranked": """
        select rank() over (order by environment_value)
            + (count(*) over (partition by environment_value) - 1) / 2.0 as rx,
          rank() over (order by relative_abundance)
            + (count(*) over (partition by relative_abundance) - 1) / 2.0 as ry
        from points""",
    # Student's t for whole degrees of freedom: a finite series in cos(theta).
    "tested": """
        select n as sample_count, rho, case when v % 2 = 0 then
            1 - sin(th) * (select sum(exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * pow(cos(th), 2 * j))
                           from range(0, cast(v // 2 as bigint)) t(j))
          else 1 - 2 / pi() * (th + sin(th) * coalesce((select sum(exp(lgamma(0.5) + lgamma(j + 1)
                - lgamma(j + 1.5)) / 2 * pow(cos(th), 2 * j + 1)) from range(0, cast((v - 1) // 2 as bigint)) t(j)), 0))
          end as p_value
        from (select *, n - 2 as v, atan(abs(rho) / sqrt(1 - rho * rho)) as th
              from (select count(*) as n, corr(rx, ry) as rho from ranked))""",
    "sessions": r"""
        select conv_id as session_id, conv_id % 5 as user_id,
          case when length(line) <= 80 then line else concat(substr(line, 1, 79), '…') end as title,
          'active' as status,
          case when conv_id % 6 = 0 then timestamp '2024-01-01' + to_hours(cast(conv_id % 17 as integer)) end as pinned_at,
          timestamp '2024-01-01' + to_hours(cast(conv_id % 8760 as integer)) as updated_at
        from (select conv_id, regexp_replace(trim(min_by(text, turn), e' \t\n\r'), '\s+', ' ', 'g') as line
              from conversations group by 1)""",
    "messages": """
        select conv_id as session_id, turn, role, text as content,
          concat(conv_id, '-202401', lpad(cast(turn % 28 + 1 as varchar), 2, '0')) as trace_id,
          row_number() over (partition by conv_id order by turn) - 1 as sequence_no from conversations""",
    "numbered": """
        select *, concat(user_id, '-', strftime(ts, '%Y%m%d')) as trace_id,
          row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as sequence_no,
          cast(round_even(value * 10, 0) as bigint) as span_ms,
          case when event_type = 'error' then 'failed' when event_id % 37 = 0 then 'running'
            else 'completed' end as state
        from events""",
    "spans": """
        select trace_id, concat(trace_id, '#', sequence_no) as span_id,
          case when sequence_no > 0 then concat(trace_id, '#', (sequence_no - 1) // 2) end as parent_span_id,
          sequence_no, concat(event_type, ' ', event_id) as name,
          case when sequence_no = 0 then 'workflow' when event_type = 'view' then 'node'
            when event_type = 'click' then 'tool' when event_type = 'purchase' then 'llm' else 'data' end as span_kind,
          state as status, ts as started_at,
          case when state <> 'running' then ts + to_milliseconds(span_ms) end as ended_at,
          case when state <> 'running' then span_ms end as duration_ms,
          case when state = 'failed' then 'OperationError' end as error_code,
          case when state = 'failed' then concat('password=', md5(cast(event_id as varchar))) end as error_message,
          case when sequence_no > 0 and event_type = 'click' then concat('tool_', event_id % 6) end as tool_name,
          event_type, json_extract_string(props, '$.k') as k, props as output_data, event_id
        from numbered""",
    "traces": """
        select trace_id, cast(split_part(trace_id, '-', 1) as bigint) as session_id, min(started_at) as started_at,
          case when bool_or(status = 'failed') then 'failed' when bool_or(status = 'running') then 'running'
            else 'completed' end as status,
          case when bool_or(status = 'failed') or not bool_or(status = 'running') then max(ended_at) end as ended_at,
          count(*) as span_count, concat('What happened in ', trace_id, '?') as question
        from spans group by trace_id""",
    "life": """
        select concat(user_id, '-', strftime(ts, '%Y%m%d')) as trace_id, cast(event_id as varchar) as span_id,
          case when event_id % 3 <> 0 then cast(event_id - event_id % 3 as varchar) end as parent_span_id,
          concat(event_type, ' ', event_id) as name, event_type as span_kind, ts as began, event_id,
          case when event_id % 29 <> 0 then ts + to_seconds(cast(round_even(value * 40, 0) as bigint)) end as done,
          case when event_id % 29 <> 0 then cast(round_even(value * 40, 0) as bigint) * 1000 end as life_ms,
          case when event_type = 'error' then 'failed' else 'completed' end as final,
          case when event_type = 'error' then 'OperationError' end as code
        from events""",
}

NEEDS = {
    "cells": ["counts"], "metadata": ["cells"], "marker_samples": ["counts"], "flawed": ["metadata"],
    "shifted": ["metadata"], "abundance": ["cells", "metadata", "marker_samples"],
    "observed": ["cells", "metadata", "marker_samples"], "points": ["abundance", "context"],
    "ranked": ["points"], "tested": ["ranked"], "spans": ["numbered"], "traces": ["spans"],
}


def _closure(names: list[str]) -> list[str]:
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo.extend(NEEDS.get(name, []))
    return [v for v in VIEWS if v in wanted]


def sql(uses: str, body: str, taxon: str = "economy", restriction: str = "") -> str:
    """``body`` behind the derived tables that it uses."""
    parts = []
    for name in _closure(uses.split()):
        text = VIEWS[name].replace("{taxon}", taxon).replace("{restriction}", restriction)
        parts.append(f"{name} as ({text})")
    # A body that starts with a comma adds derived tables of its own.
    link = "" if body.lstrip().startswith(",") else " "
    return f"with {', '.join(parts)}{link}{body.strip()}"


LEVEL = "list_contains(string_split(lower(taxonomy), ';'), 'economy')"
PROMO = ("semi join (select marker, amplicon from metadata where "
         "list_contains(string_split(lower(taxonomy), ';'), 'promo')) using (marker, amplicon)")
SEARCH = """contains(lower(ocean_region), 'asia') and polar = 'Non polar' and depth in ('SRF', 'DCM')
            and size_fraction in ('0.8-5', '5-20')"""
SUMMARY = ("sample_id_pangaea, event_date, event_latitude, event_longitude, ocean_region, station, depth, "
           "size_fraction, polar, temperature")
WARNING = "cast(null as varchar) as field, cast(null as bigint) as sample_count, cast(null as bigint) as candidate_sample_count"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMERIC = ("event_latitude event_longitude lower_size_fraction upper_size_fraction abs_lat par depth_bathy "
           "lyapunov_exp temperature chla backscattering depth_chl_max mixed_layer_depth_sigma "
           "depth_max_brunt_väisälä nitrite phosphate nitrate_nitrite silicate nstar").split()
NULLABLE = ("event_date size_fraction upper_size_fraction depthplot sizeplot par temperature chla depth_chl_max "
            "depth_max_brunt_väisälä nitrate_nitrite").split()
PROFILE = " union all ".join(
    f"""select '{c}' as column_name, cast(min("{c}") as double) as min_value, cast(max("{c}") as double) as max_value,
        count(*) - count("{c}") as null_count, cast(0 as bigint) as non_finite_count,
        count(*) filter ("{c}" < q1 - 1.5 * (q3 - q1) or "{c}" > q3 + 1.5 * (q3 - q1)) as iqr_outlier_count
        from context, (select quantile_cont("{c}", 0.25) as q1, quantile_cont("{c}", 0.75) as q3 from context)"""
    for c in NUMERIC)
MISSING = " union all ".join(
    f"""select '{c}' as column_name, count(*) - count("{c}") as null_count from context""" for c in NULLABLE)
SPLIT = "string_split({}, ';')"
REDACTED = r"""regexp_replace(regexp_replace(regexp_replace(
    concat(text, ' password=', md5(cast(conv_id as varchar)), ' Bearer tok', conv_id,
           ' https://u', conv_id, ':p', turn, '@host/x'),
    '\bbearer\s+[^\s,;]+', 'Bearer [REDACTED]', 'gi'),
    '([a-z][a-z0-9+.-]*://)([^\s/:@]+):([^\s/@]+)@', '\1[REDACTED]@', 'gi'),
    '\b(api[-_ ]?key|authorization|client[-_ ]?secret|password|passwd|access[-_ ]?token|refresh[-_ ]?token|secret)\b(\s*[:=]\s*)([^\s,;&]+)',
    '\1\2[REDACTED]', 'gi')"""
TRIMMED = r"""regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"""
REPORT = """
    (select marker, count(*) as row_count, count(*) - count(distinct amplicon) as duplicate_amplicons,
       min(total) as min_total, max(total) as max_total, min(spread) as min_spread, max(spread) as max_spread,
       cast(sum(spread) as bigint) as positive_cells,
       min(cast(string_split(confidence, ';')[5] as double)) as lowest
     from metadata group by 1) m
    join (select marker, count(*) as sample_count from marker_samples group by 1) s using (marker)
    join (select marker, max(reads) as max_read_count from cells group by 1) c using (marker)"""
# Shape of the stored artifacts built from the raw sources.
STORED = """
    (select 'abundance' as artifact, count(*) filter (reads > 0) as row_count, 4 as column_count,
       (select n from width) as sample_column_count from wide
     union all select 'context', (select count(*) from customer), 39, 0
     union all select 'marker_samples', 2 * (select n from width), 3, 0
     union all select 'metadata', 2 * (select count(*) from part), 7, 0)"""
SOURCES = """
    (select 'context_general' as source, 'context_general.tsv' as filename, (select count(*) from customer) as row_count,
       25 as column_count, 0 as samples
     union all select 'context_stat', 'context_stat.tsv', (select count(*) from customer), 15, 0
     union all select '18s_v4', 'TARA-Oceans_18S-V4_dada2_table.tsv', (select count(*) from part),
       6 + cast((select n from width) as integer), cast((select n from width) as integer)
     union all select '18s_v9', 'TARA-Oceans_18S-V9_dada2_table.tsv', (select count(*) from part),
       6 + cast((select n from width) as integer), cast((select n from width) as integer))"""
GENERAL = """sample_id_pangaea, sample_id_biosamples, sample_id_ena, sample_material,
    strftime(event_date, '%Y-%m-%dT%H:%M:%S') as event_date, event_latitude, event_longitude, depth_nominal,
    marine_biome, ocean_region, biogeo_province, station, depth, size_fraction, lower_size_fraction,
    upper_size_fraction, depthplot, sizeplot, station_plot, biomeplot, polar, abs_lat, uniq, complete, coral_station"""
STAT = """par, depth_bathy, lyapunov_exp, temperature, chla, backscattering, depth_chl_max,
    mixed_layer_depth_sigma, "depth_max_brunt_väisälä", nitrite, phosphate, nitrate_nitrite, silicate, nstar"""
ROUNDED = "sample_id, taxon_read_count, sample_total_read_count, round(relative_abundance, 9) as relative_abundance"
DIVERSE = "sample_id, analysis_read_count, observed_asv_richness, round(shannon_index, 9) as shannon_index"

DELETED = sql("sessions messages traces spans", """
        , gone as (select session_id from sessions where session_id % 3 = 0 and user_id = 0)
        select 'deleted' as table_name, count(*) as row_count from gone union all
        select 'sessions', count(*) from sessions where session_id not in (select session_id from gone) union all
        select 'messages', count(*) from messages where session_id not in (select session_id from gone) union all
        select 'traces', count(*) from traces where session_id not in (select session_id from gone) union all
        select 'spans', count(*) from spans join traces using (trace_id)
          where session_id not in (select session_id from gone)""")
SPAN_DETAILS = sql("life", """
    select trace_id, span_id, case when done is null then 'running' else final end as status,
      case when event_id % 5 = 0 and (done is null or done < began + interval 2 day or final = 'completed') then 'Late'
        when done is not null then code end as error_code,
      case when done is not null and final = 'failed' then 'api_key=[REDACTED]' end as error_message,
      case when event_id % 2 = 0 then 'late' else 'early' end as tool_name, 100 + event_id % 3 as input_tokens,
      concat('both=late,early=', event_id, ',first=', case when done is null or final = 'failed' then name else '-' end, ',phase=-')
        as attributes
    from life""")
SAFE_UPDATES = """
    select event_id, '[REDACTED]' as password, event_id as n, concat('secret=[REDACTED] in ', event_id) as error_message,
      (select string_agg(concat('S', event_id + i), ',' order by i) from range(1, 101) r(i) where i <= 90 + event_id % 30) as ids,
      least(100, 95 + event_id % 11) as sources, '[REDACTED]' as token, least(100, 95 + event_id % 11) as last_source,
      case when event_id % 4 = 0 then '{},{},{"value":[1]}' end as refs,
      case when event_id % 30 > 10 then event_id % 30 - 10 when event_id % 2 = 0 then 0 end as omitted,
      case when event_id % 2 = 0 then '[REDACTED]' end as api_key, case when event_id % 2 = 0 then event_id end as step
    from events"""

ORACLE = {
    "scan_typed_tsv": sql("context", f"select {GENERAL} from context"),
    "header_contract": sql("width", f"""select source, true as present, column_count, samples as sample_column_count,
        0 as missing, 0 as doubled, 0 as invalid, true as ready from {SOURCES}"""),
    "source_fingerprint": sql("width", f"select source, row_count, column_count, 64 as hash_digits from {SOURCES}"),
    "wide_to_long": sql("wide", "select * from wide where reads > 0"),
    "context_by_ids": sql("context marker_samples", f"""select {SUMMARY} from context
        where sample_id_pangaea in (select sample_id from marker_samples where marker = 'v9')"""),
    "marker_sample_list": sql("marker_samples", "select * from marker_samples"),
    "abundance_slice": sql("cells marker_samples", """select amplicon, sample_id, reads from cells
        where marker = 'v4' and sample_id in (select sample_id from marker_samples where marker = 'v9')"""),
    "marker_data_join": sql("cells metadata", """select amplicon, taxonomy, total, sample_id, reads
        from metadata join cells using (marker, amplicon) where marker = 'v4' and contains(taxonomy, 'ECONOMY')"""),
    "artifact_integrity": sql("width wide", f"select artifact, true as present, true as size_matches from {STORED}"),
    "benchmark_taxon_sums": sql("cells metadata marker_samples", """
        select s.sample_id, cast(coalesce(sum(reads) filter (contains(taxonomy, 'ECONOMY')), 0) as bigint) as reads
        from marker_samples s left join cells c on c.marker = s.marker and c.sample_id = s.sample_id
          left join metadata m on m.marker = c.marker and m.amplicon = c.amplicon
        where s.marker = 'v4' and s.ordinal < 8 group by 1"""),
    "benchmark_raw_and_stored": sql("wide", """
        select s.sample_id, cast(coalesce(sum(reads), 0) as bigint) as raw_reads,
          cast(coalesce(sum(reads), 0) as bigint) as stored_reads
        from (select distinct sample_id from (select concat('TARA_', lpad(cast(min(c_custkey) as varchar), 10, '0'))
                as sample_id from customer group by c_nationkey, c_mktsegment) order by 1 limit 8) s
          left join (select sample_id, reads from wide join part on md5(cast(p_partkey as varchar)) = amplicon
            where marker = 'v4' and contains(concat(p_type, ';', p_brand, ';', p_name), 'ECONOMY')) w using (sample_id)
        group by 1"""),
    "key_contract": sql("context cells", """
        select label, count(*) as row_count, count(*) - count(id) as null_ids,
          count(id) - count(distinct id) as duplicate_ids,
          count(*) filter (not starts_with(id, 'TARA_')) as invalid_ids
        from (select 'context' as label, sample_id_pangaea as id from context union all
              select 'cells', sample_id from cells union all select 'customer', c_name from customer) group by 1"""),
    "id_set_equality": sql("marker_samples", """
        select count(*) filter (a and not b) as left_only, count(*) filter (b and not a) as right_only,
          count(*) filter (a and b) as both, count(*) filter (a <> b) = 0 as equal
        from (select sample_id, bool_or(marker = 'v4') as a, bool_or(marker = 'v9') as b
              from marker_samples group by 1)"""),
    "date_parse_errors": """
        select count(*) as row_count, count(*) - count(t) as null_texts,
          count(*) - count(try_cast(t as timestamp)) as null_dates,
          count(t) - count(try_cast(t as timestamp)) as parse_errors
        from (select case when o_orderkey % 13 = 0 then 'someday' when o_orderkey % 17 = 0 then null
                when o_orderkey % 5 = 0 then strftime(o_orderdate, '%Y-%m-%d')
                else strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') end as t from orders)""",
    "context_join": sql("context", f"select {GENERAL}, {STAT} from context"),
    "coordinate_errors": """
        select count(*) as row_count, count(*) filter (lat not between -90 and 90 or lon not between -180 and 180
          or abs(size - abs(lat)) > 1e-9) as coordinate_errors
        from (select case when c_custkey % 37 <> 0 then c_custkey % 200 - 100 end as lat, c_custkey % 400 - 200 as lon,
                abs(c_custkey % 200 - 100) + case when c_custkey % 31 = 0 then 0.5 else 0 end as size from customer)""",
    "context_report": sql("context", f"""
        select count(*) as row_count, cast(0 as bigint) as coordinate_errors, count(distinct depth) as depth_values,
          count(distinct polar) as polar_values, cast(0 as bigint) as general_key_errors,
          cast(0 as bigint) as stat_key_errors, cast(0 as bigint) as unmatched_ids, cast(0 as bigint) as parse_errors,
          cast(0 as bigint) as general_duplicates, cast(0 as bigint) as stat_duplicates,
          (select cast(sum(null_count) as bigint) from ({MISSING})) as missing_values,
          cast(0 as bigint) as non_finite_values,
          (select cast(sum(iqr_outlier_count) as bigint) from ({PROFILE})) as outlier_values, 39 as column_count
        from context"""),
    "missing_values": sql("context", f"select * from ({MISSING}) where null_count > 0"),
    "numeric_profile": sql("context", f"""select column_name, round(min_value, 9) as min_value,
        round(max_value, 9) as max_value, null_count, non_finite_count, iqr_outlier_count from ({PROFILE})"""),
    "duplicate_rows": sql("context", """
        select 'general' as label, count(*) as row_count, cast(0 as bigint) as duplicate_rows from context union all
        select 'orders', count(*), count(*) - (select count(*) from (select distinct o_custkey, o_orderstatus from orders))
        from orders union all
        select 'lineitem', count(*), count(*) - (select count(*) from (select distinct l_partkey, l_quantity from lineitem))
        from lineitem"""),
    "categorical_domain": sql("context", """select distinct 'depth' as column_name, depth as value from context
        union all select distinct 'polar', polar from context"""),
    "taxonomy_level_checks": sql("flawed", f"""
        select marker, count(*) as row_count,
          count(*) filter (len({SPLIT.format('taxonomy')}) <> len({SPLIT.format('confidence')})) as level_mismatches,
          count(*) filter (len(list_filter({SPLIT.format('taxonomy')}, lambda x: trim(x) = '')) > 0) as empty_levels
        from flawed group by 1"""),
    "confidence_checks": sql("flawed", f"""
        select marker, count(*) as value_count, count(*) filter (v is null or v < 0 or v > 100) as invalid_values,
          min(v) as lowest, max(v) as highest
        from (select marker, case when regexp_matches(t, '{NUMBER}') then try_cast(t as double) end as v
              from (select marker, unnest({SPLIT.format('confidence')}) as t from flawed)) group by 1"""),
    "pattern_checks": sql("flawed", """
        select marker, count(*) filter (not regexp_matches(amplicon, '^[0-9a-f]{32}$')) as invalid_amplicons,
          count(*) filter (not regexp_matches(sequence, '^[ACGTN]+$')) as invalid_sequences from flawed group by 1"""),
    "level_histogram": sql("flawed", f"""select marker, cast(len({SPLIT.format('taxonomy')}) as integer) as levels,
        count(*) as variant_count from flawed group by 1, 2"""),
    "reconcile_totals": sql("shifted cells", """
        select s.marker, count(*) as row_count, count(*) filter (s.total <> coalesce(c.total, 0)) as total_mismatches,
          count(*) filter (s.spread <> coalesce(c.spread, 0)) as spread_mismatches,
          cast(0 as bigint) as unknown_amplicons, coalesce(max(c.top), 0) as max_read_count
        from shifted s left join (select marker, amplicon, sum(reads) as total, count(*) as spread, max(reads) as top
          from cells group by 1, 2) c using (marker, amplicon) group by 1"""),
    "marker_report": sql("metadata marker_samples cells", f"""
        select marker, row_count, cast(0 as bigint) as total_mismatches, cast(0 as bigint) as spread_mismatches,
          cast(0 as bigint) as unknown_amplicons, max_read_count, cast(0 as bigint) as level_mismatches,
          cast(0 as bigint) as empty_levels, row_count * 5 as value_count, cast(0 as bigint) as invalid_values,
          lowest, 100.0::double as highest, cast(0 as bigint) as invalid_amplicons,
          cast(0 as bigint) as invalid_sequences, duplicate_amplicons, cast(0 as bigint) as metadata_missing_values,
          min_total, max_total, min_spread, max_spread, positive_cells, sample_count,
          row_count * sample_count as total_cells,
          round(positive_cells / (row_count * sample_count), 8) as nonzero_fraction
        from {REPORT}"""),
    "shape_expectations": sql("metadata marker_samples", """
        select marker, row_count, sample_count, expected_rows, expected_samples,
          row_count = expected_rows and sample_count = expected_samples as as_expected
        from (select marker, count(*) as row_count from metadata group by 1)
          join (select marker, count(*) as sample_count from marker_samples group by 1) using (marker)
          join (values ('v4', 152155::bigint, 1011::bigint), ('v9', 181388::bigint, 1069::bigint))
            e(marker, expected_rows, expected_samples) using (marker)"""),
    "coverage": sql("context marker_samples", """
        select count(*) filter (c) as context_samples, count(*) filter (a) as v4_samples,
          count(*) filter (b) as v9_samples, count(*) filter (a and b) as shared_marker_samples,
          count(*) filter (a and not b) as v4_only_samples, count(*) filter (b and not a) as v9_only_samples,
          count(*) filter (c and not a and not b) as context_without_marker_samples,
          count(*) filter (not c) as marker_samples_missing_context
        from (select id, bool_or(w = 'c') as c, bool_or(w = 'v4') as a, bool_or(w = 'v9') as b
              from (select sample_id_pangaea as id, 'c' as w from context union all
                    select sample_id, marker from marker_samples) group by 1)"""),
    "coverage_ids": sql("context marker_samples", """
        select case when a then 'v4_only' when b then 'v9_only' else 'without_marker' end as coverage, id as sample_id
        from (select sample_id_pangaea as id, coalesce(a, false) as a, coalesce(b, false) as b from context
              left join (select sample_id, bool_or(marker = 'v4') as a, bool_or(marker = 'v9') as b
                from marker_samples group by 1) on sample_id = sample_id_pangaea) where not (a and b)"""),
    "fingerprint_agreement": sql("wide", """select marker, count(*) as row_count, true as equal from wide
        where reads > 0 group by 1"""),
    "artifact_records": sql("width wide", f"""select artifact, row_count, column_count,
        cast(sample_column_count as integer) as sample_column_count from {STORED}"""),
    "dataset_status": sql("width", f"""select source, filename, true as ready, row_count, column_count,
        cast(samples as bigint) as sample_column_count from {SOURCES}"""),
    "content_fingerprint": sql("cells", """
        select count(*) as row_count, cast(sum(mark) as decimal(38,0)) as hash_sum, bit_xor(mark) as hash_xor
        from (select ('0x' || substr(md5(concat(length(amplicon), ':', amplicon, length(marker), ':', marker,
                length(cast(reads as varchar)), ':', reads, length(sample_id), ':', sample_id)), 1, 15))::bigint as mark
              from cells)"""),
    "taxon_lookup": sql("wide", """
        , named as (select lower(concat('Root;Eukaryota;', p_type, ';', p_brand, ';', p_name)) as path, coalesce(total, 0) as total
            from part left join (select amplicon, sum(reads) as total from wide where marker = 'v4' group by 1) t
              on amplicon = md5(cast(p_partkey as varchar)))
        select taxon, mode, count(path) as variants, cast(coalesce(sum(total), 0) as bigint) as reads
        from (values ('Root', 'level'), ('PROMO BRUSHED TIN', 'level'), ('Brand#13', 'level'), ('nothing', 'level'), ('econ', 'contains'),
                ('brushed tin;brand#1', 'contains'), ('t;', 'contains'), ('xyzzy', 'contains')) q(taxon, mode)
          left join named on case when mode = 'level' then list_contains(string_split(path, ';'), lower(taxon))
            else contains(path, lower(taxon)) end
        group by 1, 2"""),
    "read_lineage": sql("wide", """
        select 'marker data' as read, artifact, row_count, 9 as column_count, 'ECONOMY' as taxonomy_contains
        from (select count(*) as row_count from wide join part on md5(cast(p_partkey as varchar)) = amplicon
              where marker = 'v4' and reads > 0 and contains(concat(p_type, ';', p_brand, ';', p_name), 'ECONOMY')),
          (values ('metadata'), ('abundance')) a(artifact)"""),
    "filter_region": sql("context", """select sample_id_pangaea, ocean_region from context
        where contains(lower(ocean_region), 'asia')"""),
    "filter_polar": sql("context", "select sample_id_pangaea, polar from context where polar = 'Non polar'"),
    "filter_depth": sql("context", "select sample_id_pangaea, depth from context where depth in ('SRF', 'DCM')"),
    "filter_size": sql("context", """select sample_id_pangaea, size_fraction from context
        where size_fraction in ('0.8-5', '5-20')"""),
    "filter_temperature": sql("context", """select sample_id_pangaea, temperature from context
        where temperature between 0 and 5000"""),
    "find_samples": sql("context", f"""select {SUMMARY} from context where {SEARCH} and temperature >= 0
        order by sample_id_pangaea limit 50"""),
    "find_samples_summary": sql("context", f"""select 'context_general,context_stat' as source_datasets,
        count(*) filter ({SEARCH} and temperature >= 0) as sample_count,
        count(*) - count(*) filter ({SEARCH} and temperature >= 0) as excluded_sample_count, 'SRF,DCM' as depths
        from context"""),
    "missing_filter_values": sql("context", f"""
        select * from (select 'missing_filter_values_excluded' as code, 'temperature' as field,
          count(*) filter (temperature is null) as sample_count, count(*) as candidate_sample_count
          from context where {SEARCH}) where sample_count > 0"""),
    "sample_info": sql("context", "select * from context where sample_id_pangaea = 'TARA_0000000042'"),
    "taxon_level_match": sql("metadata", f"select marker, amplicon, taxonomy from metadata where {LEVEL}"),
    "taxon_contains_match": sql("metadata", """select marker, amplicon, taxonomy from metadata
        where contains(lower(taxonomy), 'bolt')"""),
    "find_taxa_asvs": sql("metadata", f"""select amplicon, taxonomy, confidence, total, spread, sequence
        from metadata where marker = 'v4' and {LEVEL} order by total desc, amplicon limit 100"""),
    "find_taxa_samples": sql("metadata cells", """select sample_id, cast(sum(reads) as bigint) as read_count
        from cells join metadata using (marker, amplicon) where marker = 'v4' and contains(lower(taxonomy), 'bolt')
        group by 1 order by read_count desc, sample_id limit 100"""),
    "find_taxa_summary": sql("metadata cells marker_samples", f"""
        select '18s_v4' as source_datasets, 'v4' as marker,
          (select count(*) from metadata where marker = 'v4' and {LEVEL}) as asv_total, n as sample_count,
          (select count(*) from marker_samples where marker = 'v4') - n as excluded_sample_count, 'economy' as filters
        from (select count(distinct sample_id) as n from cells join metadata using (marker, amplicon)
              where marker = 'v4' and {LEVEL})"""),
    "resolve_samples": sql("context marker_samples", """select sample_id_pangaea as sample_id,
        sample_id_pangaea in (select sample_id from marker_samples where marker = 'v4') as available
        from context where polar = 'Polar'"""),
    "taxon_abundance": sql("abundance", f"select {ROUNDED} from abundance"),
    "taxon_abundance_nonzero": sql("abundance", f"select {ROUNDED} from abundance where taxon_read_count > 0"),
    "taxon_abundance_summary": sql("abundance", f"""
        select '18s_v4' as source_datasets, 'v4' as marker, count(*) filter (taxon_read_count > 0) as sample_count,
          count(*) filter (taxon_read_count = 0) as excluded_sample_count,
          (select count(*) from metadata where marker = 'v4' and {LEVEL}) as matching_asv_count, 'false' as filters
        from abundance"""),
    "abundance_warnings": sql("abundance", f"""
        select 'read_count_is_not_cell_abundance' as code, {WARNING} union all
        select 'taxon_not_found', null, null, null union all
        select 'zero_read_library', null, n, null from (select count(*) as n from abundance
          where sample_total_read_count = 0) where n > 0"""),
    "diversity": sql("observed", f"select {DIVERSE} from observed"),
    "diversity_taxon": sql("observed", f"select {DIVERSE} from observed", restriction=PROMO),
    "diversity_groups": sql("observed context", """
        select polar as "group", count(*) as sample_count, count(shannon_index) as shannon_sample_count,
          round(avg(observed_asv_richness), 9) as richness_mean,
          round(quantile_cont(observed_asv_richness, 0.5), 9) as richness_median,
          round(avg(shannon_index), 9) as shannon_mean, round(quantile_cont(shannon_index, 0.5), 9) as shannon_median
        from observed join context on sample_id = sample_id_pangaea group by 1"""),
    "diversity_summary": sql("marker_samples metadata", """
        select '18s_v9' as source_datasets, 'v9' as marker, count(*) as sample_count,
          cast(0 as bigint) as excluded_sample_count, (select count(*) from metadata where marker = 'v9'
            and list_contains(string_split(lower(taxonomy), ';'), 'promo')) as matching_asv_count, 'polar' as filters
        from marker_samples where marker = 'v9'"""),
    "diversity_warnings": sql("observed context", f"""
        select 'unrarefied_diversity' as code, {WARNING} union all
        select 'missing_group_values_excluded', 'size_fraction', count(*), null from observed
          join context on sample_id = sample_id_pangaea where size_fraction is null having count(*) > 0 union all
        select 'zero_reads_in_analysis_set', null, count(*), null from observed
          where analysis_read_count = 0 having count(*) > 0"""),
    "association_points": sql("points", """select sample_id, environment_value,
        round(relative_abundance, 9) as relative_abundance from points"""),
    "association_rho": sql("ranked points", """select count(*) as sample_count,
        count(distinct rx) > 1 as varied_x, count(distinct ry) > 1 as varied_y, round(corr(rx, ry), 9) as rho from ranked"""),
    "association_pvalue": sql("tested", """select sample_count, round(rho, 9) as rho,
        round(p_value, 9) as p_value from tested"""),
    "environment_association": sql("tested abundance metadata", f"""
        select '18s_v4,context_general,context_stat' as source_datasets, 'v4' as marker,
          'temperature' as environment_variable, sample_count,
          (select count(*) from abundance) - sample_count as excluded_sample_count,
          (select count(*) from metadata where marker = 'v4' and {LEVEL}) as matching_asv_count,
          round(rho, 9) as rho, round(p_value, 9) as p_value from tested"""),
    "page_totals": sql("metadata cells marker_samples abundance tested", f"""
        select 0 as call, 'asvs' as list, cast(3 as bigint) as offset, cast(5 as bigint) as limit,
          (select count(*) from metadata where marker = 'v4' and {LEVEL}) as total
        union all select 0, 'samples', 0, 7, (select count(distinct sample_id) from cells join metadata using (marker, amplicon)
          where marker = 'v4' and {LEVEL})
        union all select 1, 'observations', 2, 4, (select count(*) from abundance where taxon_read_count > 0)
        union all select 2, 'observations', 1, 2, (select count(*) from marker_samples where marker = 'v9')
        union all select 3, 'points', 0, 9, (select sample_count from tested)""").replace("as offset", 'as "offset"').replace("as limit", 'as "limit"'),
    "association_warnings": sql("abundance context", f"""
        select 'read_count_is_not_cell_abundance' as code, {WARNING} union all
        select 'taxon_not_found', null, null, null union all select 'constant_input', null, null, null union all
        select 'zero_read_library', null, count(*), null from abundance where sample_total_read_count = 0
          having count(*) > 0 union all
        select 'missing_environment_values_excluded', 'temperature', count(*), null from abundance
          join context on sample_id = sample_id_pangaea where temperature is null having count(*) > 0"""),
    "chart_sample_map": sql("context", f"""select event_longitude as x, event_latitude as y, sample_id_pangaea as label
        from context where {SEARCH} and temperature >= 0 order by sample_id_pangaea limit 50"""),
    "chart_occurrence_top20": sql("metadata cells", f"""select sample_id as x, cast(sum(reads) as double) as y
        from cells join metadata using (marker, amplicon) where marker = 'v4' and {LEVEL}
        group by 1 order by y desc, x limit 20"""),
    "chart_abundance_top20": sql("abundance", """select sample_id as x, round(relative_abundance, 9) as y
        from (select * from (select * from abundance order by sample_id limit 500)
              order by coalesce(relative_abundance, 0) desc, sample_id limit 20)
        where relative_abundance is not null"""),
    "chart_diversity_first20": sql("observed", """select sample_id as x, round(shannon_index, 9) as y
        from (select * from observed order by sample_id limit 500) where shannon_index is not null
        order by sample_id limit 20"""),
    "chart_association": sql("points", """select environment_value as x, round(relative_abundance, 9) as y,
        sample_id as label from points order by sample_id limit 200"""),
    "session_list": sql("sessions", """select * from sessions where user_id = 0
        order by pinned_at desc nulls last, updated_at desc, session_id desc limit 30"""),
    "session_list_summary": sql("sessions", """select 0 as "offset", 30 as "limit", count(*) as total
        from sessions where user_id = 0"""),
    "session_titles": r"""select conv_id, turn, case when length(line) <= 80 then line
        else concat(substr(line, 1, 79), '…') end as title
        from (select conv_id, turn, regexp_replace(trim(text, e' \t\n\r'), '\s+', ' ', 'g') as line from conversations)""",
    "message_sequence": sql("messages", """
        select m.session_id, m.turn, m.role, m.sequence_no, p.sequence_no as parent_sequence_no
        from messages m left join messages p on m.role = 'assistant' and p.role = 'user'
          and p.session_id = m.session_id and p.sequence_no = m.sequence_no - 1"""),
    "append_runs": sql("messages traces sessions", """
        , placed as (select t.session_id, trace_id, question, coalesce(last, -1) + 1
              + 2 * (row_number() over (partition by t.session_id order by started_at, trace_id) - 1) as first
            from traces t join sessions s using (session_id)
              left join (select session_id, max(sequence_no) as last from messages group by 1) m using (session_id))
        select session_id, trace_id, first as sequence_no, 'user' as role, question as content,
          cast(null as bigint) as parent_sequence_no from placed
        union all select session_id, trace_id, first + 1, 'assistant', '', first from placed"""),
    "session_messages": sql("messages traces spans", """
        select session_id, sequence_no, role, content, trace_id, response, coalesce(result, tool_output) as result
        from messages left join (
          select traces.trace_id as tid, tool_output, case when span_count % 2 = 0 then
              concat('{"metadata":{"provenance":{"sample_count":', span_count, '}}}') end as result,
            concat('{"answer":"', span_count, ' steps"', case when span_count % 2 = 0 then
              concat(',"result":{"metadata":{"provenance":{"sample_count":', span_count, '}}}') else '' end, '}') as response
          from traces left join (select trace_id, min_by(output_data, sequence_no) as tool_output from spans
            where span_kind = 'tool' group by 1) t on t.trace_id = traces.trace_id
          where status = 'completed') on tid = trace_id and role = 'assistant'"""),
    "trace_list": sql("traces sessions", """
        select trace_id, session_id, t.status, started_at, ended_at, question
        from traces t join sessions s using (session_id) where user_id = 0
        order by started_at desc, trace_id desc limit 30"""),
    "trace_list_summary": sql("traces sessions", """select 30 as "offset", 30 as "limit", count(*) as total
        from traces join sessions using (session_id) where user_id = 0"""),
    "trace_detail": sql("traces sessions spans", """
        select trace_id, t.status as trace_status, question, span_id, parent_span_id, sequence_no, name, span_kind,
          p.status, p.started_at, p.ended_at, duration_ms
        from spans p join (select trace_id, traces.status, question from traces join sessions using (session_id)
                           where user_id = 0) t using (trace_id)"""),
    "trace_tree": sql("spans", """
        , tree as (select trace_id, span_id, parent_span_id, sequence_no, span_id as root_span_id,
              cast(0 as bigint) as depth, [sequence_no] as path from spans where parent_span_id is null
            union all select c.trace_id, c.span_id, c.parent_span_id, c.sequence_no, p.root_span_id, p.depth + 1,
              list_append(p.path, c.sequence_no)
            from spans c join tree p on c.trace_id = p.trace_id and c.parent_span_id = p.span_id),
          placed as (select *, row_number() over (partition by trace_id order by path) - 1 as position from tree)
        select a.trace_id, a.span_id, any_value(a.parent_span_id) as parent_span_id, any_value(a.sequence_no) as sequence_no,
          any_value(a.root_span_id) as root_span_id, any_value(a.depth) as depth, any_value(a.position) as position, max(d.position) as last
        from placed a join placed d on a.trace_id = d.trace_id and list_slice(d.path, 1, len(a.path)) = a.path
        group by 1, 2""").replace("with ", "with recursive ", 1),
    "running_span": sql("spans", """select trace_id, max_by(span_id, sequence_no) as span_id,
        max(sequence_no) as sequence_no from spans where status = 'running' group by 1"""),
    "trace_overview": sql("spans traces", """
        , tools as (select * from spans where span_kind = 'tool')
        select distinct trace_id, 'source' as entry, cast(null as varchar) as span_id, cast(null as varchar) as key,
          concat('source_', (event_id + i) % 4, '.tsv') as value
        from tools, range(0, 3) r(i) where i <= event_id % 3
        union all select trace_id, 'filter', span_id, 'event_type', event_type from tools
        union all select trace_id, 'filter', span_id, 'k', k from tools
        union all select distinct trace_id, 'method', null, null, tool_name from tools
        union all select trace_id, 'conclusion', null, null, concat(span_count, ' steps') from traces
          where status = 'completed'"""),
    "answer_assembly": f"""
        select cast(conv_id as varchar) as trace_id,
          {TRIMMED.format("coalesce(string_agg(concat(' ', text), '' order by turn) filter (role = 'user'), '')")} as reasoning,
          {TRIMMED.format("coalesce(string_agg(concat(' ', text), '' order by turn) filter (role = 'assistant'), '')")} as answer,
          max_by(concat(' ', text), turn) filter (role = 'system') as usage
        from conversations group by conv_id""",
    "span_violations": sql("spans", """
        , flawed as (select trace_id, span_id, case when event_id % 47 = 0 then 'nowhere'
              when event_id % 59 <> 0 then parent_span_id end as parent_span_id,
            case when event_id % 61 = 0 then sequence_no - 1 else sequence_no end as sequence_no,
            case when event_id % 43 = 0 then '  ' when event_id % 67 = 0 then repeat(name, 30) else name end as name,
            case when event_id % 41 = 0 then 'unknown' else span_kind end as span_kind,
            case when event_id % 53 = 0 then -1 else duration_ms end as duration_ms from spans)
        select trace_id, span_id, 'unknown_kind' as violation from flawed where span_kind = 'unknown'
        union all select trace_id, span_id, 'blank_name' from flawed where trim(name) = ''
        union all select trace_id, span_id, 'long_name' from flawed where length(trim(name)) > 200
        union all select trace_id, span_id, 'negative_sequence' from flawed where sequence_no < 0
        union all select trace_id, span_id, 'negative_duration' from flawed where duration_ms < 0
        union all select trace_id, span_id, 'unknown_parent' from flawed where parent_span_id = 'nowhere'
        union all select trace_id, null, 'several_roots' from flawed where parent_span_id is null
          group by 1 having count(*) > 1
        union all select trace_id, null, 'duplicate_sequence' from flawed group by trace_id, sequence_no
          having count(*) > 1"""),
    "span_merge": sql("spans", """
        , entries as (select trace_id, sequence_no, concat('a', event_id % 3) as k, span_id as v from spans
            where event_id % 2 = 0 union all select trace_id, sequence_no, 'b', span_kind from spans
            where event_id % 2 = 0 union all select trace_id, sequence_no, 'b', name from spans where event_id % 2 = 1)
        select trace_id, tool_name, error_code, attributes
        from (select trace_id, max_by(tool_name, sequence_no) filter (tool_name is not null) as tool_name,
                max_by(error_code, sequence_no) filter (error_code is not null) as error_code from spans group by 1)
          join (select trace_id, string_agg(concat(k, '=', v), ',' order by k) as attributes
                from (select trace_id, k, max_by(v, sequence_no) as v from entries group by 1, 2) group by 1)
            using (trace_id)"""),
    "close_open_spans": sql("spans traces", """
        select span_id, case when hit then 'failed' else p.status end as status,
          case when hit then t.started_at + interval 1 day else p.ended_at end as ended_at,
          case when hit then cast(round_even((epoch_us(t.started_at + interval 1 day) - epoch_us(p.started_at)) / 1000.0, 0)
            as bigint) else duration_ms end as duration_ms,
          case when hit then 'AgentError' else error_code end as error_code,
          case when hit then 'token lost, secret: [REDACTED]' else error_message end as error_message
        from (select s.*, s.status = 'running' and t.status = 'failed' as hit, t.started_at as begun
              from spans s join traces t using (trace_id)) p join traces t using (trace_id)"""),
    "cascade_delete": DELETED,
    "erase_sessions": DELETED,
    "redact_text": f"select conv_id, turn, {REDACTED} as safe from conversations",
    "truncate_text": r"""select doc_id, case when length(text) > 4000 then concat(substr(text, 1, 4000),
        e'\n[TRUNCATED ', length(text) - 4000, ' CHARACTERS]') else text end as bounded from documents""",
    "sanitize_payload": f"""select conv_id, turn, '[REDACTED]' as authorization, '[REDACTED]' as api_key,
        {REDACTED} as message, turn as max_tokens, '[REDACTED]' as session_token,
        case when conv_id % 1000 > 10 then conv_id % 1000 - 10 end as omitted from conversations""",
    "sanitize_stream": f"""select conv_id, turn, '[REDACTED]' as authorization, '[REDACTED]' as api_key,
        {REDACTED} as message, turn as max_tokens, '[REDACTED]' as session_token,
        case when conv_id % 1000 > 10 then conv_id % 1000 - 10 end as omitted from conversations""",
    "sanitize_update": SAFE_UPDATES,
    "sanitize_update_stream": SAFE_UPDATES,
    "cap_sample_ids": """select event_id, (select string_agg(concat('S', event_id + i), ',' order by i)
          from range(1, 101) r(i) where i <= 90 + event_id % 30) as kept_ids,
        case when event_id % 30 > 10 then event_id % 30 - 10 end as omitted from events""",
    "compact_result": """select doc_id, n_chars as total,
        case when length(text) > 300 then concat(substr(text, 1, 300), '...') else text end as summary,
        array_to_string(list_transform(list_slice(string_split(text, ' '), 1, 20),
          lambda w: case when length(w) > 300 then concat(substr(w, 1, 300), '...') else w end), ' ') as words
        from documents""",
    "provenance_extract": sql("traces", """select trace_id,
        case when status <> 'failed' then case when span_count % 2 = 0 then 'v4' else '' end end as marker,
        case when status <> 'failed' and span_count % 5 = 4 then span_count end as sample_count from traces"""),
    "trace_finalise": sql("traces", """
        select trace_id, case when status = 'failed' then 'failed' else 'completed' end as status,
          coalesce(ended_at, started_at) as ended_at,
          cast(round_even((epoch_us(coalesce(ended_at, started_at)) - epoch_us(started_at)) / 1000.0, 0) as bigint) as duration_ms,
          case when status = 'failed' then null when span_count % 2 = 0 then 'v4' when span_count % 3 = 0 then 'v9'
            when span_count % 3 = 1 then 'v4' end as marker,
          case when status <> 'failed' and span_count % 5 = 4 then span_count end as sample_count,
          case when status <> 'failed' then concat('a.tsv,b', span_count, '.tsv') end as source_files,
          case when status = 'failed' then 'AgentModelError' end as error_code,
          case when status = 'failed' then 'api_key=[REDACTED]' end as error_message,
          case when status = 'failed' then 'failed' else 'completed' end as message_status,
          case when status <> 'failed' then concat('done ', trace_id) end as message_content
        from traces"""),
    "span_fold": sql("life", """select trace_id, span_id, parent_span_id, name, span_kind,
        case when done is null then 'running' else final end as status, began as started_at, done as ended_at,
        life_ms as duration_ms, case when done is not null then code end as error_code,
        cast(null as varchar) as error_message from life"""),
    "span_details": SPAN_DETAILS,
    "fold_violations": sql("life", """
        select trace_id, span_id, 'missing_start' as violation from life where event_id % 37 = 0 and done is not null
        union all select trace_id, span_id, 'duplicate_start' from life where event_id % 31 = 0 and event_id % 37 <> 0
        union all select trace_id, span_id, 'repeated_finish' from life
          where event_id % 31 = 0 and event_id % 37 <> 0 and done is not null
        union all select c.trace_id, c.span_id, 'parent_not_open' from life c left join life p
          on p.trace_id = c.trace_id and p.span_id = c.parent_span_id and p.event_id % 37 <> 0
            and p.began <= c.began and (p.done is null or p.done >= c.began)
        where c.event_id % 37 <> 0 and c.parent_span_id is not null and p.span_id is null"""),
    "span_stream": sql("life", """select trace_id, span_id, parent_span_id, name, span_kind,
        case when done is null then 'running' else final end as status, began as started_at, done as ended_at,
        life_ms as duration_ms, case when done is not null then code end as error_code,
        cast(null as varchar) as error_message from life"""),
    "span_detail_stream": SPAN_DETAILS,
    "span_sequence": sql("life", """select trace_id, span_id,
        row_number() over (partition by trace_id order by began, span_id) - 1 as sequence_no from life"""),
    "answer_stream": f"""
        select cast(conv_id as varchar) as trace_id,
          {TRIMMED.format("coalesce(string_agg(concat(' ', text), '' order by turn) filter (role = 'user'), '')")} as reasoning,
          {TRIMMED.format("coalesce(string_agg(concat(' ', text), '' order by turn) filter (role = 'assistant'), '')")} as answer,
          max_by(concat(' ', text), turn) filter (role = 'system') as usage
        from conversations group by conv_id""",
}
