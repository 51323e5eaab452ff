"""The same queries as SQL for an independent engine, written from FIXTURES.md."""

from __future__ import annotations

import re

VIEWS = {
    "inv": """
select collection, shard, collection||'_'||shard||'_replica'||cast(rn as varchar) as core,
  cast(rn as int) as rn,
  'host'||cast(l_suppkey as varchar)||':8983_solr' as node_name,
  'host'||cast(l_suppkey as varchar) as node,
  case when l_linestatus='O' then 'active' else 'down' end as state,
  case when l_returnflag='R' then 'true' when l_returnflag='A' then 'false' end as leader,
  l_linestatus='O' as available, cast(l_quantity as int) as num_docs,
  cast(round(l_extendedprice*100) as bigint) as version, l_shipdate as last_modified,
  l_returnflag, l_partkey, l_suppkey
from (select case when l_orderkey%3<>0 then 'c'||cast(l_orderkey as varchar)||'_collection'
                  else 'c'||cast(l_orderkey as varchar)||'_idx' end as collection,
             'shard'||cast(l_linenumber as varchar) as shard,
             row_number() over (partition by l_orderkey, l_linenumber
               order by l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
                        l_discount, l_tax) as rn,
             l_suppkey, l_linestatus, l_returnflag, l_quantity, l_extendedprice, l_shipdate,
             l_partkey
      from lineitem) t""",
    "src_inv": "select * from inv where l_returnflag<>'N'",
    "dst_inv": """
select case when collection like '%collection' then replace(collection,'_collection','_twin')
            else collection||'_copy' end as collection,
  shard,
  case when collection like '%collection' then replace(core,'_collection','_twin')
       else replace(core,collection,collection||'_copy') end as core,
  rn, node, available, num_docs, version+(l_suppkey%3)-1 as version,
  last_modified + interval '1' minute * (l_partkey%90) as last_modified
from inv""",
    "src_alias": "select c_name as alias, 'seg_'||c_mktsegment as target from customer",
    "dst_alias": """
select c_name as alias, case when c_custkey%7=0 then 'seg_OLD' else 'seg_'||c_mktsegment end as target
from customer where c_custkey%5<>0
union all select 'only_dst' as alias, 'seg_X' as target""",
    "src_tree": """
select '/configs/'||split_part(url,'/',3)||'/'||split_part(url,'/',4)||'/'||cast(page_id as varchar) as path,
  page_id, html as data from pages""",
    "dst_tree": """
select path, case when page_id%3=0 then 'stale' else data end as data from src_tree where page_id%4<>0""",
    "contents": """
select source||'_collection' as collection, 'shard'||cast(doc_id%4+1 as varchar) as shard, doc_id,
  text, n_chars from documents""",
    "progress": """
select 'core'||cast(user_id as varchar) as core,
  'core'||cast(user_id as varchar)||'/'||cast(cast(ts as date) as varchar) as req,
  event_id, ts,
  case when event_type='purchase' then 'done' when event_type='error' then 'failed'
       else 'replicating' end as status
from events""",
    "host_map": """
select 'host'||cast(s_suppkey as varchar) as private, 'pub-'||s_name as public
from supplier where s_suppkey%4<>0""",
    "state_doc": """
select *, '{"'||collection||'":{"shards":{"'||shard||'":{"range":"'||shard||'/'||cast(rn as varchar)||'","state":"active","replicas":{"core_node'
  ||cast(rn as varchar)||'":{"state":"'||state||'","core":"'||core||'","node_name":"'||node_name
  ||'","base_url":"http://'||node||':8983"'
  ||case when leader is null then '' else ',"leader":"'||leader||'"' end
  ||'}}}},"maxShardsPerNode":"'||cast(num_docs as varchar)||'","replicationFactor":"'||cast(rn as varchar)||'"}}' as doc
from inv""",
    "metadata": """
select case when o_orderkey%3<>0 then 'c'||cast(o_orderkey as varchar)||'_collection'
            else 'c'||cast(o_orderkey as varchar)||'_idx' end as collection,
  case when o_orderstatus<>'P' then 'cfg_'||lower(split_part(o_orderpriority,'-',2)) end as config
from orders""",
    # Source names and the core each destination replica wants, for known collections only.
    "wanted": """
select d.collection as dest_collection, d.shard, d.core as dest_core, d.node as dest_node,
  case when d.collection like '%twin' then replace(d.collection,'_twin','_collection')
       else replace(d.collection,'_copy','') end as collection,
  case when d.collection like '%twin' then replace(d.core,'_twin','_collection')
       else replace(d.core,'_copy','') end as core
from dst_inv d
where (case when d.collection like '%twin' then replace(d.collection,'_twin','_collection')
            else replace(d.collection,'_copy','') end) in (select collection from src_inv)""",
    "peers": """
select w.dest_collection, w.shard, w.dest_core, w.dest_node, w.collection,
  coalesce(e.core, r1.core, r2.core, w.core) as source_core,
  coalesce(e.node, r1.node, r2.node) as source_node,
  case when e.core is not null then 'exact' when r1.core is not null then 'replica1'
       when r2.core is not null then 'replica2' else 'unmatched' end as how
from wanted w
left join src_inv e on e.collection=w.collection and e.core=w.core
left join src_inv r1 on r1.collection=w.collection and r1.core=split_part(w.core,'_replica',1)||'_replica1'
left join src_inv r2 on r2.collection=w.collection and r2.core=split_part(w.core,'_replica',1)||'_replica2'""",
    "best": """
select collection, shard, core as best_core, node as best_node
from (select *, row_number() over (partition by collection, shard order by rn, core) as place
      from src_inv where available) t
where place=1""",
    "best_of_all": """
select collection, shard, core as best_core, node as best_node
from (select *, row_number() over (partition by collection, shard order by rn, core) as place
      from inv where available) t
where place=1""",
    "plan": """
select p.dest_collection, p.shard, p.dest_node, p.dest_core, p.collection,
  b.best_node as source_node, b.best_core as source_core,
  b.best_core is not null as ok,
  case when b.best_core is null then 'NULL' else b.best_core end as entity,
  case when b.best_core is null then 'Replication Failed since source Core is NULL..' else '' end as reason
from peers p
left join src_inv c on c.collection=p.collection and c.core=p.source_core
left join best b on b.collection=c.collection and b.shard=c.shard""",
    "pairs": """
select s.core as src_core, d.core as dst_core,
  s.node||'/'||s.core||case when s.available then ' [numDocs='||cast(s.num_docs as varchar)||' version='||cast(s.version as varchar)||']' else ' [Unavailable]' end as src_label,
  d.node||'/'||d.core||case when d.available then ' [numDocs='||cast(d.num_docs as varchar)||' version='||cast(d.version as varchar)||']' else ' [Unavailable]' end as dst_label,
  s.available as src_up, d.available as dst_up, s.version as src_version, d.version as dst_version,
  strftime(s.last_modified,'%Y-%m-%dT%H:%M:%S.%gZ') as src_time,
  strftime(d.last_modified,'%Y-%m-%dT%H:%M:%S.%gZ') as dst_time,
  abs(date_diff('millisecond', s.last_modified, d.last_modified)) > 3600000 as drift
from src_inv s join dst_inv d
  on s.core = case when d.collection like '%twin' then replace(d.core,'_twin','_collection')
                   else replace(d.core,'_copy','') end""",
    "content_inv": """
select collection, shard, collection||'_'||shard||'_replica'||cast(rn as varchar) as core,
  rn, 'host'||cast(rn as varchar) as node, available
from (select source||'_collection' as collection, 'shard'||cast(d.doc_id%4+1 as varchar) as shard,
        case lang when 'de' then 1 when 'en' then 2 when 'es' then 3 else 4 end as rn,
        coalesce(max(l.quality)=1, false) as available
      from documents d left join labels l on l.doc_id=d.doc_id group by 1, 2, 3) t""",
    "content_sizes": """
select collection, shard, count(*) as docs,
  cast(sum(cast('0x'||substr(md5(cast(doc_id as varchar)||chr(31)||cast(n_chars as varchar)||chr(31)||text),1,15) as bigint)) as varchar) as digest
from contents group by 1, 2""",
    "content_best": """
select collection, shard, min_by(core, rn) as best_core from content_inv where available group by 1, 2""",
    "segment_docs": """
select 'seg_'||c_mktsegment as collection, o_orderkey, o_orderstatus
from orders join customer on c_custkey=o_custkey""",
    "alias_sizes": """
select coalesce(d.alias, s.alias) as alias,
  coalesce((select count(*) from segment_docs x where x.collection=s.target),0) as source_docs,
  coalesce((select count(*) from segment_docs x where x.collection=d.target and o_orderstatus<>'P'),0) as dest_docs,
  s.alias is not null as source_exists, d.alias is not null as at_dest
from dst_alias d full join src_alias s on s.alias=d.alias""",
    "first_done": """
select req, min(ts) as started, min(ts) filter (where status='done') as finished
from progress group by req""",
    "failed_runs": """
select core, min(ts) as started, max(ts) as ended, count(*) as failures
from (select *, row_number() over (partition by core order by ts, event_id)
             - row_number() over (partition by core, status='failed' order by ts, event_id) as island
      from progress) t
where status='failed' group by core, island having count(*) >= 3""",
}


def _clone(forward: str, created: int, where: str = "true") -> str:
    """Diagnostics of a content clone; destination collections below src15 exist already."""
    return f"""
with cells as (select distinct collection, shard from content_inv),
copies as (
  select collection, shard, rn from content_inv where collection < 'src15' and rn <= 2
  union all
  select collection, shard, k.rn from cells, (select unnest(range(1, {created} + 1)) as rn) k
  where collection not in (select collection from content_inv where collection < 'src15' and rn <= 2)),
uneven as (
  select collection from content_inv group by collection
  having count(distinct shard) <> (select count(distinct x.shard) from copies x where x.collection=content_inv.collection)),
targets as (
  select collection, shard, rn, {forward} as dest_collection from copies
  where collection not in (select collection from uneven))
select t.dest_collection, t.shard, t.dest_collection||'_'||t.shard||'_replica'||cast(t.rn as varchar) as dest_core,
  b.best_core as source_core,
  case when b.best_core is not null then 'ok' else 'failed' end as status,
  case when b.best_core is not null then '' else 'Replication Failed since source Core is NULL..' end as reason,
  case when b.best_core is not null then s.docs else 0 end as docs,
  case when b.best_core is not null then s.digest end as digest
from targets t
left join content_inv e on e.collection=t.collection and e.shard=t.shard and e.rn=t.rn
left join content_inv r1 on r1.collection=t.collection and r1.shard=t.shard and r1.rn=1
left join content_inv r2 on r2.collection=t.collection and r2.shard=t.shard and r2.rn=2
left join content_best b on b.collection=t.collection and b.shard=t.shard
  and coalesce(e.core, r1.core, r2.core) is not null
left join content_sizes s on s.collection=t.collection and s.shard=t.shard
where {where}"""


def _outcomes(forward: str, back: str, rename: str) -> str:
    """Violations of a clone to an empty destination, and what became of every other shard; reasons as the job words them."""
    return f"""
with cells as (
  select {rename} as collection, shard, bool_or(available) as up from content_inv group by 1, 2),
mapped as (select *, {forward} as dest from cells),
led as (select *, {back} as back, (select count(distinct m.collection) from mapped m where m.dest=mapped.dest) as sources from mapped),
counted as (select {rename} as collection, shard, count(*) as docs from contents group by 1, 2)
select distinct collection, null::varchar as shard, 'violation' as status,
  case when sources>1 then 'shares its destination '||dest else 'destination '||dest||' leads back to '||back end as reason, 0::bigint as docs
from led where sources>1 or back<>collection
union all
select dest, led.shard, case when up then 'ok' else 'failed' end,
  case when up then '' else 'Replication Failed since source Core is NULL..' end,
  case when up then coalesce(docs, 0) else 0 end
from led left join counted c on c.collection=led.collection and c.shard=led.shard
where sources=1 and back=led.collection"""


_REASON = """
  case when src_version > dst_version
         then 'DataMatch-Failed: Version mismatch: this:'||cast(src_version as varchar)||' replica:'||cast(dst_version as varchar)
       when not dst_up then 'DataMatch-Failed: replica core not available: '||dst_label
       when not src_up then 'DataMatch-Failed: this core not available: '||src_label
       else '' end
  ||case when drift then '  last index update time between source and replica are different more than 60 minutes: source: '
                         ||src_time||' replica: '||dst_time else '' end"""

# One pass over the plan: each destination core has one status, and so has each source core.
_POST_COPY = f"""
select dest_collection, entity, source_core,
  case when not ok or not dst_up or not src_up or src_version > dst_version or drift then 'failed' else 'ok' end as status,
  case when not ok then said when not dst_up then 'Replication Failed since source Core is not available..' else {_REASON} end as reason
from (
  select p.dest_collection, p.dest_core as entity, p.source_core, p.ok, p.reason as said, d.available as dst_up, s.available as src_up,
    s.version as src_version, d.version as dst_version,
    strftime(s.last_modified,'%Y-%m-%dT%H:%M:%S.%gZ') as src_time, strftime(d.last_modified,'%Y-%m-%dT%H:%M:%S.%gZ') as dst_time,
    s.node||'/'||s.core||case when s.available then '' else ' [Unavailable]' end as src_label,
    d.node||'/'||d.core||case when d.available then '' else ' [Unavailable]' end as dst_label,
    abs(date_diff('millisecond', s.last_modified, d.last_modified)) > 3600000 as drift
  from plan p left join dst_inv d on d.core=p.dest_core left join src_inv s on s.core=p.source_core) m"""

_COMPLETION = """
select req, started, finished,
  case when finished is null then 'never' when finished > started + interval 6 hour then 'timed out'
       else 'done' end as outcome
from first_done"""

_LATEST = """
select core, ts, event_id, status
from (select *, row_number() over (partition by core order by ts desc, event_id desc) as place
      from progress) t
where place=1"""

_ALARMS = """
select req, started from first_done
where (finished is null or finished > started + interval 6 hour)
  and started + interval 6 hour <= (select max(ts) from events) - interval 20 minute"""

_PLAIN_FORWARD = "collection"
_NEW_FORWARD = "replace(collection,'_collection','_twin')"

SQL = {
    "scan_cluster_state": """
select collection, num_docs as max_shards_per_node, rn as replication_factor, shard,
  shard||'/'||cast(rn as varchar) as range, 'active' as shard_state, 'core_node'||cast(rn as varchar) as replica,
  core, node_name, 'http://'||node||':8983' as base_url, state, leader from inv""",
    "flatten_state": "select collection, shard, core, rn, node_name, node, state, leader from inv",
    "state_size": """
select collection, cast(sum(octet_length(encode(doc))) as bigint) as bytes from state_doc group by 1""",
    "scan_aliases": "select alias, target from src_alias",
    "live_nodes": "select distinct node from inv where state='active'",
    "config_names": "select distinct split_part(path,'/',3) as config from src_tree",
    "collection_config": """
select c.collection, m.config, case when m.config is null then 'no metadata' end as problem
from (select distinct collection from inv) c join metadata m on m.collection=c.collection""",
    "parse_core_status": """
select core, available, case when available then num_docs else 0 end as num_docs,
  0 as deleted_docs, 0 as max_docs,
  case when available then version else 0 end as version,
  case when available then last_modified end as last_modified, available as current
from inv""",
    "parse_replication_status": """
select event_id, event_type not in ('purchase','view') as replicating,
  cast(cast(floor(value) as bigint) as varchar) as percent_complete,
  cast(user_id as varchar)||'s' as time_elapsed,
  case when event_type='view' then cast(user_id as varchar)||' KB' end as download_speed,
  case when event_type<>'view' then cast(user_id as varchar)||'s' end as time_remaining,
  case when event_type<>'error' then cast(event_id as varchar) end as bytes_downloaded,
  cast(event_id*2 as varchar) as bytes_to_download
from events""",
    "collection_size": "select collection, count(*) as docs from contents group by 1",
    "tree_paths": """
with parts as (
  select path, octet_length(encode(data)) as size, string_split(path,'/') as p from src_tree),
nodes as (
  select array_to_string(p[1:k+1],'/') as node, k, case when k = len(p)-1 then size end as size, p[k+1] as label,
    case when k=1 then '/' else array_to_string(p[1:k],'/') end as parent
  from (select *, unnest(range(1, len(p))) as k from parts) t)
select node as path, parent, label, cast(k as int) as depth, cast(max(size) as bigint) as bytes
from nodes group by all""",
    "tree_paths_from_edges": """
select distinct id, id as path from (
  select array_to_string(p[1:k+1],'/') as id
  from (select p, unnest(range(1, len(p))) as k from (select string_split(path,'/') as p from src_tree) a) b) t""",
    "node_name": """
select core, node_name, split_part(split_part(node_name,'_solr',1),':',1) as node from inv""",
    "translate_host": """
select i.node, i.core, h.public from inv i left join host_map h on h.private=i.node""",
    "select_collections": """
select distinct collection from inv
where collection like '%\\_collection%' escape '\\' and collection not like '%7%'""",
    "exclude_default": """
select 'collection'||substr(shard,6) as collection, count(*) as replicas from inv
where shard<>'shard1' group by 1""",
    "missing_in_source": """
select distinct collection from inv except select collection from src_inv""",
    "shard_key": "select core, split_part(core,'_replica',1) as shard_key from inv",
    "map_forward": """
select distinct collection,
  case when contains(collection,'_collection') then replace(collection,'_collection','_twin')
       else collection||'_copy' end as dest_collection
from inv""",
    "map_reverse": """
select collection, core,
  case when contains(collection,'_twin') then replace(collection,'_twin','_collection')
       else replace(collection,'_copy','') end as source_collection,
  case when contains(core,'_twin') then replace(core,'_twin','_collection')
       else replace(core,'_copy','') end as source_core
from dst_inv""",
    "map_config": """
select c.collection, m.config as own_config,
  case when contains(c.collection,'_collection') then 'big_config' else 'std_config' end as rule_config
from (select distinct collection from inv) c left join metadata m on m.collection=c.collection""",
    "mapping_roundtrip": """
with names as (select collection from inv union select collection from dst_inv),
there as (
  select collection,
    case when contains(collection,'_collection') then replace(collection,'_collection','_twin')
         else collection||'_copy' end as dest_collection from names),
back as (
  select *,
    case when contains(dest_collection,'_twin') then replace(dest_collection,'_twin','_collection')
         else replace(dest_collection,'_copy','') end as back,
    count(*) over (partition by dest_collection) as sources
  from there)
select collection, dest_collection, back, sources from back where back<>collection or sources>1""",
    "peer_match": "select * from peers",
    "symmetry_fallback": """
select k.collection, k.shard_key, coalesce(a.core, b.core) as core,
  case when a.core is not null then a.node else b.node end as node,
  case when a.core is not null then 'replica1' when b.core is not null then 'replica2' end as how
from (select distinct collection, split_part(core,'_replica',1) as shard_key from inv) k
left join inv a on a.collection=k.collection and a.core=k.shard_key||'_replica1'
left join inv b on b.collection=k.collection and b.core=k.shard_key||'_replica2'""",
    "replication_plan": "select * from plan",
    "alias_diff": """
select s.alias, s.target as new_target, d.target as dest_target,
  case when d.alias is null then 'create' when d.target=s.target then 'skip' else 'repoint' end as op
from src_alias s left join dst_alias d on d.alias=s.alias""",
    "alias_verify": """
select s.alias,
  case when d.alias is null then 'missing' when d.target=s.target then 'ok' else 'wrong target' end as verdict
from src_alias s left join dst_alias d on d.alias=s.alias""",
    "missing_in_dest": """
select i.collection, i.collection as dest_collection, m.config, i.shards, 4 as replication_factor,
  500 as max_shards_per_node
from (select collection, count(distinct shard) as shards from inv group by 1) i
left join metadata m on m.collection=i.collection
where i.collection not in (select collection from src_inv)""",
    "place_replicas": """
select r.collection, r.shard, r.core, r.rn, n.node
from (select collection, shard, collection||'_'||shard||'_replica'||cast(rn as varchar) as core, rn,
        row_number() over (order by collection, shard, rn) as number,
        count(*) over (partition by collection) as replicas
      from (select distinct collection, shard from inv
            where collection not in (select collection from src_inv)) m
      cross join (select cast(unnest(range(1, 5)) as int) as rn) k) r
left join (select node, row_number() over (order by node) as slot, count(*) over () as nodes
           from (select distinct node from inv where state='active' and node is not null) a) n
  on (r.number-1)%n.nodes+1 = n.slot and n.nodes >= 4 and r.replicas <= 500*n.nodes""",
    "shard_parity": """
select a.collection, a.n as source_shards, coalesce(b.n,0) as dest_shards
from (select collection, count(distinct shard) as n from inv group by 1) a
left join (select collection, count(distinct shard) as n from src_inv group by 1) b
  on b.collection=a.collection
where a.n <> coalesce(b.n,0)""",
    "size_parity": """
select alias, source_docs, dest_docs, source_exists, source_docs=dest_docs as match
from alias_sizes where at_dest""",
    "size_parity_both_sides": """
select alias, source_docs, dest_docs, source_exists, source_docs=dest_docs as match from alias_sizes""",
    "tree_diff": """
select s.path, case when d.path is null then 'create' when d.data=s.data then 'same' else 'set' end as op
from src_tree s left join dst_tree d on d.path=s.path""",
    "inventory_drift": """
select coalesce(d.collection, s.collection) as dest_collection, coalesce(d.core, s.core) as dest_core,
  case when d.core is null then 'source only' when s.core is null then 'destination only' else 'both' end as side
from dst_inv d
full join (select case when collection like '%collection' then replace(collection,'_collection','_twin')
                       else collection||'_copy' end as collection,
             case when collection like '%collection' then replace(core,'_collection','_twin')
                  else replace(core,collection,collection||'_copy') end as core
           from src_inv) s on s.core=d.core""",
    "collections": "select distinct collection from inv",
    "cores_by_collection": """
select collection, core, node
from (select *, row_number() over (partition by collection, core order by rn desc, node desc) as place from inv) t
where place=1""",
    "cores_by_shard": """
select collection, shard, core, node
from (select *, row_number() over (partition by collection, shard, core order by rn desc, node desc) as place
      from inv where collection<>'collection1') t
where place=1""",
    "cores_by_node": "select node, core, count(*) as copies from inv group by 1, 2",
    "core_status_by_node": """
select node, core, state
from (select *, row_number() over (partition by node, core order by rn desc, state desc) as place from inv) t
where place=1""",
    "all_nodes": "select distinct node from inv",
    "shard_count": """
select i.collection, count(distinct s.shard) as shards
from (select distinct collection from inv) i left join src_inv s on s.collection=i.collection
group by 1""",
    "core_health": """
select collection, core, node, available, case when available then num_docs else 0 end as num_docs,
  case when available then version else 0 end as version
from inv""",
    "cluster_health_rollup": """
select collection, shard,
  case grouping_id(collection, shard) when 0 then 'shard' when 1 then 'collection' else 'cluster' end as level,
  bool_and(available) as healthy, count(*) as cores, count(*) filter (where not available) as unavailable
from inv group by grouping sets ((collection, shard), (collection), ())""",
    "cluster_health": """
select collection, bool_and(available) as healthy, count(*) as cores,
  count(*) filter (where not available) as unavailable
from inv group by 1""",
    "leader_by_shard": """
select collection, shard,
  coalesce(min_by(node_name||','||core, rn) filter (where lower(leader)='true'), 'NO_LEADER') as leader
from inv group by 1, 2""",
    "leader_by_snapshot": """
select date_trunc('year', last_modified) as snapshot_ts, collection, shard,
  coalesce(min_by(node_name||','||core, rn) filter (where lower(leader)='true'), 'NO_LEADER') as leader
from inv group by 1, 2, 3""",
    "core_history": """
with yearly as (
  select date_trunc('year', cast(l_shipdate as timestamp)) as snapshot_ts, 'p'||cast(l_partkey as varchar) as collection,
    'p'||cast(l_partkey as varchar)||'_s'||cast(l_suppkey as varchar) as core, l_orderkey as rn,
    'host'||cast(l_linenumber%2 as varchar) as node,
    case when l_returnflag='R' then 'down' else 'active' end as state
  from lineitem),
last as (
  select * from yearly
  qualify row_number() over (partition by snapshot_ts, collection, core order by rn desc, node desc, state desc) = 1),
times as (
  select snapshot_ts, row_number() over (order by snapshot_ts) as place, lead(snapshot_ts) over (order by snapshot_ts) as next_ts
  from (select distinct snapshot_ts from yearly) d),
numbered as (
  select l.*, t.place, t.next_ts,
    t.place - row_number() over (partition by collection, core, node, state order by t.place) as span
  from last l join times t on t.snapshot_ts=l.snapshot_ts)
select collection, 'shard1' as shard, core, node, state, cast(min(snapshot_ts) as timestamp) as valid_from,
  nullif(max(coalesce(next_ts, timestamp '9999-01-01')), timestamp '9999-01-01') as valid_to, count(*) as snapshots
from numbered group by collection, core, node, state, span""",
    "core_to_best_by_snapshot": """
with yearly as (select *, date_trunc('year', last_modified) as snapshot_ts from inv),
picked as (
  select *, row_number() over (partition by snapshot_ts, collection, shard
              order by version desc, last_modified desc, core) as place
  from yearly where available)
select y.snapshot_ts, y.collection, y.shard, y.core, b.core as best_core, b.node as best_node
from yearly y left join picked b
  on b.place=1 and b.snapshot_ts=y.snapshot_ts and b.collection=y.collection and b.shard=y.shard""",
    "best_replica": "select * from best_of_all",
    "best_replica_freshest": """
select collection, shard, core as best_core, node as best_node
from (select *, row_number() over (partition by collection, shard
               order by version desc, last_modified desc, core) as place
      from inv where available) t
where place=1""",
    "core_to_best": """
select s.collection, s.shard, s.core, b.best_core, b.best_node
from inv s left join best_of_all b on b.collection=s.collection and b.shard=s.shard""",
    "data_match": f"""
select src_core, dst_core, not (src_up and dst_up) as unavailable, src_version > dst_version as behind,
  drift, src_up and dst_up and src_version <= dst_version and not drift as ok, {_REASON} as reason
from pairs""",
    "post_copy_check": _POST_COPY,
    "diagnostics_summary": f"select status, count(*) as cores from ({_POST_COPY}) t group by 1",
    "core_label": """
select core, node||'/'||core||case when available
  then ' [numDocs='||cast(num_docs as varchar)||' version='||cast(version as varchar)||']'
  else ' [Unavailable]' end as label
from inv""",
    "is_replicating": """
select event_id, event_type not in ('purchase','view') as replicating from events""",
    "blank_test": """
select doc_id, i::int as line, not regexp_matches(l, '\\S') as blank
from (select doc_id, unnest(string_split(text, chr(10))) as l, unnest(range(len(string_split(text, chr(10))))) as i
      from documents) t""",
    "json_path": "select doc_id, n_chars as found from documents",
    "source_gate": """
select core, leader is not null and available as ok,
  case when leader is null then 'NULL' else core end as entity,
  case when leader is null then 'Replication Failed since source Core is NULL..'
       when not available then 'Replication Failed since source Core is not available..' else '' end as reason
from inv""",
    "clone_collections": _clone(_PLAIN_FORWARD, 1),
    "clone_with_rename": _clone(_NEW_FORWARD, 4),
    "content_diff": """
with other as (
  select collection, shard, doc_id, case when doc_id%64=1 then '' else text end as text, n_chars from contents where doc_id%50<>7
  union all select collection, shard, doc_id+10000000, text, n_chars from contents where doc_id%97=5)
select coalesce(c.collection, o.collection) as collection, coalesce(c.shard, o.shard) as shard, coalesce(c.doc_id, o.doc_id) as doc_id,
  case when o.doc_id is null then 'add' when c.doc_id is null then 'remove' else 'replace' end as op
from contents c full join other o on o.collection=c.collection and o.shard=c.shard and o.doc_id=c.doc_id
where o.doc_id is null or c.doc_id is null or o.text<>c.text or o.n_chars<>c.n_chars""",
    "clone_resumed": f"""
select dest_collection, dest_core as entity, source_core, status, reason, 0::bigint as copied_twice from ({_clone(_PLAIN_FORWARD, 1)}) c""",
    "clone_incremental": """
select collection, case when collection='src9_collection' then 'dropped'
    when bool_or(collection='src3_collection' and doc_id%10=3) then 'written' else 'kept' end as action,
  case when collection='src9_collection' then 0 else count(*) end as docs
from contents group by collection""",
    "drop_partitions": """
select collection, count(*) as docs, cast(sum(n_chars) as bigint) as chars from contents
where collection not in ('src1_collection','src7_collection') group by collection""",
    "full_backup": f"""
select 'tree' as step, s.path as entity, 'ok' as status,
  case when d.path is null then 'create' when d.data=s.data then 'same' else 'set' end as detail
from src_tree s left join dst_tree d on d.path=s.path
union all
select 'collection', dest_core, status, reason from ({_clone(_PLAIN_FORWARD, 1)}) c""",
    "clone_tree": """
select path, md5(data) as digest from src_tree
union all
select path, md5(data) from dst_tree where path not in (select path from src_tree)""",
    "clone_aliases": """
select s.alias,
  case when d.alias is null then 'create' when d.target=s.target then 'skip' else 'repoint' end as op,
  'ok' as verdict
from src_alias s left join dst_alias d on d.alias=s.alias""",
    "smoke_test": """
select 'size' as "check", alias as entity,
  'source '||cast(source_docs as varchar)||', destination '||cast(dest_docs as varchar) as detail
from alias_sizes where at_dest and source_docs<>dest_docs
union all
select 'health', core, 'unavailable on '||node from dst_inv where not available""",
    "clone_with_collisions": _outcomes("case when contains(collection,'src1') then replace(collection,'src1','src') else collection end",
                                       "case when contains(dest,'src') then replace(dest,'src','src1') else dest end", "collection"),
    "clone_unmapped": _outcomes("collection||'_copy'", "replace(dest,'_copy','')",
                                "case when regexp_matches(collection,'^src1[0-9]_') then replace(collection,'_collection','_copy_idx') else collection end"),
    "content_parity": """
select collection, shard, count(*) as source_docs, count(*) filter (doc_id%50<>7) as dest_docs,
  count(*) filter (doc_id%50=7 or (doc_id%64=1 and text<>''))=0 as same
from contents group by 1, 2""",
    "apply_delete": """
select collection, count(*) as docs, sum(n_chars)::bigint as chars from contents
where collection not in ('src1_collection','src7_collection') group by 1""",
    "scan_live_nodes": "select 'host'||cast(s_suppkey as varchar) as node from supplier",
    "rejected_documents": "select conv_id, turn from conversations where turn%3=0",
    "read_documents": """
select collection, shard, 'core_node'||cast(rn as varchar) as replica, core, node_name, state, leader from inv""",
    "delete_plan": """
select r.collection,
  case when r.collection='collection1' then 'protected'
       when r.collection in (select collection from contents) then 'drop' else 'absent' end as action
from (values ('collection1'), ('src1_collection'), ('src7_collection'), ('no_such_collection')) r(collection)""",
    "completion_monitor": _COMPLETION,
    "completion_monitor_stream": _COMPLETION,
    "completion_summary": f"select outcome, count(*) as requests from ({_COMPLETION}) t group by 1",
    "latest_status": _LATEST,
    "latest_status_stream": _LATEST,
    "retry_gate": "select * from failed_runs",
    "retry_gate_stream": "select * from failed_runs",
    "retry_verdict": """
select distinct r.core,
  case when r.core in (select core from progress where status='done') then 'unverified' else 'failed' end as verdict
from failed_runs r""",
    # Alarms go off once the latest sample, less the allowed lateness, is past the deadline.
    "overdue_alarms_stream": _ALARMS,
    "overdue_timers_stream": _ALARMS,
}


def _views(sql: str) -> list[str]:
    """The views a statement needs, each after those it needs itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                order.append(name)

    visit(sql)
    return order


# Views that others use several times.
ONCE = ("inv", "src_inv", "dst_inv", "wanted", "best", "plan")


def statements() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        ctes = ",\n".join(f"{v} as {'materialized ' if v in ONCE else ''}({VIEWS[v]})" for v in _views(sql))
        body = sql.strip()
        if ctes and body.startswith("with "):
            out[name] = f"with {ctes},\n{body[5:]}"
        else:
            out[name] = f"with {ctes}\n{body}" if ctes else body
    return out
