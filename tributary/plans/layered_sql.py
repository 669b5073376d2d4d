"""The graphs of ``graphs`` as SQL over the driver's tables, for the oracle."""

A = """edges as (
 select 'model.tpch.r_' || n_regionkey as parent, 'model.tpch.n_' || n_nationkey as child from nation
 union select 'model.tpch.n_' || c_nationkey, 'model.tpch.c_' || c_custkey from customer
 union select 'model.tpch.n_' || s_nationkey, 'model.tpch.s_' || s_suppkey from supplier
 union select 'model.tpch.c_' || o_custkey, 'model.tpch.o_' || o_orderkey from orders
 union select 'model.tpch.s_' || l_suppkey, 'model.tpch.p_' || l_partkey from lineitem
 union select 'model.tpch.p_' || l_partkey, 'model.tpch.o_' || l_orderkey from lineitem)"""

# models, nodes, edges, detail, cols, tests, run and catalog of the layered graph
B = """m0 as (
 select 'staging' as layer, s_suppkey as k from supplier
 union all select 'intermediate', p_partkey from part
 union all select 'marts', o_orderkey from orders),
m1 as (select *, (select count(*) from m0 where layer = 'staging') as ns, (select count(*) from m0 where layer = 'intermediate') as ni,
 case layer when 'staging' then case when k % 7 = 0 then 'sta_' else 'stg_' end when 'intermediate' then case when k % 9 = 0 then 'mid_' else 'int_' end
 else case when k % 11 = 0 then 'mar_' when k % 2 = 0 then 'fct_' else 'dim_' end end || case when k < 100000 then lpad(cast(k as varchar), 5, '0') else cast(k as varchar) end as name from m0),
m as (select layer, k, ns, ni, name, case layer when 'staging' then k when 'intermediate' then ns + k else ns + ni + k end as idx,
 'model.' || case when k % 10 = 9 then 'vendor' else 'bench' end || '.' || name as unique_id,
 case when k % 13 = 0 then case when layer = 'staging' then 'marts' else 'staging' end else layer end as dir,
 case k % 4 when 0 then 'view' when 1 then 'table' when 2 then 'ephemeral' else 'incremental' end as materialized from m1),
src as (select j, 'source.bench.raw.tbl_' || j as unique_id, 'tbl_' || j as name from range(10) t(j)),
expo as (select i, 'exposure.bench.exp_' || i as unique_id, 'exp_' || i as name from range(16) t(i)),
nodes as (select unique_id, name, 'model' as resource_type, dir || '/' || name || '.sql' as path, materialized, dir as dir_layer from m
 union all select unique_id, name, 'source', 'staging/sources.yml', null, 'staging' from src
 union all select unique_id, name, 'exposure', 'exposures.yml', null, 'other' from expo),
edges as (
 select distinct p.unique_id as parent, c.unique_id as child from m c, range(3) t(j), m p
  where (c.layer = 'marts' or (c.layer = 'intermediate' and c.k % 97 <> 5)) and p.idx = (c.idx * 31 + j * 7) % case when c.layer = 'intermediate' then c.ns else c.ns + c.ni end
 union select 'source.bench.raw.tbl_' || (k % 8), unique_id from m where layer = 'staging' or (layer = 'intermediate' and k % 17 = 0)
 union select p.unique_id, c.unique_id from m c join m p on p.idx = c.idx - 1 where c.layer = 'marts' and c.k % 59 = 1
 union select p.unique_id, c.unique_id from m c join m p on p.idx = ((c.idx - 1) * 31) % (c.ns + c.ni) where c.layer = 'marts' and c.k % 59 = 1
 union select 'source.bench.raw.tbl_' || ((k + 3) % 8), unique_id from m where layer = 'staging' and k % 29 = 3
 union select p.unique_id, c.unique_id from m c join m p on p.k = c.k - 1 and p.layer = 'staging' where c.layer = 'staging' and c.k % 19 = 1
 union select m.unique_id, expo.unique_id from expo, range(2) t(z), m where m.layer = 'marts' and m.k = (expo.i * 7 + 3 * z) % (select count(*) from m where layer = 'marts')),
cols as (select unique_id, k, 0 as pos, 'id' as name, 'int' as data_type, case when k % 3 = 0 then null else 'Key' end as description from m
 union all select unique_id, k, 1, 'c0000', case when k % 7 = 2 then null else 'text' end, case when k % 2 = 1 then null else 'A value' end from m
 union all select unique_id, k, 2, 'C0001', 'text', ' ' from m),
tests as (select unique_id, k, 'not_null' as kind, 'id' as column_name from m where k % 2 = 0 union all select unique_id, k, 'unique', 'id' from m where k % 3 = 0
 union all select unique_id, k, 'not_null', 'c0000' from m where k % 5 = 1 union all select unique_id, k, 'unique_combination_of_columns', null from m where k % 31 = 4
 union all select unique_id, k, 'unit', null from m where layer = 'marts' and k % 4 = 0),
cat as (select unique_id, k, 'id' as col, case when k % 4 = 2 then 'bigint' else 'INTEGER' end as data_type from m where layer = 'marts'
 union all select unique_id, k, 'c0000', 'VARCHAR' from m where layer = 'marts' and k % 9 <> 4 union all select unique_id, k, 'c0001', 'text' from m where layer = 'marts'
 union all select unique_id, k, 'loaded_at', 'timestamp' from m where layer = 'marts' and k % 8 = 1)"""

# the later state, on top of B
LATER = """gone as (select unique_id from m where idx % 211 = 0),
nodes2 as (select n.unique_id, n.name, n.resource_type, n.path, case when m.idx % 41 = 0 then 'table' else n.materialized end as materialized, n.dir_layer
 from nodes n left join m on m.unique_id = n.unique_id where n.unique_id not in (select unique_id from gone)
 union all select 'model.bench.fct_new_' || k, 'fct_new_' || k, 'model', 'marts/fct_new_' || k || '.sql', 'table', 'marts' from m where layer = 'marts' and k < 4),
edges2 as (select parent, child from (select parent, child from edges union select unique_id, 'model.bench.fct_new_' || k from m where layer = 'marts' and k < 4)
 where parent in (select unique_id from nodes2) and child in (select unique_id from nodes2)),
tests2 as (select t.unique_id, t.kind, t.column_name from tests t join m on m.unique_id = t.unique_id where not (m.idx % 43 = 0 and t.kind = 'not_null') and t.unique_id in (select unique_id from nodes2))"""


def over(*ctes: str, query: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n" + query
