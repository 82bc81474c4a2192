"""SQL that computes the same results as the registered queries."""

ORACLES: dict[str, str] = {}

# --- vector documents ----------------------------------------------------------

EMB = """
emb as (select vec_id // 100 as doc_id,
               case when vec_id % 2 = 0 then 'source' else 'summary' end as component,
               vec_id as node_id, cast(label as varchar) as attrib_type, label,
               cast(embedding as double[]) as vec from embeddings),
norms as (select *, sqrt(list_dot_product(vec, vec)) as nrm from emb),
allpairs as (select s.doc_id, s.attrib_type, s.label, s.node_id as src_node, m.node_id as smy_node,
               case when s.nrm * m.nrm = 0 then 0.0
                    else greatest(list_dot_product(s.vec, m.vec) / (s.nrm * m.nrm), 0.0) end as sim
             from norms s join norms m on s.doc_id = m.doc_id and s.label = m.label
             where s.component = 'source' and m.component = 'summary'),
pairs as (select * from allpairs where sim > 0.05)
"""

MEANS = """
dims as (select doc_id, component, label, attrib_type, unnest(vec) as x, generate_subscripts(vec, 1) as dim from emb),
means as (select doc_id, component, label, attrib_type, dim, avg(x) as value from dims group by all),
sents as (select doc_id, component, label, list(value order by dim) as vec from means group by all),
sentnorms as (select *, sqrt(list_dot_product(vec, vec)) as nrm from sents),
sentpairs as (select s.doc_id, s.label as src_sent, m.label as smy_sent,
                case when s.nrm * m.nrm = 0 then 0.0
                     else greatest(list_dot_product(s.vec, m.vec) / (s.nrm * m.nrm), 0.0) end as sim
              from sentnorms s join sentnorms m on s.doc_id = m.doc_id
              where s.component = 'source' and m.component = 'summary')
"""

ORACLES["bipartite_pairs"] = f"""with {EMB}
select doc_id, attrib_type, count(*) filter (where component = 'source') as n_source,
       count(*) filter (where component = 'summary') as n_summary,
       count(*) filter (where component = 'source') * count(*) filter (where component = 'summary') as n_pairs
from emb group by all"""
ORACLES["pair_cosine"] = f"""with {EMB}
select doc_id, attrib_type, src_node, smy_node, round(sim, 6) as sim from pairs"""
# a document fails if the cut vectors, of different lengths, meet in a block pair
ORACLES["kernel_failures"] = f"""with {EMB},
last as (select doc_id, max(attrib_type) as label from emb where doc_id = (select max(doc_id) from emb) group by doc_id),
broken as (select e.doc_id, count(distinct component) as sides,
                  max(lens) as lens from emb e join last l on l.doc_id = e.doc_id and l.label = e.attrib_type
           join (select e.doc_id as d, count(distinct e.node_id % 7) as lens from emb e join last l
                 on l.doc_id = e.doc_id and l.label = e.attrib_type group by all) on d = e.doc_id group by all)
select doc_id, count(*) as n_pairs, false as failed from pairs
where doc_id not in (select doc_id from broken where sides = 2 and lens > 1) group by doc_id
union all select doc_id, 0, true from broken where sides = 2 and lens > 1"""
ORACLES["sigmoid_skew"] = f"""with {EMB}
select doc_id, src_node, smy_node, round(1 / (1 + exp(0.5 - sim)) - 0.5, 6) as skew from pairs"""
ORACLES["node_similarity"] = f"""with {EMB}
select doc_id, src_node, smy_node,
  round(least(greatest(pow(sim, 2) + 1 / (1 + exp(0.5 - pow(pow(sim, 0.8), 2))) - 0.5, 0.0), 1.0), 6) as sim
from pairs"""
ORACLES["mean_vector"] = f"""with {EMB}, {MEANS}
select doc_id, component, attrib_type, cast(dim - 1 as bigint) as dim, round(value, 6) + 0.0 as value from means"""
ORACLES["sentence_skew"] = f"""with {EMB}, {MEANS}
select doc_id, cast(src_sent as bigint) as src_sent, cast(smy_sent as bigint) as smy_sent, round(sim, 6) as sim,
       round(sim * 0.5 + 0.5, 6) as skew from sentpairs where sim > 0"""
ORACLES["dampened_similarity"] = f"""with {EMB}, {MEANS}
select p.doc_id, p.src_node, p.smy_node, round(p.sim * (coalesce(s.sim, 0.0) * 0.5 + 0.5), 6) as sim
from pairs p left join sentpairs s on s.doc_id = p.doc_id and s.src_sent = p.label and s.smy_sent = p.label"""
ORACLES["alignment_capacities"] = f"""with {EMB}
select doc_id, src_node, smy_node, round(sim, 6) as capacity from pairs where sim > 0.1"""
ORACLES["top_alignments"] = f"""with {EMB}
select doc_id, src_node, smy_node, round(sim, 6) as sim, rank from (
  select *, row_number() over (partition by doc_id, src_node order by sim desc, smy_node) as rank from pairs)
where rank <= 2"""
ORACLES["best_partner"] = f"""with {EMB}
select doc_id, smy_node, src_node, round(sim, 6) as sim from (
  select *, row_number() over (partition by doc_id, smy_node order by sim desc, src_node) as rank from pairs)
where rank = 1"""
ORACLES["orient_alignments"] = f"""with {EMB}
select doc_id, 'source' as component, src_node as to_id, count(*) as n, round(sum(sim), 6) as inflow
from pairs group by all
union all
select doc_id, 'summary', smy_node, count(*), round(sum(sim), 6) from pairs group by all"""

# rings by definition: all nodes at exactly one, two and three hops, any direction
ORACLES["neighborhood_vector"] = f"""with {EMB},
links as (
  select distinct doc_id, component, -1 as u, -(label + 2) as v from emb
  union all select doc_id, component, -(label + 2), node_id from emb),
und as (select * from links union all select doc_id, component, v, u from links),
verts as (select distinct doc_id, component, u as node_id from und),
r1 as (select doc_id, component, u as center, v as node_id from und),
r2 as (select distinct a.doc_id, a.component, a.center, b.v as node_id from r1 a join und b
       on a.doc_id = b.doc_id and a.component = b.component and a.node_id = b.u where b.v <> a.center),
r3all as (select distinct a.doc_id, a.component, a.center, b.v as node_id from r2 a join und b
       on a.doc_id = b.doc_id and a.component = b.component and a.node_id = b.u),
r3 as (select * from r3all x where not exists (select 1 from r1 y where y.doc_id = x.doc_id and
       y.component = x.component and y.center = x.center and y.node_id = x.node_id)),
rings as (select 1 as hop, 1.0 as w, * from r1 union all select 2, 0.1, * from r2 union all select 3, 0.1, * from r3),
comps as (select doc_id, component, node_id, unnest(vec) as x, generate_subscripts(vec, 1) as dim from emb),
ringsize as (select doc_id, component, center, hop, w, count(*) as n from rings group by all),
ringsum as (select r.doc_id, r.component, r.center, r.hop, c.dim, sum(c.x) as s
            from rings r join comps c on r.doc_id = c.doc_id and r.component = c.component and r.node_id = c.node_id
            group by all),
vals as (select z.doc_id, z.component, z.center as node_id, s.dim, sum(z.w * s.s / z.n) as value
         from ringsize z join ringsum s on z.doc_id = s.doc_id and z.component = s.component
              and z.center = s.center and z.hop = s.hop group by all)
select v.doc_id, v.component, cast(v.node_id as bigint) as node_id,
       round(coalesce(sum(dim * value), 0.0), 5) + 0.0 as weighted,
       round(coalesce(sum(value * value), 0.0), 5) + 0.0 as squared
from verts v left join vals using (doc_id, component, node_id) group by all"""

ORACLES["roles_vector"] = f"""with {EMB},
lab as (select label, avg(x) as m, dim from (
  select label, unnest(vec) as x, generate_subscripts(vec, 1) as dim from emb) group by all),
comps as (select doc_id, component, label, node_id, unnest(vec) as x, generate_subscripts(vec, 1) as dim from emb)
select doc_id, component, cast(-(c.label + 2) as bigint) as node_id,
  round(sum(c.dim * (0.3 * c.x + 0.5 * case when node_id % 4 < 2 then 2 * l.m
                                            when node_id % 5 > 0 then 1.0 else 0.0 end)), 5) as weighted
from comps c join lab l on c.label = l.label and c.dim = l.dim group by all"""

# --- coreference -----------------------------------------------------------------

COREF = EMB + """,
refs as (select doc_id, label * 7 + node_id % 7 as rel_id, component, node_id from emb),
al as (select doc_id, src_node, smy_node, sim as capacity from pairs where sim > 0.1),
span as (select doc_id, rel_id from refs group by all having count(distinct component) = 2),
lent as (select a.doc_id, b.node_id as src_node, a.smy_node, l.rel_id, a.capacity
         from al a join refs l on l.doc_id = a.doc_id and l.node_id = a.src_node
         join refs b on b.doc_id = l.doc_id and b.rel_id = l.rel_id and b.component = 'source'
              and b.node_id <> l.node_id
         where l.component = 'source'),
new as (select s.doc_id, s.node_id as src_node, m.node_id as smy_node, max(s.rel_id) as rel_id
        from span join refs s using (doc_id, rel_id) join refs m using (doc_id, rel_id)
        where s.component = 'source' and m.component = 'summary' group by s.doc_id, s.node_id, m.node_id)
"""
ORACLES["coref_edges"] = f"""with {COREF}
select doc_id, src_node, smy_node, cast(rel_id as bigint) as rel_id, round(capacity, 6) as capacity from lent"""
ORACLES["bipartite_relations"] = f"with {COREF} select doc_id, cast(rel_id as bigint) as rel_id from span"
ORACLES["component_relations"] = f"""with {COREF}
select doc_id, component, count(*) as relations from (
  select doc_id, rel_id, min(component) as component from refs group by all having count(distinct component) = 1)
group by all"""
ORACLES["coref_upsert"] = f"""with {COREF}
select doc_id, src_node, smy_node, cast(null as bigint) as rel_id, cast(null as boolean) as is_bipartite,
       round(capacity, 6) as capacity from al
where not exists (select 1 from new n where n.doc_id = al.doc_id and n.src_node = al.src_node and n.smy_node = al.smy_node)
union all
select doc_id, src_node, smy_node, cast(rel_id as bigint), true, 1.0 from new"""
ORACLES["coref_total"] = f"""with {COREF},
mixed as (select doc_id, src_node, smy_node, null as rel_id from al
          union all select doc_id, src_node, smy_node, rel_id from lent),
firsts as (select doc_id, src_node, smy_node, min(coalesce(rel_id, -1)) as f from mixed group by all),
left_over as (
  select m.doc_id, m.rel_id from mixed m
  left join new n on n.doc_id = m.doc_id and n.src_node = m.src_node and n.smy_node = m.smy_node
  left join firsts f on f.doc_id = m.doc_id and f.src_node = m.src_node and f.smy_node = m.smy_node
  where m.rel_id is not null and not (n.doc_id is not null and coalesce(m.rel_id, -1) = f.f)
  union all select doc_id, rel_id from new)
select doc_id, count(*) as added from left_over group by all"""

# --- sales trees -------------------------------------------------------------------

HIER = """
cust as (select c_custkey, c_nationkey, n_regionkey from customer join nation on c_nationkey = n_nationkey),
ord as (select o_orderkey, o_custkey, n_regionkey from orders join cust on o_custkey = c_custkey),
lines as (select l_orderkey, l_linenumber, sum(l_quantity) as q, min(l_returnflag) as flag from lineitem group by all),
hier as (
  select cast(n_regionkey as bigint) as doc_id, 'r' || n_regionkey as parent_id, 'n' || n_nationkey as child_id,
         'doc' as edge_type, cast(null as double) as weight from nation
  union all select cast(n_regionkey as bigint), 'n' || c_nationkey, 'c' || c_custkey, 'sentence', null from cust
  union all select cast(n_regionkey as bigint), 'c' || o_custkey, 'o' || o_orderkey, 'role', null from ord
  union all select cast(n_regionkey as bigint), 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber, 'role', q
            from lines join ord on l_orderkey = o_orderkey),
hnodes as (
  select cast(r_regionkey as bigint) as doc_id, 'r' || r_regionkey as node_id, 'doc' as attrib_type, true as is_root from region
  union all select doc_id, child_id, case when edge_type <> 'role' then edge_type
       when child_id like 'o%' then 'concept' else 'attribute' end, false from hier)
"""

DAG = """
toporders as (select o_custkey as doc_id, 'o' || o_orderkey as edge_id, 'c' || o_custkey as parent_id,
              'o' || o_orderkey as child_id, 'sentence' as edge_type from orders),
partedges as (select distinct o_custkey as doc_id, 'e' || l_orderkey || '-' || l_partkey as edge_id,
              'o' || l_orderkey as parent_id, 'p' || l_partkey as child_id, 'role' as edge_type
              from lineitem join orders on l_orderkey = o_orderkey),
dag as (select * from toporders union all select * from partedges)
"""

ORACLES["reverse_edges"] = f"""with {HIER}
select doc_id, child_id as edge_id, child_id as from_id, parent_id as to_id, edge_type from hier"""
ORACLES["graph_union"] = f"""with {HIER}, {DAG}
select 'source' as component, edge_type, count(*) as n from hier group by all
union all select 'summary', edge_type, count(*) from dag group by all"""
# vertices of a region share its tree; the smallest id is the first customer in text order
ORACLES["components"] = f"""with {HIER}
select node_id, min(node_id) over (partition by doc_id) as component_root from hnodes"""
ORACLES["component_of_root"] = f"""with {DAG},
verts as (select doc_id, parent_id as v from dag union select doc_id, child_id from dag)
select doc_id, n_nodes, n_edges from (select doc_id, count(*) as n_nodes from verts group by all)
join (select doc_id, count(*) as n_edges from dag group by all) using (doc_id)"""
ORACLES["induced_subgraph"] = f"""with {HIER}
select doc_id, child_id as edge_id, parent_id, child_id from hier where weight is null"""
ORACLES["leaves"] = f"""with {HIER}
select doc_id, node_id, attrib_type from hnodes where node_id not in (select parent_id from hier)"""
ORACLES["graph_roots"] = f"with {HIER} select doc_id, node_id, is_root from hnodes where is_root"
ORACLES["degrees"] = f"""with {DAG},
ends as (select doc_id, parent_id as node_id, 1 as o, 0 as i from dag
         union all select doc_id, child_id, 0, 1 from dag)
select doc_id, node_id, cast(sum(i) as bigint) as in_degree, cast(sum(o) as bigint) as out_degree from ends group by all"""
CLOSURE = HIER + """,
up as (select child_id as k, parent_id as p from hier),
closure as (
  select doc_id, parent_id as ancestor, child_id as node_id, 1 as hops from hier
  union all select h.doc_id, a.p, h.child_id, 2 from hier h join up a on a.k = h.parent_id
  union all select h.doc_id, b.p, h.child_id, 3 from hier h join up a on a.k = h.parent_id join up b on b.k = a.p
  union all select h.doc_id, c.p, h.child_id, 4 from hier h join up a on a.k = h.parent_id join up b on b.k = a.p
            join up c on c.k = b.p),
ndesc as (select doc_id, node_id, coalesce(n, 0) + 1 as n_desc from hnodes left join
          (select ancestor, count(*) as n from closure group by all) on ancestor = node_id)
"""
ORACLES["k_hop"] = f"""with {CLOSURE}
select doc_id, ancestor as center, cast(hops as bigint) as hops, count(*) as n from closure where hops <= 3 group by all
union all select doc_id, node_id, 0, 1 from hnodes"""
ORACLES["descendants"] = f"""with {CLOSURE}
select doc_id, ancestor, count(*) as n, cast(max(hops) as bigint) as depth from closure group by all"""
ORACLES["adjacency"] = f"""with {DAG}
select doc_id, parent_id as node_id, row_number() over (partition by doc_id, parent_id order by child_id) - 1 as position,
       child_id as neighbor_id from dag"""
ORACLES["neighborhood_vector_dag"] = f"""with {DAG},
und as (select distinct doc_id, parent_id as u, child_id as v from dag
        union select distinct doc_id, child_id, parent_id from dag),
verts as (select distinct doc_id, u as node_id, cast(regexp_extract(u, '[0-9]+') as bigint) as k from und),
r1 as (select doc_id, u as center, v as node_id from und),
r2 as (select distinct a.doc_id, a.center, b.v as node_id from r1 a join und b on a.doc_id = b.doc_id and a.node_id = b.u
       where b.v <> a.center and (a.doc_id, a.center, b.v) not in (select (doc_id, center, node_id) from r1)),
r3 as (select distinct a.doc_id, a.center, b.v as node_id from r2 a join und b on a.doc_id = b.doc_id and a.node_id = b.u
       where b.v <> a.center and (a.doc_id, a.center, b.v) not in (select (doc_id, center, node_id) from r1)
             and (a.doc_id, a.center, b.v) not in (select (doc_id, center, node_id) from r2)),
rings as (select 1 as hop, 1.0 as w, * from r1 union all select 2, 0.1, * from r2 union all select 3, 0.1, * from r3),
means as (select r.doc_id, r.center, r.hop, r.w, avg(x.k % 7) as a, avg(x.k % 11) as b, avg(1.0) as c
          from rings r join verts x on x.doc_id = r.doc_id and x.node_id = r.node_id group by all)
select v.doc_id, v.node_id, round(coalesce(sum(w * a), 0.0), 9) as v0, round(coalesce(sum(w * b), 0.0), 9) as v1,
       round(coalesce(sum(w * c), 0.0), 9) as v2
from verts v left join means m on m.doc_id = v.doc_id and m.center = v.node_id group by all"""
ORACLES["incident_edges"] = f"""with {DAG}
select doc_id, edge_id, child_id as node_id from dag where edge_type = 'role' and (doc_id, child_id) in (
  select (doc_id, child_id) from dag group by doc_id, child_id having count(*) > 1)"""
ORACLES["delete_edges"] = f"""with {HIER},
gone as (select * from hier where weight < 10), kept as (select * from hier where weight is null or weight >= 10),
ends as (select parent_id as node_id from gone union select child_id from gone),
live as (select parent_id as node_id from kept union select child_id from kept)
select doc_id, attrib_type, count(*) as n_nodes from hnodes
where not (node_id in (select node_id from ends) and node_id not in (select node_id from live)) group by all"""
ORACLES["select_edges"] = f"""with {HIER}
select doc_id, child_id as edge_id, weight from hier where edge_type = 'role' and weight > 40"""
ORACLES["containing_component"] = f"with {EMB} select doc_id, node_id, component from emb"
ORACLES["set_capacities"] = f"""with {HIER}
select doc_id, child_id as edge_id, coalesce(weight, 1e10) as capacity from hier"""
ORACLES["assign_ids"] = f"""with {HIER}
select doc_id, node_id, row_number() over (partition by doc_id order by node_id) - 1 as attrib_id from hnodes"""

# --- flow ------------------------------------------------------------------------------

FLOW = CLOSURE + """,
mass as (select doc_id, ancestor as node_id, sum(weight) as m from (
           select c.doc_id, c.ancestor, h.weight from closure c join hier h on h.child_id = c.node_id
           where h.weight is not null
           union all select doc_id, child_id, weight from hier where weight is not null) group by all),
flows as (select h.doc_id, h.child_id, h.edge_type, coalesce(m, 0.0) as flow
          from hier h left join mass on mass.node_id = h.child_id
          union all select n.doc_id, n.node_id, 'terminal', coalesce(m, 0.0)
          from hnodes n left join mass using (node_id) where is_root),
fpn as (select f.doc_id, f.child_id, f.edge_type, f.flow / n_desc as flow
        from flows f join ndesc on ndesc.node_id = f.child_id)
"""
ORACLES["saturated_flow"] = f"with {FLOW} select doc_id, child_id, edge_type, round(flow, 6) as flow from flows"
ORACLES["flow_per_node"] = f"with {FLOW} select doc_id, child_id, edge_type, round(flow, 6) as flow from fpn"
ORACLES["flow_normalized"] = f"""with {FLOW}
select doc_id, child_id, round(flow / sum(flow) over (partition by doc_id), 9) as flow from fpn"""
ORACLES["flow_display"] = f"""with {FLOW}
select doc_id, child_id, round(flow / sum(flow) over (partition by doc_id), 9) as flow,
       round(flow, 6) as vis_flow from fpn"""
ORACLES["set_flow"] = f"""with {FLOW} select doc_id, child_id, edge_type,
  round(case when edge_type in ('terminal', 'doc') then 1.0 else flow end, 6) as flow from flows"""
ORACLES["discount_flow"] = f"""with {HIER},
tot as (select parent_id, sum(weight) as s from hier where weight is not null group by all)
select doc_id, child_id as from_id, parent_id as to_id,
       round(case when s > 100 then weight * 100 / s else weight end, 6) as capacity
from hier join tot using (parent_id) where weight is not null"""
ORACLES["clamp_capacity"] = f"""with {HIER}
select doc_id, child_id as from_id, parent_id as to_id, case when weight <= 5 then 0.0 else weight end as capacity,
       case when weight <= 5 then 0.0 else weight end as flow from hier where weight is not null"""
ORACLES["remove_alignments"] = f"""with {HIER}
select doc_id, count(*) as n, round(sum(weight), 6) as capacity from hier where weight > 5 group by all"""
ORACLES["flow_gaps"] = f"""with {FLOW}
select doc_id, child_id, round(flow, 6) as flow from flows where edge_type = 'role' and 50 - flow < 0"""
ORACLES["flow_updates"] = f"""with {HIER},
lost as (select doc_id, child_id, parent_id from hier where weight <= 5)
select h.doc_id, count(*) filter (where h.child_id in (select child_id from lost)
                                  or h.child_id in (select parent_id from lost)) as updates
from hier h where edge_type = 'role' group by all"""
ORACLES["prune_subtrees"] = f"""with {FLOW},
weak as (select child_id from fpn where edge_type in ('role', 'sentence') and flow < 15)
select distinct doc_id, node_id from (
  select c.doc_id, c.node_id from closure c join weak on weak.child_id = c.ancestor
  union all select f.doc_id, f.child_id from fpn f join weak using (child_id))"""

ORACLES["tree_intervals"] = f"""with {CLOSURE},
sized as (select n.doc_id, n.node_id, n.n_desc, h.parent_id from ndesc n left join hier h on h.child_id = n.node_id),
offsets as (select doc_id, node_id, n_desc, parent_id,
                   coalesce(sum(n_desc) over (partition by doc_id, parent_id order by node_id
                            rows between unbounded preceding and 1 preceding), 0)
                   + case when parent_id is null then 0 else 1 end as off from sized),
above as (select node_id, ancestor from closure union all select node_id, node_id from hnodes)
select o.doc_id, o.node_id, cast(count(*) - 1 as bigint) as depth, cast(sum(u.off) as bigint) as first,
       cast(sum(u.off) + max(o.n_desc) - 1 as bigint) as last
from offsets o join above a on a.node_id = o.node_id join offsets u on u.node_id = a.ancestor group by all"""

SUMMARY = DAG + """,
sline as (select o_custkey as doc_id, 'p' || l_partkey as src_node, 'b' || p_brand as smy_node, l_discount
          from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
al as (select doc_id, src_node, smy_node, sum(l_discount) / count(*) + 0.1 * count(*) as capacity from sline group by all)
"""
ORACLES["terminals"] = f"""with {SUMMARY}
select distinct doc_id, 'S' as from_key, 'summary:' || smy_node as to_key, 1e10 as capacity from sline
union all select distinct doc_id, 'source:' || parent_id, 'T', 1e10 from toporders"""
ORACLES["reentrancies"] = f"""with {SUMMARY},
tot as (select doc_id, src_node, sum(capacity) as c from al group by all)
select p.doc_id, p.child_id as node_id, count(*) as n_parents, round(max(c), 6) as total_flow,
       max(c) = 0 as has_zero_flow
from partedges p join tot on tot.doc_id = p.doc_id and tot.src_node = p.child_id
group by all having count(*) > 1"""
ORACLES["max_flow_value"] = f"""with {SUMMARY}
select doc_id, round(sum(capacity), 6) as value from al group by all"""
ORACLES["min_cut"] = f"""with {SUMMARY},
parts as (select doc_id, src_node, sum(capacity) as c from al group by all),
ways as (select doc_id, child_id, count(*) as n from partedges group by all),
value as (select p.doc_id, round(sum(least(c, 0.2 * n)), 6) as v from parts p
          join ways w on w.doc_id = p.doc_id and w.child_id = p.src_node group by all)
select doc_id, v as value, v as cut, true as certified from value"""
ORACLES["repaired_reentrancies"] = f"""with {SUMMARY}
select doc_id, round(sum(capacity), 6) as value, coalesce(max(n), 0) as n_reentrancies from al left join (
  select doc_id, count(*) as n from (
    select doc_id, child_id from partedges group by all having count(*) > 1) group by all) using (doc_id)
group by doc_id"""
EVEN = SUMMARY + """,
tot as (select doc_id, src_node, sum(capacity) as c from al group by all),
shares as (select p.*, c / count(*) over (partition by p.doc_id, p.child_id) as flow
           from partedges p join tot on tot.doc_id = p.doc_id and tot.src_node = p.child_id)
"""
ORACLES["max_flow_edges"] = f"with {EVEN} select doc_id, edge_id, round(flow, 6) as flow from shares"
ORACLES["repaired_edge_flows"] = f"""with {EVEN},
up as (select doc_id, parent_id, sum(flow) as f from shares group by all),
tops as (select t.doc_id, t.child_id, t.parent_id, coalesce(f, 0.0) as flow from toporders t
         left join up on up.doc_id = t.doc_id and up.parent_id = t.child_id)
select doc_id, child_id as from_id, parent_id as to_id, round(flow, 6) as flow from shares
union all select doc_id, child_id, parent_id, round(flow, 6) from tops
union all select doc_id, parent_id, 'T', round(sum(flow), 6) from tops group by all"""
ORACLES["summary_terminals"] = f"""with {SUMMARY}
select distinct doc_id, 'summary:' || smy_node as from_key, 'T' as to_key from sline
union all select distinct doc_id, 'S', 'source:' || parent_id from toporders"""
ORACLES["network_edges"] = f"""with {SUMMARY},
parts as (
  select 'sentence' as edge_type, doc_id from toporders
  union all select 'role', doc_id from partedges
  union all select 'sentence', doc_id from (select distinct doc_id, smy_node from sline)
  union all select 'align', doc_id from al
  union all select 'terminal', doc_id from (select distinct doc_id, smy_node from sline)
  union all select 'terminal', doc_id from (select distinct doc_id from toporders))
select edge_type, count(*) as n, count(distinct doc_id) as n_docs from parts group by all"""
ORACLES["first_visit_counts"] = f"""with {DAG},
firsts as (select doc_id, child_id, min(lpad(parent_id, 20, '0') || lpad(edge_id, 20, '0')) as f from partedges group by all),
marked as (select p.*, lpad(parent_id, 20, '0') || lpad(edge_id, 20, '0') = f as is_tree
           from partedges p join firsts using (doc_id, child_id)),
osize as (select doc_id, parent_id as o, count(*) + 1 as n from marked group by all),
sizes as (
  select doc_id, 1 as n_desc from marked
  union all select t.doc_id, coalesce(n, 1) from toporders t left join osize on osize.doc_id = t.doc_id and osize.o = t.child_id
  union all select doc_id, count(*) from (
    select doc_id, parent_id as v from dag union select doc_id, child_id from dag) group by doc_id)
select doc_id, cast(sum(n_desc) as bigint) as sum_desc, max(n_desc) as max_desc from sizes group by all"""

# --- results on the vector trees ------------------------------------------------------------

ROUNDS = 6


def _alignment_loop(start: str = ",\nlinks as (select *, cast(null as bigint) as rel_id from pairs)") -> str:
    """The loop unrolled: flow, clamp, prune for both directions, until it settles."""
    base = EMB + start + """,
sent as (select doc_id, component, label, count(*) as n from emb group by all),
st0 as (select doc_id, label, src_node, smy_node, rel_id, sim,
               case when sim <= 0.1 then 0.0 else sim end as cap from links)
"""
    for i in range(ROUNDS):
        for j, node in enumerate(("src_node", "smy_node")):
            cur, nxt = f"st{2 * i + j}", f"st{2 * i + j + 1}"
            comp = ("source", "summary")[j]
            # concept edge flow is the inflow of the node, sentence edge flow the sum over its nodes
            base += f""",
w{2 * i + j} as (select doc_id, label, sum(cap) as f from {cur} group by all),
c{2 * i + j} as (select doc_id, {node} as node_id, sum(cap) as f from {cur} group by all),
{nxt} as (select s.doc_id, s.label, s.src_node, s.smy_node, s.rel_id, s.sim,
   case when s.cap <= 0.1 then 0.0
        when w.f / (t.n + 1) < 0.1 then 0.0
        when c.f < 0.1 then 0.0 else s.cap end as cap
   from {cur} s join w{2 * i + j} w on w.doc_id = s.doc_id and w.label = s.label
   join c{2 * i + j} c on c.doc_id = s.doc_id and c.node_id = s.{node}
   join sent t on t.doc_id = s.doc_id and t.label = s.label and t.component = '{comp}')"""
    return base + f""",
al as (select doc_id, label, src_node, smy_node, rel_id, cap from st{2 * ROUNDS} where cap > 0),
inflow as (select doc_id, 'source' as component, src_node as node_id, sum(cap) as f, count(*) as n from al group by all
           union all select doc_id, 'summary', smy_node, sum(cap), count(*) from al group by all),
leaf as (select e.doc_id, e.component, e.node_id, e.label, coalesce(f, 0.0) as f, coalesce(i.n, 0) as n
         from emb e left join inflow i on i.doc_id = e.doc_id and i.component = e.component and i.node_id = e.node_id),
sentf as (select doc_id, component, label, sum(f) as f, count(*) as n from leaf group by all),
rootf as (select doc_id, component, sum(f) as f, sum(n + 1) + 1 as n from sentf group by all),
ef as (select doc_id, component, node_id as child_id, -(label + 2) as parent_id, 'role' as edge_type, f as flow from leaf
       union all select doc_id, component, -(label + 2), -1, 'sentence', f / (n + 1) from sentf
       union all select doc_id, component, -1, null, 'terminal', f / n from rootf),
con as (select r.doc_id, r.component, cast(r.n - 1 as bigint) as alignable,
               (select count(*) from leaf l where l.doc_id = r.doc_id and l.component = r.component and l.n > 0) as aligned,
               r.f / r.n as root_flow
        from rootf r),
agg as (select doc_id, case when min(aligned) = 0 then 0.0 else count(*) / sum(alignable / aligned) end as hm,
               avg(root_flow) as mf, cast(sum(alignable) as bigint) as talignable, cast(sum(aligned) as bigint) as taligned
        from con group by all)
"""


LOOP = _alignment_loop()
ORACLES["aligned_edges"] = f"with {LOOP} select doc_id, src_node, smy_node, round(cap, 6) as capacity from al"
ORACLES["aligned_flows"] = f"""with {LOOP}
select doc_id, component, cast(child_id as bigint) as child_id, edge_type, round(flow, 6) as flow from ef"""
ORACLES["alignment_flows"] = f"""with {LOOP},
fl as (select doc_id, component as name, cast(child_id as bigint) as s_id, cast(parent_id as bigint) as t_id,
              'role' as edge_type, flow, component as s_comp,
              case edge_type when 'role' then 'concept' when 'sentence' then 'sentence' else 'doc' end as s_attr,
              case edge_type when 'role' then 'sentence' when 'sentence' then 'doc' else 'control' end as t_attr from ef
       union all select doc_id, 'source', smy_node, src_node, 'align', cap, 'summary', 'concept', 'concept' from al
       union all select doc_id, 'summary', src_node, smy_node, 'align', cap, 'source', 'concept', 'concept' from al),
tot as (select doc_id, name, t_id, sum(flow) as af, count(*) as ac from fl where edge_type = 'align' group by all)
select f.doc_id, f.name, f.s_attr || ' ' || f.s_id as s_descr,
       case when f.t_attr = 'control' then 'T' else f.t_attr || ' ' || f.t_id end as t_descr,
       f.s_id, f.t_id, f.s_attr, f.t_attr, f.edge_type, round(f.flow, 6) as flow, false as reentrancy,
       round(coalesce(af, 0.0), 6) as align_flow, coalesce(ac, 0) as align_count
from fl f left join tot on tot.doc_id = f.doc_id and tot.name = f.name and tot.t_id = f.t_id"""
# lent edges and edges of spanning relations among all pairs, before the first flow
COREF_START = """,
refs as (select doc_id, label, label * 7 + node_id % 7 as rel_id, component, node_id from emb),
span as (select doc_id, rel_id from refs group by all having count(distinct component) = 2),
mixed as (select doc_id, label, src_node, smy_node, cast(null as bigint) as rel_id, sim from pairs
          union all
          select a.doc_id, a.label, b.node_id, a.smy_node, l.rel_id, a.sim
          from pairs a join refs l on l.doc_id = a.doc_id and l.node_id = a.src_node and l.component = 'source'
          join refs b on b.doc_id = l.doc_id and b.rel_id = l.rel_id and b.component = 'source' and b.node_id <> l.node_id),
new as (select s.doc_id, s.label, s.node_id as src_node, m.node_id as smy_node, max(s.rel_id) as rel_id
        from span join refs s using (doc_id, rel_id) join refs m using (doc_id, rel_id)
        where s.component = 'source' and m.component = 'summary' group by all),
firsts as (select doc_id, src_node, smy_node, min(coalesce(rel_id, -1)) as f from mixed group by all),
links as (select m.* from mixed m join firsts f using (doc_id, src_node, smy_node)
          left join new n on n.doc_id = m.doc_id and n.src_node = m.src_node and n.smy_node = m.smy_node
          where n.doc_id is null or coalesce(m.rel_id, -1) <> f.f
          union all select doc_id, label, src_node, smy_node, rel_id, 1.0 from new)
"""
ORACLES["align_with_coref"] = f"""with {_alignment_loop(COREF_START)}
select doc_id, src_node, smy_node, cast(rel_id as bigint) as rel_id, round(cap, 6) as capacity from al"""
ORACLES["aligned_without_pruning"] = f"""with {EMB}
select doc_id, src_node, smy_node, round(sim, 6) as capacity from pairs where sim > 0.1"""
ORACLES["align_one"] = f"""with {LOOP}
select doc_id, src_node, smy_node, round(cap, 6) as capacity from al where doc_id = (select min(doc_id) from emb)"""
ORACLES["corpus_report"] = f"""with {LOOP}
select doc_id, component as name, case edge_type when 'terminal' then 'role' else 'role' end as edge_type, count(*) as n,
       round(sum(flow), 5) as flow from ef group by all
union all select doc_id, 'source', 'align', count(*), round(sum(cap), 5) from al group by all
union all select doc_id, 'summary', 'align', count(*), round(sum(cap), 5) from al group by all"""
ORACLES["align_loops"] = f"with {EMB} select distinct doc_id, true as converged from emb"
ORACLES["written_results"] = f"""with {LOOP},
k as (select doc_id, count(*) as n from ef group by all), a as (select doc_id, 2 * count(*) as n from al group by all)
select doc_id, taligned as tot_aligned, talignable as tot_alignable, k.n + coalesce(a.n, 0) as n_flows
from agg join k using (doc_id) left join a using (doc_id)"""
ORACLES["root_flow"] = f"with {LOOP} select doc_id, component, round(root_flow, 6) as root_flow from con"
ORACLES["connected_stats"] = f"""with {LOOP}
select doc_id, component, alignable, aligned, round(aligned / alignable, 6) as aligned_portion from con"""
ORACLES["aggregate_stats"] = f"""with {LOOP}
select doc_id, round(hm, 6) as aligned_portion_hmean, round(mf, 6) as mean_flow, talignable as tot_alignable,
       taligned as tot_aligned, round(taligned / talignable, 6) as aligned_portion,
       cast(0 as bigint) as reentrancies, cast(0 as bigint) as bipartite_relations from agg"""
ORACLES["stats_frame"] = f"""with {LOOP}
select c.doc_id, component, round(hm, 6) as agg_aligned_portion_hmean, round(mf, 6) as agg_mean_flow,
       talignable as agg_tot_alignable, taligned as agg_tot_aligned,
       round(taligned / talignable, 6) as agg_aligned_portion, cast(0 as bigint) as agg_reentrancies,
       round(root_flow, 6) as root_flow, alignable, aligned, round(aligned / alignable, 6) as aligned_portion,
       cast(0 as bigint) as reentrancies from con c join agg using (doc_id)"""


def _score_columns() -> str:
    out = []
    for c in ("source", "summary"):
        at = f"filter (where con.component = '{c}')"
        out += [f"round(max(aligned / alignable) {at}, 6) as {c}_aligned_portion",
                f"round(max(root_flow) {at}, 6) as {c}_root_flow",
                f"cast(0 as bigint) as {c}_reentrancies", f"cast(0 as bigint) as {c}_relations",
                f"cast(1 as bigint) as {c}_node_doc_count",
                f"max(ns) {at} as {c}_node_sentence_count", f"max(nc) {at} as {c}_node_concept_count",
                f"cast(0 as bigint) as {c}_node_attribute_count", f"cast(0 as bigint) as {c}_edge_doc_count",
                f"max(ns) {at} as {c}_edge_sentence_count", f"max(nc) {at} as {c}_edge_role_count"]
    return ", ".join(out)


ORACLES["alignment_score"] = f"""with {LOOP},
sizes as (select doc_id, component, count(*) as ns, cast(sum(n) as bigint) as nc from sentf group by all)
select con.doc_id, round(max(mf), 6) as agg_mean_flow, round(max(taligned / talignable), 6) as agg_aligned_portion,
       cast(0 as bigint) as bipartite_relations, {_score_columns()}
from con join agg using (doc_id) join sizes on sizes.doc_id = con.doc_id and sizes.component = con.component
group by con.doc_id"""
ORACLES["reduce_graph"] = f"""with {LOOP},
live as (select * from ef where edge_type <> 'terminal' and flow > 0),
verts as (select doc_id, component, child_id as v from live union select doc_id, component, parent_id from live)
select doc_id, component, n_nodes, n_edges from
  (select doc_id, component, count(*) as n_nodes from verts group by all)
  join (select doc_id, component, count(*) as n_edges from live group by all) using (doc_id, component)"""
ORACLES["node_counts"] = f"""with {HIER}
select doc_id, count(*) filter (where attrib_type = 'doc') as node_doc_count,
       count(*) filter (where attrib_type = 'sentence') as node_sentence_count,
       count(*) filter (where attrib_type = 'concept') as node_concept_count,
       count(*) filter (where attrib_type = 'attribute') as node_attribute_count from hnodes group by all"""
ORACLES["edge_counts"] = f"""with {HIER}
select doc_id, count(*) filter (where edge_type = 'doc') as edge_doc_count,
       count(*) filter (where edge_type = 'sentence') as edge_sentence_count,
       count(*) filter (where edge_type = 'role') as edge_role_count from hier group by all"""
ORACLES["graph_sizes"] = f"""with {HIER}
select doc_id, n_nodes, n_edges, n_nodes + n_edges as size from (
  select doc_id, count(*) as n_nodes from hnodes group by all)
  join (select doc_id, count(*) as n_edges from hier group by all) using (doc_id)"""
ORACLES["reentrancy_stats"] = f"""with {DAG}
select doc_id, count(*) as total, cast(0 as bigint) as zero_flow, round(cast(sum(n) as double), 6) as total_flow from (
  select doc_id, child_id, count(*) as n from partedges group by all having count(*) > 1) group by all"""

# --- texts --------------------------------------------------------------------------------------

CONV = """
conv as (select conv_id as doc_id, turn, case role when 'user' then 'source' else 'summary' end as component, text
         from conversations where role in ('user', 'assistant'))
"""


def _sentences(source: str, part: str) -> str:
    """Sentence rows of a text table, as the text graph cuts them."""
    return f"""
cut as (select *, string_split(regexp_replace(text, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) as parts
        from {source}),
trimmed as (select doc_id, component, {part} as part,
              list_filter(list_transform(parts, lambda s: trim(regexp_replace(s, '[ \\t\\r]+', ' ', 'g'))),
                          lambda s: s <> '') as sents from cut),
sentences as (select doc_id, component, part, unnest(sents) as text, generate_subscripts(sents, 1) - 1 as pos from trimmed),
tokens as (select doc_id, component, part, pos, (part << 20) + pos as sent_ix,
             text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as toks from sentences)
"""


ORACLES["text_graph_counts"] = f"""with
src as (select doc_id, 'source' as component, text from documents), {_sentences('src', '0')},
words as (select doc_id, unnest(toks) as w from tokens),
wc as (select doc_id, count(*) filter (where regexp_full_match(w, '[0-9]+')) as na,
              count(*) filter (where not regexp_full_match(w, '[0-9]+')) as nc from words group by all),
sc as (select doc_id, count(*) as ns from tokens group by all)
select doc_id, cast(1 as bigint) as node_doc_count, ns as node_sentence_count, coalesce(nc, 0) as node_concept_count,
       coalesce(na, 0) as node_attribute_count, ns + coalesce(nc, 0) + coalesce(na, 0) as n_edges
from sc left join wc using (doc_id)"""
ORACLES["sentence_index"] = f"""with {CONV}, {_sentences('conv', 'turn')}
select doc_id, component, sent_ix, (sent_ix + 1) << 24 as sentence_node,
       cast(len(list_filter(toks, lambda t: not regexp_full_match(t, '[0-9]+'))) as bigint) as n_concepts,
       cast(len(list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+'))) as bigint) as n_attributes from tokens"""
ORACLES["token_spans"] = f"""with {CONV}, {_sentences('conv', 'turn')},
words as (select doc_id, component, sent_ix, unnest(toks) as w, generate_subscripts(toks, 1) - 1 as ix from tokens),
spans as (select *, cast(coalesce(sum(length(w) + 1) over (partition by doc_id, component, sent_ix order by ix
                    rows between unbounded preceding and 1 preceding), 0) as bigint) as b from words)
select doc_id, component, ((sent_ix + 1) << 24) + ix + 1 as node_id,
       '[["' || w || '",[' || b || ',' || (b + length(w)) || ']]]' as spans from spans"""
ORACLES["sentence_text"] = f"""with {CONV}, {_sentences('conv', 'turn')}
select doc_id, component, (sent_ix + 1) << 24 as node_id,
       case when length(text) <= 20 then text
            when regexp_extract(text || ' ', '^(.{{1,14}})\\s', 1) = '' then '[...]'
            else rtrim(regexp_extract(text || ' ', '^(.{{1,14}})\\s', 1)) || ' [...]' end as descr from tokens"""
SECTIONS = CONV + """,
tk as (select *, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as n,
         turn // 2 as section from conv)
"""
SECTION_COUNTS = """
select doc_id, component, {docs} as node_doc_count, count(*) as node_sentence_count, count(*) as node_concept_count,
       cast(sum(n) as bigint) as node_attribute_count, {docs} - 1 as edge_doc_count, 2 * count(*) as edge_sentence_count,
       cast(sum(n) as bigint) as edge_role_count from tk group by doc_id, component"""
ORACLES["built_graph_counts"] = f"with {SECTIONS} " + SECTION_COUNTS.format(
    docs="case when component = 'source' then 1 + 3 * count(distinct section) else 1 end")
ORACLES["collapsed_sections"] = f"with {SECTIONS} " + SECTION_COUNTS.format(
    docs="case when component = 'source' then 1 + count(distinct section) else 1 end")
ORACLES["doc_chain"] = f"""with {SECTIONS}
select doc_id, cast(0 as bigint) as position, cast(0 as bigint) as src_node, cast(0 as bigint) as smy_node,
       1e10 as capacity from tk group by doc_id having count(distinct component) = 2"""
ORACLES["path_sentences"] = f"""with {SECTIONS}
select doc_id, count(*) as n_sentences from tk where component = 'source' and section = 0 group by all"""
ORACLES["graph_corpus_roundtrip"] = f"""with {SECTIONS}
select doc_id || '_0' as doc_id, component as snt_type, cast(sum(n + 1) as bigint) as n_triples,
       count(*) as n_sentences, cast(0 as bigint) as n_failures from tk group by doc_id, component"""
ORACLES["parse_role"] = """with lab as (
  select event_id, ':' || case when event_id % 5 = 0 then 'prep-out-of' else
    regexp_replace(event_type, '[^A-Za-z-]', '-', 'g') ||
    case when event_id % 3 > 0 then cast(event_id % 7 as varchar) else '' end ||
    case when event_id % 2 = 0 then '-of' else '' end end as label from events)
select event_id, label,
  case when label = ':prep-out-of' then 'prep-out-of' else regexp_extract(label, '^:([A-Za-z-]+?)(\\d+)?(-of)?$', 1) end as role_prefix,
  case when label = ':prep-out-of' then null else
    try_cast(nullif(regexp_extract(label, '^:([A-Za-z-]+?)(\\d+)?(-of)?$', 2), '') as bigint) end as role_index,
  label <> ':prep-out-of' and label like '%-of' as role_inverted from lab"""
ORACLES["relation_match"] = """with lab as (select distinct o_orderpriority as label, cast(left(o_orderpriority, 1) as int) as ord from orders),
rel as (select * from lab where ord > 1),
best as (select o.label as role, min(r.ord) as ord from lab o join rel r on o.ord <= r.ord group by all)
select o_orderkey as edge_id, ':' || o_orderpriority as role, r.label as relation
from orders left join best on best.role = o_orderpriority left join rel r on r.ord = best.ord"""
ORACLES["roleset_match"] = """with p as (select p_partkey as node_id, lower(regexp_replace(p_type, '[ ]+', '-', 'g')) as base, p_size from part),
known as (select distinct base || '-01' as id from p where p_size > 25),
named as (select node_id, base || case when p_size % 2 = 0 then '-01' else '' end as instance from p)
select node_id, instance, id as roleset_id from named left join known on id = instance"""

ORDER_LINES = """
li as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) - 1 as i
       from (select distinct l_orderkey, l_linenumber from lineitem) where l_orderkey in (select o_orderkey from orders))
"""
ORACLES["variable_relations"] = f"""with {ORDER_LINES}
select l_orderkey as doc_id, cast((1 << 24) + 1 as bigint) as parent_id, (1 << 24) + 2 + 2 * i as child_id, ':line' || l_linenumber as role,
       'line' as role_prefix, cast(l_linenumber as int) as role_index from li"""
ORACLES["role_label_failures"] = f"""with {ORDER_LINES}
select l_orderkey as doc_id, 'role' as stage, 'role must start with a colon: ' || min('line' || l_linenumber) as message
from li where ':line' || l_linenumber > ':line3' group by all"""

# --- corpora ---------------------------------------------------------------------------------------

ORACLES["written_corpus"] = """with d as (
  select lang, string_split(text, chr(10)) as lines from documents),
c as (select lang, count(*) as n, cast(sum(len(lines)) as bigint) as n_lines,
             cast(sum(list_sum(list_transform(lines, lambda x: length(x)))) as bigint) as n_chars from d group by all)
select f as format, c.* from c, (select unnest(['txt', 'csv', 'json']) as f)"""

ORACLES["corpus_keys"] = "select distinct conv_id as doc_id from conversations"
ORACLES["doc_keys"] = """select 'PROXY_AFP_ENG_' || conv_id || '_1.' || turn as sent_id, conv_id || '_1' as doc_id,
  cast(turn as bigint) as sent_no from conversations"""
ORACLES["sentence_types"] = """select conv_id as doc_id, turn as sent_ix,
  case role when 'user' then 'b' when 'assistant' then 'a' when 'system' then 'o' end as sent_type from conversations"""
SIDES = """
sides as (select conv_id as doc_id, count(*) filter (where role = 'user') as nb,
                 count(*) filter (where role = 'assistant') as na from conversations group by all),
bad as (select doc_id, case when na = 0 then 'document has no summary' else 'document has no source' end as message
        from sides where na = 0 or nb = 0)
"""
ORACLES["split_components"] = f"""with {SIDES}
select conv_id as doc_id, case role when 'user' then 'source' else 'summary' end as what, count(*) as n
from conversations where role in ('user', 'assistant') and conv_id not in (select doc_id from bad) group by all
union all select doc_id, message, 0 from bad"""
ORACLES["result_status"] = f"""with {SIDES}
select doc_id, case when message is null then 'success' else 'failure' end as status, message
from sides left join bad using (doc_id)"""
ORACLES["drop_summary_sentences"] = """with parts as (select doc_id, string_split(text, chr(10)) as p from documents),
lines as (select doc_id, unnest(p) as text, generate_subscripts(p, 1) - 1 as ix from parts),
kept as (select doc_id, ix, text, case when ix = 0 then 'summary' else 'source' end as component from lines where trim(text) <> '')
select doc_id, component, count(*) as n, cast(sum(length(text)) as bigint) as n_chars from kept k
where component = 'summary' or not exists (
  select 1 from kept s where s.doc_id = k.doc_id and s.component = 'summary' and s.text = k.text) group by all"""
ORACLES["merge_annotations"] = """with t as (
  select conv_id || '.' || turn as sent_id, role, text, len(string_split(text, ' ')) as n1,
         len(string_split(regexp_replace(text, '  +', ' ', 'g'), ' ')) as n2 from conversations)
select sent_id,
  case when role = 'system' then 'no sentence with this id' when n1 <> n2 then 'different number of triples'
       when role = 'user' then 'body' else 'summary' end as what,
  case when role = 'system' or n1 <> n2 then 0 else length(regexp_replace(text, '[aeiou]', '-', 'g')) end as n,
  case when role = 'system' or n1 <> n2 then 0 else length(text) end as n_org from t"""
ORACLES["filter_keys"] = """with wanted as (select unnest(['src1', 'src3', 'src5', 'nowhere']) as k)
select k as doc_id, count(source) as n, case when count(source) > 0 then 'found' else 'unknown' end as status
from wanted left join documents on source = k group by k"""
ORACLES["corpus_summary"] = """select doc_id, cast(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) as bigint) as len from documents"""
ORACLES["corpus_fingerprint"] = """with h as (
  select sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source ||
                '","text":' || to_json(text) || '}') as h from documents),
s as (select count(*) as n, """ + ", ".join(
    f"sum(cast(('0x' || substr(h, {1 + 12 * i}, 12)) as hugeint)) as s{i}" for i in range(5)) + """ from h)
select sha256(concat_ws('-', n, s0, s1, s2, s3, s4)) as fingerprint, n as n_docs from s"""
ORACLES["incremental_ids"] = "select doc_id, lang from documents where doc_id not in (select doc_id from labels)"
ORACLES["content_upsert"] = """select d.doc_id, length(d.text) as n_chars,
  case when (l.quality is null and d.lang = 'en') or (l.quality = 1 and d.text is not null) then 2 else 1 end as version
from documents d left join labels l on l.doc_id = d.doc_id where coalesce(l.toxic, 0) <> 1"""
ORACLES["missing_vectors"] = f"""with {CONV}, {_sentences('conv', 'turn')},
words as (select doc_id, unnest(toks) as w from tokens),
m as (select doc_id, count(*) as n_missing from words where not regexp_matches(w, '^[a-z]') group by all)
select doc_id, 'token without a vector' as message, n_missing from m"""
ORACLES["several_corpora"] = """select lang as corpus, count(*) as n, count(*) filter (where text like '%' || chr(10) || '%') as n_body,
  cast(sum(length(string_split(text, chr(10))[1])) as bigint) as summary_chars from documents group by all"""

# --- scores -----------------------------------------------------------------------------------------

TEXT_PAIRS = """
p as (select u.conv_id || '-' || (u.turn + 1) as pair_id, regexp_extract_all(lower(u.text), '[\\p{L}\\p{N}]+') as a,
        regexp_extract_all(lower(coalesce(a.text, '')), '[\\p{L}\\p{N}]+') as b
      from conversations u left join conversations a on u.conv_id = a.conv_id and u.turn + 1 = a.turn and a.role = 'assistant'
      where u.role = 'user')
"""


def _ngrams(orders: range, pairs: str = TEXT_PAIRS) -> str:
    parts = []
    for side in ("a", "b"):
        for n in orders:
            parts.append(f"""select pair_id, '{side}' as side, {n} as n,
 unnest(case when len({side}) >= {n} then list_transform(range(1, len({side}) - {n - 1} + 1),
   lambda i: array_to_string({side}[i:i + {n - 1}], ' ')) else [] end) as gram from p""")
    return pairs + ", grams as (" + " union all ".join(parts) + """),
per as (select pair_id, n, gram, count(*) filter (where side = 'a') as ca, count(*) filter (where side = 'b') as cb
        from grams group by all),
m as (select pair_id, n, sum(least(ca, cb)) as match, sum(ca) as ta, sum(cb) as tb from per group by all)"""


def _rouge_columns(orders: range = range(1, 10)) -> str:
    out = []
    for n in orders:
        def at(c: str) -> str:
            return f"coalesce(max({c}) filter (where n = {n}), 0)"
        pr = f"(case when {at('ta')} > 0 then {at('match')} / {at('ta')} else 0.0 end)"
        re = f"(case when {at('tb')} > 0 then {at('match')} / {at('tb')} else 0.0 end)"
        out += [f"round({pr}, 6) as rouge{n}_precision", f"round({re}, 6) as rouge{n}_recall",
                f"round(case when {pr} + {re} > 0 then 2 * {pr} * {re} / ({pr} + {re}) else 0.0 end, 6) as rouge{n}_f_score"]
    return ", ".join(out)


ORACLES["rouge_n"] = f"""with {_ngrams(range(1, 10))}
select p.pair_id, {_rouge_columns()} from p left join m using (pair_id) group by p.pair_id"""


def _bleu(pairs_cte: str) -> str:
    log = " + ".join(
        f"ln(case when coalesce(max(match) filter (where n = {n}), 0) > 0 then max(match) filter (where n = {n}) / "
        f"greatest(max(ta) filter (where n = {n}), 1) else 2.2250738585072014e-308 end)" for n in range(1, 5))
    return f"""
sc as (select p.pair_id, case when coalesce(max(match) filter (where n = 1), 0) = 0 then 0.0 else
   (case when len(any_value(a)) > len(any_value(b)) then 1.0 else exp(1 - len(any_value(b)) / len(any_value(a))) end)
   * exp(({log}) / 4) end as bleu from p left join m using (pair_id) group by p.pair_id)"""


ORACLES["bleu"] = f"with {_ngrams(range(1, 5))}, {_bleu('p')} select pair_id, round(bleu, 6) as bleu from sc"

ORACLES["score_batch"] = f"""with {_ngrams(range(1, 5))}, {_bleu('p')}
select p.pair_id, {_rouge_columns(range(1, 3))},
       round(any_value(bleu), 6) as bleu from p left join m using (pair_id) left join sc using (pair_id) group by p.pair_id"""
ORACLES["rouge_l"] = f"""with recursive {TEXT_PAIRS},
dp as (
  select pair_id, a, b, 0 as i, list_transform(a, lambda x: 0) as r from p
  union all
  select pair_id, a, b, i + 1, list_transform(range(1, len(a) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda t: greatest(r[t], case when t > 1 then r[t - 1] else 0 end + case when a[t] = b[i + 1] then 1 else 0 end))))
  from dp where i < len(b)),
l as (select pair_id, cast(coalesce(r[len(a)], 0) as double) as l, len(a) as na, len(b) as nb from dp where i = len(b)),
pr as (select pair_id, case when na > 0 then l / na else 0.0 end as pr, case when nb > 0 then l / nb else 0.0 end as re from l)
select pair_id, round(pr, 6) as "rougeL_precision", round(re, 6) as "rougeL_recall",
       round(case when pr + re > 0 then 2 * pr * re / (pr + re) else 0.0 end, 6) as "rougeL_f_score" from pr"""

PURCHASES = """
lines as (select l_orderkey, l_linenumber, sum(l_quantity) as q, min(l_returnflag) as flag from lineitem group by all),
o as (select o_custkey as pair_id, case o_orderstatus when 'F' then 'a' else 'b' end as side, o_orderkey, o_orderpriority
      from orders),
ln as (select pair_id, side, l_orderkey, l_linenumber, flag || cast(floor(q / 10) as bigint) as label
       from lines join o on l_orderkey = o_orderkey),
nodes as (select distinct pair_id, side, -1 as node_id, 'customer' as label from o
          union all select pair_id, side, o_orderkey * 4096, o_orderpriority from o
          union all select pair_id, side, l_orderkey * 4096 + l_linenumber + 1, label from ln),
edges as (select pair_id, side, -1 as parent_id, o_orderkey * 4096 as child_id, ':' || o_orderpriority as role from o
          union all select pair_id, side, l_orderkey * 4096, l_orderkey * 4096 + l_linenumber + 1, ':line' || l_linenumber from ln)
"""
# every pair has a mapping: tops match tops
ORACLES["smatch_check"] = f"""with {PURCHASES}
select pair_id, true as "right" from nodes group by pair_id having count(distinct side) = 2"""
ORACLES["smatch_triples"] = f"""with {PURCHASES}
select pair_id, side, 'instance' as kind, count(*) as n from nodes group by all
union all select pair_id, side, 'relation', count(*) from edges group by all
union all select distinct pair_id, side, 'attribute', 1 from o"""
ORACLES["wlk"] = f"""with {PURCHASES},
links as (select pair_id, side, parent_id as u, child_id as v, '>' || role as via from edges
          union all select pair_id, side, child_id, parent_id, '<' || role from edges),
l0 as (select pair_id, side, node_id, md5(label) as label from nodes),
l1 as (select n.pair_id, n.side, n.node_id, md5(any_value(n.label) || '#' ||
          coalesce(string_agg(k.via || '|' || m.label, ',' order by k.via, m.label), '')) as label
       from l0 n left join links k on k.pair_id = n.pair_id and k.side = n.side and k.u = n.node_id
       left join l0 m on m.pair_id = n.pair_id and m.side = n.side and m.node_id = k.v group by n.pair_id, n.side, n.node_id),
l2 as (select n.pair_id, n.side, n.node_id, md5(any_value(n.label) || '#' ||
          coalesce(string_agg(k.via || '|' || m.label, ',' order by k.via, m.label), '')) as label
       from l1 n left join links k on k.pair_id = n.pair_id and k.side = n.side and k.u = n.node_id
       left join l1 m on m.pair_id = n.pair_id and m.side = n.side and m.node_id = k.v group by n.pair_id, n.side, n.node_id),
counts as (select 0 as r, * from l0 union all select 1, * from l1 union all select 2, * from l2),
per as (select pair_id, r, label, count(*) filter (where side = 'a') as ca, count(*) filter (where side = 'b') as cb
        from counts group by all),
d as (select pair_id, sum(ca * cb) as ab, sum(ca * ca) as aa, sum(cb * cb) as bb from per group by all)
select pair_id, round(case when aa > 0 and bb > 0 then ab / (sqrt(aa) * sqrt(bb)) else 0.0 end, 6) as wlk from d"""


ORACLES["compare_scores"] = f"""with {_ngrams(range(1, 3))},
v as (select p.pair_id, n,
        coalesce(max(case when ta > 0 then match / ta else 0.0 end), 0.0) as pr,
        coalesce(max(case when tb > 0 then match / tb else 0.0 end), 0.0) as re
      from (select pair_id, unnest([1, 2]) as n from p) p left join m using (pair_id, n) group by all),
cells as (select pair_id, 'rouge' || n || '_precision' as score, round(pr, 2) as left_value, round(re, 2) as right_value from v
          union all select pair_id, 'rouge' || n || '_recall', round(re, 2), round(pr, 2) from v)
select * from cells where left_value <> right_value"""

# Similarity of the conversations, straight from the definitions.  A token's rings
# are its sentence, its sentence's other tokens and the root, then the other
# sentences; document nodes have zero vectors.
CONV_SIM = f"""{CONV}, {_sentences('conv', 'turn')},
nvec as (select count(*) as n from embeddings),
tk as (select doc_id, component, sent_ix, unnest(toks) as w, generate_subscripts(toks, 1) as ix from tokens),
words as (select distinct w from tk),
wv as (select w, list_transform(cast(embedding as double[]), lambda x: x) as vec
       from words, nvec join embeddings on vec_id = cast(('0x' || substr(md5(w), 1, 8)) as bigint) % n),
tv as (select doc_id, component, sent_ix, ix, w, vec, case when regexp_full_match(w, '[0-9]+') then 1.0 else 0.4 end as own
       from tk join wv using (w)),
tdim as (select doc_id, component, sent_ix, unnest(vec) as x, generate_subscripts(vec, 1) as d,
           own from tv),
sdim as (select doc_id, component, sent_ix, d, sum(x) as s, sum(own * x) as o, count(*) as k from tdim group by all),
cdim as (select doc_id, component, d, sum(s / k) as m from sdim group by all),
scount as (select doc_id, component, count(*) as ns, count(*) filter (where len(toks) > 0) as nfull from tokens group by all),
sv as (select doc_id, component, sent_ix, any_value(k) as k, list(s / k order by d) as smean, list(o order by d) as osum,
              list(m order by d) as call
       from sdim join cdim using (doc_id, component, d) group by all),
-- words count with the concept weight 0.4 in a neighbourhood, numbers in full:
-- sentence + 0.1 * mean(other tokens, root) + 0.1 * mean(other sentences)
tn as (select t.doc_id, t.component, t.sent_ix, t.ix,
         case when regexp_full_match(t.w, '[0-9]+') then 'attribute' else 'concept' end as kind, t.vec, s.smean,
         list_transform(range(1, 65), lambda i: s.smean[i] + 0.1 * (s.osum[i] - t.own * t.vec[i]) / s.k
           + case when c.ns > 1 then 0.1 * (s.call[i] - s.smean[i]) / (c.ns - 1) else 0.0 end) as nv
       from tv t join sv s using (doc_id, component, sent_ix) join scount c using (doc_id, component)),
-- equal words of one side and sentence have equal vectors, so they are compared once
g as (select doc_id, component, sent_ix, kind, vec, smean, nv, count(*) as c,
        sqrt(list_dot_product(vec, vec)) as a, sqrt(list_dot_product(smean, smean)) as b, sqrt(list_dot_product(nv, nv)) as e
      from tn group by doc_id, component, sent_ix, kind, vec, smean, nv),
raw as (select x.doc_id, x.kind, x.c * y.c as c,
          greatest(list_dot_product(x.vec, y.vec) / nullif(x.a * y.a, 0), 0.0) as cv,
          greatest(list_dot_product(x.smean, y.smean) / nullif(x.b * y.b, 0), 0.0) as cs,
          greatest(list_dot_product(x.nv, y.nv) / nullif(x.e * y.e, 0), 0.0) as cn
        from g x join g y on x.doc_id = y.doc_id and x.kind = y.kind
        where x.component = 'source' and y.component = 'summary'),
sims as (select doc_id, kind as attrib_type, c,
           least(greatest(pow(cv, case kind when 'concept' then 2 else 0.8 end) + 1 / (1 + exp(0.5 - cn * cn)) - 0.5, 0.0), 1.0)
             * (cs * 0.5 + 0.5) as sim from raw
         union all
         select x.doc_id, 'sentence', 1, greatest(list_dot_product(x.smean, y.smean) / nullif(
             sqrt(list_dot_product(x.smean, x.smean)) * sqrt(list_dot_product(y.smean, y.smean)), 0), 0.0)
         from sv x join sv y on x.doc_id = y.doc_id where x.component = 'source' and y.component = 'summary')
"""
ORACLES["conversation_pairs"] = f"""with {CONV_SIM}
select doc_id, attrib_type, cast(sum(c) as bigint) as n, round(sum(c * sim), 5) as total, round(max(sim), 6) as best
from sims where sim > 0.3 group by all"""


def _conversation_loop(rounds: int = 8) -> str:
    """The alignment loop on the conversations, unrolled; token 0 is the sentence itself."""
    out = CONV_SIM + """,
kk as materialized (select doc_id, component, sent_ix, len(toks) as k from tokens),
nn as materialized (select *, sqrt(list_dot_product(vec, vec)) as a, sqrt(list_dot_product(smean, smean)) as b,
                           sqrt(list_dot_product(nv, nv)) as e from tn),
st0 as materialized (
  select * from (
    select x.doc_id, x.sent_ix as s_sent, x.ix as s_ix, y.sent_ix as m_sent, y.ix as m_ix,
       least(greatest(pow(greatest(list_dot_product(x.vec, y.vec) / nullif(x.a * y.a, 0), 0.0),
                          case x.kind when 'concept' then 2 else 0.8 end)
             + 1 / (1 + exp(0.5 - pow(greatest(list_dot_product(x.nv, y.nv) / nullif(x.e * y.e, 0), 0.0), 2))) - 0.5, 0.0), 1.0)
       * (greatest(list_dot_product(x.smean, y.smean) / nullif(x.b * y.b, 0), 0.0) * 0.5 + 0.5) as cap
    from nn x join nn y on x.doc_id = y.doc_id and x.kind = y.kind
    where x.component = 'source' and y.component = 'summary'
    union all
    select x.doc_id, x.sent_ix, 0, y.sent_ix, 0, greatest(list_dot_product(x.smean, y.smean) / nullif(
             sqrt(list_dot_product(x.smean, x.smean)) * sqrt(list_dot_product(y.smean, y.smean)), 0), 0.0)
    from sv x join sv y on x.doc_id = y.doc_id where x.component = 'source' and y.component = 'summary')
  where cap > 0.3)"""
    for i in range(2 * rounds):
        side, comp = ("s", "source") if i % 2 == 0 else ("m", "summary")
        out += f""",
st{i + 1} as materialized (
  select s.* replace (case when s.cap <= 0.1 or w.f / (k.k + 1) < 0.1 or (s.{side}_ix > 0 and c.f < 0.1) then 0.0 else s.cap end as cap)
  from st{i} s
  join (select doc_id, {side}_sent as u, sum(cap) as f from st{i} group by all) w on w.doc_id = s.doc_id and w.u = s.{side}_sent
  join (select doc_id, {side}_sent as u, {side}_ix as v, sum(cap) as f from st{i} group by all) c
    on c.doc_id = s.doc_id and c.u = s.{side}_sent and c.v = s.{side}_ix
  join kk k on k.doc_id = s.doc_id and k.sent_ix = s.{side}_sent and k.component = '{comp}')"""
    return out + f""",
al as (select * from st{2 * rounds} where cap > 0),
hit as (select doc_id, 'source' as component, s_sent as u, s_ix as v, sum(cap) as f from al group by all
        union all select doc_id, 'summary', m_sent, m_ix, sum(cap) from al group by all),
got as (select doc_id, component, count(*) as aligned, sum(f) as f from hit group by all),
size as (select doc_id, component, cast(sum(k + 1) as bigint) as alignable from kk group by all),
con as (select doc_id, component, alignable, coalesce(aligned, 0) as aligned, coalesce(f, 0.0) / (alignable + 1) as root_flow
        from size left join got using (doc_id, component)),
agg as (select doc_id, case when min(aligned) = 0 then 0.0 else count(*) / sum(alignable / aligned) end as hm,
               avg(root_flow) as mf, cast(sum(alignable) as bigint) as talignable, cast(sum(aligned) as bigint) as taligned
        from con group by all)
"""


ORACLES["align_conversations"] = f"""with {_conversation_loop()}
select c.doc_id, component, round(hm, 6) as agg_aligned_portion_hmean, round(mf, 6) as agg_mean_flow,
       talignable as agg_tot_alignable, taligned as agg_tot_aligned,
       round(taligned / talignable, 6) as agg_aligned_portion, cast(0 as bigint) as agg_reentrancies,
       round(root_flow, 6) as root_flow, alignable, aligned, round(aligned / alignable, 6) as aligned_portion,
       cast(0 as bigint) as reentrancies from con c join agg using (doc_id)"""


def _scored_columns() -> str:
    out = []
    for c in ("source", "summary"):
        at = f"filter (where con.component = '{c}')"
        zero = "cast(0 as double)"
        out += [f"round(max(aligned / alignable) {at}, 6) as {c}_aligned_portion", f"round(max(root_flow) {at}, 6) as {c}_root_flow",
                f"{zero} as {c}_reentrancies", f"{zero} as {c}_relations", f"cast(1 as double) as {c}_node_doc_count",
                f"cast(max(ns) {at} as double) as {c}_node_sentence_count", f"cast(max(nc) {at} as double) as {c}_node_concept_count",
                f"cast(max(na) {at} as double) as {c}_node_attribute_count", f"{zero} as {c}_edge_doc_count",
                f"cast(max(ns) {at} as double) as {c}_edge_sentence_count",
                f"cast(max(nc + na) {at} as double) as {c}_edge_role_count"]
    return ", ".join(out)


def _side(role: str) -> str:
    return (f"regexp_extract_all(lower(string_agg(text, ' ' order by turn) filter (where role = '{role}')), "
            "'[\\p{L}\\p{N}]+')")


SIDES_AS_PAIRS = f"""
p as (select conv_id as pair_id, {_side('user')} as a, {_side('assistant')} as b from conversations group by conv_id
      having count(*) filter (where role = 'user' and text <> '') > 0 and count(*) filter (where role = 'assistant' and text <> '') > 0)
"""
ORACLES["score_pairs"] = f"""with {_conversation_loop()},
cnt as (select doc_id, component, count(*) as ns, sum(len(list_filter(toks, lambda t: not regexp_full_match(t, '[0-9]+')))) as nc,
               sum(len(list_filter(toks, lambda t: regexp_full_match(t, '[0-9]+')))) as na from tokens group by all),
one as (select con.doc_id as pair_id, round(max(mf), 6) as agg_mean_flow,
               round(max(taligned / talignable), 6) as agg_aligned_portion, cast(0 as double) as bipartite_relations, {_scored_columns()}
        from con join agg using (doc_id) join cnt on cnt.doc_id = con.doc_id and cnt.component = con.component group by con.doc_id),
{_ngrams(range(1, 3), SIDES_AS_PAIRS)},
two as (select p.pair_id, {_rouge_columns(range(1, 3))} from p left join m using (pair_id) group by p.pair_id)
select * from one join two using (pair_id)"""
ORACLES["committed_results"] = ORACLES["written_results"]
