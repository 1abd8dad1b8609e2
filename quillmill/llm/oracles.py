"""SQL equivalents, for DuckDB, of the queries that SQL can express.

Texts compare after NFKC, which DuckDB doesn't have, so what depends on words has none; it is tested by brute force.
"""

from __future__ import annotations

#: Ids trimmed of white space and lower-cased, each record with each of its keys.
_KEYS = r"""t as (select distinct instance_id as id, gold_skill_ids, source_instance_ids from synthetic_task where instance_id is not null),
    s as (select distinct id, lower(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as x from (select id, unnest(gold_skill_ids) as x from t) where x is not null),
    o as (select distinct id, lower(regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as x from (select id, unnest(source_instance_ids) as x from t) where x is not null),
    k as (select id, 'skill ' || x as key from s where x <> '' union select id, 'source ' || x from o where regexp_full_match(x, 'task_[0-9a-f]{20}'))"""

#: Components of the graph of skills: two are linked if a record, or records of one source, name both.
ORACLES: dict[str, str] = {
    "p1_found": f"""with recursive {_KEYS},
    first as (select id, min(key) as least from k group by id),
    edge as (select distinct f.least as a, k.key as b from k join first f using (id) where f.least <> k.key),
    both_ways as (select a, b from edge union select b, a from edge),
    nodes as (select distinct key from k),
    reach(key, root) as (select key, key from nodes union select e.b, r.root from reach r join both_ways e on e.a = r.key where r.root < e.b),
    label as (select key, min(root) as root from reach group by key),
    rooted as (select f.id, l.root from first f join label l on l.key = f.least),
    named as (select r.root, coalesce(min(case when k.key like 'skill %' then substr(k.key, 7) end), min(r.id)) as group_id from rooted r join k using (id) group by r.root)
    select id as instance_id, group_id from rooted join named using (root)
    union all select distinct id, id from t where id not in (select id from k)""",
}
