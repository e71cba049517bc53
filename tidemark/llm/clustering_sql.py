"""Operator 11 in DuckDB's SQL: every vector against every centroid, four times."""

from __future__ import annotations


def sql(k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, seed: int = 1) -> str:
    steps = [
        f"""
with r as (select row_number() over () as r, vec_id, [cast(x as double) for x in embedding] as x from embeddings where embedding is not null and len(embedding) = {dims}),
v as materialized (
  select r, vec_id, [cast(floor({scale} * y) as bigint) for y in x] as v from r
  where len(list_filter(x, lambda y: y is not null and isfinite(y))) = {dims}
),
c0 as materialized (
  select cast(row_number() over (order by h, v) - 1 as int) as j, v as c
  from (select v, sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')) as h from v order by h, v limit {k})
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (
  select r, vec_id, v, min_by(j, (d, j)) as j, min(d) as d
  from (select r, vec_id, v, j, cast(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(v, c)]) as bigint) as d from v, c{i}) group by r, vec_id, v
)"""
        )
        if i < rounds:
            steps.append(
                f"""m{i} as (
  select j, i, cast(sum(x) as hugeint) as s, count(*) as n from (select j, unnest(v) as x, generate_subscripts(v, 1) as i from a{i}) group by j, i
),
c{i + 1} as materialized (
  select j, coalesce(l, c) as c from c{i}
  left join (select j, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as l from m{i} group by j) using (j)
)"""
            )
    last = rounds
    return (
        ",\n".join(steps)
        + f"""
select vec_id, j as cluster, d as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from a{last} join c{last} using (j)
"""
    )
