"""Vector oracles (D1-D13) as DuckDB SQL: the same hashed bag-of-words
embedding (md5 buckets) and cosine arithmetic, written independently."""

from __future__ import annotations

from churnlens.operators.vectors import DEFAULT_DIM, MODEL_NAME, TOKEN_SPLIT

CHUNKS = """
chunks AS (
 select 'feedback' as record_type, feedback_id as record_id, customer_id, created_at, feedback_text as text,
  cast(rating as varchar) as meta_rating, feedback_source as meta_source
 from fact_feedback where feedback_text is not null and trim(feedback_text) <> ''
 union all
 select 'ticket', ticket_id, customer_id, created_at, concat_ws(' | ', subject, message), null, null
 from fact_ticket where subject is not null and trim(subject) <> ''),
hashed AS (select *, sha256(concat_ws('|', record_type, record_id, text)) as source_hash from chunks)"""


def embedding_expr(text: str, dim: int = DEFAULT_DIM) -> str:
    b = (f"list_transform(list_filter(string_split_regex(lower({text}), '{TOKEN_SPLIT}'), lambda t: t <> ''), "
         f"lambda t: cast(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} as integer))")
    counts = f"list_transform(list_distinct({b}), lambda k: {{'k': k, 'c': len(list_filter({b}, lambda x: x = k))::double}})"
    return (f"CASE WHEN len({b}) > 0 THEN map_from_entries(list_transform({counts}, lambda e: (e.k, e.c / "
            f"sqrt(list_sum(list_transform({counts}, lambda z: z.c * z.c)))))) END")


def vectors_sql(dim: int = DEFAULT_DIM) -> str:
    """Bucket weights of each hashed text, counted by grouping its tokens."""
    return f"""
tok AS (select source_hash, k, count(*)::double as c from (
  select source_hash, cast(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} as integer) as k from (
   select source_hash, unnest(string_split_regex(lower(text), '{TOKEN_SPLIT}')) as t
   from (select distinct source_hash, text from hashed)) a where t <> '') b group by source_hash, k),
wt AS (select source_hash, k, c / sqrt(sum(c * c) over (partition by source_hash)) as w from tok),
vec AS (select source_hash, map_from_entries(list((k, w))) as embedding from wt group by source_hash),
embedded AS (select hashed.*, vec.embedding from hashed left join vec using (source_hash))"""


def store_sql() -> str:
    """Run 1 embeds chunks created before the midpoint; run 2 the delta by
    hash; run 3 force re-embeds the feedback chunks."""
    return CHUNKS + "," + vectors_sql() + f""",
cut AS (select min(created_at) + (max(created_at) - min(created_at)) / 2 as cutoff from hashed),
run1 AS (select *, timestamp '2024-03-01 00:00:00' as embedded_at from embedded where created_at < (select cutoff from cut)),
run2 AS (select *, timestamp '2024-03-02 00:00:00' as embedded_at from embedded
  where source_hash not in (select source_hash from run1 where embedding is not null)),
run3 AS (select *, timestamp '2024-03-03 00:00:00' as embedded_at from embedded where record_type = 'feedback'),
store AS (select *, '{MODEL_NAME}' as model, {DEFAULT_DIM} as dimension from (
  select * from run1 union all select * from run2 union all select * from run3) where embedding is not null)"""


def retrieval_sql(query: str, k: int, filters: str = "") -> str:
    qe = embedding_expr(f"'{query}'")
    where = f"where {filters}" if filters else ""
    return store_sql() + f""",
q AS (select {qe} as qv),
latest AS (select * from (select *, row_number() over (partition by record_type, record_id order by embedded_at desc, source_hash desc) as rn from store) where rn = 1),
scored AS (select record_type, record_id, customer_id, created_at, text,
  list_sum(list_transform(map_entries((select qv from q)), lambda e: e.value * coalesce(embedding[e.key], 0.0))) as score
  from latest {where}),
top AS (select * from scored order by score desc nulls last, record_type, record_id limit {k})"""


def dense_sql() -> str:
    return """
ev AS (select vec_id, label, cast(embedding as double[]) as v from embeddings),
cent AS (select label, list(x order by pos) as c from (
  select label, pos, avg(x) as x from (select label, unnest(v) as x, unnest(range(1, len(v) + 1)) as pos from ev) u
  group by label, pos) a group by label),
gcent AS (select list(x order by pos) as c from (
  select pos, avg(x) as x from (select unnest(v) as x, unnest(range(1, len(v) + 1)) as pos from ev) u group by pos) a)"""


def cosine(a: str, b: str) -> str:
    return (f"CASE WHEN sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) <> 0 THEN "
            f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END")
