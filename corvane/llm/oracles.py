"""DuckDB SQL of the queries that SQL can express."""

SQL: dict[str, str] = {
    "op4_topk": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select q.vec_id query_id, c.vec_id vec_id, cast(list_inner_product(q.e, c.e) as bigint) score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
    r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank, vec_id, score from s) select * from r where rank <= 20""",
    "op8_mixing": r"""with sized as (select doc_id k, source s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size from documents),
    d as (select *, ('0x' || substr(md5('17:' || coalesce(k::varchar, '') || ':' || size), 1, 15))::bigint h from sized),
    n as (select greatest(64, (count(*) + 199999) // 200000)::bigint shards, coalesce(sum(size), 0)::bigint total from d),
    p as (select s, sum(size)::bigint source_size from d group by s),
    g as (select *, [1, 2, 3][(rank - 1) % 3 + 1]::bigint w, source_size * 3 stop from (select *, row_number() over (order by s nulls last) rank from p)),
    l as (select *, (sum(source_size) over () - coalesce(sum(stop) over (order by stop / w, rank rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by stop / w, rank rows between current row and unbounded following) lev from g),
    t as (select s, rank, source_size, least(stop::double, w * coalesce((select lev from l where lev * w <= stop order by stop / w, rank limit 1), 'infinity'::double)) target from l),
    e as (select *, unnest(range(3 * source_size + 1)) seat from t where target > 0),
    b as (select s, least(count(*), any_value(3 * source_size)) blocks from (select *, row_number() over (order by target / (2 * seat + 1) desc, rank, seat) place from e) where place <= (select total from n) group by s),
    z as (select s, h % (select shards from n) shard, sum(size)::bigint z from d group by all),
    c as (select s, shard, z, blocks, unnest(range(3 * z + 1)) seat from z join b using (s) where z > 0 union all select z.s, shard, z, blocks, unnest(range(3 * z + 1)) seat from z join b on z.s is null and b.s is null where z > 0),
    q as (select s, shard, count(*) words from (select *, row_number() over (partition by s order by z / (2 * seat + 1) desc, shard, seat) place from c) where place <= blocks group by s, shard),
    f as (select z.s, z.shard, z, coalesce(words, 0) words from z left join q on z.s is not distinct from q.s and z.shard = q.shard),
    u as (select *, h % (select shards from n) shard, sum(size) over (partition by s, h % (select shards from n) order by h, k, size rows unbounded preceding) upto from d)
    select u.k doc_id, size, source_size, target, (case when z > 0 then words // z else 0 end * size + greatest(0, least(size, words - case when z > 0 then words // z else 0 end * z - (upto - size))))::bigint taken
    from u join f on u.s is not distinct from f.s and u.shard = f.shard join t on u.s is not distinct from t.s""",
    "op9_sharding": """with h as (select doc_id, coalesce(strlen(text), 0)::bigint bytes, ('0x' || substr(md5(coalesce('v' || doc_id, 'n') || chr(31) || coalesce('v' || text, 'n')), 1, 15))::bigint h from documents),
    x as (select *, unnest(range(61)) depth from h),
    p as (select depth, h >> (60 - depth) bucket, sum(bytes) total from x group by all),
    leaf as (select a.depth, a.bucket from p a left join p b on b.depth = a.depth - 1 and b.bucket = a.bucket >> 1 where (a.total <= 1048576 or a.depth = 60) and (a.depth = 0 or b.total > 1048576))
    select doc_id, bytes, x.depth::int depth, leaf.bucket, 0::bigint page, '0b' || case when x.depth = 0 then '' else right(lpad(bin(leaf.bucket), 64, '0'), x.depth) end shard from x join leaf on x.depth = leaf.depth and x.h >> (60 - x.depth) = leaf.bucket""",
}
