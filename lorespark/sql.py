"""SQL for DuckDB with the results of the engine's queries."""

_TOK = "list_transform(list_filter(regexp_split_to_array({}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2), lambda w: lower(w))"
_TF = f"tok as (select id, unnest({_TOK.format('text')}) as term from entries), tf as (select id, term, count(*) as tf from tok group by all)"
_LEN = f"dl as (select id, coalesce(len({_TOK.format('text')}), 0) as dl from entries), st as (select count(*) as n_docs, coalesce(sum(dl), 0) as total_len, coalesce(avg(dl), 0) as avgdl from dl)"


def _bm25(k: int, name: str = "bm") -> str:
    return f"""qt as (select id as qid, unnest({_TOK.format('question')}) as term from recall_queries), {_TF}, {_LEN},
df as (select term, count(*) as df from tf group by term),
sc as (select qid, tf.id, round(sum(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1)))), 6) as score
       from qt join tf using (term) join df using (term) join dl on dl.id = tf.id, st group by qid, tf.id),
{name} as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from sc) where rank <= {k})"""


def _overlap(k: int) -> str:
    return f"""qd as (select distinct id as qid, unnest({_TOK.format('question')}) as term from recall_queries),
os as (select qid, id, count(*)::double as score from qd join tf using (term) group by all),
ov as (select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from os) where rank <= {k})"""


def _rrf(base: int) -> str:
    return f"""with {_bm25(50)}, {_overlap(50)},
parts as (select qid, id, 1e0 / (60 + rank + {base} - 1) as part from bm union all select qid, id, 1e0 / (60 + rank + {base} - 1) from ov),
s as (select qid, id, round(sum(part), 9) as score from parts group by all)
select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10"""


_METRICS = f"""{_bm25(10)},
jq as (select id as qid from recall_queries where relevant_entries is not null),
qr as (select distinct id as qid, unnest(relevant_entries) as id from recall_queries),
wanted as (select qid, count(*) as wanted from qr where id is not null group by qid),
hit as (select qid, count(*) as hits, sum(1 / log2(rank + 1)) as gain from bm join qr using (qid, id) group by qid),
m as (select qid, coalesce(wanted, 0) as wanted, coalesce(hits, 0) as hits, coalesce(gain, 0) as gain from jq left join wanted using (qid) left join hit using (qid)),
mm as (select qid, round(case when wanted > 0 then hits / wanted else 0 end, 6) as recall, round(hits / 10e0, 6) as precision,
  round(case when wanted > 0 then gain / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1 / log2(i + 1))) else 0 end, 6) as ndcg from m)"""

_EDGES = "e as (select distinct * from fact_edges)"
_ENTITY = "en as (select distinct entry, lower(trim(x)) as phrase from (select entry, unnest(entities) as x from extractions) where strlen(lower(trim(x))) >= 2)"
_FEW = "few as (select en.*, df from en join (select phrase, count(*) as df from en group by phrase having count(*) <= 64) using (phrase))"
_TOPICS = f"{_EDGES}, t as (select distinct subj as entity, obj as cluster, entry from e where rel in ('talked_about', 'thinks_about', 'works_on', 'likes') and subj is not null and obj is not null), profile as (select entity, cluster, count(*) as n from t group by all)"
_TAIL = "least(1, greatest(0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({q}) + ({n} - i) * ln(1 - {q}))))))"
_BRIDGE = f"""{_TOPICS},
tot as (select cluster, sum(n) as al from profile group by cluster),
pl as (select *, row_number() over (partition by entity order by n desc, cluster) as place from profile),
b as (select entity, count(*)::bigint as spread, sum(n)::bigint as support, max(case when place = 1 then cluster end) as c1, max(case when place = 2 then cluster end) as c2, sum(case when place <= 2 then n end)::bigint as top2 from pl group by entity having count(*) >= 2),
bq as (select b.*, greatest(1e-9, least(1 - 1e-9, (x.al + y.al)::double / (select sum(al) from tot)::double)) as q from b join tot x on c1 = x.cluster join tot y on c2 = y.cluster),
bridge as (select entity, c1, c2, support, spread, round(top2 / support / (spread - 1), 6) as surprise, round({_TAIL.format(k='top2', n='support', q='q')}, 6) as p_value from bq)"""
_PLACES = f"{_EDGES}, pm as (select distinct lower(obj) as entity, entry from e where rel = 'was_at' and lower(obj) like 'the %'), pd as (select entity, entry, day from pm join entries on entry = id where day is not null)"
_LAGS = f"""{_PLACES},
ser as (select *, row_number() over (partition by entity order by day, entry) - 1 as nth from pd),
ofn as (select entity from ser group by entity having count(*) >= 5),
sr as (select * from ser where entity in (select entity from ofn)),
lg as (select unnest(range(0, 91)) as lag),
hits as (select distinct a.entity as a, b.entity as b, a.nth, lag from sr a join sr b on a.entity <> b.entity join lg on b.day between a.day + greatest(lag - 1, 0) and a.day + lag + 1),
counts as (select a, b, lag, sum(nth % 2)::bigint as selected, sum(1 - nth % 2)::bigint as held_out from hits group by all),
best as (select a, b, lag, selected, held_out from (select *, row_number() over (partition by a, b order by selected desc, lag) as rn from counts where selected > 0) where rn = 1)"""
_DERIVED = """d as (select 'o' || l_orderkey as output, 'l' || l_orderkey || '-' || l_linenumber as input from lineitem
  union all select 'c' || o_custkey, 'o' || o_orderkey from orders union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'r' || n_regionkey, 'n' || n_nationkey from nation),
ch as (select 's' || l_suppkey as change, 'l' || l_orderkey || '-' || l_linenumber as item from lineitem where l_quantity >= 50 and l_discount >= 0.1),
stale as (select change, output from ch join d on input = item union select change, d.output from stale join d on d.input = stale.output)"""
_Q = "q as (select vec_id::bigint as qid, embedding::double[] as q from embeddings where vec_id % 20 = 0)"


def _knn(v: str, q: str, k: int = 10) -> str:
    return f"select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from (select qid, id, round(list_inner_product(q, v), 6) as score from {q}, {v})) where rank <= {k}"


_SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?])([ \\t\\n\\f\\r])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)), lambda s: s <> '')"
_NORM = "regexp_replace(regexp_replace(lower(trim(subj)), '''s$', ''), '[^\\p{L}\\p{N}]+$', '')"

SQL = {
    "tokenize_tf": f"with {_TF} select * from tf",
    "doc_freq": f"with {_TF} select term, count(*) as df from tf group by term",
    "corpus_stats": f"with {_LEN} select n_docs, total_len, round(avgdl, 6) as avgdl from st",
    "bm25_topk": f"with {_bm25(10)} select * from bm",
    "overlap_topk": f"with {_TF}, {_overlap(10)} select * from ov",
    "rrf_one_based": _rrf(1),
    "rrf_zero_based": _rrf(0),
    "recall_at_k": f"with {_METRICS} select qid, recall from mm",
    "precision_at_k": f"with {_METRICS} select qid, precision from mm",
    "ndcg_at_k": f"with {_METRICS} select qid, ndcg from mm",
    "answer_in_topk": f"with {_bm25(10)}, h as (select qid, bool_or(contains(lower(text), lower(answer))) as hit from bm join entries using (id) join recall_queries r on r.id = qid where answer <> '' group by qid) select r.id as qid, coalesce(hit, false) as hit from recall_queries r left join h on qid = r.id where answer is not null and answer <> ''",
    "jaccard_match": f"with {_bm25(10)}, {_overlap(10)}, a as (select qid, list(id) as a from bm group by qid), b as (select qid, list(id) as b from ov group by qid) select qid, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard from a join b using (qid)",
    "metrics_by_type_rollup": f"with {_METRICS} select type, count(*) as n, round(avg(recall), 6) as recall, round(avg(ndcg), 6) as ndcg from (select mm.*, coalesce(lower(regexp_extract(question, '^([A-Za-z]+)', 1)), '') as type from mm join recall_queries r on r.id = qid) group by rollup (type)",
    "latency_percentiles": "with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(n) as n, min(case when i >= floor(0.5 * (n - 1) + 0.5) then value end) as p50, min(case when i >= floor(0.95 * (n - 1) + 0.5) then value end) as p95, max(value) as most from r group by event_type",
    "sentence_units": f"with p as (select event_id, {_SENTENCES} as parts from events_l0), u as (select event_id, unnest(parts) as s, generate_subscripts(parts, 1) - 1 as unit_no from p), c as (select *, sum(strlen(s)) over (partition by event_id order by unit_no) as byte_end from u) select event_id, unit_no, byte_end - strlen(s) as byte_start, byte_end from c",
    "event_dedup": "select min(event_id) as event_id, count(*) as copies from events_l0 group by created_utc_secs, source, text",
    "append_batch": "select event_id, batch_id from (select *, row_number() over (partition by created_utc_secs, source, text order by event_id) as rn from events_l0 where batch_id > 0) n where rn = 1 and not exists (select 1 from events_l0 o where o.batch_id = 0 and o.created_utc_secs is not distinct from n.created_utc_secs and o.source is not distinct from n.source and o.text is not distinct from n.text)",
    "unit_validation": "select unit_id, case when e.event_id is null then 'unknown_event' when byte_start >= 0 and byte_start < byte_end and byte_end <= coalesce(strlen(text), 0) then 'ok' else 'bad_span' end as status from units u left join events_l0 e using (event_id)",
    "unit_texts": "select unit_id, event_id, byte_end - byte_start as n_bytes from units join events_l0 using (event_id) where byte_start >= 0 and byte_start < byte_end and byte_end <= strlen(text)",
    "last_wins_log": "select entry, v, model, n_entities from (select *, row_number() over (partition by entry order by v desc, model desc, n_entities desc) as rn from (select entry, v, model, coalesce(len(entities), 0) as n_entities from extractions)) where rn = 1",
    "id_assignment": "select id, day, row_number() over (order by day, id) - 1 as new_id from entries where day is not null",
    "pooled_offsets": "select coalesce(kind, '') as instance, id as entry, row_number() over (order by coalesce(kind, ''), id) - 1 as global_id from entries",
    "dates_of_days": "select id, strftime(date '2018-01-01' + day, '%Y-%m-%d') as iso, day // 365 as year from entries",
    "gazetteer_mentions": f"with {_EDGES}, p as (select distinct lower(trim(obj)) as phrase from e where rel = 'was_at' and lower(trim(obj)) like 'the %') select id as entry, phrase from entries, p where contains(lower(text), phrase) and strlen(phrase) >= 3",
    "word_bounded_mentions": "with t as (select unnest(['coffee', 'sleep', 'chess', 'budget', 'soup']) as topic) select id, topic from entries, t where regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || topic || '($|[^\\p{L}\\p{N}])')",
    "hub_guard": f"with {_ENTITY}, {_FEW} select * from few",
    "comention_one_hop": f"""with {_bm25(10)}, {_ENTITY}, {_FEW}, asked as (select distinct qid, term as phrase from qt),
br as (select qid, phrase, entry as seed, 0.5e0 * (ln((select count(*) from entries)::double / greatest(df, 1)) + 1) * score as part from bm join few on entry = bm.id where not exists (select 1 from asked a where a.qid = bm.qid and a.phrase = few.phrase))
select qid, few.entry as id, round(sum(part), 6) as score from br join few using (phrase) where few.entry <> seed group by all""",
    "intro_rec_person_join": f"with {_EDGES}, i as (select distinct subj as asked, obj as other, entry as intro_entry from e where rel = 'introduced'), r as (select distinct subj as other, entry as advice_entry from e where rel = 'recommended') select asked, other, intro_entry, advice_entry, 3e0 as score from i join r using (other) where asked <> other and intro_entry <> advice_entry",
    "venue_interval_join": f"""with {_EDGES}, pv as (select distinct entry, lower(obj) as venue, day from e join entries on entry = id where rel = 'was_at' and obj is not null and day is not null),
f as (select * from pv where entry in (select entry from e where rel = 'introduced')), l as (select * from pv where entry in (select entry from e where rel = 'recommended'))
select f.venue, f.entry as intro_entry, l.entry as advice_entry, round(3e0 / (1 + (l.day - f.day) / 30e0), 6) as score from f join l on f.venue = l.venue and l.day between f.day and f.day + 90 and f.entry <> l.entry""",
    "triple_two_hop": f"""with {_EDGES}, c as (select lower(trim(subj)) as a, lower(trim(obj)) as b, entry from e where trim(subj) <> '' and trim(obj) <> '' and lower(trim(subj)) <> lower(trim(obj))),
ends as (select a as name, b as other, entry from c union select b, a, entry from c),
asr as (select distinct name as bridge, entry from ends), df as (select bridge, count(*) as df from asr group by bridge having count(*) <= 64),
anc as (select distinct lower(trim(subj)) as name from e where rel = 'introduced'),
br as (select distinct name, other as bridge from ends where name in (select name from anc))
select name, entry, round(sum(0.5e0 * (ln((select count(*) from entries)::double / greatest(df, 1)) + 1)), 6) as score
from br join df using (bridge) join asr using (bridge) where not exists (select 1 from ends x where x.name = br.name and x.entry = asr.entry) group by all""",
    "prefix_canon": f"""with f as (select distinct {_NORM} as name from fact_edges where subj is not null), g as (select * from f where strlen(name) >= 3)
select g.name, coalesce((select w.name from g w where starts_with(w.name, g.name) and strlen(w.name) >= strlen(g.name) + 2 order by strlen(w.name) desc, w.name limit 1), g.name) as canonical from g""",
    "context_budget": f"with {_bm25(10)}, s as (select qid, bm.id, rank, (length(coalesce(date, '')) // 4 + 2 + length(coalesce(text, '')) // 4 + 2) as est from bm join entries using (id)) select * from (select *, sum(est) over (partition by qid order by rank) as total from s) where total <= 120",
    "entity_cluster_profile": f"with {_TOPICS} select * from profile",
    "structural_bridge": f"with {_BRIDGE} select * from bridge",
    "naive_comention": f"with {_TOPICS} select entity, count(*) as spread from profile group by entity having count(*) >= 2",
    "binomial_tails": f"with {_TOPICS}, s as (select *, sum(n) over (partition by entity)::bigint as total from profile) select entity, cluster, round({_TAIL.format(k='n', n='total', q='0.1e0')}, 5) as tail from s",
    "bh_fdr": f"with {_BRIDGE}, r as (select entity as id, p_value, row_number() over (order by p_value) as i, count(*) over () as m from bridge) select id, p_value, coalesce(p_value <= (select max(p_value) from r where p_value <= i / m * 0.2e0), false) as accepted from r",
    "bh_fdr_per_kind": f"with {_BRIDGE}, r as (select entity as id, p_value, spread > 2 as kind, row_number() over (partition by spread > 2 order by p_value) as i, count(*) over (partition by spread > 2) as m from bridge), c as (select kind, max(p_value) as cut from r where p_value <= i / m * 0.2e0 group by kind) select id, p_value, r.kind, coalesce(p_value <= cut, false) as accepted from r left join c using (kind)",
    "lag_alignment": f"with {_LAGS} select * from counts",
    "best_lag": f"with {_LAGS} select * from best",
    "circular_shift_p": f"""with {_LAGS}, sz as (select entity, count(*) as n from ser group by entity), per as (select max(day) + 1 as p from pd),
good as (select best.*, x.n as na, y.n as nb from best join sz x on a = x.entity join sz y on b = y.entity where selected + held_out >= 4 and selected + held_out >= x.n * 0.35e0 and held_out >= 2),
sm as (select distinct entity as b, (day + o + p) % p as spot from ser, per, (select unnest([-1, 0, 1]) as o)),
sh as (select a, b, held_out, (spot - day + p) % p as shift, count(*) as c from good join (select entity as a, day from ser where nth % 2 = 0) using (a) join sm using (b), per group by all),
pv as (select a, b, round(sum((c >= held_out)::int)::double / (select p from per), 6) as p_value from sh group by a, b)
select a, b, lag, selected + held_out as support, round((selected + held_out) / sqrt(na * nb), 6) as effect, p_value from good join pv using (a, b)""",
    "circular_shift_loose": f"""with {_LAGS}, sz as (select entity, count(*) as n from ser group by entity), per as (select max(day) + 1 as p from pd),
good as (select best.*, x.n as na, y.n as nb from best join sz x on a = x.entity join sz y on b = y.entity where selected + held_out >= 4 and selected + held_out >= x.n * 0.05e0 and held_out >= 2),
sm as (select distinct entity as b, (day + o + p) % p as spot from ser, per, (select unnest([-1, 0, 1]) as o)),
sh as (select a, b, held_out, (spot - day + p) % p as shift, count(*) as c from good join (select entity as a, day from ser where nth % 2 = 0) using (a) join sm using (b), per group by all),
pv as (select a, b, round(sum((c >= held_out)::int)::double / (select p from per), 6) as p_value from sh group by a, b)
select a, b, lag, selected + held_out as support, round((selected + held_out) / sqrt(na * nb), 6) as effect, p_value from good join pv using (a, b)""",
    "lead_evidence": f"""with {_LAGS} select a, b, entry_a, entry_b from (select best.a, best.b, x.entry as entry_a, y.entry as entry_b, row_number() over (partition by best.a, best.b, x.entry order by y.day, y.entry) as rn
from best join ser x on x.entity = a join ser y on y.entity = b and y.day between x.day + greatest(lag - 1, 0) and x.day + lag + 1) where rn = 1""",
    "contradiction_reversal": f"""with {_EDGES}, s as (select distinct obj as entity, entry, day, rel in ('works_with', 'joins', 'congratulated') as good from e join entries on entry = id where obj is not null and day is not null and rel in ('works_with', 'joins', 'congratulated', 'avoids', 'disagrees_with', 'complains_to'))
select entity, min(case when good then day end) as praised, max(case when not good then day end) as regretted, count(distinct entry) as n_evidence from s group by entity having max(case when not good then day end) > min(case when good then day end)""",
    "citation_check": f"with {_bm25(10)} select qid as id, bm.id as cited from bm join recall_queries r on r.id = qid where rank = 1 and list_contains(relevant_entries, bm.id)",
    "stale_closure": f"with recursive {_DERIVED} select * from stale",
    "staleness_score": f"with recursive {_DERIVED}, dr as (select distinct change, output from ch join d on input = item), n as (select change, count(*) as truth, count(dr.output) as hit from stale left join dr using (change, output) group by change) select change, round(hit / truth, 6) as recall, 0e0 as over from n",
    "fan_out": f"with recursive {_DERIVED} select round(avg(n), 6) as mean, max(n) as most from (select change, count(*) as n from stale group by change)",
    "scheduler_order": "select o_orderkey as job_id, o_orderstatus as queue, row_number() over (partition by o_orderstatus order by cast(substring(o_orderpriority, 1, 1) as int) desc, o_orderkey) as position from orders",
    "exact_knn": f"with {_Q}, v as (select vec_id as id, embedding::double[] as v from embeddings) {_knn('v', 'q')}",
    "matryoshka_knn": f"with s as (select vec_id as id, embedding[1:32]::double[] as x from embeddings), v as (select id, list_transform(x, lambda y: (y / sqrt(list_inner_product(x, x)))::float::double) as v, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) as w from s), q as (select id::bigint as qid, w as q from v where id % 20 = 0) {_knn('v', 'q')}",
    "int8_knn": f"with {_Q}, x as (select vec_id, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as pos from embeddings), r as (select pos, min(x) as lo, case when max(x) > min(x) then (max(x) - min(x)) / 255 else 1 end as step from x group by pos), v as (select vec_id as id, list((lo + floor((x - lo) / step + 0.5e0) * step)::float::double order by pos) as v from x join r using (pos) group by vec_id) {_knn('v', 'q')}",
    "mean_pool": "select label, pos, round(avg(x), 6) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all",
    "coarse_to_fine": f"with {_Q}, m as (select label, list(x order by pos) as mean from (select label, pos, round(avg(x), 9) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by all) group by label), c as (select qid, q, label from (select qid, q, label, row_number() over (partition by qid order by round(list_inner_product(q, list_transform(mean, lambda y: y::float::double)), 6) desc, label) as rn from q, m) where rn <= 3), s as (select qid, vec_id as id, round(list_inner_product(q, embedding::double[]), 6) as score from c join embeddings using (label)) select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10",
    "scheduler_simulation": "select * from (values (0, 'ran', 'a', 10, 40), (1, 'ran', 'a', 10, 30), (2, 'blocked', null, 0, 30), (3, 'blocked', null, 0, 30), (4, 'ran', 'a', 10, 20), (5, 'ran', 'b', 10, 10), (6, 'ran', 'b', 10, 0), (7, 'drained', null, 0, 0), (8, 'drained', null, 0, 0)) t(tick, action, job_id, work_done, pending)",
}
