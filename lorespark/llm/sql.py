"""SQL with the same results, for the queries that SQL can express."""

WORDS = "list_transform(list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda w: strlen(w) >= 2), lambda w: lower(w))"
_WORD_ROWS = f"select id as entry_id, unnest({WORDS.format('text')}) as word from entries where id is not null"
_SCORED = f"""
counts as (select entry_id, word, count(*) as n from ({_WORD_ROWS}) group by all),
cols as (select word, sum(n) as c, count(*) as n_entries from counts group by word),
lines as (select entry_id, sum(n) as r from counts group by entry_id),
whole as (select sum(n)::double as total from counts),
expect as (select entry_id, word, n, n_entries, r * c / total as e, r / total as pr, c / total as pc
           from counts join cols using (word) join lines using (entry_id), whole),
scored as (select entry_id, word, n, n_entries,
                  round(case when e * (1 - pr) * (1 - pc) > 0 then (n - e) / sqrt(e * (1 - pr) * (1 - pc)) else 0 end, 6) as score
           from expect)"""
_ASKED = f"asked as (select distinct id as query_id, unnest({WORDS.format('question')}) as word from recall_queries where id is not null)"

P5_ITEMS = """
select 'event' as item_kind, event_id as item_id from events_l0 where strlen(text) > 2000
union all
select 'unit', unit_id from units join events_l0 using (event_id)
where byte_start >= 0 and byte_end <= strlen(text) and byte_end - byte_start > 2000"""

P6_TEXT = f"""
with rows as (select row_number() over () as rec, {WORDS.format('text')} as words from entries where text is not null),
total as (select count(*) as records from rows),
terms as (select rec, unnest(words) as term from rows)
select @columns from (
  select term, count(*) as occurrences, count(distinct rec) as records,
         case when count(distinct rec) <= 2 then 'rare' when count(distinct rec) > (select records from total) * 0.1 then 'common' end as mark
  from terms group by term)"""
P6_ENTITIES = """
with total as (select count(distinct entry) as records from extractions),
terms as (select entry, unnest(entities) as term from extractions where entry is not null)
select @columns from (
  select term, count(*) as occurrences, count(distinct entry) as records,
         case when count(distinct entry) <= 2 then 'rare' when count(distinct entry) > (select records from total) * 0.1 then 'common' end as mark
  from terms where term != '' group by term)"""

VALID = """valid as (select vec_id, v::double[] as v from vectors
where dim = 64 and len(v) = 64 and len(list_filter(v, lambda x: x is not null and isfinite(x))) = 64
  and len(list_filter(v, lambda x: x != 0)) > 0)"""
_NEAR = f"""{VALID},
pairs as (select a.vec_id, b.vec_id as near_id, round(list_cosine_similarity(a.v, b.v), 6) as cosine from valid a join valid b on a.vec_id <> b.vec_id),
near as (select *, row_number() over (partition by vec_id order by cosine desc, near_id) as rank from pairs qualify rank <= 5)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""with recursive {VALID},
links as materialized (select a.vec_id as a, b.vec_id as b from valid a join valid b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.8),
reach as (select distinct a as first_vec_id, a as vec_id from links where a not in (select a from links where b < a)
          union select first_vec_id, b from reach join links on a = vec_id)
select min(first_vec_id) as first_vec_id, vec_id from reach group by vec_id having min(first_vec_id) < vec_id""",
        "p4_found": f"with {_NEAR} select distinct least(vec_id, near_id) as vec_id_a, greatest(vec_id, near_id) as vec_id_b from near where cosine >= 0.8",
        "p5_found": P5_ITEMS,
        "p6_found": "select * from (" + P6_TEXT.replace("@columns", "'text' as field, term, mark") + ") where mark is not null union all select * from (" + P6_ENTITIES.replace("@columns", "'entities' as field, term, mark") + ") where mark is not null",
        "p6_entities": P6_ENTITIES.replace("@columns", "term, occurrences, records, mark"),
        "p7_scores": f"with {_SCORED} select * from scored",
        "p7_found": f"""with {_SCORED}, {_ASKED},
telling as (select entry_id, word from scored where n_entries <= 5),
need as (select query_id, count(*) as need from asked where word in (select word from telling) group by query_id)
select query_id, entry_id from asked join telling using (word) join need using (query_id)
group by query_id, entry_id, need having count(*) = need""",
        "p7_search": f"""with {_SCORED}, {_ASKED},
total as (select query_id, entry_id, sum(round(score * 1000000)::bigint)::bigint / 1e6 as score from asked join scored using (word) where score > 0 group by all)
select query_id, entry_id, score, rank from (
  select *, row_number() over (partition by query_id order by score desc, entry_id) as rank from total) where rank <= 10""",
    }
