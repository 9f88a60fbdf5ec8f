"""Further queries, one for each operator, and SQL for DuckDB with the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark import queries as core
from lorespark.functions import text as tx
from lorespark.functions.vector import popcount_and
from lorespark.operators import graph, insight, ledger, lexical, metrics, relations, search, store
from lorespark.operators.vector_index import ListIndex
from lorespark.session import materialise, scratch_path, table
from lorespark.sources import readers
from lorespark.sql import _BRIDGE, _EDGES, _ENTITY, _TOK, _TOPICS, _bm25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = 10
CUES = ["introduc", "recommend", "told me"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Search along relations and facts

_ASKED = "asked as (select min(entry) as qid, lower(trim(subj)) as person from e where rel = 'introduced' and trim(subj) <> '' group by 2)"
_WALK = f"""{_EDGES}, ven as (select entry, min(lower(trim(obj))) as venue from e where rel = 'was_at' and obj is not null group by entry),
ip as (select distinct entry, lower(trim(unnest([subj, obj]))) as p from e where rel = 'introduced'),
intros as (select ip.entry, p, venue, day from ip join ven using (entry) join entries on entries.id = ip.entry where p <> ''),
ab as (select distinct e.entry, lower(trim(subj)) as p from e where rel = 'recommended' and subj is not null),
advice as (select distinct a.entry, venue, day from ab a left join ven using (entry) join entries on entries.id = a.entry),
{_ASKED},
met as (select qid, person, i.entry, venue, day from asked join intros i on p = person),
parts as (select qid, ab.entry as id, 2e0 as part from asked join ab on p = person join advice using (entry)
  union all select qid, entry, 3e0 from met
  union all select qid, ab.entry, 3e0 from met join intros o on o.entry = met.entry join ab on ab.p = o.p join advice v on v.entry = ab.entry
    where ab.entry <> met.entry and not exists (select 1 from asked a where a.qid = met.qid and a.person = o.p)
  union all select qid, a.entry, 3e0 / (1 + (a.day - met.day) / 30e0) from met join advice a on a.venue = met.venue and a.day between met.day and met.day + 90 and a.entry <> met.entry),
walk as (select qid, id, sum(round(part * 1e9)::bigint)::bigint / 1e9 as score from parts group by all)"""


def _people(spark, sf):
    rows = core._edges(spark, sf).filter("rel = 'introduced' and trim(subj) != ''")
    return rows.groupBy(F.lower(F.trim("subj")).alias("person")).agg(F.min("entry").alias("qid"))


def _relation_walk(spark, sf):
    edges = materialise(core._edges(spark, sf))
    intros, advice = relations.typed_facts(edges, core._entries(spark, sf))
    return relations.relation_scores(_people(spark, sf), materialise(intros), materialise(advice))


@query(f"with {_WALK} select * from walk")
def relation_walk(spark, sf):
    """What each person who introduced somebody leads to, along introductions and advice."""
    return _relation_walk(spark, sf)


_PERSON_BM = _bm25(50).replace("select id as qid, unnest(" + _TOK.format("question") + ") as term from recall_queries", "select qid, unnest(" + _TOK.format("person") + ") as term from asked")
_FUSE = "parts2 as (select qid, id, 1e0 / (60 + rank - 1) as part from wr union all select qid, id, 1e0 / (60 + rank - 1) from bm), s as (select qid, id, round(sum(part), 9) as score from parts2 group by all) select * from (select *, row_number() over (partition by qid order by score desc, id) as rank from s) where rank <= 10"


@query(f"with {_WALK}, wr as (select *, row_number() over (partition by qid order by score desc, id) as rank from walk), {_PERSON_BM}, {_FUSE}")
def relation_topk(spark, sf):
    """The same fused with the ranking by words; the question is the person's name, so it is relational."""
    asked = _people(spark, sf)
    words = lexical.Bm25.index(core._entries(spark, sf)).search(asked, 50, "qid", "person")
    return relations.fused(_relation_walk(spark, sf), words, K)


@query(f"select id, {' or '.join(f'contains(lower(question), {c!r})' for c in CUES)} as relational from recall_queries")
def relational_gate(spark, sf):
    return core._asked(spark, sf).select("id", relations.relational(F.col("question"), CUES).alias("relational"))


_ANCHOR = f"""{_ENTITY}, voc as (select phrase, count(*) as df from en group by phrase having count(*) <= greatest((select count(*) from entries) // 4, 1)),
anc as (select r.id as qid, phrase, df from recall_queries r, voc where strlen(phrase) >= 3 and contains(lower(question), phrase)),
seed as (select qid, entry as id, sum(round((ln((select count(*) from entries)::double / df) + 1) * 1e9)::bigint)::bigint / 1e9 as score from anc join en using (phrase) group by all)"""


def _anchored(spark, sf):
    edges, n = materialise(core._entity_edges(spark, sf)), core._entries(spark, sf).count()
    asked = graph.mentions(core._asked(spark, sf).select("id", F.col("question").alias("text")), edges).withColumnRenamed("entry", "qid")
    return relations.anchors(asked, edges, n), edges, n


@query(f"with {_ANCHOR} select * from anc")
def anchor_guard(spark, sf):
    """Phrases of questions that don't stand in more than a quarter of all entries."""
    return _anchored(spark, sf)[0]


_COWALK = f"""{_ANCHOR}, few as (select en.*, df from en join (select phrase, count(*) as df from en group by phrase having count(*) <= 64) using (phrase)),
hop as (select qid, b.entry as id, round(sum(0.5e0 * (ln((select count(*) from entries)::double / a.df) + 1) * score), 6) as score
  from seed join few a on a.entry = seed.id join few b on b.phrase = a.phrase and b.entry <> a.entry
  where not exists (select 1 from anc where anc.qid = seed.qid and anc.phrase = a.phrase) group by all),
walk as (select qid, id, sum(round(score * 1e9)::bigint)::bigint / 1e9 as score from (select * from seed union all select * from hop) group by all),
wr as (select *, row_number() over (partition by qid order by score desc, id) as rank from walk)"""


@query(f"with {_COWALK} select * from wr where rank <= 10")
def entity_graph_only(spark, sf):
    """Entries that share mentions with the question, one step on; without words."""
    return lexical.ranked(relations.entity_walk(*_anchored(spark, sf)), K)


@query(f"with {_COWALK}, {_bm25(50)}, {_FUSE}")
def entity_graph_topk(spark, sf):
    words = lexical.Bm25.index(core._entries(spark, sf)).search(core._asked(spark, sf), 50)
    return relations.fused(relations.entity_walk(*_anchored(spark, sf)), words, K)


_FACTWALK = f"""{_ANCHOR}, {_EDGES}, c as (select lower(trim(subj)) as a, lower(trim(obj)) as b, entry from e where trim(subj) <> '' and trim(obj) <> '' and lower(trim(subj)) <> lower(trim(obj))),
ends as (select a as name, b as other, entry from c union select b, a, entry from c), asr as (select distinct name as bridge, entry from ends),
fdf as (select bridge, count(*) as bdf from asr group by bridge having count(*) <= 64), fb as (select distinct name, other as bridge from ends),
hop as (select qid, asr.entry as id, sum(round(0.5e0 * (ln((select count(*) from entries)::double / bdf) + 1) * 1e9)::bigint)::bigint / 1e9 as score
  from anc join fb on fb.name = anc.phrase join fdf using (bridge) join asr using (bridge) where not exists (select 1 from seed where seed.qid = anc.qid and seed.id = asr.entry) group by all),
wr as (select *, row_number() over (partition by qid order by score desc, id) as rank from (select * from seed union all select * from hop))"""


@query(f"with {_FACTWALK}, {_bm25(50)}, {_FUSE}")
def fact_topk(spark, sf):
    """Seeds and entries one fact further, fused with words."""
    anchored, edges, n = _anchored(spark, sf)
    words = lexical.Bm25.index(core._entries(spark, sf)).search(core._asked(spark, sf), 50)
    return relations.fused(relations.fact_walk(anchored, edges, core._edges(spark, sf), n), words, K)


_TIER = f"""with {_EDGES}, p as (select distinct lower(trim(obj)) as phrase from e where rel = 'was_at' and lower(trim(obj)) like 'the %'),
w as (select distinct lower(trim(subj)) as phrase from e where rel = 'introduced' and strlen(lower(trim(subj))) >= 3),
sel as (select id from entries where (contains(lower(text), 'recommended') or contains(lower(text), 'suggested'))
  and exists (select 1 from p where strlen(phrase) >= 3 and contains(lower(text), phrase)) and not exists (select 1 from w where contains(lower(text), phrase)))
select (select count(*) from sel) as selected, (select count(*) from entries) as n, round((select count(*) from sel) / greatest((select count(*) from entries), 1), 6) as share"""


@query(_TIER)
def tier_share(spark, sf):
    """How many entries an expensive reader would see: advice at a place, nobody named."""
    entries = core._entries(spark, sf)
    who = core._edges(spark, sf).filter("rel = 'introduced'").select(F.lower(F.trim("subj")).alias("phrase")).distinct()
    found = relations.tier_selected(entries, graph.mentions(entries, who), graph.mentions(entries, core.places(spark, sf)), ["recommended", "suggested"])
    n = entries.count()
    return found.agg(F.count("*").alias("selected")).select("selected", F.lit(n).cast("bigint").alias("n"), F.round(F.col("selected") / F.lit(float(max(n, 1))), 6).alias("share"))


@query("with b as (select subj as name, 0 as nth from fact_edges union all select obj, 1 from fact_edges where rel = 'was_at'), f as (select lower(name) as phrase, nth, name, row_number() over (partition by lower(name) order by nth, name) as rn from b where name is not null and name <> '') select phrase, case when nth = 0 then 'entity' else 'venue' end as kind, name from f where rn = 1")
def gazetteer_union(spark, sf):
    rows = table(spark, sf, "fact_edges")
    return relations.gazetteer(rows.select(F.col("subj").alias("name")), rows.filter("rel = 'was_at'").select(F.col("obj").alias("name")))


# Store


@query("select count(*) as n from (select distinct created_utc_secs, source, text from events_l0)")
def distinct_event_count(spark, sf):
    return store.distinct_events(table(spark, sf, "events_l0")).agg(F.count("*").alias("n"))


@query("select event_id, batch_id from events_l0 order by event_id desc limit 100")
def tail_events(spark, sf):
    return store.tail(table(spark, sf, "events_l0"), "event_id", 100).select("event_id", "batch_id")


@query("select name, row_number() over (order by seen, name) - 1 as key from (select subj as name, min(entry) as seen from fact_edges where subj is not null group by subj)")
def surrogate_keys(spark, sf):
    return store.surrogate_keys(table(spark, sf, "fact_edges"), "subj", ["entry"])


@query("select id, row_number() over (order by md5('7:' || id), id) - 1 as place from entries")
def shuffled_entries(spark, sf):
    return store.shuffled(core._entries(spark, sf).select("id"), "id", 7)


@query("with r as (select id, row_number() over (order by id) - 1 as p, greatest(1, count(*) over () // 500) as stride from entries) select id from r where p % stride = 0 and p < stride * 500")
def stride_sample(spark, sf):
    """About 500 entries at even distances; a sample is what the operator is for."""
    return store.strided(core._entries(spark, sf).select("id"), ["id"], 500)


@query("with c as (select source, count(*) as n from documents where source is not null group by source), x as (select source, n * 10000 / (select sum(n) from c) as exact, floor(n * 10000 / (select sum(n) from c))::bigint as whole from c) select source, whole + (row_number() over (order by round(exact - whole, 9) desc, source) <= 10000 - sum(whole) over ())::bigint as share from x")
def largest_remainder(spark, sf):
    sizes = table(spark, sf, "documents").filter("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return store.parted(sizes, 10_000, "source", "n")


_SECS = "case when created_utc_secs >= 100000000000 then created_utc_secs // 1000 else created_utc_secs end"
_UNITS = f"select unit_id, event_id, byte_end - byte_start as n, source, (to_timestamp({_SECS}) at time zone 'UTC')::date as d from units join events_l0 using (event_id) where byte_start >= 0 and byte_start < byte_end and byte_end <= strlen(text)"


@query(f"select unit_id as id, date_diff('day', date '2018-01-01', d) as day, strftime(d, '%Y-%m-%d') as date, source as kind, n as n_bytes from ({_UNITS})")
def store_corpus(spark, sf):
    """Entries made of units, dated by the time of their event."""
    rows = store.units_as_entries(table(spark, sf, "units"), table(spark, sf, "events_l0"))
    return rows.select("id", "day", "date", "kind", F.octet_length("text").alias("n_bytes"))


@query("select tb as text_bytes, tb + ne * 9 as record_bytes, nu * 16 as span_bytes, round((tb + ne * 9 + nu * 16) / greatest(tb, 1), 6) as overhead, case when nu > 0 then 16e0 else 0e0 end as unit_bytes from (select coalesce(sum(strlen(text)), 0)::bigint as tb, count(*) as ne from events_l0), (select count(*) as nu from units)")
def storage_accounting(spark, sf):
    return store.storage(table(spark, sf, "units"), table(spark, sf, "events_l0"))


@query("select count(*) as n, max(event_id) as high from events_l0")
def counts_watermark(spark, sf):
    return store.watermark(table(spark, sf, "events_l0"))


@query("select event_id, batch_id from events_l0 where event_id > (select max(event_id) from events_l0 where batch_id = 0)")
def reopen_above(spark, sf):
    """What a reader finds that has seen the first batch; the store is written in order of ids."""
    events = table(spark, sf, "events_l0")
    folder = scratch_path(spark, "events")
    events.select("event_id", "batch_id").repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(folder)
    high = store.watermark(events.filter("batch_id = 0")).first().high
    return store.above(spark.read.parquet(folder), high if high is not None else -1)


@query("select min(event_id) as event_id from events_l0 group by created_utc_secs, source, text")
def compacted_runs(spark, sf):
    """Runs of hashes, one for each batch, merged: one run with the first event of each content."""
    events = store.event_hash(table(spark, sf, "events_l0"))
    batches = sorted(r.batch_id for r in events.select("batch_id").distinct().collect() if r.batch_id is not None)
    runs = [events.filter(F.col("batch_id") == b).select("hash", "event_id") for b in batches] + [events.filter("batch_id is null").select("hash", "event_id")]
    return store.merged_runs(runs, 0)[0].select("event_id")


@query("select max(entry) + 1 as next from extractions")
def resume_point(spark, sf):
    """Where an extraction goes on whose log is this."""
    return table(spark, sf, "extractions").agg((F.max("entry") + 1).alias("next"))


@query("select id, to_base64(encode(text)) as base, hex(encode(text)) as hex, text as back from entries where text is not null")
def hex_round_trip(spark, sf):
    rows = core._entries(spark, sf).filter("text is not null")
    data = F.encode("text", "utf-8")
    return rows.select("id", F.base64(data).alias("base"), F.hex(data).alias("hex"), F.decode(F.unhex(F.hex(data)), "utf-8").alias("back")).withColumn("base", F.regexp_replace("base", "[\r\n]", ""))


@query("select event_id, 9 + strlen(text) as n_bytes, created_utc_secs as secs, length(source) as source, text from events_l0 where created_utc_secs is not null and source is not null and text is not null")
def record_codec(spark, sf):
    """Events written as records and read back; the source is told by the length of its name."""
    rows = table(spark, sf, "events_l0").filter("created_utc_secs is not null and source is not null and text is not null")
    coded = rows.select("event_id", tx.event_record(F.col("created_utc_secs"), F.length("source"), F.col("text")).alias("record"))
    secs, source, text = tx.record_fields(F.col("record"))
    return coded.select("event_id", F.octet_length("record").alias("n_bytes"), secs.alias("secs"), source.alias("source"), text.alias("text"))


@query("select id, case when regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}') then epoch(try_cast(date as date))::bigint end as secs, strftime(date '2018-01-01' + day, '%Y-%m-%d') as back from entries")
def date_seconds(spark, sf):
    day = F.unix_seconds(tx.date_of_day(F.col("day")).cast("timestamp"))
    return core._entries(spark, sf).select("id", tx.date_seconds(F.col("date")).alias("secs"), F.date_format(F.timestamp_seconds(day), "yyyy-MM-dd").alias("back"))


@query("select event_type, quantile_cont(value, 0.05) as p5, quantile_cont(value, 0.5) as p50 from events where value is not null group by event_type")
def interpolated_percentiles(spark, sf):
    """Percentiles between the two nearest ranks."""
    rows = table(spark, sf, "events").filter("value is not null")
    return rows.groupBy("event_type").agg(F.percentile("value", F.lit(0.05)).alias("p5"), F.percentile("value", F.lit(0.5)).alias("p50"))


_LAST = "last as (select * from (select entry, entities, row_number() over (partition by entry order by v desc, model desc, coalesce(len(entities), 0) desc, entities desc) as rn from extractions where entities is not null) where rn = 1)"


@query(f"with {_LAST} select id, strlen(case when q = '' or q is null then text else coalesce(text, '') || chr(10) || q end) as n_bytes from entries left join (select entry, array_to_string(list_filter(list_transform(entities, lambda x: trim(x)), lambda x: x <> ''), chr(10)) as q from last) on entry = id")
def expanded_texts(spark, sf):
    """Entries with the strings of their newest extraction added, as generated questions would be."""
    log = table(spark, sf, "extractions").filter("entities is not null")
    line = F.struct("v", "model", F.size("entities"), "entities")
    rows = store.expanded_texts(core._entries(spark, sf), log.select("entry", line.alias("line"), F.col("entities").alias("questions")))
    return rows.select("id", F.octet_length("text").alias("n_bytes"))


@query("select distinct on (entry, v, model, f) entry, v, model, trim(f[1]) as subj, f[2] as rel, trim(f[3]) as obj from (select entry, v, model, unnest(facts) as f from extractions) where len(f) = 3 and trim(f[1]) <> '' and trim(f[3]) <> ''")
def extraction_cleanup(spark, sf):
    """Facts of extractions read from text as models write it, in fences and with words around."""
    rows = table(spark, sf, "extractions")
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("entities", "facts")), F.lit("\n```\nDone."))
    read = rows.select("entry", "v", "model", tx.extraction_of(raw).alias("o")).select("entry", "v", "model", F.explode("o.facts").alias("f")).filter("size(f) = 3")
    facts = read.select("entry", "v", "model", F.trim(F.col("f")[0]).alias("subj"), F.col("f")[1].alias("rel"), F.trim(F.col("f")[2]).alias("obj"), "f")
    return facts.filter("subj != '' and obj != ''").distinct().drop("f")


@query("select entry, v, len(entities) as n from extractions")
def json_lines_scan(spark, sf):
    """A log written as lines of JSON and read again; a line that is none would be an error."""
    folder = scratch_path(spark, "log")
    readers.write_json_lines(table(spark, sf, "extractions").select("entry", "entities", "v"), folder)
    rows = readers.json_lines(spark, folder, "entry bigint, entities array<string>, v bigint")
    return rows.select("entry", "v", F.when(F.col("entities").isNotNull(), F.size("entities")).cast("bigint").alias("n"))


@query("select a.id, r.answer from recall_queries a left join (select question, min(answer) as answer from recall_queries where question is not null group by question) r using (question)")
def query_lookup(spark, sf):
    """Answers kept by the text of the question; an unknown question has none."""
    asked = core._asked(spark, sf)
    kept = asked.filter("question is not null").groupBy("question").agg(F.min("answer").alias("answer"))
    return asked.select("id", "question").join(kept, "question", "left").select("id", "answer")


@query("select id, regexp_replace(text, '[^\\p{L}\\p{N}_-]', '_', 'g') as safe from entries where text is not null")
def safe_ids(spark, sf):
    return core._entries(spark, sf).filter("text is not null").select("id", tx.safe_id(F.col("text")).alias("safe"))


@query("select id, to_json({'id': id, 'day': day}) as j from entries where day is not null")
def json_emit(spark, sf):
    return core._entries(spark, sf).filter("day is not null").select("id", F.to_json(F.struct("id", "day")).alias("j"))


# Insight

_REPORT = f"""{_BRIDGE}, ev as (select t.entity, list_sort(list(distinct entry)) as evidence from t join bridge b on t.entity = b.entity and t.cluster in (b.c1, b.c2) group by t.entity),
num as (select *, row_number() over (order by entity, entity || ' stands both with ' || c1 || ' and with ' || c2 || ', which few others do') - 1 + (1::bigint << 56) as id from bridge join ev using (entity)),
fl as (select *, row_number() over (order by p_value) as i, count(*) over () as m from num where support >= 2 and surprise >= 0.6),
rep as (select id, entity, entity || ' stands both with ' || c1 || ' and with ' || c2 || ', which few others do' as text, evidence, surprise, p_value from fl where p_value <= (select max(p_value) from fl where p_value <= i / m * 0.5e0))"""


def _report(spark, sf):
    return insight.discovered(insight.bridge_candidates(core._topics(spark, sf)), {"bridge": 0.5})


@query(f"with {_REPORT} select id, entity, text, len(evidence) as n_citations, surprise as effect, p_value from rep")
def insight_report(spark, sf):
    """Bridges that hold, each told and with what it cites."""
    return _report(spark, sf).select("id", "entity", "text", F.size("citations").alias("n_citations"), "effect", "p_value")


@query(f"with {_REPORT}, cites as (select sha256(text) as output, unnest(evidence) as entry from rep) select distinct output, sha256(coalesce(entries.text, '')) as input, 1 as method_id, 1::bigint as method_version from cites join entries on entry = entries.id")
def insight_ledger(spark, sf):
    return insight.finding_derivations(_report(spark, sf), core._entries(spark, sf))


@query(f"with {_EDGES}, s as (select distinct obj as entity, entry, day, rel in ('works_with', 'joins', 'congratulated') as good from e join entries on entry = id where obj is not null and day is not null and rel in ('works_with', 'joins', 'congratulated', 'avoids', 'disagrees_with', 'complains_to')), r as (select entity, min(case when good then day end) as a, max(case when not good then day end) as b from s group by entity having max(case when not good then day end) > min(case when good then day end)) select entity, entity || ' was spoken well of on day ' || a || ' and badly on day ' || b as claim, 1e0 as surprise from r")
def reversal_claims(spark, sf):
    day = core._entries(spark, sf).select(F.col("id").alias("entry"), "day")
    said = lambda rels: core._edges(spark, sf).filter(F.col("rel").isin(rels) & F.col("obj").isNotNull()).select(F.col("obj").alias("entity"), "entry").join(day, "entry").distinct()
    found = insight.reversal_candidates(said(["works_with", "joins", "congratulated"]), said(["avoids", "disagrees_with", "complains_to"]))
    return found.select("entity", "claim", "surprise")


# Ledger


@query("with recursive d as (select 'c' || o_custkey as output, 'o' || o_orderkey as input, (o_orderpriority = '1-URGENT')::int as v from orders union all select 'n' || c_nationkey, 'c' || c_custkey, 0 from customer), old as (select distinct output from d where v <> 0), stale as (select output from old union select d.output from stale join d on d.input = stale.output) select 'any' as change, output from stale")
def stale_by_method(spark, sf):
    """Outputs of a method with another version than the current one, and all that follows from them."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    version = (F.col("o_orderpriority") == "1-URGENT").cast("bigint")
    rows = table(spark, sf, "orders").select(key("c", "o_custkey").alias("output"), key("o", "o_orderkey").alias("input"), F.lit(1).alias("method_id"), version.alias("method_version"))
    rows = rows.unionByName(table(spark, sf, "customer").select(key("n", "c_nationkey").alias("output"), key("c", "c_custkey").alias("input"), F.lit(2).alias("method_id"), F.lit(0).cast("bigint").alias("method_version")))
    current = spark.createDataFrame([(1, 0), (2, 0)], "method_id int, version bigint")
    return ledger.stale_outputs(rows, spark.createDataFrame([("any", "nothing")], "change string, item string"), current)


# Vectors


@query("select pos, round(avg(x), 6) as x from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by pos")
def dataset_centroid(spark, sf):
    v = core._vectors(spark, sf).select(F.lit(0).alias("all"), "embedding")
    return search.mean_vectors(v, "all").select(F.posexplode("mean").alias("pos", "x")).select("pos", F.round("x", 6).alias("x"))


_VALID = "valid as (select vec_id, v::double[] as v from vectors where dim = 64 and len(v) = 64 and len(list_filter(v, lambda x: x is not null and isfinite(x))) = 64)"


@query(f"with {_VALID}, d as (select vec_id, list_id, list_inner_product(c.v::double[], c.v::double[]) - 2 * list_inner_product(valid.v, c.v::double[]) as dist from valid, centroids c) select vec_id, list_id from (select *, row_number() over (partition by vec_id order by dist, list_id) as rn from d) where rn = 1")
def nearest_centroid(spark, sf):
    """The nearest of the given centroids for each whole vector, of equals the first."""
    import numpy as np

    centres = np.array([r.v for r in table(spark, sf, "centroids").orderBy("list_id").collect()], np.float64)  # a fixed table
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf, "vectors").filter((F.col("dim") == 64) & (F.size("v") == 64) & finite)
    return search.assigned(rows, centres, "vec_id", "v").select(F.col("id").alias("vec_id"), "list_id")


@query("with q as (select vec_id as qid, embedding as q from embeddings where vec_id % 20 = 0), s as (select qid::bigint as qid, vec_id as id, list_sum(list_transform(list_zip(q, embedding), lambda z: (z[1] > 0 and z[2] > 0)::int))::int as shared from q, embeddings) select * from (select *, row_number() over (partition by qid order by shared desc, id) as rank from s) where rank <= 10")
def sign_overlap(spark, sf):
    """Vectors that share most positive dimensions with each query, by bits in words."""
    word = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L"))), F.expr("named_struct('bit', 0, 'low', 0L, 'high', 0L)"), lambda s, b: F.struct((s["bit"] + 1).alias("bit"), (s["low"] + F.when(s["bit"] < 32, F.call_function("shiftleft", b, s["bit"])).otherwise(F.expr("0L"))).alias("low"), (s["high"] + F.when(s["bit"] >= 32, F.call_function("shiftleft", b, s["bit"] - 32)).otherwise(F.expr("0L"))).alias("high")))
    coded = materialise(core._vectors(spark, sf).select("vec_id", word.alias("w")).select("vec_id", F.array("w.low", "w.high").alias("bits")))
    asked = coded.filter("vec_id % 20 = 0").select(F.col("vec_id").cast("bigint").alias("qid"), F.col("bits").alias("q"))
    rows = coded.select(F.col("vec_id").alias("id"), "bits").crossJoin(F.broadcast(asked)) if asked.count() <= search.QUERIES_AT_ONCE else None
    if rows is None:
        raise ValueError("more queries than one pass compares")
    return lexical.ranked(rows.select("qid", "id", popcount_and(F.col("q"), F.col("bits")).alias("shared")), K, score="shared")


@query("select (select count(*) from embeddings where vec_id % 20 = 0) as n_queries, 10 as least_found, true as enough")
def list_index_recall(spark, sf):
    """An index by lists, written, opened and searched: every query has k rows, recall is at least 0.9."""
    v = core._vectors(spark, sf)
    asked = search.queries_of(v)
    index = ListIndex.build(v, scratch_path(spark, "lists"))
    found = materialise(index.search(v, asked, K, max(1, len(index.centres) // 2), 20 * K))
    share = search.recall(found, core.exact_knn(spark, sf)).first().recall
    by = found.groupBy("qid").agg(F.count("*").alias("n"))
    return by.agg(F.count("*").alias("n_queries"), F.min("n").cast("int").alias("least_found")).withColumn("enough", F.lit(share >= 0.9))


@query("select system, true as enough from (values ('int8'), ('product'), ('two_stage')) t(system)")
def ann_gate(spark, sf):
    """Which searches by codes find at least 0.9 of the nearest."""
    return core.ann_recall(spark, sf).filter("system != 'lists'").select("system", (F.col("recall") >= 0.9).alias("enough"))


@query("select vec_id, embedding[1] as first from embeddings")
def raw_vectors_scan(spark, sf):
    """Vectors written as raw numbers and read again by their place."""
    folder = scratch_path(spark, "raw")
    rows = store.dense_ids(core._vectors(spark, sf).select("vec_id", "embedding"), ["vec_id"], "place")
    readers.write_raw_vectors(rows, folder, "place", "embedding")
    back = readers.raw_vectors(spark, folder, 64).select(F.col("vec_id").alias("place"), F.col("embedding")[0].alias("first"))
    return rows.select("place", "vec_id").join(back, "place").select("vec_id", "first")


@query("select kind, n, greatest(64, least(65536, floor(4 * sqrt(n))::bigint)) as lists from (select 'vectors' as kind, count(*) as n from vectors union all select 'embeddings', count(*) from embeddings union all select 'lineitem', count(*) from lineitem)")
def auto_lists(spark, sf):
    from lorespark.operators.vector_index import auto_lists as lists

    return spark.createDataFrame([(t, n, lists(n)) for t in ("vectors", "embeddings", "lineitem") for n in [table(spark, sf, t).count()]], "kind string, n bigint, lists bigint")
