"""A retrieval system over tables, and the messages an agent asks it by."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators import graph, insight, lexical, relations
from lorespark.session import materialise

PARSE, REQUEST, METHOD, PARAMS = -32700, -32600, -32601, -32602
#: Arguments of each tool: name, JSON type, default (none if it must be given).
TOOLS = {
    "search": ("Entries that answer a question, best first.", {"query": ("string", None), "k": ("integer", 10)}),
    "assemble_context": ("Cited entries for a question within a budget of tokens.", {"query": ("string", None), "token_budget": ("integer", 512)}),
    "discover_insights": ("Findings that hold against chance, with what they cite.", {"q": ("number", 0.05)}),
}
_TYPES = {"string": str, "integer": int, "number": (int, float)}


class Retrieval:
    """What answers questions: ``search`` gives (qid, id, score, rank)."""

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        raise NotImplementedError


@dataclass
class Lexical(Retrieval):
    entries: DataFrame
    index: lexical.Bm25 = field(init=False)

    def __post_init__(self) -> None:
        built = lexical.Bm25.index(self.entries)
        self.index = lexical.Bm25(materialise(built.postings), materialise(built.lengths), materialise(built.stats))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return self.index.search(queries, k)


@dataclass
class Comention(Retrieval):
    """Words, fused with one hop over phrases that entries share."""

    words: Lexical
    edges: DataFrame

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        depth = max(5 * k, 50)
        base = self.words.search(queries, depth)
        asked = graph.mentions(queries.select("id", F.col("question").alias("text")), self.edges).withColumnRenamed("entry", "qid")
        n = self.words.entries.count()
        df = graph.without_hubs(self.edges)
        seeds = asked.join(df, "phrase").groupBy("qid", F.col("entry").alias("id")).agg(F.round(F.sum(lexical.idf(float(n), F.col("df"))), 6).alias("score"))
        hops = graph.comention_hop(seeds, self.edges, asked, n)
        walked = lexical.ranked(seeds.unionByName(hops).groupBy("qid", "id").agg(F.round(F.sum("score"), 6).alias("score")), depth)
        return lexical.reciprocal_ranks([base, walked], 0, depth, k)


@dataclass
class Service:
    """Answers messages ``{jsonrpc, id, method, params}`` about one table of entries."""

    entries: DataFrame
    system: Retrieval
    mentions: DataFrame | None = None

    def handle(self, message: dict) -> dict | None:
        """The answer to a message; a notification has none."""
        if not isinstance(message, dict) or not isinstance(message.get("method"), str):
            return {"jsonrpc": "2.0", "id": message.get("id") if isinstance(message, dict) else None, "error": {"code": REQUEST, "message": "no method"}}
        reply, method = {"jsonrpc": "2.0", "id": message.get("id")}, message["method"]
        if method.startswith("notifications/"):
            return None
        params = message.get("params") if isinstance(message.get("params"), dict) else {}
        if method == "initialize":
            version = params.get("protocolVersion") or "2024-11-05"
            return reply | {"result": {"protocolVersion": version, "capabilities": {"tools": {}}, "serverInfo": {"name": "lorespark", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": [{"name": n, "description": about, "inputSchema": {"type": "object", "properties": {a: {"type": kind} for a, (kind, _) in takes.items()}, "required": [a for a, (_, default) in takes.items() if default is None]}} for n, (about, takes) in TOOLS.items()]}}
        if method != "tools/call":
            return reply | {"error": {"code": METHOD, "message": f"unknown method {method}"}}
        name, given = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS:
            return reply | {"error": {"code": PARAMS, "message": f"unknown tool {name}"}}
        wrong = self._wrong(given, TOOLS[name][1])
        if wrong:
            return reply | {"error": {"code": PARAMS, "message": wrong}}
        try:
            text, failed = getattr(self, name)(**given), False
        except Exception as error:  # a failing tool is no failing service
            text, failed = f"{type(error).__name__}: {error}".splitlines()[0], True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}

    @staticmethod
    def _wrong(given: dict, takes: dict) -> str | None:
        """What is wrong with the arguments of a tool."""
        if not isinstance(given, dict) or set(given) - set(takes):
            return f"takes {', '.join(takes)}"
        for name, (kind, default) in takes.items():
            value = given.get(name, default)
            if not isinstance(value, _TYPES[kind]) or isinstance(value, bool):
                return f"{name} must be a {kind}"
            if kind == "integer" and value < 1:
                return f"{name} must be 1 or more"
        return None

    def _asked(self, query: str) -> DataFrame:
        return self.entries.sparkSession.createDataFrame([(0, query)], "id int, question string")

    def search(self, query: str, k: int = 10) -> str:
        rows = self.system.search(self._asked(query), k).join(self.entries, "id").orderBy("rank").collect()  # k rows
        return "\n".join(f"[{r.id}] {r.date}: {r.text}" for r in rows) or "No results."

    def assemble_context(self, query: str, token_budget: int = 512) -> str:
        """The first entries of the ranking that fit the budget, each with its id."""
        kept = graph.context_prefix(self.system.search(self._asked(query), 64), self.entries, token_budget)
        rows = kept.join(self.entries, "id").orderBy("rank").collect()
        return "\n".join(f"[{r.id}] {r.date}: {r.text}" for r in rows) or "No results."

    def discover_insights(self, q: float = 0.05) -> str:
        """Findings that pass the test, each with what it cites."""
        if self.mentions is None:
            return "No results."
        found = insight.discovered(insight.bridge_candidates(self.mentions), {"bridge": q})
        rows = found.orderBy(F.desc("effect"), "id").limit(100).collect()  # a report
        return "\n".join(f"{r.text} [{', '.join(map(str, r.citations))}]" for r in rows) or "No results."


@dataclass
class Relations(Retrieval):
    """Words, fused with a walk over introductions and advice where a question asks for one."""

    words: Lexical
    edges: DataFrame
    cues: tuple[str, ...] = ("introduc", "recommend", "told me")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        intros, advice = relations.typed_facts(self.edges, self.words.entries)
        names = self.edges.filter("rel in ('introduced', 'recommended')").select(F.explode(F.array("subj", "obj")).alias("phrase")).filter("phrase is not null").distinct()
        asked = queries.filter(relations.relational(F.col("question"), list(self.cues))).select("id", F.col("question").alias("text"))
        persons = graph.mentions(asked, names).select(F.col("entry").alias("qid"), F.trim("phrase").alias("person"))
        return relations.fused(relations.relation_scores(persons, intros, advice), self.words.search(queries, max(5 * k, 50)), k)


@dataclass
class Facts(Retrieval):
    """Mentions and facts of extractions, fused with words or alone."""

    words: Lexical
    edges: DataFrame
    facts: DataFrame | None = None
    alone: bool = False

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        n = self.words.entries.count()
        asked = graph.mentions(queries.select("id", F.col("question").alias("text")), self.edges).withColumnRenamed("entry", "qid")
        anchored = relations.anchors(asked, self.edges, n)
        walk = relations.entity_walk(anchored, self.edges, n) if self.facts is None else relations.fact_walk(anchored, self.edges, self.facts, n)
        return lexical.ranked(walk, k) if self.alone else relations.fused(walk, self.words.search(queries, max(5 * k, 50)), k)
