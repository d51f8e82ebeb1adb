"""The query verb: lookup, neighborhood of all nodes of a name, pages with cursors, token budgets, and texts to show."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import CodeGraph, priority, settled
from . import advice, filters, linking, traverse

#: The share of a budget that counts, and how it is split by section.
BUDGET_PART = 0.7
ZONES = {"header": 0.025, "hop1": 0.30, "hop_rest": 0.4375, "warnings": 0.0625}


@dataclass(frozen=True)
class Options:
    min_confidence: float = 0.70
    depth: int = 3
    token_budget: int = 8000
    include_stale: bool = False
    page_size: int = 50


#: What the presets change, where an option still has its default.
PRESETS = {
    "standard": {},
    "fast": {"min_confidence": 0.9, "depth": 1, "token_budget": 2000},
    "full": {"min_confidence": 0.0, "depth": 5, "token_budget": 16000},
}


def preset(name: str, options: Options | None = None) -> Options:
    """Options with a preset's values for all that still have their defaults; ``full`` shows stale edges in any case."""
    given, default = options or Options(), Options()
    changed = {k: v for k, v in PRESETS[name].items() if getattr(given, k) == getattr(default, k)}
    return replace(given, **changed, include_stale=True if name == "full" else given.include_stale)


def zones(budget: int) -> dict[str, int]:
    """Tokens by section of a budget of which ``BUDGET_PART`` counts."""
    return {k: int(int(budget * BUDGET_PART) * part) for k, part in ZONES.items()}


def lookup(nodes: DataFrame, name: str, limit: int = 1024) -> DataFrame:
    """Nodes of exactly that name, by id; without any the fuzzy ones, by rank: id, name, score (exact: 0)."""
    exact = nodes.where(F.col("name") == name).select("id", "name", F.lit(0).alias("score"))
    return linking.fuzzy(nodes, name, limit) if exact.isEmpty() else exact.orderBy("id").limit(limit)


def centers(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Of the nodes of each of ``names(name)`` the one that stands for it: the first public one, else the first."""
    best = F.min(F.struct((F.col("visibility") != "Public").alias("hidden"), "id"))
    return nodes.join(names, "name").groupBy("name").agg(best["id"].alias("id"), F.count("*").alias("definitions"))


def around(graph: CodeGraph, centers: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Edges around all of ``centers(rank, id)``: direction, depth, and the edge, each edge once for a direction.

    Each center has a traversal of its own; where several reach an edge, the depth of the first by rank counts.
    """
    g = CodeGraph(graph.nodes, filters.fresh(graph.edges, options.include_stale))
    found = traverse.neighborhood(g, centers.select(F.col("rank").alias("seed"), "id"), max(options.depth, 1), options.min_confidence)
    first = Window.partitionBy("direction", "from_id", "to_id", "kind").orderBy("seed", "depth")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "seed")


def in_page_order(edges: DataFrame) -> list:
    """Outgoing before incoming, near before far, then by kind and ids."""
    return [F.col("direction") == "incoming", "depth", priority(), "from_id", "to_id", "kind"]


def cursor(query: str, page: int, size: int) -> str:
    """An opaque text that names a page of a query."""
    return base64.urlsafe_b64encode(json.dumps([query, page, size]).encode()).decode()


def read_cursor(text: str) -> tuple[str, int, int]:
    try:
        query, page, size = json.loads(base64.urlsafe_b64decode(text.encode()))
        return str(query), int(page), int(size)
    except (ValueError, TypeError) as e:
        raise ValueError("not a cursor") from e


def page(edges: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    return linking.page(edges, in_page_order(edges), number, size)


def edge_json(edges: DataFrame) -> DataFrame:
    """Edges as JSON texts with their estimated tokens."""
    text = F.to_json(F.struct("direction", "depth", "from_id", "to_id", "kind", "origin", F.round(F.col("confidence").cast("double"), 3).alias("confidence")))
    return edges.withColumn("json", text).withColumn("cost", T.estimated_tokens("json"))


def within_zones(edges: DataFrame, budget: int = 8000) -> DataFrame:
    """Edges in page order as far as their zone's tokens go: one hop, and all hops beyond; ``json`` is what they cost."""
    limit = zones(budget)
    zone = F.when(F.col("depth") == 1, "hop1").otherwise("hop_rest")
    spent = F.sum("cost").over(Window.partitionBy("zone").orderBy(*in_page_order(edges)).rowsBetween(Window.unboundedPreceding, 0))
    priced = edge_json(edges).withColumn("zone", zone)
    return priced.withColumn("spent", spent).where(F.col("spent") <= F.when(F.col("zone") == "hop1", limit["hop1"]).otherwise(limit["hop_rest"]))


def query(graph: CodeGraph, name: str, options: Options = Options(), kinds: list[str] | None = None, edge_kinds: list[str] | None = None,  # noqa: B008
          direction: str = "both", number: int = 1) -> dict:
    """All that the query verb shows of a name: centers, the page of edges, its trust and the cursor of the next page.

    Kinds of edges and the direction are filtered after the traversal, so edges reached through others count. ``edges``
    is a DataFrame of at most a page; the other values are single ones.
    """
    hits = lookup(filters.of_kinds(graph.nodes, kinds or []), name)
    ranked = settled(hits.select("id", F.row_number().over(Window.orderBy("score", "id")).cast("long").alias("rank")))  # at most 1024 rows
    found = filters.directed(filters.edges_of_kinds(settled(around(graph, ranked, options)), edge_kinds or []), direction)
    total, trust = found.count(), advice.path_trust(found, advice.verified()).first()
    more = number * options.page_size < total
    return {
        "name": name, "centers": [r["id"] for r in ranked.orderBy("rank").select("id").collect()], "edges": page(found, number, options.page_size), "total": total,
        "trust": trust["trust"], "next": cursor(name, number + 1, options.page_size) if more else None,
    }


def rendered(shown: dict, nodes: DataFrame, form: str = "human", budget: int = 8000) -> Iterator[str]:
    """Lines for a result of ``query``: human (a line an edge), llm (as human, as far as the budget goes), json (one text).

    Only the page's own rows come to the driver.
    """
    names = nodes.select("id", "name")
    rows = shown["edges"].join(names.withColumnsRenamed({"id": "from_id", "name": "from_name"}), "from_id", "left").join(
        names.withColumnsRenamed({"id": "to_id", "name": "to_name"}), "to_id", "left")
    order = in_page_order(rows)
    if form == "json":
        edges = [json.loads(r["json"]) for r in edge_json(rows).orderBy(*order).select("json").collect()]
        yield json.dumps({k: v for k, v in shown.items() if k != "edges"} | {"edges": edges})
        return
    yield f"{shown['name']}: {len(shown['centers'])} definitions, {shown['total']} edges, {shown['trust']}"
    if len(shown["centers"]) > 1:
        yield f"note: edges of all {len(shown['centers'])} definitions are shown together"
    used, most = 40, int(budget * BUDGET_PART)
    for r in rows.orderBy(*order).collect():
        line = f"{'<-' if r['direction'] == 'incoming' else '->'} {r['depth']} {r['kind']} {r['from_name']} {r['to_name']} {r['confidence']:.2f}"
        used += len(line) // 4 + 1
        if form == "llm" and used > most:
            yield "truncated"
            return
        yield line
    if shown["next"]:
        yield f"next: {shown['next']}"
