"""Tools over the engine and a bounded agent loop; the chat model is a plugged-in callable."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.operators import catalogue, retrieval

TURNS = 5
PROTOCOL, SERVER = "2025-06-18", {"name": "stratalith", "version": "1"}
_TEXT = {"type": "string"}
TOOLS = [
    {
        "name": "search_docs",
        "description": "Search the documentation. Results are numbered passages; cite them as [n].",
        "parameters": {"type": "object", "properties": {"query": _TEXT}, "required": ["query"]},
        "output": {"type": "object", "properties": {"passages": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}, "section": _TEXT, "url": _TEXT, "content": _TEXT}, "required": ["n", "section", "url", "content"]}}}, "required": ["passages"]},
    },
    {
        "name": "search_scenes",
        "description": "Search the catalogue of scenes of a product, by days and, if given, place, mode and orbit.",
        "parameters": {
            "type": "object",
            "properties": {"product": {"enum": list(catalogue.PRODUCTS)}, "place": _TEXT, "days": {"type": "integer"}, "start": _TEXT, "end": _TEXT, "mode": {"enum": list(catalogue.MODES)}, "orbit": {"enum": list(catalogue.ORBITS)}, "confirm_place": {"type": "boolean"}},
        },
        "output": {"type": "object", "properties": {"summary": _TEXT, "scenes": {"type": "array", "items": _TEXT}, "more": {"type": "boolean"}}, "required": ["summary", "scenes", "more"]},
    },
]


@dataclass
class Toolbox:
    """Tools bound to tables. Errors of a call become its text; passages keep their number over calls.

    embed: gives the vectors of questions; with it the documents are searched by both halves, fused, else by words.
    scorer: makes a reranker of (questions, chunks), see providers.scorer. geocode: gives the place of a name, or None.
    """

    chunks: DataFrame
    documents: DataFrame
    scenes: DataFrame
    today: dt.date
    k: int = retrieval.TOP_K
    embed: Callable[[list[str]], list[list[float]]] | None = None
    scorer: Callable[[DataFrame, DataFrame], Callable[[DataFrame], DataFrame]] | None = None
    geocode: Callable[[str], catalogue.Place | None] | None = None
    numbers: dict[int, int] = field(default_factory=dict)
    confirmed: set[str] = field(default_factory=set)
    structured: dict = field(default_factory=dict)

    def call(self, name: str, arguments: dict) -> str:
        tool = {"search_docs": self.search_docs, "search_scenes": self.search_scenes}.get(name)
        if tool is None:
            return f"Error: unknown tool {name}."
        self.structured = {}
        try:
            return tool(**arguments)
        except (TypeError, ValueError) as e:
            return f"Error: {e}"

    def search_docs(self, query: str) -> str:
        if not query.strip():
            raise ValueError("query is empty")
        spark = self.chunks.sparkSession
        asked, vectors, method = spark.createDataFrame([(0, query)], "id long, question string"), None, "lexical"
        if self.embed:
            method, vectors = "hybrid", spark.createDataFrame([(0, [float(x) for x in self.embed([query])[0]])], "qid long, vec array<double>")
        top = retrieval.retrieve(self.chunks, asked, vectors, self.k, method, scorer=self.scorer(asked, self.chunks) if self.scorer else None)
        text = self.chunks.select(F.col("id").cast("long").alias("id"), "content")
        rows = retrieval.with_documents(top, self.chunks, self.documents).join(text, "id").orderBy("rank").collect()
        new = [r for r in rows if r.id not in self.numbers]
        for r in new:
            self.numbers[r.id] = len(self.numbers) + 1
        self.structured = {"passages": [{"n": self.numbers[r.id], "section": r.section, "url": r.citation, "content": r.content} for r in rows]}
        lines = [f"[{self.numbers[r.id]}] {r.section}\n{r.content}" for r in new]
        if len(new) < len(rows):
            lines.append("Already shown: " + ", ".join(f"[{self.numbers[r.id]}]" for r in rows if r not in new))
        return "\n\n".join(lines) or "No passages found."

    def search_scenes(self, product: str | None = None, place: str | None = None, days: int | None = None, start: str | None = None, end: str | None = None, mode: str | None = None, orbit: str | None = None, confirm_place: bool = False, limit: int = catalogue.LIMIT) -> str:
        catalogue.check_filters(mode=mode, orbit=orbit, product=product)
        a, b = catalogue.resolve_days(self.today, days, start, end)
        raw, where = self.scenes, ""
        if product is not None and "product" in raw.columns:
            raw = raw.where(F.col("product") == product)
        scenes = catalogue.normalise(raw)
        if place is not None:
            found_place = self.geocode(place) if self.geocode else None
            if found_place is None:
                raise ValueError(f"no place is called {place}")
            catalogue.guard_place(found_place, self.confirmed, confirm_place)
            where = f" over {found_place.name}"
            if "west" in self.scenes.columns:
                boxes = raw.select("id", "west", "south", "east", "north").dropDuplicates(["id"])
                inside = boxes.where(catalogue.intersects(found_place.west, found_place.south, found_place.east, found_place.north))
                scenes = scenes.join(inside.select("id"), "id", "left_semi")
        found = catalogue.search(scenes, a, b, limit, mode=mode, orbit=orbit)
        rows = [r.line for r in found.select(catalogue.scene_line().alias("line")).collect()]
        self.structured = {"summary": "No scenes found.", "scenes": rows[:limit], "more": len(rows) > limit}
        if not rows:
            return "No scenes found."
        shown = found.limit(limit)
        s = catalogue.summary(shown).first()
        more = "; the catalogue has more" if len(rows) > limit else ""
        tracks = "; ".join(f"{r.orbit}, track {r.tracks}" for r in catalogue.tracks(shown).orderBy("orbit").collect())
        self.structured["summary"] = f"Found{where}: {s.scenes} newest scenes{more}, {s.passes} passes, {s.satellites} satellites, {s.days} days."
        return f"{self.structured['summary']}\nOrbits: {tracks}."


@dataclass
class Run:
    answer: str = ""
    turns: int = 0
    calls: list[dict] = field(default_factory=list)


def run_agent(question: str, chat: Callable[[list[dict], list[dict]], dict], tools: Toolbox, turns: int = TURNS) -> Run:
    """At most ``turns`` model turns. An answer before any tool was called is not taken: the documents are searched
    first. chat(messages, tools) gives {"content": text} or {"calls": [(name, arguments)]}."""
    run = Run()
    messages = [{"role": "system", "content": f"Today is {tools.today:%A} {tools.today}."}, {"role": "user", "content": question}]
    while run.turns < turns:
        run.turns += 1
        reply = chat(messages, TOOLS)
        calls = [(n, a, False) for n, a in reply.get("calls", [])]
        if not calls and not run.calls:
            calls = [("search_docs", {"query": question}, True)]
        if not calls:
            run.answer = reply.get("content", "")
            break
        for name, arguments, forced in calls:
            text = tools.call(name, arguments)
            run.calls.append({"turn": run.turns, "tool": name, "arguments": arguments, "forced": forced, "summary": text.split("\n")[0][:120]})
            messages += [{"role": "assistant", "content": json.dumps({"tool": name, "arguments": arguments})}, {"role": "tool", "content": text}]
    return run


def _answer(request: dict, result: dict | None = None, code: int = 0, message: str = "") -> dict:
    body = {"result": result} if result is not None else {"error": {"code": code, "message": message}}
    return {"jsonrpc": "2.0", "id": request.get("id"), **body}


def serve_call(tools: Toolbox, request: dict) -> dict | None:
    """One JSON-RPC request as a stateless response; None for notifications.

    initialize answers with the protocol's version, tools/list with input and output schemas; tools/call gives text and
    structured content. Unknown methods are error -32601, unknown tools and arguments -32602, no request -32600.
    """
    if not isinstance(request, dict) or "method" not in request:
        return _answer(request if isinstance(request, dict) else {}, code=-32600, message="no request")
    method, params = request["method"], request.get("params") or {}
    if "id" not in request:
        return None
    if method == "initialize":
        return _answer(request, {"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": SERVER})
    if method == "ping":
        return _answer(request, {})
    if method == "tools/list":
        return _answer(request, {"tools": [{"name": t["name"], "description": t["description"], "inputSchema": t["parameters"], "outputSchema": t["output"]} for t in TOOLS]})
    if method != "tools/call":
        return _answer(request, code=-32601, message=f"unknown method {method}")
    tool = next((t for t in TOOLS if t["name"] == params.get("name")), None)
    if tool is None:
        return _answer(request, code=-32602, message=f"unknown tool {params.get('name')}")
    arguments = params.get("arguments") or {}
    wrong = sorted(set(arguments) - set(tool["parameters"]["properties"]))
    if wrong:
        return _answer(request, code=-32602, message=f"unknown argument {', '.join(wrong)}")
    fresh = replace(tools, numbers={}, confirmed=tools.confirmed, structured={})
    text = fresh.call(params["name"], arguments)
    failed = text.startswith("Error:")
    return _answer(request, {"content": [{"type": "text", "text": text}], "isError": failed} | ({} if failed else {"structuredContent": fresh.structured}))


def serve(tools: Toolbox, lines: Iterable[str], write: Callable[[str], object]) -> None:
    """The endpoint over text streams: one JSON message a line in, one a line out; a line that is no JSON is -32700."""
    for line in lines:
        if not line.strip():
            continue
        try:
            response = serve_call(tools, json.loads(line))
        except json.JSONDecodeError:
            response = _answer({}, code=-32700, message="no JSON")
        if response is not None:
            write(json.dumps(response, ensure_ascii=False) + "\n")


def protocol_check(send: Callable[[dict], dict | None]) -> list[tuple[str, bool]]:
    """(check, passed) of an endpoint: handshake, tools with schemas, calls that work, fail and don't exist."""
    ask = lambda i, method, **params: send({"jsonrpc": "2.0", "id": i, "method": method, "params": params}) or {}
    hello, listed = ask(1, "initialize", protocolVersion=PROTOCOL), ask(2, "tools/list").get("result", {}).get("tools", [])
    good, empty = ask(3, "tools/call", name="search_docs", arguments={"query": "noise"}), ask(4, "tools/call", name="search_docs", arguments={"query": " "})
    days = ask(5, "tools/call", name="search_scenes", arguments={"start": "2024-13-01"})
    return [
        ("handshake gives version and name", hello.get("result", {}).get("protocolVersion") == PROTOCOL and bool(hello.get("result", {}).get("serverInfo"))),
        ("ids are given back", hello.get("id") == 1 and good.get("id") == 3),
        ("a notification has no answer", send({"jsonrpc": "2.0", "method": "notifications/initialized"}) is None),
        ("both tools are listed", {t["name"] for t in listed} == {t["name"] for t in TOOLS}),
        ("tools have schemas", bool(listed) and all(t.get("inputSchema") and t.get("outputSchema") for t in listed)),
        ("a call gives text and structure", bool(good.get("result", {}).get("content")) and "passages" in good.get("result", {}).get("structuredContent", {})),
        ("an empty query is a tool's error", empty.get("result", {}).get("isError") is True),
        ("a wrong date is a tool's error", days.get("result", {}).get("isError") is True),
        ("an unknown tool is refused", ask(6, "tools/call", name="nope").get("error", {}).get("code") == -32602),
        ("an unknown argument is refused", ask(7, "tools/call", name="search_docs", arguments={"x": 1}).get("error", {}).get("code") == -32602),
        ("an unknown method is refused", ask(8, "nope").get("error", {}).get("code") == -32601),
    ]
