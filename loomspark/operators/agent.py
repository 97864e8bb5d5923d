"""Question answering over the stores: route, retrieve, grade, rewrite, answer.

Language models are plain callables with deterministic defaults; every
retriever returns a lazy DataFrame, and only its few top rows reach the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

STORES = ("sql_db", "graph_db", "vector_db")
TRIGGERS = {
    "sql_db": ("how many", "count", "average", "total", "quanti", "quante", "number of", "trend"),
    "graph_db": ("relation", "related", "connected", "between", "relazione", "linked", "who"),
}
_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_CALLS = re.compile(r"(?i)\b(try_reflect|reflect|java_method)\s*\(")  # functions that run code of the class path


@dataclass
class State:
    question: str
    asked: str = ""
    stores: list[str] = field(default_factory=list)
    evidence: dict[str, list[str]] = field(default_factory=dict)
    rounds: int = 0
    steps: list[str] = field(default_factory=list)
    answer: str = ""


def route(question: str) -> list[str]:
    """Stores whose trigger words occur; the vector store when none does."""
    q = question.lower()
    hit = [s for s in STORES if any(t in q for t in TRIGGERS.get(s, ()))]
    return hit or ["vector_db"]


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """A generated statement, fences removed, if it only reads: Spark's parser decides, and the whole plan is walked."""
    sql = re.sub(r"```[A-Za-z]*", "", text).strip().rstrip(";")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ValueError("not a single statement") from e
    if _CALLS.search(sql) or not _only_reads(spark, plan):
        raise ValueError("only a single query is allowed")
    return spark.sql(sql)


def _only_reads(spark: SparkSession, plan) -> bool:
    """No command, no insert (a statement of its own), no script in the parsed plan or the queries named in it."""
    of = spark._jvm.java.lang.Class.forName
    refused = [of(_LOGICAL + x) for x in ("Command", "ParsedStatement", "ScriptTransformation")]
    open_ = [plan]
    while open_:
        node = open_.pop()
        if any(c.isInstance(node) for c in refused):
            return False
        for group in (node.children(), node.innerChildren()):
            it = group.iterator()
            while it.hasNext():
                child = it.next()
                if of(_LOGICAL + "LogicalPlan").isInstance(child):
                    open_.append(child)
    return True


def context(evidence: dict[str, list[str]], limit: int = 25_000) -> str:
    """Evidence in the order vector, graph, SQL; "no context" where all stores are empty."""
    parts = [*evidence.get("vector_db", []), *evidence.get("graph_db", []), *(f"SQL Result: {x}" for x in evidence.get("sql_db", []))]
    return "\n".join(parts)[:limit] or "no context"


def answer(
    question: str,
    retrievers: dict[str, Callable[[str], DataFrame]],
    router: Callable[[str], list[str]] = route,
    grade: Callable[[str, str], bool] = lambda q, c: c != "no context",
    rewrite: Callable[[str], str] = lambda q: q,
    generate: Callable[[str, str], str] = lambda q, c: c,
    retries: int = 2,
    rows: int = 50,
    shown: tuple[int, int] = (1000, 2000),
) -> State:
    """At most ``retries`` rewrites; a store's evidence is replaced when it is asked again; a failing grader counts as content.

    The stores are asked at the same time, each in a thread of its own. The
    grader sees the first ``shown`` characters of the question and the context.
    """
    state = State(question, question)
    while True:
        state.stores = [s for s in router(state.asked) if s in retrievers] or [s for s in ("vector_db",) if s in retrievers]
        state.steps.append("route:" + ",".join(state.stores))
        ask = lambda s: [" | ".join(map(str, r)) for r in retrievers[s](state.asked).limit(rows).collect()]
        with ThreadPoolExecutor(max(len(state.stores), 1)) as pool:
            state.evidence |= dict(zip(state.stores, pool.map(ask, state.stores)))
        found = context(state.evidence)
        try:
            good = grade(state.question[: shown[0]], found[: shown[1]])
        except Exception:  # noqa: BLE001
            good = True
        state.steps.append(f"grade:{good}")
        if good or state.rounds >= retries:
            break
        state.rounds += 1
        state.asked = rewrite(state.asked)
    state.answer = generate(state.question, found)
    return state


def service(ask: Callable[[str], State], host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """An HTTP server, not yet running, that answers POST /ask {"question": ...} with answer, stores, contexts and steps as JSON."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:  # noqa: N802
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                question = body["question"] if self.path == "/ask" else None
            except (ValueError, KeyError, TypeError):
                question = None
            if not isinstance(question, str) or not question.strip():
                return self._send(404 if self.path != "/ask" else 400, {"error": "no question"})
            try:
                state = ask(question)
            except Exception as e:  # noqa: BLE001
                return self._send(500, {"error": type(e).__name__})
            self._send(200, {"answer": state.answer, "stores": state.stores, "contexts": state.evidence, "steps": state.steps})

        def _send(self, code: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
