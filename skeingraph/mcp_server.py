"""Tools of a model context protocol server, bound to one repository.

What a tool takes follows from the query it stands for: `agent.SHAPES` names the queries over facts,
and those that plan files take a limit for these as well."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from skeingraph.plans import agent
from skeingraph.plans.service import Service, error_of
from skeingraph.sources.store import StoreError

#: Parameter -> default, least and most.
LIMITS = {"file_limit": (agent.FILES, 1, 50), "fact_limit": (agent.FACTS, 1, 200)}
WITH_FILES = ("read_plan", "pack")
ABOUT = {
    "status": "Whether the index is fresh.", "languages": "Supported languages and indexed files of each.", "update": "Create or update the index.", "resolve": "Resolve a symbol, qualified name or path.",
    "who_calls": "Direct callers of a symbol.", "calls": "What a symbol calls.", "impact": "Calls, imports and inheritance one hop away.", "read_plan": "Files to read before a change.", "pack": "Target, facts, evidence and files to read.",
}


def parameters(command: str) -> list[inspect.Parameter]:
    if command in ("status", "languages", "update"):
        return []
    one = lambda name, kind, **default: inspect.Parameter(name, inspect.Parameter.POSITIONAL_OR_KEYWORD, annotation=kind, **default)
    limits = [n for n in LIMITS if command in agent.SHAPES and (n == "fact_limit" or command in WITH_FILES)]
    return [one("query", str), *(one(n, int, default=LIMITS[n][0]) for n in limits)]


def tool(service: Service, command: str) -> Callable:
    """A function with the command's parameters; limits out of bounds are moved to the bound."""
    takes = inspect.Signature(parameters(command))

    def run(*args, **named):
        given = takes.bind(*args, **named)
        given.apply_defaults()
        values = {n: min(max(v, LIMITS[n][1]), LIMITS[n][2]) if n in LIMITS else v for n, v in given.arguments.items()}
        try:
            return getattr(service, command)(**values)
        except (OSError, ValueError, StoreError) as e:
            return {"status": "error", "error": error_of(e)}

    run.__name__, run.__doc__, run.__signature__ = command, ABOUT[command], takes
    run.__annotations__ = {p.name: p.annotation for p in takes.parameters.values()}
    return run


def tools(service: Service, prefix: str = "graph") -> dict[str, Callable]:
    return {f"{prefix}_{command}": tool(service, command) for command in ABOUT}


def create_server(service: Service):
    try:
        from mcp.server.fastmcp import FastMCP
    except ModuleNotFoundError as e:
        raise RuntimeError("the mcp package is not installed") from e
    server = FastMCP("skeingraph")
    for name, f in tools(service).items():
        server.add_tool(f, name=name, structured_output=True)
    return server
