"""REST routes over the service. ROUTES needs no web framework; create_app mounts it on FastAPI."""

from __future__ import annotations

from collections.abc import Callable

from skeingraph.plans.service import Service


class NotFound(Exception):
    pass


def found(value: dict | None, what: str) -> dict:
    if value is None:
        raise NotFound(f"{what} not found")
    return value


def routes(service: Service) -> dict[tuple[str, str], Callable]:
    """(method, path) -> handler, parameters by name."""

    def pack(q: str, file_limit: int = 10, fact_limit: int = 40):
        return service.pack(q, file_limit, fact_limit)

    def search(q: str, limit: int = 20):
        return service.search(q, limit)

    def node(node_id: str):
        return found(service.node(node_id), "node")

    def edge(edge_id: str):
        return found(service.edge(edge_id), "edge")

    def history(entity_id: str):
        return service.history(entity_id)

    def neighborhood(node_id: str, hops: int = 1, edge_types: str = ""):
        return service.neighborhood(node_id, hops, [x.strip() for x in edge_types.split(",") if x.strip()] or None)

    def path(src_id: str, dst_id: str, max_hops: int = 2):
        return service.path(src_id, dst_id, max_hops)

    return {
        ("GET", "/healthz"): lambda: service.doctor(),
        ("GET", "/index/status"): lambda: service.status(),
        ("POST", "/index/update"): lambda: service.update(),
        ("POST", "/index/repo"): lambda: service.index(),
        ("GET", "/agent/pack"): pack,
        ("GET", "/search"): search,
        ("GET", "/nodes/{node_id}"): node,
        ("GET", "/edges/{edge_id}"): edge,
        ("GET", "/history/{entity_id}"): history,
        ("GET", "/graph/neighborhood"): neighborhood,
        ("GET", "/graph/path"): path,
    }


def create_app(service: Service):
    try:
        from fastapi import FastAPI
        from fastapi.responses import JSONResponse
    except ModuleNotFoundError as e:
        raise RuntimeError("FastAPI is not installed") from e
    app = FastAPI(title="Code graph")
    app.add_exception_handler(NotFound, lambda request, e: JSONResponse({"detail": str(e)}, 404))
    for (method, path), handler in routes(service).items():
        app.add_api_route(path, handler, methods=[method], name=path)
    return app
