"""Process graphs in JSON, bound to operators: nodes become calls, callbacks become functions that build Columns.

{"a": {"process_id": "filter_bands", "arguments": {"data": {"from_parameter": "cube"}, "bands": ["B1"]}, "result": true}}
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from gridloom.errors import ProcessParameterMissing
from gridloom.functions.reducers import Group, Series
from gridloom.plans.registry import processes


def bound(process: Callable, named: dict) -> Callable:
    """A call with references resolved from `named`; arguments that the process doesn't take are left out."""

    def run(arguments: dict):
        known = inspect.signature(process).parameters
        spread = any(p.kind is p.VAR_KEYWORD for p in known.values())
        return process(**{k: v for k, v in arguments.items() if k in known or spread})

    return run


class Graph:
    def __init__(self, nodes: dict, extra: dict[str, Callable] | None = None):
        self.nodes = nodes
        self.processes = {**processes(), **(extra or {})}

    def result(self, parameters: dict | None = None):
        """The value of the result node. Each node is bound once, its inputs first."""
        done: dict = {}
        params = parameters or {}

        def value(x):
            if isinstance(x, dict):
                if "from_node" in x:
                    return node(x["from_node"])
                if "from_parameter" in x:
                    if x["from_parameter"] not in params:
                        raise ProcessParameterMissing(x["from_parameter"])
                    return params[x["from_parameter"]]
                if "process_graph" in x:
                    return self._callback(x["process_graph"], params)
                return {k: value(v) for k, v in x.items()}
            return [value(v) for v in x] if isinstance(x, list) else x

        def node(name: str):
            if name not in done:
                spec = self.nodes[name]
                done[name] = self._call(spec["process_id"], {k: value(v) for k, v in spec.get("arguments", {}).items()}, params)
            return done[name]

        last = next((n for n, s in self.nodes.items() if s.get("result")), None) or next(reversed(self.nodes))
        return node(last)

    def _call(self, name: str, arguments: dict, params: dict):
        process = self.processes[name]
        known = list(inspect.signature(process).parameters)
        # the first parameter of cube operators is the cube, which graphs call data (or cube1)
        for given in ("data", "cube1", "parameters"):
            if given in arguments and given not in known and known and known[0] == "cube":
                arguments["cube"] = arguments.pop(given)
        if known and known[0] == "spark" and "spark" not in arguments:
            arguments["spark"] = params["spark"]
        if "process" in arguments and name in ("reduce_dimension", "reduce_spatial", "aggregate_temporal", "aggregate_temporal_period", "aggregate_spatial") and "reducer" not in arguments:
            arguments["reducer"] = arguments.pop("process")
        return bound(process, params)(arguments)

    def _callback(self, nodes: dict, outer: dict) -> Callable:
        inner = Graph(nodes)
        inner.processes = self.processes
        only = next(iter(nodes.values())) if len(nodes) == 1 else None

        def call(*args, context=None, **named):
            params = {**outer, "context": context, **named}
            if len(args) == 1:
                params |= {"x": args[0], "data": args[0], "value": args[0]}
            elif len(args) >= 2:
                params |= {"x": args[0], "y": args[1], "parameters": args[1]}
                params |= {"data": args[0]} if isinstance(args[0], (Group, Series)) else {}
            return inner.result(params)

        if only and getattr(self.processes.get(only["process_id"]), "along", False):
            call.along = True
        return call
