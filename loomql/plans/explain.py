"""Plans as text and as trees, for EXPLAIN and for tests that pin a plan."""

from __future__ import annotations

import contextlib
import io
import json
import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints: simple, extended, codegen, cost or formatted."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode=mode)
    return out.getvalue()


def plan_tree(df: DataFrame) -> dict:
    """The physical plan as nested {node, detail, plans}."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    root: dict = {"node": "", "detail": "", "plans": []}
    stack = [(-1, root)]
    for line in lines:
        if not (m := re.match(r"^([\s:|+-]*)(?:\*\(\d+\) )?(\w.*)$", line)) or "==" in line:
            continue
        depth, text = len(m[1]), m[2]
        while stack[-1][0] >= depth:
            stack.pop()
        node = {"node": re.match(r"\w+", text)[0], "detail": text, "plans": []}
        stack[-1][1]["plans"].append(node)
        stack.append((depth, node))
    return root["plans"][0] if root["plans"] else root


def nodes(df: DataFrame) -> list[str]:
    """Names of the plan's operators, from the top."""
    def walk(n: dict) -> list[str]:
        return [n["node"], *[x for p in n["plans"] for x in walk(p)]]

    return walk(plan_tree(df))


def explain(df: DataFrame, form: str = "text", analyze: bool = False) -> str:
    """EXPLAIN (FORMAT text, json, yaml or xml); ``analyze`` runs the query first, so that adaptive plans are final."""
    if analyze:
        df.write.format("noop").mode("overwrite").save()
    if form == "text":
        return plan_text(df)
    tree = plan_tree(df)
    if form == "json":
        return json.dumps(tree, indent=2)
    if form == "yaml":
        def lines(n: dict, pad: str) -> list[str]:
            head = [f"{pad}- node: {n['node']}", f"{pad}  detail: {json.dumps(n['detail'])}"]
            return head + ([f"{pad}  plans:"] + [x for p in n["plans"] for x in lines(p, pad + "    ")] if n["plans"] else [])

        return "\n".join(lines(tree, ""))
    if form == "xml":
        def element(n: dict) -> ElementTree.Element:
            e = ElementTree.Element("plan", node=n["node"], detail=n["detail"])
            e.extend([element(p) for p in n["plans"]])
            return e

        return ElementTree.tostring(element(tree), encoding="unicode")
    raise ValueError(form)
