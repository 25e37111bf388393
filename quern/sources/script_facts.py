"""Facts of scripts: trees, scopes, bindings, value edges, calls, control flow, modules, branches.

Each script is parsed and walked where it is read (a mapInArrow leaf, one script at a time); everything after that is joins over the tables of `tables`. Ids are numbers within a script: a node's number in preorder, a binding's is its first identifier's, a function's entry and exit are -2 * f - 1 and -2 * f - 2. A value is a node or a binding; edges say what flows into what, by kind (ASSIGN, ARGUMENT, RETURN, ELEMENT, INITIAL, MUTATE, MERGE, ITERATE, OTHER). A variable is one value for all of its assignments; reaching definitions are facts of their own.

Edge cases: null code is empty; a script that can't be parsed in any mode has one `script` row with mode `failed`; one that is parsed in part has mode `loose`, its error and the facts of what could be read."""

from __future__ import annotations

import sys
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import script_parser
from .script_parser import Node, children

COLUMNS = ("fact", "a", "b", "c", "start", "stop", "kind", "name", "text")
SCHEMA = "package string, script string, fact string, a long, b long, c long, start long, stop long, kind string, name string, text string"
FUNCTIONS = frozenset(("FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression"))
LOOPS = frozenset(("ForStatement", "ForInStatement", "ForOfStatement", "WhileStatement", "DoWhileStatement"))
_SCOPES = {"Program": "page", "BlockStatement": "block", "ClassDeclaration": "class", "ClassExpression": "class", "SwitchStatement": "switch", "CatchClause": "catch", "WithStatement": "with", "ForStatement": "for", "ForInStatement": "for", "ForOfStatement": "for", "StaticBlock": "block"} | dict.fromkeys(FUNCTIONS, "function")
#: Containers whose written properties stay apart from them, and those properties.
ISOLATED = frozenset("document location window".split())
ISOLATED_PROPERTIES = frozenset("title URL cookie href hash search domain referrer location name".split())
#: Properties whose assignment writes markup.
MARKUP_PROPERTIES = frozenset("innerHTML outerHTML".split())
_GLOBALS = frozenset("window self globalThis".split())
_DULL = frozenset("== != === !== < > <= >= in instanceof".split())


def static_value(e: Node | None):
    """(kind, text) of a literal, undefined, a template without expressions or a signed number; None if it isn't known."""
    if e is None:
        return None
    if e["type"] == "Literal" and e["kind"] != "regex":
        return e["kind"], e["value"]
    if e["type"] == "TemplateLiteral" and not e["expressions"]:
        return "string", e["quasis"][0]["value"]
    if e["type"] == "Identifier" and e["name"] == "undefined":
        return "undefined", "undefined"
    if e["type"] == "UnaryExpression" and e["operator"] == "-" and e["argument"].get("kind") == "number":
        return "number", "-" + e["argument"]["value"]
    return None


def number(text: str) -> float | None:
    t = text.replace("_", "").rstrip("n").lower()
    try:
        sign, t = (-1, t[1:]) if t[:1] == "-" else (1, t)
        return sign * (float(int(t, 0)) if t[:2] in ("0x", "0o", "0b") else float(t))
    except ValueError:
        return None


def compare(op: str, x, y) -> bool | None:
    """Truth of a comparison of two known values by the language's rules; None where it isn't known."""
    (k, a), (m, b) = x, y
    if op in ("===", "!=="):
        same = k == m and (number(a) == number(b) if k == "number" else a == b)
        return same if op == "===" else not same
    nothing = ("null", "undefined")
    as_number = lambda kind, t: {"boolean": float(t == "true"), "null": 0.0}.get(kind, 0.0 if kind == "string" and not t.strip() else number(t.strip()) if kind in ("number", "string") else None)
    if op in ("==", "!="):
        if k in nothing or m in nothing:
            same = k in nothing and m in nothing
        elif k == m == "string":
            same = a == b
        else:
            p, q = as_number(k, a), as_number(m, b)
            same = p is not None and p == q
        return same if op == "==" else not same
    if op in ("<", ">", "<=", ">="):
        p, q = (a, b) if k == m == "string" else (as_number(k, a), as_number(m, b))
        if p is None or q is None:
            return False
        return {"<": p < q, ">": p > q, "<=": p <= q, ">=": p >= q}[op]
    return None


def truth(e: Node | None) -> bool | None:
    """Three-valued truth of an expression: None is UNKNOWN."""
    if e is None:
        return None
    v, t = static_value(e), e["type"]
    if v is not None:
        kind, text = v
        return {"string": text != "", "boolean": text == "true", "null": False, "undefined": False, "number": bool(number(text))}[kind]
    if t in ("ObjectExpression", "ArrayExpression", "ClassExpression", "NewExpression") or t in FUNCTIONS or (t == "Literal" and e["kind"] == "regex"):
        return True
    if t == "UnaryExpression" and e["operator"] == "!":
        x = truth(e["argument"])
        return None if x is None else not x
    if t == "UnaryExpression" and e["operator"] == "void":
        return False
    if t == "LogicalExpression":
        x, y = truth(e["left"]), truth(e["right"])
        if e["operator"] == "&&":
            return False if x is False or y is False else True if x and y else None
        if e["operator"] == "||":
            return True if x or y else False if x is False and y is False else None
        known = static_value(e["left"])
        return None if known is None else y if known[0] in ("null", "undefined") else x
    if t == "BinaryExpression":
        x, y = static_value(e["left"]), static_value(e["right"])
        return compare(e["operator"], x, y) if x and y else None
    return None


def url_control(e: Node | None) -> str:
    """PARTIAL where part of an address is fixed in the text, else FULL."""

    def fixed(x: Node) -> bool:
        if x["type"] == "BinaryExpression" and x["operator"] == "+":
            return fixed(x["left"]) or fixed(x["right"])
        if x["type"] == "TemplateLiteral":
            return any(q["value"] for q in x["quasis"])
        return x["type"] == "Literal" and x["kind"] == "string"

    if e is not None and (e["type"] == "TemplateLiteral" or (e["type"] == "BinaryExpression" and e["operator"] == "+")) and fixed(e):
        return "PARTIAL"
    return "FULL"


def no_string(e: Node) -> bool:
    """Whether a value surely is no string, so that eval gives it back as it is."""
    t = e["type"]
    if t == "ConditionalExpression":
        return no_string(e["consequent"]) and no_string(e["alternate"])
    return t in FUNCTIONS or t in ("ObjectExpression", "ArrayExpression", "ClassExpression", "UpdateExpression") or (t == "Literal" and e["kind"] != "string") or (t == "UnaryExpression" and e["operator"] != "typeof") or (t == "BinaryExpression" and e["operator"] != "+")


class Facts:
    def __init__(self, tree: Node):
        self.tree, self.rows, self.n = tree, [], 0
        self.scope_of: dict[int, int] = {}
        self.parent: dict[int, Node] = {}
        self.scopes: dict[int, dict] = {}
        self.alias: dict[int, str] = {}
        self.written: dict[int, int] = {}
        self.functions: dict[int, Node] = {}
        self.known_function: dict[int, Node] = {}
        self.globals: dict[str, int] = {}
        self.anonymous = 0

    def emit(self, fact: str, a=None, b=None, c=None, start=None, stop=None, kind=None, name=None, text=None) -> None:
        self.rows.append((fact, a, b, c, start, stop, kind, name, text))

    def edge(self, src: int | None, dst: int | None, kind: str) -> None:
        if src is not None and dst is not None and src != dst:
            self.emit("edge", src, dst, kind=kind)

    # --- trees and scopes --------------------------------------------------

    def number(self) -> None:
        """Numbers the nodes, opens the scopes and writes both."""
        stack: list[tuple[Node, Node | None, str, int, int | None]] = [(self.tree, None, "", 0, None)]
        while stack:
            node, parent, field, place, scope = stack.pop()
            node["id"] = k = self.n
            self.n += 1
            if parent is not None:
                self.parent[k] = parent
            t = node["type"]
            text = node.get("operator") or node.get("name") or (node.get("value") if isinstance(node.get("value"), str) else None)
            self.emit("node", k, None if parent is None else parent["id"], place, node["start"], node["end"], t, field, text)
            if t in FUNCTIONS:
                self.functions[k] = node
            if t in _SCOPES and not (t == "BlockStatement" and parent is not None and (parent["type"] in FUNCTIONS or parent["type"] == "CatchClause")):
                name = None
                if _SCOPES[t] in ("function", "class"):
                    own = node.get("_name")
                    name = own["name"] if own else None
                    if name is None and _SCOPES[t] == "function":
                        name, self.anonymous = f"anonymous_{self.anonymous}", self.anonymous + 1
                self.scopes[k] = {"parent": scope, "kind": _SCOPES[t], "names": {}, "node": node}
                self.emit("scope", k, scope, start=node["start"], stop=node["end"], kind=_SCOPES[t], name=name)
                inner = k
            else:
                inner = scope
            self.scope_of[k] = inner
            for f, i, child in reversed(list(children(node))):
                # a function's and a class's name is seen outside (declarations) or inside (expressions)
                outside = f == "_name" and t.endswith("Declaration")
                stack.append((child, node, f.lstrip("_"), i, scope if outside else inner))

    def near(self, scope: int, kinds: tuple[str, ...]) -> int:
        while self.scopes[scope]["kind"] not in kinds:
            scope = self.scopes[scope]["parent"]
        return scope

    def bind(self, ident: Node, scope: int, kind: str) -> int:
        names = self.scopes[scope]["names"]
        if ident["name"] not in names:
            names[ident["name"]] = ident["id"]
            self.emit("binding", ident["id"], scope, kind=kind, name=ident["name"])
        return names[ident["name"]]

    def find(self, name: str, scope: int | None) -> int | None:
        while scope is not None:
            s = self.scopes[scope]
            if name in s["names"]:
                return s["names"][name]
            scope = s["parent"]
        return None

    def value_of_name(self, ident: Node) -> int:
        """The binding of a name; an undeclared one is the script's global."""
        found = self.find(ident["name"], self.scope_of[ident["id"]])
        if found is None:
            name = ident["name"]
            if name not in self.globals:
                self.globals[name] = ident["id"]
                self.emit("binding", ident["id"], self.tree["id"], kind="global", name=name)
                self.scopes[self.tree["id"]].setdefault("globals", {})[name] = ident["id"]
            found = self.globals[name]
        return found

    def names_in(self, pattern: Node | None) -> list[Node]:
        if pattern is None:
            return []
        t = pattern["type"]
        if t == "Identifier":
            return [pattern]
        if t == "AssignmentPattern":
            return self.names_in(pattern["left"])
        if t == "RestElement":
            return self.names_in(pattern["argument"])
        if t == "ArrayPattern":
            return [x for e in pattern["elements"] for x in self.names_in(e)]
        if t == "ObjectPattern":
            return [x for p in pattern["properties"] for x in self.names_in(p.get("value") or p.get("argument"))]
        return []

    def declare(self) -> None:
        """Binds all declared names; var and functions are hoisted."""
        for node in self.all():
            t, scope = node["type"], self.scope_of[node["id"]]
            if t == "VariableDeclaration":
                at = self.near(scope, ("function", "page")) if node["kind"] == "var" else scope
                for d in node["declarations"]:
                    for x in self.names_in(d["_target"]):
                        self.bind(x, at, node["kind"])
            elif t in FUNCTIONS:
                if node.get("_name"):
                    outer = self.scopes[node["id"]]["parent"] if t == "FunctionDeclaration" else node["id"]
                    self.bind(node["_name"], outer, "function")
                for k, p in enumerate(node["params"]):
                    for x in self.names_in(p):
                        b = self.bind(x, node["id"], "param")
                        if p["type"] in ("Identifier", "AssignmentPattern", "RestElement"):
                            self.emit("param", node["id"], b, k, name=x["name"])
            elif t in ("ClassDeclaration", "ClassExpression") and node.get("_name"):
                self.bind(node["_name"], self.scopes[node["id"]]["parent"] if t == "ClassDeclaration" else node["id"], "class")
            elif t == "CatchClause":
                for x in self.names_in(node["param"]):
                    self.bind(x, node["id"], "catch")
            elif t == "ImportDeclaration":
                for s in node["specifiers"]:
                    b = self.bind(s["local"], self.tree["id"], "import")
                    what = "*" if s["type"] == "ImportNamespaceSpecifier" else "default" if s["type"] == "ImportDefaultSpecifier" else s["imported"].get("name") or s["imported"].get("value")
                    self.emit("import", b, kind=what, name=s["local"]["name"], text=node["source"]["value"])
                if not node["specifiers"]:
                    self.emit("import", kind="", text=node["source"]["value"])

    def all(self):
        stack = [self.tree]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for _, _, x in reversed(list(children(node))))

    # --- values ------------------------------------------------------------

    def dotted(self, e: Node) -> str | None:
        """The dotted name of a value whose root is global, through names that stand for such a value; instances of a global class as Class.prototype."""
        t = e["type"]
        if t == "Identifier":
            b = self.find(e["name"], self.scope_of[e["id"]])
            if b is None:
                return "chrome" if e["name"] == "browser" else "" if e["name"] in _GLOBALS else e["name"]
            return self.alias.get(b)
        if t == "MemberExpression":
            base = self.dotted(e["object"])
            if base is None:
                return None
            p = e["property"]
            name = p["name"] if not e["computed"] else (static_value(p) or (None, None))[1] if static_value(p) and static_value(p)[0] == "string" else None
            return None if name is None else f"{base}.{name}" if base else name
        if t == "NewExpression":
            base = self.dotted(e["callee"])
            return f"{base}.prototype" if base else None
        return None

    def stand_for(self) -> None:
        """Names that are written once, with a value that has a dotted name; and names and properties of functions."""
        for node in self.all():
            if node["type"] == "AssignmentExpression":
                for x in self.names_in(node["left"]):
                    b = self.find(x["name"], self.scope_of[x["id"]])
                    self.written[b] = self.written.get(b, 0) + 1
            elif node["type"] == "VariableDeclarator" and node["init"] is not None:
                for x in self.names_in(node["_target"]):
                    b = self.find(x["name"], self.scope_of[x["id"]])
                    self.written[b] = self.written.get(b, 0) + 1
            elif node["type"] == "FunctionDeclaration" and node.get("_name"):
                b = self.find(node["_name"]["name"], self.scope_of[node["_name"]["id"]])
                self.written[b] = self.written.get(b, 0) + 1
                self.known_function[b] = node
        for node in self.all():
            if node["type"] != "VariableDeclarator" or node["init"] is None:
                continue
            target, init = node["_target"], node["init"]
            for x in self.names_in(target):
                b = self.find(x["name"], self.scope_of[x["id"]])
                if self.written.get(b) != 1:
                    continue
                if target["type"] == "Identifier":
                    if init["type"] in FUNCTIONS:
                        self.known_function[b] = init
                    elif name := self.dotted(init):
                        self.alias[b] = name
                elif target["type"] == "ObjectPattern" and (base := self.dotted(init)) is not None:
                    for p in target["properties"]:
                        if p["type"] == "Property" and not p["computed"] and p["value"] is x:
                            key = p["key"].get("name") or p["key"].get("value")
                            self.alias[b] = f"{base}.{key}" if base else key

    def function_of(self, e: Node) -> Node | None:
        """The function that an expression surely is."""
        if e["type"] in FUNCTIONS:
            return e
        if e["type"] == "Identifier":
            b = self.find(e["name"], self.scope_of[e["id"]])
            return self.known_function.get(b) if self.written.get(b) == 1 else None
        return None

    def into(self, pattern: Node | None, src: int | None, kind: str) -> None:
        """Edges from a value into all that a pattern assigns."""
        if pattern is None:
            return
        t = pattern["type"]
        if t == "Identifier":
            self.edge(src, self.value_of_name(pattern), kind)
        elif t == "MemberExpression":
            self.write(pattern, src)
        elif t == "AssignmentPattern":
            self.into(pattern["left"], src, kind)
            self.into(pattern["left"], pattern["right"]["id"], "ASSIGN")
        elif t == "RestElement":
            self.into(pattern["argument"], src, "COPY")
        elif t == "ArrayPattern":
            for e in pattern["elements"]:
                self.into(e, src, "ELEMENT")
        elif t == "ObjectPattern":
            for p in pattern["properties"]:
                target = p.get("value") or p.get("argument")
                self.into(target, src, "ELEMENT")
                if p["type"] == "Property" and not p["computed"]:
                    for x in self.names_in(target):
                        self.emit("destructured", src, self.value_of_name(x), kind=t, name=p["key"].get("name") or p["key"].get("value"))

    def write(self, member: Node, src: int | None) -> None:
        """An assignment to a property: its container holds the value, but for those that are set apart."""
        name = None if member["computed"] else member["property"].get("name")
        root = self.dotted(member["object"])
        if name in MARKUP_PROPERTIES and src is not None:
            self.emit("markup", member["id"], src, kind="DOM_INNER_HTML", name=name)
        if root is not None and (root == "" or root.split(".")[-1] in ISOLATED) and name in ISOLATED_PROPERTIES:
            self.emit("isolated", member["id"], src, name=f"{root}.{name}")
            return
        target = member["object"]
        self.edge(src, target["id"], "MUTATE")
        while target["type"] == "MemberExpression":
            self.edge(src, target["object"]["id"], "MUTATE")
            target = target["object"]
        if target["type"] == "Identifier":
            self.edge(src, self.value_of_name(target), "MUTATE")

    def values(self) -> None:
        """Edges of every expression, calls with their arguments, returns, properties."""
        owner = self.owner
        for node in self.all():
            t, k = node["type"], node["id"]
            if t == "Identifier":
                p = self.parent.get(k)
                if p is not None and self.reads(node, p):
                    b = self.value_of_name(node)
                    self.edge(b, k, "ASSIGN")
                    self.emit("use", k, b, owner(node), name=node["name"])
            elif t == "MemberExpression":
                self.edge(node["object"]["id"], k, "ELEMENT")
                name = self.dotted(node)
                if name:
                    self.emit("member", k, node["object"]["id"], name=name)
            elif t == "VariableDeclarator" and node["init"] is not None:
                self.into(node["_target"], node["init"]["id"], "ASSIGN")
            elif t == "AssignmentExpression":
                self.into(node["left"], node["right"]["id"], "ASSIGN")
                self.edge(node["right"]["id"], k, "ASSIGN")
                if node["operator"] != "=":
                    self.edge(node["left"]["id"], k, "ASSIGN")
            elif t == "BinaryExpression" and node["operator"] not in _DULL:
                for x in ("left", "right"):
                    self.edge(node[x]["id"], k, "MERGE")
            elif t == "LogicalExpression":
                for x in ("left", "right"):
                    self.edge(node[x]["id"], k, "MERGE")
            elif t == "ConditionalExpression":
                for x in ("consequent", "alternate"):
                    self.edge(node[x]["id"], k, "MERGE")
            elif t == "SequenceExpression":
                self.edge(node["expressions"][-1]["id"], k, "ASSIGN")
            elif t == "TemplateLiteral":
                for x in node["expressions"]:
                    self.edge(x["id"], k, "MERGE")
            elif t in ("AwaitExpression", "SpreadElement", "YieldExpression") and node["argument"] is not None:
                self.edge(node["argument"]["id"], k, "OTHER")
            elif t == "ArrayExpression":
                for x in node["elements"]:
                    if x is not None:
                        self.edge(x["id"], k, "INITIAL")
            elif t == "ObjectExpression":
                for p in node["properties"]:
                    v = p.get("value") or p.get("argument")
                    self.edge(v["id"], k, "INITIAL")
                    if p["type"] == "Property" and not p["computed"]:
                        self.emit("property", k, v["id"], name=p["key"].get("name") or p["key"].get("value"), text=(static_value(v) or (None, None))[1])
            elif t in ("ForOfStatement", "ForInStatement"):
                left = node["left"]
                target = left["declarations"][0]["_target"] if left["type"] == "VariableDeclaration" else left
                self.into(target, node["right"]["id"], "ITERATE")
            elif t == "ReturnStatement" and node["argument"] is not None:
                f = owner(node)
                self.emit("return", f, node["argument"]["id"])
            elif t == "ArrowFunctionExpression" and node["body"]["type"] != "BlockStatement":
                self.emit("return", k, node["body"]["id"])
            elif t in ("CallExpression", "NewExpression"):
                self.call(node)
            elif t in ("ClassDeclaration", "ClassExpression"):
                parent = node["superClass"]
                self.emit("class", k, None if parent is None else self.value_of_name(parent) if parent["type"] == "Identifier" else None, kind=t, name=(node.get("_name") or {}).get("name"))
                for m in node["body"]["body"]:
                    if m["type"] in ("MethodDefinition", "PropertyDefinition") and not m["computed"]:
                        self.emit("class_member", k, m["value"]["id"] if m["value"] else None, kind="static" if m["static"] else "instance", name=m["key"].get("name") or m["key"].get("value"))
            elif t == "ExportNamedDeclaration":
                source = node["source"]["value"] if node["source"] else None
                for s in node["specifiers"]:
                    name, local = (s[x].get("name") or s[x].get("value") for x in ("exported", "local"))
                    b = None if source else self.find(local, self.tree["id"])
                    self.emit("export", b, kind=local, name=name, text=source)
                d = node["declaration"]
                if d is not None:
                    idents = [x for v in d["declarations"] for x in self.names_in(v["_target"])] if d["type"] == "VariableDeclaration" else [d["_name"]] if d.get("_name") else []
                    for x in idents:
                        self.emit("export", self.value_of_name(x), kind=x["name"], name=x["name"])
            elif t == "ExportDefaultDeclaration":
                d = node["declaration"]
                self.emit("export", self.value_of_name(d["_name"]) if d.get("_name") else d["id"], kind="default", name="default")
            elif t == "ExportAllDeclaration":
                self.emit("export", kind="*", name=node["exported"]["name"] if node["exported"] else "*", text=node["source"]["value"])
            if t in ("IfStatement", "ConditionalExpression", *LOOPS) and node.get("test") is not None:
                x = truth(node["test"])
                self.emit("branch", node["test"]["id"], kind="loop" if t in LOOPS else "branch", text="UNKNOWN" if x is None else str(x).upper())

    def reads(self, node: Node, p: Node) -> bool:
        """Whether an identifier is a value that is read."""
        t = p["type"]
        if t == "MemberExpression":
            return p["object"] is node or p["computed"]
        if t in ("Property", "MethodDefinition", "PropertyDefinition"):
            if t == "Property" and self.parent.get(p["id"], {}).get("type") == "ObjectPattern":
                return False
            return p["value"] is node or (p["key"] is node and p["computed"])
        if t == "VariableDeclarator":
            return p["init"] is node
        if t == "AssignmentExpression":
            return p["right"] is node or p["operator"] != "="
        if t == "AssignmentPattern":
            return p["right"] is node
        if t in FUNCTIONS:
            return p["body"] is node
        return t not in ("ArrayPattern", "RestElement", "CatchClause", "LabeledStatement", "BreakStatement", "ContinueStatement", "ClassDeclaration", "MetaProperty", "ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier", "ExportSpecifier", "ExportAllDeclaration") and not (t == "ClassExpression" and p["superClass"] is not node)

    def owner(self, node: Node) -> int:
        """The function (or the program) that a node is in."""
        p = self.parent.get(node["id"])
        while p is not None and p["type"] not in FUNCTIONS:
            p = self.parent.get(p["id"])
        return p["id"] if p is not None else self.tree["id"]

    def call(self, node: Node) -> None:
        k, callee = node["id"], node["callee"]
        is_new = node["type"] == "NewExpression"
        name = self.dotted(callee)
        if is_new and name:
            name += ".prototype.constructor"
        method = callee["property"].get("name") if callee["type"] == "MemberExpression" and not callee["computed"] else None
        f = self.function_of(callee)
        b = self.find(callee["name"], self.scope_of[callee["id"]]) if callee["type"] == "Identifier" else None
        self.emit("call", k, b, None if f is None else f["id"], node["start"], node["end"], node["type"], name or (f"*.{method}" if method else None), method)
        for i, x in enumerate(node["arguments"]):
            g, v = self.function_of(x), static_value(x)
            guard = "callable" if g is not None else "no_string" if no_string(x) else ""
            self.emit("arg", k, x["id"], i, None if g is None else g["id"], None, x["type"], guard or url_control(x), None if v is None else v[1])
            if f is not None:
                for j, p in enumerate(f["params"]):
                    if j == i:
                        self.into(p, x["id"], "ARGUMENT")
        if f is not None:
            self.emit("calls", k, f["id"])
        elif callee["type"] == "MemberExpression":
            if method in ("then", "catch", "finally", "map", "forEach", "filter", "find", "some", "every", "flatMap", "reduce"):
                for x in node["arguments"][:2]:
                    g = self.function_of(x)
                    if g is not None:
                        self.emit("calls", k, g["id"])
                        if g["params"]:
                            self.into(g["params"][-1 if method == "reduce" and len(g["params"]) == 2 else 0], callee["object"]["id"], "ARGUMENT")
            self.edge(callee["object"]["id"], k, "RETURN")
            if method in ("push", "unshift", "set", "add", "append", "concat"):
                for x in node["arguments"]:
                    self.edge(x["id"], callee["object"]["id"], "MUTATE")
                    self.edge(x["id"], k, "MERGE")
                    if callee["object"]["type"] == "Identifier":
                        self.edge(x["id"], self.value_of_name(callee["object"]), "MUTATE")

    # --- control flow ------------------------------------------------------

    def control(self) -> dict[int, dict[int, list[tuple[int, str]]]]:
        """Graphs of the program and of each function: node -> (successor, kind)."""
        out = {}
        for f in (self.tree, *self.functions.values()):
            graph: dict[int, list[tuple[int, str]]] = {}
            entry, exit_ = -2 * f["id"] - 1, -2 * f["id"] - 2
            body = f["body"] if f["type"] == "Program" else f["body"]["body"] if f["body"]["type"] == "BlockStatement" else None

            def link(a, b, kind="NORMAL", graph=graph):
                if (b, kind) not in graph.setdefault(a, []):
                    graph[a].append((b, kind))

            def follow(stmts, nxt, jumps):
                for s in reversed(stmts):
                    nxt = flow(s, nxt, jumps, None)
                return nxt

            def flow(s, nxt, jumps, label, link=link, exit_=exit_):
                t, k = s["type"], s["id"]
                inner = lambda brk, cont: jumps | {"break": brk, "continue": cont} | ({("break", label): brk, ("continue", label): cont} if label else {})
                if t in ("BlockStatement", "StaticBlock"):
                    return follow(s["body"], nxt, jumps)
                if t in ("EmptyStatement", "FunctionDeclaration", "ImportDeclaration", "ExportAllDeclaration", "DebuggerStatement"):
                    return nxt
                if t == "ExpressionStatement":
                    link(s["expression"]["id"], nxt)
                    return s["expression"]["id"]
                if t in ("ExportNamedDeclaration", "ExportDefaultDeclaration"):
                    d = s["declaration"]
                    if d is None or d["type"] == "FunctionDeclaration":
                        return nxt
                    return flow(d, nxt, jumps, None) if d["type"].endswith("Declaration") else (link(d["id"], nxt), d["id"])[1]
                if t == "IfStatement":
                    test = s["test"]["id"]
                    yes = flow(s["consequent"], nxt, jumps, None)
                    no = nxt if s["alternate"] is None else flow(s["alternate"], nxt, jumps, None)
                    link(test, yes, "TRUE"), link(test, no, "FALSE")
                    return test
                if t == "WhileStatement":
                    test = s["test"]["id"]
                    link(test, flow(s["body"], test, inner(nxt, test), None), "TRUE"), link(test, nxt, "FALSE")
                    return test
                if t == "DoWhileStatement":
                    test = s["test"]["id"]
                    body = flow(s["body"], test, inner(nxt, test), None)
                    link(test, body, "TRUE"), link(test, nxt, "FALSE")
                    return body
                if t == "ForStatement":
                    head = s["test"]["id"] if s["test"] else k
                    again = s["update"]["id"] if s["update"] else head
                    if s["update"]:
                        link(again, head)
                    link(head, flow(s["body"], again, inner(nxt, again), None), "TRUE" if s["test"] else "NORMAL")
                    if s["test"]:
                        link(head, nxt, "FALSE")
                    if s["init"] is None:
                        return head
                    link(s["init"]["id"], head)
                    return s["init"]["id"]
                if t in ("ForOfStatement", "ForInStatement"):
                    link(k, flow(s["body"], k, inner(nxt, k), None), "TRUE"), link(k, nxt, "FALSE")
                    return k
                if t == "LabeledStatement":
                    return flow(s["body"], nxt, jumps | {("break", s["label"]["name"]): nxt}, s["label"]["name"])
                if t in ("BreakStatement", "ContinueStatement"):
                    word = "break" if t == "BreakStatement" else "continue"
                    return jumps.get((word, s["label"]["name"]) if s["label"] else word, exit_)
                if t in ("ReturnStatement", "ThrowStatement"):
                    a = s["argument"]["id"] if s["argument"] else k
                    link(a, jumps.get("throw", exit_) if t == "ThrowStatement" else jumps.get("return", exit_), "EXCEPTION" if t == "ThrowStatement" else "NORMAL")
                    return a
                if t == "SwitchStatement":
                    subject, at, entries = s["discriminant"]["id"], nxt, []
                    own = jumps | {"break": nxt}
                    for c in reversed(s["cases"]):
                        at = follow(c["consequent"], at, own)
                        entries.append((c, at))
                    for c, e in reversed(entries):
                        if c["test"] is not None:
                            x, y = static_value(s["discriminant"]), static_value(c["test"])
                            link(subject, e, "CASE")
                            self.emit("case", subject, e, c["test"]["id"], text=None if not (x and y) else str(compare("===", x, y)).upper())
                    link(subject, next((e for c, e in entries if c["test"] is None), nxt), "DEFAULT")
                    return subject
                if t == "TryStatement":
                    after = nxt if s["finalizer"] is None else follow(s["finalizer"]["body"], nxt, jumps)
                    handler = after if s["handler"] is None else follow(s["handler"]["body"]["body"], after, jumps)
                    entry = follow(s["block"]["body"], after, jumps | {"throw": handler})
                    if s["handler"] is not None:
                        link(s["block"]["id"], handler, "EXCEPTION")
                    link(s["block"]["id"], entry)
                    return s["block"]["id"]
                if t == "WithStatement":
                    link(s["object"]["id"], flow(s["body"], nxt, jumps, None))
                    return s["object"]["id"]
                link(k, nxt)
                return k

            if body is None:
                link(entry, f["body"]["id"]), link(f["body"]["id"], exit_)
            else:
                link(entry, follow(body, exit_, {}))
            out[f["id"]] = graph
            for a, succ in graph.items():
                for k, (b, kind) in enumerate(succ):
                    self.emit("flow", a, b, f["id"], start=k, kind=kind)
        return out

    def reaching(self, graphs) -> None:
        """Which assignments reach which reads, in each function: a worklist over its graph; an assignment ends the others of its name. (use, assignment) with the binding; assignments are nodes."""
        where: dict[int, tuple[int, int]] = {}
        for f, graph in graphs.items():
            where |= {p: (f, p) for p in {*graph, *(b for s in graph.values() for b, _ in s)} if p >= 0}

        def point(node):
            """The nearest point of the graph that holds a node."""
            while node is not None and node["id"] not in where:
                if node["type"] in FUNCTIONS:
                    return None
                node = self.parent.get(node["id"])
            return None if node is None else where[node["id"]]

        gens, uses = {}, {}
        for node in self.all():
            if node["type"] in ("VariableDeclarator", "AssignmentExpression", "UpdateExpression"):
                target = node.get("_target") or node.get("left") or node.get("argument")
                if node["type"] == "VariableDeclarator" and node["init"] is None:
                    continue
                at = point(node)
                if at:
                    for x in self.names_in(target):
                        gens.setdefault(at, []).append((self.value_of_name(x), node["id"]))
            elif node["type"] == "Identifier" and node["id"] in self.parent and self.reads(node, self.parent[node["id"]]):
                at = point(node)
                if at:
                    uses.setdefault(at, []).append((self.value_of_name(node), node["id"]))
        for f, graph in graphs.items():
            state: dict[int, frozenset] = {-2 * f - 1: frozenset()}
            work, held = deque(state), set(state)
            while work:
                p = work.popleft()
                held.discard(p)
                now = state[p]
                for b, d in gens.get((f, p), ()):
                    now = frozenset(x for x in now if x[0] != b) | {(b, d)}
                for q, _ in graph.get(p, ()):
                    old = state.get(q)
                    new = now if old is None else old | now
                    if new != old:
                        state[q] = new
                        if q not in held:
                            held.add(q)
                            work.append(q)
            for (g, p), reads in uses.items():
                if g == f and p in state:
                    for b, u in reads:
                        for x, d in state[p]:
                            if x == b:
                                self.emit("reaches", u, d, b)


def _rename(tree: Node) -> None:
    """Names of declarations and functions are the field `_name`, targets of declarators `_target`, as `id` is the node's number."""
    stack = [tree]
    while stack:
        node = stack.pop()
        if "id" in node:
            value = node.pop("id")
            moved = {("_target" if node["type"] == "VariableDeclarator" else "_name"): value}
            rest = {k: node.pop(k) for k in list(node) if k not in ("type", "start", "end")}
            node.update(moved)
            node.update(rest)
        stack.extend(x for _, _, x in children(node))


def simplify(tree: Node) -> Node:
    """The tree in normal form: arrows have blocks, sequences that stand as statements are statements of their own, sequences in sequences are flat, an assigned sequence's earlier parts stand before the assignment, empty statements are gone."""

    def flat(e: Node) -> list[Node]:
        return [y for x in e["expressions"] for y in flat(x)] if e["type"] == "SequenceExpression" else [e]

    def statements(body: list[Node]) -> list[Node]:
        out = []
        for s in body:
            if s["type"] == "EmptyStatement":
                continue
            if s["type"] == "ExpressionStatement":
                parts = flat(s["expression"])
                for x in parts:
                    if x["type"] == "AssignmentExpression" and x["right"]["type"] == "SequenceExpression" and x["left"]["type"] == "Identifier":
                        *before, last = flat(x["right"])
                        out += [{"type": "ExpressionStatement", "start": y["start"], "end": y["end"], "expression": y} for y in before]
                        x["right"] = last
                    out.append(s if len(parts) == 1 else {"type": "ExpressionStatement", "start": x["start"], "end": x["end"], "expression": x})
            else:
                out.append(s)
        return out

    stack = [tree]
    while stack:
        node = stack.pop()
        t = node["type"]
        if t == "ArrowFunctionExpression" and node["body"]["type"] != "BlockStatement":
            e = node["body"]
            place = {"start": e["start"], "end": e["end"]}
            node["body"], node["expression"] = {"type": "BlockStatement", **place, "body": [{"type": "ReturnStatement", **place, "argument": e}]}, False
        if t in ("Program", "BlockStatement", "StaticBlock"):
            node["body"] = statements(node["body"])
        elif t == "SwitchCase":
            node["consequent"] = statements(node["consequent"])
        elif t == "SequenceExpression":
            node["expressions"] = flat(node)
        stack.extend(x for _, _, x in children(node))
    return tree


def facts_of(code: str) -> list[tuple]:
    """Rows of COLUMNS of one script."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 6000))
    try:
        tree, mode, error = script_parser.parse(code)
        if tree is None:
            return [("script", None, None, None, 0, len(code), mode, None, error)]
        _rename(simplify(tree))
        f = Facts(tree)
        f.number()
        f.declare()
        f.stand_for()
        f.values()
        f.reaching(f.control())
        return [("script", None, None, None, 0, len(code), mode, None, error), *f.rows]
    except RecursionError as e:
        return [("script", None, None, None, 0, len(code), "failed", None, str(e))]
    finally:
        sys.setrecursionlimit(limit)


def extract(scripts: DataFrame) -> DataFrame:
    """scripts (package, script, code) -> rows of SCHEMA. A mapInArrow leaf: a script at a time, no shuffle."""

    def run(batches):
        for b in batches:
            for package, script, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = facts_of(code or "")
                for k in range(0, len(rows), 50_000):
                    part = rows[k : k + 50_000]
                    fields = list(zip(*part, strict=True))
                    types = [pa.string(), *[pa.int64()] * 5, *[pa.string()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array([package] * len(part), pa.string()), pa.array([script] * len(part), pa.string()), *(pa.array(list(x), t) for x, t in zip(fields, types, strict=True))], names=["package", "script", *COLUMNS])

    return scripts.select("package", "script", F.col("code").cast("string").alias("code")).mapInArrow(run, SCHEMA)


_NAMES = {
    "script": {"kind": "mode", "text": "error", "stop": "size"},
    "node": {"a": "node", "b": "parent", "c": "ord", "kind": "type", "name": "field", "text": "text", "start": "start", "stop": "stop"},
    "scope": {"a": "scope", "b": "parent", "kind": "kind", "name": "name", "start": "start", "stop": "stop"},
    "binding": {"a": "def", "b": "scope", "kind": "kind", "name": "name"},
    "param": {"a": "function", "b": "def", "c": "ord", "name": "name"},
    "edge": {"a": "src", "b": "dst", "kind": "kind"},
    "use": {"a": "use", "b": "def", "c": "function", "name": "name"},
    "member": {"a": "node", "b": "object", "name": "api"},
    "call": {"a": "call", "b": "callee", "c": "function", "start": "start", "stop": "stop", "kind": "type", "name": "api", "text": "method"},
    "arg": {"a": "call", "b": "def", "c": "ord", "start": "function", "kind": "type", "name": "hint", "text": "literal"},
    "calls": {"a": "call", "b": "function"},
    "return": {"a": "function", "b": "def"},
    "property": {"a": "object", "b": "def", "name": "name", "text": "literal"},
    "destructured": {"a": "source", "b": "def", "kind": "pattern", "name": "name"},
    "markup": {"a": "sink", "b": "def", "kind": "sink_type", "name": "name"},
    "isolated": {"a": "node", "b": "def", "name": "name"},
    "class": {"a": "class", "b": "parent", "name": "name"},
    "class_member": {"a": "class", "b": "def", "kind": "kind", "name": "name"},
    "import": {"a": "def", "kind": "name", "name": "local", "text": "module"},
    "export": {"a": "def", "kind": "local", "name": "name", "text": "module"},
    "branch": {"a": "node", "kind": "kind", "text": "truth"},
    "case": {"a": "node", "b": "dst", "c": "test", "text": "truth"},
    "flow": {"a": "src", "b": "dst", "c": "function", "start": "ord", "kind": "kind"},
    "reaches": {"a": "use", "b": "assignment", "c": "def"},
}


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The rows of `extract`, which should be written before, as a table for each fact."""
    return {fact: facts.filter(F.col("fact") == fact).select("package", "script", *(F.col(c).alias(n) for c, n in names.items())) for fact, names in _NAMES.items()}
