"""A parser of ECMAScript text (to 2022) into trees of nodes named as ESTree names them.

One hand-written pass: a scanner that the parser asks for the next token (it knows whether a slash may begin a regular expression) and precedence climbing for expressions. Patterns are parsed as expressions and turned into patterns when `=`, `=>`, `of` or `in` follows. In loose mode a statement that can't be parsed is skipped to the next line's beginning or the next semicolon, and reported.

A node is a dict: type, start, end (code points) and the fields of its kind."""

from __future__ import annotations

import re
from collections.abc import Iterator

Node = dict

_WORD = re.compile(r"(?:[$_A-Za-z\u00aa-\uffff\U00010000-\U0010ffff]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$_A-Za-z0-9\u00aa-\uffff\U00010000-\U0010ffff\u200c\u200d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?")
_SPACE = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*[\s\S]*?\*/|<!--[^\n\r]*)+")
_MARK = re.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_REGEX = re.compile(r"/((?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+)/([a-zA-Z]*)")
_STRING = re.compile(r"'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r": "", "\r\n": "", "\u2028": "", "\u2029": ""}

#: Binding strength of binary operators.
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6} | dict.fromkeys(("==", "!=", "===", "!=="), 7) | dict.fromkeys(("<", ">", "<=", ">=", "in", "instanceof"), 8) | dict.fromkeys(("<<", ">>", ">>>"), 9) | dict.fromkeys("+-", 10) | dict.fromkeys("*/%", 11) | {"**": 12}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())


class ScriptError(ValueError):
    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


def _unescape(text: str) -> str:
    def one(m: re.Match) -> str:
        code = m[1] or m[2] or m[3]
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else "\ufffd"
        return _PLAIN.get(m[4], m[4])

    return _ESCAPE.sub(one, text) if "\\" in text else text


class Parser:
    def __init__(self, text: str):
        self.text, self.n = text, len(text)
        self.at = self.last = 0
        self.in_function = self.in_async = self.in_generator = 0
        self.errors: list[str] = []
        self.module = False
        if text.startswith("#!"):
            self.at = (text.find("\n") + 1) or self.n
        self.step()

    # --- tokens ------------------------------------------------------------

    def step(self) -> None:
        """Reads the next token: kind (word, number, string, template, mark, end), value, where it stands, whether a line break is before it."""
        self.last = getattr(self, "end", self.at)
        m = _SPACE.match(self.text, self.at)
        a = m.end() if m else self.at
        self.line = bool(m) and any(c in self.text[self.at : a] for c in "\n\r\u2028\u2029")
        self.start = a
        if a >= self.n:
            self.kind, self.value, self.end = "end", "", a
        elif m := _WORD.match(self.text, a):
            self.kind, self.value, self.end = "word", _unescape(m[0]), m.end()
        elif self.text[a].isdigit() or (self.text[a] == "." and self.text[a + 1 : a + 2].isdigit()):
            m = _NUMBER.match(self.text, a)
            self.kind, self.value, self.end = "number", m[0], m.end()
        elif self.text[a] in "'\"":
            m = _STRING.match(self.text, a)
            if not m:
                raise ScriptError("a string without an end", a)
            self.kind, self.value, self.end = "string", _unescape(m[0][1:-1]), m.end()
        elif self.text[a] == "`":
            self.kind, self.value, self.end = "template", "`", a + 1
        elif m := _MARK.match(self.text, a):
            self.kind, self.value, self.end = "mark", m[0], m.end()
        else:
            raise ScriptError(f"{self.text[a]!r} isn't known", a)
        self.at = self.end

    def save(self):
        return self.at, self.last, self.kind, self.value, self.start, self.end, self.line

    def back(self, state) -> None:
        self.at, self.last, self.kind, self.value, self.start, self.end, self.line = state

    def sees(self, *values: str) -> bool:
        return self.kind in ("mark", "word") and self.value in values

    def takes(self, value: str) -> bool:
        if self.sees(value):
            self.step()
            return True
        return False

    def needs(self, value: str) -> None:
        if not self.takes(value):
            raise ScriptError(f"{value!r} is missing before {self.value!r}", self.start)

    def semicolon(self) -> None:
        if not self.takes(";") and not (self.line or self.sees("}") or self.kind == "end"):
            raise ScriptError(f"a statement doesn't end before {self.value!r}", self.start)

    def node(self, type_: str, start: int, **fields) -> Node:
        return {"type": type_, "start": start, "end": self.last, **fields}

    # --- statements --------------------------------------------------------

    def program(self, loose: bool = False) -> Node:
        body = []
        while self.kind != "end":
            state = self.save()
            try:
                body.append(self.statement())
            except (ScriptError, RecursionError) as e:
                if not loose:
                    raise
                self.errors.append(str(e) or type(e).__name__)
                self.skip(state)
        self.last = self.n
        return {"type": "Program", "start": 0, "end": self.n, "body": body}

    def skip(self, state) -> None:
        """Goes on at the next semicolon or line after a statement that couldn't be read."""
        a = state[4]
        while True:
            m = re.compile(r"[;\n\r]").search(self.text, a + 1)
            a = m.end() if m else self.n
            self.at = self.end = a
            try:
                self.step()
                return
            except ScriptError:
                if a >= self.n:
                    self.kind, self.value, self.start, self.end, self.at = "end", "", self.n, self.n, self.n
                    return

    def block(self) -> Node:
        a = self.start
        self.needs("{")
        body = []
        while not self.sees("}"):
            if self.kind == "end":
                raise ScriptError("a block without an end", a)
            body.append(self.statement())
        self.step()
        return self.node("BlockStatement", a, body=body)

    def statement(self) -> Node:
        a, v = self.start, self.value
        if self.kind == "mark":
            if v == "{":
                return self.block()
            if v == ";":
                self.step()
                return self.node("EmptyStatement", a)
        elif self.kind == "word":
            f = getattr(self, f"on_{v}", None)
            if f is not None and (v not in ("let", "async", "import") or self.opens(v)):
                return f(a)
            if v not in _RESERVED and v not in ("yield", "await"):
                state = self.save()
                self.step()
                if self.takes(":"):
                    return self.node("LabeledStatement", a, label={"type": "Identifier", "start": a, "end": a + len(v), "name": v}, body=self.statement()) | {"end": self.last}
                self.back(state)
        e = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", a, expression=e)

    def opens(self, word: str) -> bool:
        """Whether `let`, `async` or `import` begins a declaration here."""
        state = self.save()
        self.step()
        if word == "let":
            ok = (self.kind == "word" and self.value not in ("in", "instanceof", "of")) or self.sees("{", "[")
        elif word == "async":
            ok = self.sees("function") and not self.line
        else:
            ok = not self.sees("(", ".")
        self.back(state)
        return ok

    def on_var(self, a: int) -> Node:
        out = self.declaration(a, True)
        self.semicolon()
        return out | {"end": self.last}

    on_let = on_const = on_var

    def declaration(self, a: int, with_in: bool) -> Node:
        kind = self.value
        self.step()
        items = []
        while True:
            s = self.start
            target = self.target()
            init = self.assignment(with_in) if self.takes("=") else None
            items.append(self.node("VariableDeclarator", s, id=target, init=init))
            if not self.takes(","):
                return self.node("VariableDeclaration", a, kind=kind, declarations=items)

    def target(self) -> Node:
        return self.pattern(self.primary()) if self.sees("{", "[") else self.identifier()

    def identifier(self, any_word: bool = False) -> Node:
        if self.kind != "word" or (self.value in _RESERVED and not any_word):
            raise ScriptError(f"{self.value!r} is no name", self.start)
        a, v = self.start, self.value
        self.step()
        return self.node("Identifier", a, name=v)

    def on_function(self, a: int) -> Node:
        return self.function(a, "FunctionDeclaration", False)

    def on_async(self, a: int) -> Node:
        self.step()
        return self.function(a, "FunctionDeclaration", True)

    def function(self, a: int, type_: str, is_async: bool) -> Node:
        self.needs("function")
        star = self.takes("*")
        name = self.identifier() if self.kind == "word" and not self.sees("(") else None
        return self.rest_of_function(a, type_, is_async, star, id=name)

    def rest_of_function(self, a: int, type_: str, is_async: bool, star: bool, **fields) -> Node:
        outer = self.in_async, self.in_generator
        self.in_async, self.in_generator = is_async, star
        params = self.params()
        body = self.block()
        self.in_async, self.in_generator = outer
        return self.node(type_, a, params=params, body=body, **{"async": is_async, "generator": star}, **fields)

    def params(self) -> list[Node]:
        self.needs("(")
        out = []
        while not self.sees(")"):
            a = self.start
            if self.takes("..."):
                out.append(self.node("RestElement", a, argument=self.target()) | {"end": self.last})
            else:
                p = self.target()
                if self.takes("="):
                    p = self.node("AssignmentPattern", a, left=p, right=self.assignment()) | {"end": self.last}
                out.append(p)
            if not self.takes(","):
                break
        self.needs(")")
        return out

    def on_class(self, a: int) -> Node:
        return self.klass(a, "ClassDeclaration")

    def klass(self, a: int, type_: str) -> Node:
        self.needs("class")
        name = self.identifier() if self.kind == "word" and not self.sees("extends") else None
        parent = self.subscripts(self.primary()) if self.takes("extends") else None
        b = self.start
        self.needs("{")
        body = []
        while not self.takes("}"):
            if not self.takes(";"):
                body.append(self.member())
        return self.node(type_, a, id=name, superClass=parent, body=self.node("ClassBody", b, body=body))

    def member(self) -> Node:
        a, static, is_async, star, kind = self.start, False, False, False, "method"

        def modifier(word: str) -> bool:
            if not self.sees(word):
                return False
            state = self.save()
            self.step()
            if self.sees("(", "=", ";", "}") or (word != "static" and word != "get" and word != "set" and self.line):
                self.back(state)
                return False
            return True

        static = modifier("static")
        if static and self.sees("{"):
            return self.node("StaticBlock", a, body=self.block()["body"]) | {"end": self.last}
        is_async = modifier("async")
        star = self.takes("*")
        for k in ("get", "set"):
            if not star and not is_async and kind == "method" and modifier(k):
                kind = k
        key, computed = self.key()
        if self.sees("("):
            f = self.rest_of_function(self.start, "FunctionExpression", is_async, star, id=None)
            if key.get("name", key.get("value")) == "constructor" and not static:
                kind = "constructor"
            return self.node("MethodDefinition", a, key=key, computed=computed, static=static, kind=kind, value=f)
        value = self.assignment() if self.takes("=") else None
        self.semicolon()
        return self.node("PropertyDefinition", a, key=key, computed=computed, static=static, value=value)

    def key(self) -> tuple[Node, bool]:
        a = self.start
        if self.takes("["):
            e = self.assignment()
            self.needs("]")
            return e, True
        if self.takes("#"):
            return self.node("PrivateIdentifier", a, name=self.identifier(True)["name"]) | {"end": self.last}, False
        if self.kind in ("string", "number"):
            return self.literal(), False
        return self.identifier(True), False

    def on_if(self, a: int) -> Node:
        self.step()
        test = self.in_parens()
        yes = self.statement()
        no = self.statement() if self.takes("else") else None
        return self.node("IfStatement", a, test=test, consequent=yes, alternate=no)

    def in_parens(self) -> Node:
        self.needs("(")
        e = self.expression()
        self.needs(")")
        return e

    def on_while(self, a: int) -> Node:
        self.step()
        test = self.in_parens()
        return self.node("WhileStatement", a, test=test, body=self.statement()) | {"end": self.last}

    def on_do(self, a: int) -> Node:
        self.step()
        body = self.statement()
        self.needs("while")
        test = self.in_parens()
        self.takes(";")
        return self.node("DoWhileStatement", a, body=body, test=test)

    def on_with(self, a: int) -> Node:
        self.step()
        obj = self.in_parens()
        return self.node("WithStatement", a, object=obj, body=self.statement()) | {"end": self.last}

    def on_for(self, a: int) -> Node:
        self.step()
        self.takes("await")
        self.needs("(")
        init, s = None, self.start
        if self.sees("var", "const") or (self.sees("let") and self.opens("let")):
            init = self.declaration(s, False)
        elif not self.sees(";"):
            init = self.expression(False)
        for word, type_ in (("of", "ForOfStatement"), ("in", "ForInStatement")):
            if init is not None and self.takes(word):
                if init["type"] != "VariableDeclaration":
                    init = self.pattern(init)
                right = self.assignment() if word == "of" else self.expression()
                self.needs(")")
                return self.node(type_, a, left=init, right=right, body=self.statement()) | {"end": self.last}
        self.needs(";")
        test = None if self.sees(";") else self.expression()
        self.needs(";")
        update = None if self.sees(")") else self.expression()
        self.needs(")")
        return self.node("ForStatement", a, init=init, test=test, update=update, body=self.statement()) | {"end": self.last}

    def jump(self, a: int, type_: str) -> Node:
        self.step()
        label = self.identifier() if self.kind == "word" and not self.line and not self.sees("}") and self.value not in _RESERVED else None
        self.semicolon()
        return self.node(type_, a, label=label)

    def on_break(self, a: int) -> Node:
        return self.jump(a, "BreakStatement")

    def on_continue(self, a: int) -> Node:
        return self.jump(a, "ContinueStatement")

    def on_return(self, a: int) -> Node:
        self.step()
        e = None if self.line or self.sees(";", "}") or self.kind == "end" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", a, argument=e)

    def on_throw(self, a: int) -> Node:
        self.step()
        e = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", a, argument=e)

    def on_try(self, a: int) -> Node:
        self.step()
        block, handler, last = self.block(), None, None
        c = self.start
        if self.takes("catch"):
            param = None
            if self.takes("("):
                param = self.target()
                self.needs(")")
            handler = self.node("CatchClause", c, param=param, body=self.block()) | {"end": self.last}
        if self.takes("finally"):
            last = self.block()
        if handler is None and last is None:
            raise ScriptError("try without catch or finally", a)
        return self.node("TryStatement", a, block=block, handler=handler, finalizer=last)

    def on_switch(self, a: int) -> Node:
        self.step()
        subject = self.in_parens()
        self.needs("{")
        cases = []
        while not self.takes("}"):
            c = self.start
            if self.takes("default"):
                test = None
            else:
                self.needs("case")
                test = self.expression()
            self.needs(":")
            body = []
            while not self.sees("case", "default", "}"):
                body.append(self.statement())
            cases.append(self.node("SwitchCase", c, test=test, consequent=body))
        return self.node("SwitchStatement", a, discriminant=subject, cases=cases)

    def on_debugger(self, a: int) -> Node:
        self.step()
        self.semicolon()
        return self.node("DebuggerStatement", a)

    def on_import(self, a: int) -> Node:
        self.module = True
        self.step()
        parts = []
        if self.kind != "string":
            s = self.start
            if self.kind == "word":
                parts.append(self.node("ImportDefaultSpecifier", s, local=self.identifier()) | {"end": self.last})
                self.takes(",")
            s = self.start
            if self.takes("*"):
                self.needs("as")
                parts.append(self.node("ImportNamespaceSpecifier", s, local=self.identifier()) | {"end": self.last})
            elif self.sees("{"):
                parts += self.specifiers("ImportSpecifier", "imported", "local")
            self.needs("from")
        source = self.literal()
        self.semicolon()
        return self.node("ImportDeclaration", a, specifiers=parts, source=source)

    def specifiers(self, type_: str, first: str, second: str) -> list[Node]:
        self.needs("{")
        out = []
        while not self.sees("}"):
            s = self.start
            x = self.literal() if self.kind == "string" else self.identifier(True)
            y = x
            if self.takes("as"):
                y = self.literal() if self.kind == "string" else self.identifier(True)
            out.append(self.node(type_, s, **{first: x, second: y}))
            if not self.takes(","):
                break
        self.needs("}")
        return out

    def on_export(self, a: int) -> Node:
        self.module = True
        self.step()
        if self.takes("default"):
            s = self.start
            if self.sees("function") or (self.sees("async") and self.opens("async")):
                d = self.on_async(s) if self.sees("async") else self.on_function(s)
            elif self.sees("class"):
                d = self.on_class(s)
            else:
                d = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", a, declaration=d)
        if self.takes("*"):
            name = self.identifier(True) if self.takes("as") else None
            self.needs("from")
            source = self.literal()
            self.semicolon()
            return self.node("ExportAllDeclaration", a, exported=name, source=source)
        if self.sees("{"):
            parts = self.specifiers("ExportSpecifier", "local", "exported")
            source = self.literal() if self.takes("from") else None
            self.semicolon()
            return self.node("ExportNamedDeclaration", a, declaration=None, specifiers=parts, source=source)
        return self.node("ExportNamedDeclaration", a, declaration=self.statement(), specifiers=[], source=None) | {"end": self.last}

    # --- expressions -------------------------------------------------------

    def expression(self, with_in: bool = True) -> Node:
        a = self.start
        e = self.assignment(with_in)
        if not self.sees(","):
            return e
        all_ = [e]
        while self.takes(","):
            all_.append(self.assignment(with_in))
        return self.node("SequenceExpression", a, expressions=all_)

    def assignment(self, with_in: bool = True) -> Node:
        a = self.start
        if self.sees("yield") and self.in_generator:
            self.step()
            star = not self.line and self.takes("*")
            arg = None if self.line or self.sees(")", "]", "}", ",", ";", ":") or self.kind == "end" else self.assignment(with_in)
            return self.node("YieldExpression", a, argument=arg, delegate=star)
        if self.sees("async"):
            state = self.save()
            self.step()
            if self.kind == "word" and not self.line and self.value not in _RESERVED:
                p = self.identifier()
                if self.sees("=>"):
                    return self.arrow(a, [p], True)
            elif self.sees("(") and not self.line:
                try:
                    p = self.primary_paren()
                except ScriptError:
                    p = None
                if p is not None and self.sees("=>") and not self.line:
                    return self.arrow(a, [self.pattern(x) for x in p["items"]], True)
            self.back(state)
        left = self.conditional(with_in)
        if left["type"] == "_Parens":
            if not self.sees("=>"):
                raise ScriptError("empty parentheses", a)
            return self.arrow(a, [self.pattern(x) for x in left["items"]], False)
        if self.sees("=>") and not self.line and left["type"] == "Identifier":
            return self.arrow(a, [left], False)
        if self.kind == "mark" and self.value in _ASSIGN:
            op = self.value
            if op == "=" and left["type"] in ("ObjectExpression", "ArrayExpression"):
                left = self.pattern(left)
            elif left["type"] not in ("Identifier", "MemberExpression"):
                raise ScriptError("nothing that can be assigned to", a)
            self.step()
            return self.node("AssignmentExpression", a, operator=op, left=left, right=self.assignment(with_in)) | {"end": self.last}
        return left

    def arrow(self, a: int, params: list[Node], is_async: bool) -> Node:
        self.needs("=>")
        outer = self.in_async, self.in_generator
        self.in_async, self.in_generator = is_async, 0
        body = self.block() if self.sees("{") else self.assignment()
        self.in_async, self.in_generator = outer
        return self.node("ArrowFunctionExpression", a, params=params, body=body, **{"async": is_async, "generator": False, "expression": body["type"] != "BlockStatement"})

    def conditional(self, with_in: bool) -> Node:
        a = self.start
        test = self.binary(0, with_in)
        if test["type"] == "_Parens" or not self.takes("?"):
            return test
        yes = self.assignment()
        self.needs(":")
        return self.node("ConditionalExpression", a, test=test, consequent=yes, alternate=self.assignment(with_in)) | {"end": self.last}

    def binary(self, least: int, with_in: bool) -> Node:
        a = self.start
        if self.sees("#"):
            left = self.key()[0]
        else:
            left = self.unary()
        if left["type"] == "_Parens":
            return left
        while self.kind in ("mark", "word") and self.value in _BINARY and (with_in or self.value != "in"):
            op, power = self.value, _BINARY[self.value]
            if power <= least:
                return left
            self.step()
            right = self.binary(power - (op == "**"), with_in)
            left = self.node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", a, operator=op, left=left, right=right)
        return left

    def unary(self) -> Node:
        a, v = self.start, self.value
        if (self.kind == "mark" and v in ("!", "~", "+", "-")) or (self.kind == "word" and v in ("typeof", "void", "delete")):
            self.step()
            return self.node("UnaryExpression", a, operator=v, argument=self.unary()) | {"end": self.last}
        if self.kind == "mark" and v in ("++", "--"):
            self.step()
            return self.node("UpdateExpression", a, operator=v, prefix=True, argument=self.unary()) | {"end": self.last}
        if v == "await" and self.kind == "word":
            state = self.save()
            self.step()
            if self.in_async or not (self.sees(")", "]", "}", ",", ";", "=", "=>", ".", ":", "?") or self.kind == "end" or self.value in _BINARY and not self.sees("+", "-", "/")):
                return self.node("AwaitExpression", a, argument=self.unary()) | {"end": self.last}
            self.back(state)
        e = self.primary()
        if e["type"] == "_Parens":
            return e
        e = self.subscripts(e)
        if self.sees("++", "--") and not self.line:
            op = self.value
            self.step()
            return self.node("UpdateExpression", a, operator=op, prefix=False, argument=e)
        return e

    def subscripts(self, e: Node, calls: bool = True) -> Node:
        a = e["start"]
        while True:
            if self.takes("."):
                p = self.key()[0] if self.sees("#") else self.identifier(True)
                e = self.node("MemberExpression", a, object=e, property=p, computed=False, optional=False)
            elif self.sees("?.") and calls:
                self.step()
                if self.sees("("):
                    e = self.node("CallExpression", a, callee=e, arguments=self.arguments(), optional=True) | {"end": self.last}
                elif self.takes("["):
                    p = self.expression()
                    self.needs("]")
                    e = self.node("MemberExpression", a, object=e, property=p, computed=True, optional=True)
                else:
                    p = self.key()[0] if self.sees("#") else self.identifier(True)
                    e = self.node("MemberExpression", a, object=e, property=p, computed=False, optional=True)
            elif self.takes("["):
                p = self.expression()
                self.needs("]")
                e = self.node("MemberExpression", a, object=e, property=p, computed=True, optional=False)
            elif self.sees("(") and calls:
                e = self.node("CallExpression", a, callee=e, arguments=self.arguments(), optional=False) | {"end": self.last}
            elif self.kind == "template":
                e = self.node("TaggedTemplateExpression", a, tag=e, quasi=self.template()) | {"end": self.last}
            else:
                return e

    def arguments(self) -> list[Node]:
        self.needs("(")
        out = []
        while not self.sees(")"):
            out.append(self.spread() if self.sees("...") else self.assignment())
            if not self.takes(","):
                break
        self.needs(")")
        return out

    def spread(self) -> Node:
        a = self.start
        self.needs("...")
        return self.node("SpreadElement", a, argument=self.assignment()) | {"end": self.last}

    def literal(self) -> Node:
        a, kind, v = self.start, self.kind, self.value
        if kind not in ("string", "number"):
            raise ScriptError(f"{v!r} is no literal", a)
        self.step()
        return self.node("Literal", a, kind=kind, value=v)

    def primary(self) -> Node:
        a, kind, v = self.start, self.kind, self.value
        if kind in ("string", "number"):
            return self.literal()
        if kind == "template":
            return self.template()
        if kind == "mark":
            if v == "(":
                return self.primary_paren()
            if v == "[":
                return self.array()
            if v == "{":
                return self.object()
            if v in ("/", "/="):
                m = _REGEX.match(self.text, a)
                if not m:
                    raise ScriptError("a regular expression without an end", a)
                self.at = self.end = m.end()
                self.step()
                return self.node("Literal", a, kind="regex", value=m[0])
        if kind == "word":
            if v == "function":
                return self.function(a, "FunctionExpression", False)
            if v == "async" and self.opens("async"):
                self.step()
                return self.function(a, "FunctionExpression", True)
            if v == "class":
                return self.klass(a, "ClassExpression")
            if v == "new":
                return self.new(a)
            if v in ("this", "super"):
                self.step()
                return self.node("ThisExpression" if v == "this" else "Super", a)
            if v in ("null", "true", "false"):
                self.step()
                return self.node("Literal", a, kind="null" if v == "null" else "boolean", value=v)
            if v == "import":
                self.step()
                if self.takes("."):
                    self.module = True
                    return self.node("MetaProperty", a, property=self.identifier(True)) | {"end": self.last}
                self.needs("(")
                e = self.assignment()
                self.takes(",")
                if not self.sees(")"):
                    self.assignment()
                self.needs(")")
                return self.node("ImportExpression", a, source=e)
            return self.identifier()
        raise ScriptError(f"{v!r} can't begin an expression", a)

    def primary_paren(self) -> Node:
        """A parenthesised expression, or what only an arrow can follow."""
        a = self.start
        self.needs("(")
        items, only_arrow = [], self.sees(")")
        while not self.sees(")"):
            if self.sees("..."):
                items.append(self.spread())
                only_arrow = True
            else:
                items.append(self.assignment())
            if not self.takes(","):
                break
            only_arrow |= self.sees(")")
        self.needs(")")
        if only_arrow or (self.sees("=>") and not self.line):
            return self.node("_Parens", a, items=items)
        return items[0] if len(items) == 1 else {"type": "SequenceExpression", "start": items[0]["start"], "end": items[-1]["end"], "expressions": items}

    def array(self) -> Node:
        a = self.start
        self.needs("[")
        out: list[Node | None] = []
        while not self.sees("]"):
            if self.takes(","):
                out.append(None)
                continue
            out.append(self.spread() if self.sees("...") else self.assignment())
            if not self.takes(","):
                break
        self.needs("]")
        return self.node("ArrayExpression", a, elements=out)

    def object(self) -> Node:
        a = self.start
        self.needs("{")
        out = []
        while not self.sees("}"):
            out.append(self.property())
            if not self.takes(","):
                break
        self.needs("}")
        return self.node("ObjectExpression", a, properties=out)

    def property(self) -> Node:
        a = self.start
        if self.sees("..."):
            return self.spread()
        kind, is_async, star = "init", False, False
        for word in ("async", "get", "set"):
            if self.sees(word):
                state = self.save()
                self.step()
                if self.sees(",", ":", "(", "}", "=") or (self.line and word == "async"):
                    self.back(state)
                    continue
                is_async, kind = word == "async", "init" if word == "async" else word
                break
        star = self.takes("*")
        named = self.kind == "word"
        key, computed = self.key()
        if self.sees("("):
            f = self.rest_of_function(self.start, "FunctionExpression", is_async, star, id=None)
            return self.node("Property", a, key=key, computed=computed, kind=kind, method=kind == "init", shorthand=False, value=f)
        if self.takes(":"):
            return self.node("Property", a, key=key, computed=computed, kind="init", method=False, shorthand=False, value=self.assignment()) | {"end": self.last}
        if not named or computed:
            raise ScriptError("a property without a value", self.start)
        value = key
        if self.takes("="):
            value = self.node("AssignmentPattern", a, left=key, right=self.assignment()) | {"end": self.last}
        return self.node("Property", a, key=key, computed=False, kind="init", method=False, shorthand=True, value=value)

    def new(self, a: int) -> Node:
        self.needs("new")
        if self.takes("."):
            return self.node("MetaProperty", a, property=self.identifier(True)) | {"end": self.last}
        callee = self.new(self.start) if self.sees("new") else self.subscripts(self.primary(), calls=False)
        return self.node("NewExpression", a, callee=callee, arguments=self.arguments() if self.sees("(") else []) | {"end": self.last}

    def template(self) -> Node:
        a, at, quasis, inner = self.start, self.end, [], []
        while True:
            s = at
            while at < self.n and self.text[at] != "`" and not self.text.startswith("${", at):
                at += 2 if self.text[at] == "\\" else 1
            if at >= self.n:
                raise ScriptError("a template without an end", a)
            quasis.append({"type": "TemplateElement", "start": s, "end": at, "value": _unescape(self.text[s:at])})
            if self.text[at] == "`":
                self.at = self.end = at + 1
                self.step()
                return self.node("TemplateLiteral", a, quasis=quasis, expressions=inner)
            self.at = self.end = at + 2
            self.step()
            inner.append(self.expression())
            if not self.sees("}"):
                raise ScriptError("a template's expression without an end", self.start)
            at = self.end

    def pattern(self, e: Node) -> Node:
        """An expression as what it assigns to."""
        t = e["type"]
        if t in ("Identifier", "MemberExpression", "ObjectPattern", "ArrayPattern", "AssignmentPattern", "RestElement"):
            return e
        if t == "ObjectExpression":
            return e | {"type": "ObjectPattern", "properties": [self.pattern(p) if p["type"] == "SpreadElement" else p | {"value": self.pattern(p["value"])} for p in e["properties"]]}
        if t == "ArrayExpression":
            return e | {"type": "ArrayPattern", "elements": [x and self.pattern(x) for x in e["elements"]]}
        if t == "AssignmentExpression" and e["operator"] == "=":
            return {"type": "AssignmentPattern", "start": e["start"], "end": e["end"], "left": self.pattern(e["left"]), "right": e["right"]}
        if t == "SpreadElement":
            return e | {"type": "RestElement", "argument": self.pattern(e["argument"])}
        raise ScriptError(f"{t} can't be assigned to", e["start"])


def parse(text: str) -> tuple[Node | None, str, str | None]:
    """The tree, the mode (module, script or loose; failed if nothing could be read) and what went wrong."""
    p = None
    try:
        p = Parser(text)
        tree = p.program()
        return tree, "module" if p.module else "script", None
    except (ScriptError, RecursionError) as e:
        first = str(e) or type(e).__name__
    try:
        p = Parser(text)
        tree = p.program(loose=True)
        return (tree, "loose", first) if tree["body"] else (None, "failed", first)
    except (ScriptError, RecursionError):
        return None, "failed", first


def children(node: Node) -> Iterator[tuple[str, int, Node]]:
    """(field, place, child) in order of the fields."""
    for field, value in node.items():
        if isinstance(value, dict):
            yield field, 0, value
        elif isinstance(value, list):
            for k, x in enumerate(value):
                if isinstance(x, dict):
                    yield field, k, x
