"""Facts of one TypeScript file from a masked-text scan (no grammar library is assumed).

Strings, comments and templates are blanked first, so brackets can be matched and declarations found
by shape.  Covered: functions and overload signatures, classes and methods, bound arrows, anonymous
default exports, imports, calls.  Not covered: anything that needs types or a full grammar.
"""

from __future__ import annotations

import re

from symtrail.sources.notes import Notes

_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.S)
_DEFAULT = r"(?P<export>\bexport\s+(?P<default>default\s+)?)?"
_DECLARATIONS = re.compile(
    _DEFAULT + r"(?P<head>(?:declare\s+)?(?:async\s+)?function\b\s*\*?\s*(?P<fn>[A-Za-z_$][\w$]*)?"
    r"|(?:abstract\s+)?class\b\s*(?P<cls>(?!extends\b|implements\b)[A-Za-z_$][\w$]*)?)"
    r"|(?:\bexport\s+)?\b(?:const|let|var)\s+(?P<bound>[A-Za-z_$][\w$]*)\s*(?::[^=;]*?)?=(?!=)\s*(?P<value>(?:async\s+)?"
    r"(?:function\b\s*\*?\s*[\w$]*\s*)?)(?=[(A-Za-z_$<])"
    r"|\bexport\s+default\s+(?P<anon>(?:async\s*)?)(?=\()")
_METHOD = re.compile(
    r"(?:(?:public|private|protected|static|async|override|readonly|get|set|abstract)\s+)*\*?\s*"
    r"(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")
_CALL = re.compile(r"(?<![\w$.])(?P<new>new\s+)?(?P<callee>[A-Za-z_$][\w$]*(?:\s*\??\.\s*#?[A-Za-z_$][\w$]*)*)"
                   r"\s*(?:<[^<>()]*>)?\(")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "async",
              "import", "constructor", "void", "in", "of", "do", "else", "case"}
_IMPORT = re.compile(r"^[ \t]*import\s+(?:type\s+)?(?P<what>[^'\";]*?)\s*from\s*['\"](?P<from>[^'\"]+)['\"]", re.M)


def _mask(text: str) -> str:
    return _TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _brackets(code: str) -> tuple[dict[int, int], dict[int, int]]:
    """`open -> close` and, for each bracket, the bracket it sits in."""
    pairs, inside, stack = {}, {}, []
    for m in re.finditer(r"[(){}\[\]]", code):
        if m.group() in "({[":
            inside[m.start()] = stack[-1] if stack else -1
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    for left in stack:
        pairs[left] = len(code) - 1
    return pairs, inside


def _imports(text: str) -> dict[str, dict]:
    table = {}
    for m in _IMPORT.finditer(text):
        what, module = m.group("what"), m.group("from")
        named = re.search(r"\{(.*?)\}", what, re.S)
        for item in (named.group(1).split(",") if named else ()):
            words = re.sub(r"^type\s+", "", item.strip()).split()
            if words:
                table[words[-1]] = {"module": module, "name": words[0]}
        rest = re.sub(r"\{.*?\}", "", what, flags=re.S)
        for item in rest.split(","):
            words = item.split()
            if len(words) == 3 and words[0] == "*":
                table[words[2]] = {"module": module, "name": None}
            elif len(words) == 1:
                table[words[0]] = {"module": module, "name": "default"}
    return table


def _arity(params: str) -> int:
    flat, depth = [], 0
    for ch in re.sub(r"=>", "  ", params):
        depth += ch in "([{<"
        depth -= ch in ")]}>"
        flat.append("|" if ch == "," and depth == 0 else ch)
    parts = [p.strip() for p in "".join(flat).split("|")]
    return sum(1 for p in parts if p and not p.startswith("...") and not re.match(r"this\b", p))


class _Scan:
    def __init__(self, text: str):
        self.text, self.code = text, _mask(text)
        self.pairs, self.inside = _brackets(self.code)
        self.found = []

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def body_after(self, at: int) -> int:
        """The `{` that opens a body after a parameter list or heritage; -1 for a bare signature."""
        i = at
        while i < len(self.code):
            ch = self.code[i]
            if ch == "{":
                before = self.code[at:i].rstrip()
                if before.endswith((":", "|", "&", "<", ",")):      # an object type, not a body
                    i = self.pairs.get(i, i) + 1
                    continue
                return i
            if ch == ";" or (ch == "\n" and re.match(r"\s*(export\b|function\b|\}|const\b|$)", self.code[i:i + 40])):
                return -1
            i = self.pairs.get(i, i) + 1 if ch in "([" else i + 1
        return -1

    def add(self, name, kind, start, span, params, body, end, **more):
        self.found.append({"name": name, "kind": kind, "start": start, "span": span, "body": body, "end": end,
                           "arity": _arity(self.code[params + 1:self.pairs.get(params, params + 1)]) if params >= 0 else 0,
                           **more})

    def declarations(self):
        for m in _DECLARATIONS.finditer(self.code):
            if m.group("head"):
                start = m.start("head")
                name = m.group("fn") or m.group("cls") or ("default" if m.group("default") else None)
                if name is None:
                    continue
                if re.match(r"(?:abstract\s+)?class\b", m.group("head")):
                    body = self.code.find("{", m.end())
                    if body >= 0:
                        ext = re.search(r"\bextends\s+([\w$.]+)", self.code[m.end():body])
                        self.add(name, "class", start, start, -1, body, self.pairs.get(body, len(self.code) - 1) + 1,
                                 base=ext.group(1) if ext else None)
                    continue
                params = self.code.find("(", m.end())
                if params < 0:
                    continue
                close = self.pairs.get(params, params)
                body = self.body_after(close + 1)
                end = self.pairs.get(body, close) + 1 if body >= 0 else close + 1 + len(
                    re.match(r"[^;\n]*;?", self.code[close + 1:]).group())
                self.add(name, "function", start, start, params, body, end)
            elif m.group("bound") or m.group("anon") is not None:
                self.arrow(m)

    def arrow(self, m):
        bound = m.group("bound")
        start = m.start("value") if bound else m.start("anon")
        at = m.end()
        is_function = bound and "function" in m.group("value")
        if self.code[at] == "<":
            at = self.code.find("(", at)
        params = at if at >= 0 and self.code[at] == "(" else -1
        after = self.pairs.get(params, params) + 1 if params >= 0 else at + len(
            re.match(r"(?:async\s+)?[\w$]*", self.code[at:]).group())
        if is_function:
            body = self.code.find("{", after)
        else:
            head = re.match(r"\s*(?::[^={;]*(?:\{[^}]*\}[^={;]*)?)?=>\s*", self.code[after:])
            if head is None:
                return
            body = after + head.end()
        if body < 0 or body >= len(self.code):
            return
        if self.code[body] in "{(":
            end = self.pairs.get(body, body) + 1
        else:
            end = body + len(re.match(r"[^;\n]*", self.code[body:]).group())
        self.add(bound or "default", "function", start, m.start("bound") if bound else start, params, body, end,
                 closed=True, lone=None if params >= 0 else 1)

    def methods(self):
        for cls in [d for d in self.found if d["kind"] == "class"]:
            at, stop = cls["body"] + 1, cls["end"] - 1
            while at < stop:
                m = _METHOD.match(self.code, at)
                if m and m.group("name") not in _NOT_CALLS - {"constructor"}:
                    params = m.end() - 1
                    body = self.body_after(self.pairs.get(params, params) + 1)
                    if 0 <= body < stop:
                        lead = len(m.group()) - len(m.group().lstrip())
                        end = self.pairs.get(body, body) + 1
                        self.add(m.group("name"), "function", at + lead, at + lead, params, body, end)
                        at = end
                        continue
                ch = self.code[at]
                step = self.pairs.get(at, at) + 1 if ch in "({[" else at + 1
                skip = re.match(r"[\w$#]+", self.code[at:stop])
                at = at + len(skip.group()) if skip and ch not in "({[" else step

    def reachable(self, d) -> bool:
        """A declaration counts when only statement blocks lie between it and its scope."""
        left = max((b for b, e in self.pairs.items() if b < d["start"] < e), default=-1)
        bodies = {o["body"]: o for o in self.found if o is not d}
        while left >= 0:
            if left in bodies:
                return not bodies[left].get("closed") and self.reachable(bodies[left])
            before = self.code[:left].rstrip()
            if self.code[left] != "{" or before.endswith(("=>", "=", "(", ",", ":", "?", "return", "[")):
                return False
            left = self.inside.get(left, -1)
        return True


def extract(text: str) -> dict:
    """Facts of one file, in the shape the Python front end uses."""
    scan = _Scan(text)
    scan.declarations()
    scan.methods()
    keep = sorted((d for d in scan.found if scan.reachable(d)), key=lambda d: (d["start"], d["end"]))
    imports = _imports(text)
    book = Notes(imports)
    defs = []
    for d in keep:
        outer = [o for o in keep if o["body"] >= 0 and o["body"] < d["start"] and d["end"] <= o["end"]]
        scope = max(outer, key=lambda o: o["body"], default=None)
        enclosing = max((o for o in outer if o["kind"] == "class"), key=lambda o: o["body"], default=None)
        d["path"] = f"{scope['path']}.{d['name']}" if scope else d["name"]
        d["signature"] = " ".join(text[d["start"]:d["body"] if d["body"] > d["start"] else d["end"]].split())
        doc = re.search(r"/\*\*((?:(?!\*/).)*)\*/\s*(?:export\s+)?(?:default\s+)?(?:(?:const|let|var)\s+)?\Z",
                        text[:d["span"]], re.S)
        lines = [x.strip().lstrip("*").strip() for x in doc.group(1).strip().splitlines()] if doc else []
        source = text[d["span"]:d["end"]]
        defs.append({
            "path": d["path"], "name": d["name"], "kind": d["kind"], "arity": d.get("lone") or d["arity"],
            "signature": d["signature"], "docstring": "\n".join(x for x in lines if x) or None,
            "source": source, "enclosing": enclosing["signature"] if enclosing else None,
            "names": sorted(set(re.findall(r"(?<![\w$.])[A-Za-z_$][\w$]*", scan.code[d["start"]:d["end"]]))),
            "decorators": [], "start_line": scan.line(d["span"]), "end_line": scan.line(d["end"] - 1)})
    book.add_definitions(defs)
    for i, d in enumerate(keep):
        if d.get("base"):
            book.note(i, "INHERITS", d["base"])
    own_heads = {d["start"]: d for d in keep}
    for m in _CALL.finditer(scan.code):
        callee = re.sub(r"\s|\?", "", m.group("callee"))
        head = callee.split(".", 1)[0]
        owners = [i for i, d in enumerate(keep) if d["start"] <= m.start() < d["end"]]
        if m.group("new") or head in _NOT_CALLS and head == callee or not owners:
            continue
        i = max(owners, key=lambda k: (keep[k]["start"], -keep[k]["end"]))
        body = keep[i]["body"]
        if body < 0 or m.start() < body and keep[i]["kind"] != "class" and callee == keep[i]["name"]:
            continue
        if any(scan.code[:m.start()].rstrip().endswith(w) for w in ("function", "function*")):
            continue
        cls = book.class_of(i)
        method = callee.partition(".")[2]
        if callee == "super" and cls >= 0:
            book.note(i, "CALLS", book.defs[cls]["path"], "constructor", "super")
        elif head in ("this", "super") and method and "." not in method and cls >= 0:
            if head == "super":
                book.note(i, "CALLS", book.defs[cls]["path"], method, "super")
            else:
                book.member(i, cls, method)
        elif keep[i]["kind"] != "class":
            book.note(i, "CALLS", callee)
    head = re.sub(r"\A(?:\s|//[^\n]*|/\*.*?\*/)+", "", text, flags=re.S)
    client = re.match(r"(?:(['\"])use (?:server|strict)\1;?\s*)*(['\"`])use client\2", head) is not None
    return {"imports": imports, "defs": book.defs, "refs": book.refs, "docstring": None, "client": client,
            "end_line": max(1, text.count("\n") + (not text.endswith("\n")))}
