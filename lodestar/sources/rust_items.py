"""Relations of one Rust file: items, uses, call sites, identifier occurrences, flow facts and string-typed declarations.

A tolerant single pass over tokens: items are recognised by their keywords and matched brackets, bodies by local shapes, so
code that a compiler would refuse in other ways still gives its relations. Only unbalanced brackets and broken literals make a file fail.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from lodestar.sources.rust_tokens import Token, joined, partners, split_top, tokenize

_NOT_CALLS = {"if", "while", "for", "match", "return", "in", "loop", "move", "as", "let", "else", "fn", "impl", "where", "pub", "dyn", "mut", "ref", "break", "continue", "use", "struct", "enum", "unsafe", "async", "await", "static", "const", "type", "trait", "mod", "extern", "box", "yield"}
_ITEM_WORDS = {"fn", "struct", "enum", "union", "trait", "impl", "mod", "const", "static", "type", "use", "extern", "macro_rules"}
_STRINGS = re.compile(r"^(?:&(?:'\w+ )?(?:mut )?)?(?:str|String|(?:std::string|alloc::string)::String)$")


@dataclass
class Scope:
    module: tuple[str, ...] = ()
    cfg: tuple[str, ...] = ()
    test: bool = False
    owner: str | None = None  # type or trait that holds methods
    trait: bool = False


@dataclass
class Relations:
    functions: list = field(default_factory=list)
    types: list = field(default_factory=list)  # structs, enums, consts, traits, aliases
    call_sites: list = field(default_factory=list)
    aliases: list = field(default_factory=list)
    reexports: list = field(default_factory=list)
    occurrences: list = field(default_factory=list)
    impls: list = field(default_factory=list)
    flow: list = field(default_factory=list)
    string_sites: list = field(default_factory=list)
    literals: list = field(default_factory=list)


def cfg_enables_test(predicate: str) -> bool:
    """Whether a cfg predicate is ``test`` or has it inside ``all`` or ``any``, but not inside ``not``."""
    p = predicate.replace(" ", "")
    if p == "test":
        return True
    if m := re.match(r"(all|any)\((.*)\)$", p):
        depth, part, parts = 0, "", []
        for c in m[2] + ",":
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                depth += (c == "(") - (c == ")")
                part += c
        return any(cfg_enables_test(x) for x in parts)
    return False


class Parser:
    def __init__(self, path: str, text: str):
        self.path = path
        self.t = tokenize(text)
        self.close = partners(self.t)
        self.out = Relations()
        self.in_tests = "tests" in path.split("/")

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def run(self) -> Relations:
        self.items(0, len(self.t), Scope(test=self.in_tests), None)
        return self.out

    # items

    def attributes(self, i: int, end: int) -> tuple[int, list[str]]:
        found = []
        while i < end and self.text(i) == "#":
            j = i + 1 + (self.text(i + 1) == "!")
            if self.text(j) != "[":
                break
            found.append(joined(self.t[j + 1 : self.close[j]]))
            i = self.close[j] + 1
        return i, found

    def angle_end(self, i: int, end: int) -> int:
        """Index after the angle brackets that open at i."""
        depth = 0
        while i < end:
            x = self.text(i)
            if x == "<":
                depth += 1
            elif x == "<<":
                depth += 2
            elif x == ">":
                depth -= 1
            elif x in (">>=", ">="):
                depth -= x.count(">")
            elif x in "([{" and self.t[i].kind == "punct":
                i = self.close[i]
            i += 1
            if depth <= 0:
                return i
        return end

    def until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """Index of the first stop outside of brackets."""
        while i < end:
            x = self.t[i]
            if x.kind == "punct":
                if x.text in stops:
                    return i
                if x.text in "([{":
                    i = self.close[i]
            elif x.text in stops:
                return i
            i += 1
        return end

    def items(self, i: int, end: int, scope: Scope, fn: dict | None) -> None:
        while i < end:
            i = max(self.item(i, end, scope, fn), i + 1)

    def item(self, i: int, end: int, scope: Scope, fn: dict | None) -> int:
        start = i
        i, attrs = self.attributes(i, end)
        cfg = [a[4:-1] for a in attrs if a.startswith("cfg(") and a.endswith(")")]
        test = scope.test or any(cfg_enables_test(c) for c in cfg)
        first = i
        public = False
        if self.text(i) == "pub":
            public = self.text(i + 1) != "("
            i = i + 1 if public else self.close[i + 1] + 1
        if self.text(i) == "default":
            i += 1
        begin, words = i, set()
        while self.text(i) in ("const", "async", "unsafe", "extern", "safe") or (self.t[i].kind == "str" and words) if i < end else False:
            if self.text(i) == "const" and self.text(i + 1) not in ("fn", "async", "unsafe", "extern"):
                break
            if self.text(i) == "extern" and self.text(i + 1) == "crate":
                return self.until(i, end, (";",)) + 1
            if self.text(i) == "unsafe" and self.text(i + 1) == "{":
                return i + 1
            words.add(self.text(i))
            i += 1
        word = self.text(i)
        if word == "{" and "extern" in words:
            self.items(i + 1, self.close[i], Scope(scope.module, scope.cfg + tuple(cfg), test, scope.owner, scope.trait), fn)
            return self.close[i] + 1
        if word not in _ITEM_WORDS or (word == "union" and self.t[i + 1].kind != "ident"):
            if fn is None and word == "" or i >= end:
                return end
            if fn is not None:
                return start + 1
            if self.t[i].kind == "ident" and self.text(i + 1) == "!":  # a macro called as an item
                self.macro(i, scope, fn, statement=False)
                j = self.until(i + 2, end, ("(", "[", "{"))
                return self.close[j] + 1 if j < end else end
            return i + 1
        inner = Scope(scope.module, scope.cfg + tuple(cfg), test, scope.owner, scope.trait)
        return getattr(self, f"item_{word}")(i, end, inner, fn, {"start": self.t[start].line, "first": first, "begin": begin, "public": public, "words": words, "attrs": attrs, "cfg": list(scope.cfg) + cfg})

    def item_mod(self, i, end, scope, fn, at):
        name, j = self.text(i + 1), i + 2
        if self.text(j) == "{":
            self.items(j + 1, self.close[j], Scope((*scope.module, name), scope.cfg, scope.test), None)
            return self.close[j] + 1
        return j + 1

    def item_use(self, i, end, scope, fn, at):
        stop = self.until(i, end, (";",))
        self.use_tree(i + 1, stop, [], scope, at["public"])
        return stop + 1

    def use_tree(self, i: int, end: int, prefix: list[str], scope: Scope, public: bool) -> None:
        path = list(prefix)
        while i < end:
            x = self.text(i)
            if x == "{":
                inner = i + 1
                for part in self.comma_ranges(inner, self.close[i]):
                    self.use_tree(*part, path, scope, public)
                return
            if x == "*":
                return
            if x == "as":
                name = self.text(i + 1)
                target = [p for p in path if p != "self"] or path
                if name != "_":
                    self.out.aliases.append({"alias": name, "target": target[-1], "file_path": self.path, "full_path": "::".join(path)})
                    if public:
                        self.out.reexports.append({"containing_module": list(scope.module), "local_name": name, "target_path": "::".join(path)})
                return
            if x != "::":
                path.append(x)
            i += 1
        if public and path:
            self.out.reexports.append({"containing_module": list(scope.module), "local_name": path[-1] if path[-1] != "self" else path[-2], "target_path": "::".join(path)})

    def comma_ranges(self, i: int, end: int):
        start = i
        while i <= end:
            if i == end or self.text(i) == ",":
                if i > start:
                    yield start, i
                start = i + 1
            elif self.text(i) in "([{" and self.t[i].kind == "punct":
                i = self.close[i]
            i += 1

    def generics(self, i: int, end: int) -> tuple[int, list[str]]:
        if self.text(i) != "<":
            return i, []
        stop = self.angle_end(i, end)
        return stop, [joined(p) for p in split_top(self.t[i + 1 : stop - 1])]

    def item_fn(self, i, end, scope, fn, at):
        name = self.text(i + 1)
        j, generics = self.generics(i + 2, end)
        if self.text(j) != "(":
            return i + 1
        params = split_top(self.t[j + 1 : self.close[j]])
        j = self.close[j] + 1
        returned = None
        stop = self.until(j, end, ("{", ";"))
        if self.text(j) == "->":
            where = self.until(j, stop, ("where",))
            returned = joined(self.t[j + 1 : where])
        last = self.close[stop] if self.text(stop) == "{" else min(stop, len(self.t) - 1)
        kind = "function" if scope.owner is None else f"trait_fn({scope.owner})" if scope.trait else f"method({scope.owner})"
        is_test = scope.test or any(re.split(r"[(=\s]", a)[0].split("::")[-1] == "test" for a in at["attrs"])
        row = {
            "name": name, "signature": joined(self.t[at["first"] : stop]), "file_path": self.path, "start_line": self.t[i].line, "end_line": self.t[last].line,
            "is_async": "async" in at["words"], "is_unsafe": "unsafe" in at["words"], "is_pub": at["public"] and not scope.trait, "is_const": "const" in at["words"], "is_test": is_test,
            "generics": generics, "parameters": [joined(self.bare(p)) for p in params], "return_type": returned, "kind": kind,
            "kind_tag": kind.split("(")[0], "owner_type": scope.owner, "cfg_attrs": at["cfg"], "module_path": list(scope.module), "attributes": at["attrs"],
        }
        row["fn_id"] = f"{self.path}:{row['start_line']}:{name}"
        row["ordinal"] = len(self.out.functions)
        self.out.functions.append(row)
        self.types_in(self.close[j - 1] if self.text(j - 1) == ")" else i, stop, row)
        for k, p in enumerate(params):
            self.string_site("parameter", p, row, k)
        if self.text(stop) == "{":
            self.body(stop + 1, last, Scope(scope.module, scope.cfg, is_test), row)
        return last + 1

    @staticmethod
    def bare(tokens: list[Token]) -> list[Token]:
        """Without leading attributes."""
        while len(tokens) > 1 and tokens[0].text == "#":
            depth = 0
            for k, t in enumerate(tokens):
                depth += (t.text == "[") - (t.text == "]")
                if t.text == "]" and not depth:
                    tokens = tokens[k + 1 :]
                    break
            else:
                break
        return tokens

    def named_type(self, i, end, at, symbol_kind, **more):
        row = {
            "symbol_kind": symbol_kind, "name": self.text(i + 1), "file_path": self.path, "start_line": self.t[i].line, "end_line": self.t[min(end, len(self.t) - 1)].line, "is_pub": at["public"],
            "generics": [], "fields": [], "variants": [], "ty": None, "rhs": None, "kind": symbol_kind, "cfg_attrs": at["cfg"], "signature": "",
        } | more
        row["symbol_id"] = f"{symbol_kind.split(' ')[0]}:{self.path}:{row['start_line']}:{row['name']}"
        self.out.types.append(row)
        for a in at["attrs"]:
            if m := re.match(r"derive\((.*)\)$", a):
                for d in filter(None, (x.strip() for x in m[1].split(","))):
                    self.out.impls.append({"type_name": row["name"], "trait_path": d, "trait_name": d.split("::")[-1], "impl_kind": "derive", "file_path": self.path, "line": row["start_line"]})
        return row

    def item_struct(self, i, end, scope, fn, at):
        j, generics = self.generics(i + 2, end)
        stop = self.until(j, end, ("{", "(", ";"))
        fields, last = [], stop
        if self.text(stop) in ("{", "("):
            last = self.close[stop]
            parts = [self.bare(p) for p in split_top(self.t[stop + 1 : last])]
            fields = [joined(p) for p in parts]
            if self.text(stop) == "(":
                last = min(self.until(last, end, (";",)), len(self.t) - 1)
        sig_end = stop if self.text(stop) == "{" else last
        row = self.named_type(i, last, at, "struct", generics=generics, fields=fields, signature=joined(self.t[at["first"] : sig_end]))
        if self.text(stop) == "{":
            for k, p in enumerate(split_top(self.t[stop + 1 : self.close[stop]])):
                self.string_site("field", self.bare(p), row, k)
        self.types_in(stop + 1, last, None)
        return last + 1

    item_union = item_struct

    def item_enum(self, i, end, scope, fn, at):
        j, generics = self.generics(i + 2, end)
        stop = self.until(j, end, ("{",))
        if stop >= end:
            return end
        variants = []
        for p in split_top(self.t[stop + 1 : self.close[stop]]):
            p = self.bare(p)
            eq = next((k for k, x in enumerate(p) if x.text == "="), None)
            inner = p[2:-1] if len(p) > 2 and p[1].text in "({" and eq is None else []
            variants.append({"name": p[0].text, "fields": [joined(self.bare(x)) for x in split_top(inner)], "discriminant": joined(p[eq + 1 :]) if eq else None})
        self.named_type(i, self.close[stop], at, "enum", generics=generics, variants=variants, signature=joined(self.t[at["first"] : stop]))
        return self.close[stop] + 1

    def item_trait(self, i, end, scope, fn, at):
        j, generics = self.generics(i + 2, end)
        stop = self.until(j, end, ("{", ";"))
        last = self.close.get(stop, min(stop, len(self.t) - 1))
        self.named_type(i, last, at, "trait", generics=generics, signature=joined(self.t[at["first"] : stop]))
        if self.text(stop) == "{":
            self.items(stop + 1, last, Scope(scope.module, scope.cfg, scope.test, self.text(i + 1), True), None)
        return last + 1

    def item_impl(self, i, end, scope, fn, at):
        j, _ = self.generics(i + 1, end)
        stop = self.until(j, end, ("{", ";"))
        where = self.until(j, stop, ("where",))
        head = self.t[j:where]
        split = next((k for k, x in enumerate(head) if x.text == "for" and (k + 1 >= len(head) or head[k + 1].text != "<")), None)
        target = joined(head[split + 1 :] if split is not None else head)
        name = re.split(r"[<\s]", target.lstrip("&").strip())[0].split("::")[-1]
        if split is not None:
            trait = joined(head[:split]).lstrip("!")
            bare = re.sub(r"<.*", "", trait)
            self.out.impls.append({"type_name": name, "trait_path": bare, "trait_name": bare.split("::")[-1], "impl_kind": "handwritten", "file_path": self.path, "line": self.t[i].line})
            depth = 0  # of the trait only the types between angle brackets are references to types
            for k in range(j, j + split):
                depth += {"<": 1, ">": -1, ">>": -2}.get(self.text(k), 0)
                if depth:
                    self.types_in(k, k + 1, None)
        self.types_in(j + (split + 1 if split is not None else 0), where, None)
        if self.text(stop) == "{":
            self.items(stop + 1, self.close[stop], Scope(scope.module, scope.cfg, scope.test, name), None)
            return self.close[stop] + 1
        return stop + 1

    def item_const(self, i, end, scope, fn, at):
        return self.constant(i, end, scope, fn, at, "const")

    def item_static(self, i, end, scope, fn, at):
        return self.constant(i, end, scope, fn, at, "static")

    def constant(self, i, end, scope, fn, at, kind):
        at_name = i
        if self.text(i + 1) == "mut":
            kind, at_name = "static mut", i + 1
        stop = self.until(i, end, (";",))
        eq = self.until(i, stop, ("=",))
        colon = self.until(i, eq, (":",))
        if self.t[at_name + 1].kind == "ident" and colon < eq and fn is None:
            shown = f"const({scope.owner})" if scope.owner and kind == "const" else kind
            row = self.named_type(at_name, stop, at, kind, kind=shown, ty=joined(self.t[colon + 1 : eq]), signature=joined(self.t[at["first"] : eq]))
            row["start_line"] = self.t[i].line
            row["symbol_id"] = f"const:{self.path}:{row['start_line']}:{row['name']}"
        self.body(eq + 1, stop, scope, fn)
        return stop + 1

    def item_type(self, i, end, scope, fn, at):
        stop = self.until(i, end, (";",))
        eq = self.until(i, stop, ("=",))
        if scope.owner is None:
            _, generics = self.generics(i + 2, eq)
            self.named_type(i, stop, at, "alias", generics=generics, rhs=joined(self.t[eq + 1 : stop]) if eq < stop else None, signature=joined(self.t[at["first"] : stop]))
        return stop + 1

    def item_extern(self, i, end, scope, fn, at):
        return i + 1

    def item_macro_rules(self, i, end, scope, fn, at):
        j = self.until(i + 1, end, ("{", "(", "["))
        return self.close[j] + 1 if j < end else end

    # bodies

    def emit(self, kind: str, i: int, fn: dict | None, qualifier: str = "") -> None:
        """An occurrence of the identifier at i, at the place where its path begins."""
        at = self.t[i if kind in ("method", "field", "macro") else self.path_back(i)]
        self.out.occurrences.append({"file_path": self.path, "line": at.line, "col": at.col, "ident": self.t[i].text, "qualifier": qualifier, "kind": kind, "fn_id": fn and fn["fn_id"]})

    def types_in(self, i: int, end: int, fn: dict | None) -> None:
        for k in range(i, min(end, len(self.t))):
            if self.t[k].kind == "ident" and self.t[k].text[:1].isupper() and self.text(k + 1) != "::":
                self.emit("type", k, fn)

    def string_site(self, role: str, tokens: list[Token], owner: dict, position: int) -> None:
        tokens = self.bare(tokens)
        names = [t for t in tokens if t.text not in ("pub", "mut", "ref", "let")]
        if names and names[0].text == "(":  # pub(crate)
            names = names[next((k for k, t in enumerate(names) if t.text == ")"), -1) + 1 :]
        if len(names) >= 3 and names[0].kind == "ident" and names[1].text == ":":
            ty = joined(names[2:])
            if _STRINGS.match(ty):
                holder = owner.get("fn_id") or owner.get("symbol_id")
                self.out.string_sites.append({"site_id": f"{self.path}:{names[0].line}:{names[0].text}", "role": role, "name": names[0].text, "ty": ty, "owner": holder, "owner_name": owner["name"], "position": position, "file_path": self.path, "line": names[0].line, "is_test": bool(owner.get("is_test"))})

    def path_back(self, i: int) -> int:
        """Start of the path whose last segment is at i."""
        while i >= 2 and self.text(i - 1) == "::":
            if self.t[i - 2].kind == "ident":
                i -= 2
            elif self.text(i - 2) == ">":
                depth, k = 0, i - 2
                while k > 0:
                    depth += (self.text(k) == ">") - (self.text(k) == "<")
                    if not depth:
                        break
                    k -= 1
                if self.text(k - 1) == "::" and self.t[k - 2].kind == "ident":
                    i = k - 2
                elif self.t[k - 1].kind == "ident":
                    i = k - 1
                else:
                    return k
            else:
                return i - 1
        return i

    def path_text(self, a: int, b: int) -> str:
        out, depth = "", 0
        for k in range(a, b + 1):
            x = self.text(k)
            if x == "<":
                depth += 1
            if not depth:
                out += x
            if x == ">":
                depth -= 1
        return re.sub(r"(::)+", "::", out).strip(":")

    def chain_back(self, r: int) -> int:
        """Start of the expression with postfix parts (calls, fields, indices, ``?``) whose last token is at r."""
        while r > 0:
            x = self.text(r)
            if x == "?":
                r -= 1
                continue
            if x in (")", "]", "}") and self.t[r].kind == "punct":
                r = self.close[r]
                before = self.t[r - 1]
                if before.kind == "ident" and before.text not in _NOT_CALLS or before.text in (")", "]", "?"):
                    r -= 1
                    continue
                if before.text == "!" and self.t[r - 2].kind == "ident":
                    r = self.path_back(r - 2)
                elif before.text == ">":  # the type arguments of a call
                    depth, k = 0, r - 1
                    while k > 0:
                        depth += {">": 1, ">>": 2, "<": -1, "<<": -2}.get(self.text(k), 0)
                        if depth <= 0:
                            break
                        k -= 1
                    if self.text(k - 1) == "::" and self.t[k - 2].kind == "ident":
                        r = k - 2
                        continue
            elif self.t[r].kind == "ident":
                r = self.path_back(r)
            if self.text(r - 1) != ".":
                return r
            r -= 2
        return max(r, 0)

    def call(self, kind: str, callee: str, base: str, i: int, fn: dict | None, args: list[str]) -> None:
        """A call site, at the place where the whole call expression begins."""
        self.out.call_sites.append({"caller_id": fn and fn["fn_id"], "caller_name": fn and fn["name"], "callee": callee, "callee_base": base, "call_kind": kind, "file_path": self.path, "line": self.t[i].line, "column": self.t[i].col, "args": args})

    def macro(self, i: int, scope: Scope, fn: dict | None, statement: bool) -> int:
        """A macro call whose name is at i; its arguments give occurrences, but no call sites."""
        j = i + 2
        if self.t[j].kind == "ident" if j < len(self.t) else False:
            j += 1
        if self.text(j) not in ("(", "[", "{"):
            return i + 1
        if not statement:
            name = self.path_text(self.path_back(i), i)
            self.call("macro", name + "!", self.text(i) + "!", self.path_back(i), fn, [joined(p) for p in split_top(self.t[j + 1 : self.close[j]])])
        self.emit("macro", i, fn)
        self.body(j + 1, self.close[j], scope, fn, in_macro=True)
        return self.close[j] + 1

    def pattern_heads(self, i: int, end: int) -> set[int]:
        """Places in a body where a pattern stands: after ``let`` up to ``=``, and before ``=>``."""
        found: set[int] = set()
        k = i
        while k < end:
            x = self.text(k)
            if x == "let":
                stop = self.until(k, end, ("=", ";"))
                colon = self.until(k, stop, (":",))
                found.update(range(k, min(stop, colon)))
            elif x == "=>":
                back, depth = k - 1, 0
                while back > i:
                    y = self.text(back)
                    if y in (")", "]", "}") and self.t[back].kind == "punct":
                        if y == "}" and self.text(back - 1) not in (",",) and self.t[self.close[back] - 1].kind != "ident":
                            break
                        back = self.close[back]
                    elif y in (",", "{", ";") or y == "if":
                        break
                    back -= 1
                found.update(range(back + 1, k))
                depth += 0
            k += 1
        return found

    def body(self, i: int, end: int, scope: Scope, fn: dict | None, in_macro: bool = False) -> None:
        patterns = self.pattern_heads(i, end)
        own = fn and fn["fn_id"]
        k = i
        while k < end:
            t = self.t[k]
            if t.text in _ITEM_WORDS | {"#", "pub"} and not in_macro and self.text(k - 1) in ("{", "}", ";", "]"):
                if t.text != "const" or self.t[k + 1].kind == "ident":
                    after = self.item(k, end, Scope(scope.module, scope.cfg, scope.test), fn)
                    if after > k + 1:
                        k = after
                        continue
            if t.kind == "str":
                self.out.literals.append({"fn_id": own, "file_path": self.path, "line": t.line, "col": t.col, "literal": re.sub(r'^[bc]?r?#*"|"#*$', "", t.text), "before": joined(self.t[max(i, k - 3) : k]), "after": joined(self.t[k + 1 : min(end, k + 3)])})
            elif t.kind == "punct" and t.text in ("?", "&&", "||"):
                closure = t.text == "||" and self.text(k - 1) in ("(", ",", "=", "move", "=>", "{", ";", "return")
                if not closure and not (t.text == "&&" and self.text(k - 1) in ("(", ",", "=", "<", ":", "->")):
                    self.out.flow.append({"fn_id": own, "fact": "split", "what": t.text, "file_path": self.path, "line": t.line, "col": t.col})
                elif closure:
                    self.out.flow.append({"fn_id": own, "fact": "deferred", "what": "closure", "file_path": self.path, "line": t.line, "col": t.col})
            elif t.text in ("if", "while", "for", "loop", "match") and t.kind == "ident":
                self.out.flow.append({"fn_id": own, "fact": "split", "what": t.text, "file_path": self.path, "line": t.line, "col": t.col})
            elif t.text == "async" and self.text(k + 1) in ("{", "move"):
                self.out.flow.append({"fn_id": own, "fact": "deferred", "what": "async", "file_path": self.path, "line": t.line, "col": t.col})
            if t.text == "let" and fn is not None:
                stop = self.until(k, end, ("=", ";"))
                self.string_site("local", self.t[k + 1 : stop], fn, 0)
                colon = self.until(k, stop, (":",))
                self.types_in(colon + 1, stop, fn)
            if t.kind == "ident" and t.text not in _NOT_CALLS:
                k = self.name(k, i, end, scope, fn, in_macro, patterns)
                continue
            if t.text == "(" and not in_macro and k > i and self.text(k - 1) in (")", "]"):
                self.call("function", "complex_call", "complex_call", self.chain_back(k - 1), fn, [])
            k += 1

    def name(self, k: int, i: int, end: int, scope: Scope, fn: dict | None, in_macro: bool, patterns: set[int]) -> int:
        before, after = self.text(k - 1) if k > i else "", self.text(k + 1) if k + 1 < end else ""
        if after == "!" and self.text(k + 2) in ("(", "[", "{") and before != ".":
            stop = self.close[k + 2] + 1
            head = self.text(self.path_back(k) - 1)
            statement = head in ("{", "}", ";", "") and (self.text(stop) == ";" or self.text(k + 2) == "{")
            return self.macro(k, scope, fn, statement or in_macro)
        open_at, turbofish = k + 1, False
        if after == "::" and self.text(k + 2) == "<":
            open_at, turbofish = self.angle_end(k + 2, end), True
        calls = self.text(open_at) == "(" and open_at < end and (turbofish or open_at == k + 1)
        if before == ".":
            if calls:
                self.emit("method", k, fn)
                if not in_macro:
                    r = k - 2
                    plain = self.t[r].kind == "ident" and self.text(r - 1) != "."
                    start = self.path_back(r) if plain else r
                    receiver = self.path_text(start, r) if plain else "receiver"
                    self.call("method", f"{receiver}.{self.text(k)}", self.text(k), self.chain_back(r), fn, [joined(p) for p in split_top(self.t[open_at + 1 : self.close[open_at]])])
            elif self.text(k) != "await":
                self.emit("field", k, fn)
                if calls is False and self.text(k + 1) == ")" and self.text(k + 2) == "(" and not in_macro:
                    self.call("function", f"field::{self.text(k)}", self.text(k), self.close[k + 1], fn, [])
            return k + 1
        if after == "::" and not turbofish:
            if self.text(k + 2) and self.t[k + 2].kind == "ident" and self.text(k + 3) != "::":
                self.emit("second_last", k, fn, self.text(k + 2))
            return k + 1
        start = self.path_back(k)
        qualifier = self.path_text(start, k - 2) if start < k else ""
        if k in patterns and (calls or after == "{" or self.text(k)[:1].isupper()):
            self.emit("pattern", k, fn, qualifier)
        elif calls:
            self.emit("call", k, fn, qualifier)
            if not in_macro:
                callee = f"{qualifier}::{self.text(k)}" if qualifier else self.text(k)
                self.call("function", callee, self.text(k), start, fn, [joined(p) for p in split_top(self.t[open_at + 1 : self.close[open_at]])])
        elif after == "{" and self.text(k)[:1].isupper() and before not in ("for", "impl", "in"):
            self.emit("struct", k, fn, qualifier)
        elif self.text(k)[:1].isupper() and before in (":", "<", "as", "->", "&", "dyn", "impl"):
            self.emit("type", k, fn, qualifier)
        elif k not in patterns:
            self.emit("path", k, fn, qualifier)
        return k + 1


def extract(path: str, text: str) -> Relations:
    return Parser(path, text).run()
