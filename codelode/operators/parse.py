"""Syntax nodes of source files.

A parser is a function from (path, text) to node tuples; PARSERS has one per language. Python is read
by the standard library's ast module, whose nodes are named as in schemas; Java, JavaScript,
TypeScript and Bash by patterns for declarations and calls with brace matching. Other languages have
no nodes. A file that can't be parsed has none either. Offsets count characters.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from codelode import schemas as S
from codelode.functions.scalars import language_of

KEY = ["repo_id", "branch", "relative_path"]
#: Files whose nodes are held at once.
FILES = 256

#: node_type, name, signature, docstring, start, end (characters), parent (position in the list or None), depth, complexity
Node = tuple[str, str | None, str | None, str | None, int, int, int | None, int, int]

_PYTHON = {
    ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.ClassDef: "class_definition", ast.Call: "call",
    ast.Import: "import_statement", ast.ImportFrom: "import_from_statement", ast.If: "if_statement", ast.For: "for_statement",
    ast.AsyncFor: "for_statement", ast.While: "while_statement", ast.With: "with_statement", ast.AsyncWith: "with_statement",
    ast.ExceptHandler: "except_clause", ast.Assert: "assert_statement", ast.Raise: "raise_statement", ast.Await: "await",
}
_KEPT = {"function_definition", "class_definition", "call", "import_statement", "import_from_statement"}


def parse_python(text: str) -> list[Node]:
    tree = ast.parse(text)
    lines = text.encode().split(b"\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.decode("utf-8", "replace")) + 1)

    def at(line: int, byte: int) -> int:
        return starts[line - 1] + len(lines[line - 1][:byte].decode("utf-8", "replace"))

    counted = set(S.COMPLEXITY_TYPES["python"])
    out: list[Node] = []
    branches: list[int] = []  # of each node: those directly in it, then those of all below it

    stack: list[tuple[ast.AST, int | None, int]] = [(tree, None, 0)]
    while stack:
        node, parent, depth = stack.pop()
        kind = _PYTHON.get(type(node))
        mine = parent
        if kind in _KEPT:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
            start = at(node.lineno, node.col_offset) if first == node.lineno else at(first, node.col_offset)
            end = at(node.end_lineno, node.end_col_offset)
            name = signature = doc = None
            if kind in ("function_definition", "class_definition"):
                name = node.name
                signature = f"{name}({ast.unparse(node.args)})" if hasattr(node, "args") else name
                body = node.body[0]
                if isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str):
                    doc = text[at(body.lineno, body.col_offset) : at(body.end_lineno, body.end_col_offset)]
            elif kind == "call":
                name = ast.unparse(node.func) if isinstance(node.func, ast.Name | ast.Attribute) else None
                signature = name
            mine = len(out)
            out.append((kind, name, signature, doc, start, end, parent, depth, 1))
            branches.append(0)
        elif kind in counted and parent is not None:
            branches[parent] += 1
        stack += [(c, mine, depth + 1) for c in reversed(list(ast.iter_child_nodes(node)))]
    for i in reversed(range(len(out))):  # a parent stands before what it holds
        if out[i][6] is not None:
            branches[out[i][6]] += branches[i]
    return [n if n[0] == "call" else (*n[:8], 1 + k) for n, k in zip(out, branches, strict=True)]


_TYPE_HEADS = {
    "java": (("class_declaration", re.compile(r"(?:\b(?:public|protected|private|abstract|final|static)\s+)*\bclass\s+(\w+)[^{;()]*\{")),),
    "javascript": (("class_declaration", re.compile(r"(?:\bexport\s+(?:default\s+)?)?\bclass\s+(\w+)[^{;()]*\{")),),
    "typescript": (
        ("class_declaration", re.compile(r"(?:\bexport\s+(?:default\s+)?)?(?:\babstract\s+)?\bclass\s+(\w+)[^{;()]*\{")),
        ("interface_declaration", re.compile(r"(?:\bexport\s+(?:default\s+)?)?\binterface\s+(\w+)[^{;()]*\{")),
    ),
}
_CALL = {"java": "method_invocation", "javascript": "call_expression", "typescript": "call_expression"}
#: A name, type arguments, and the bracket that opens its list.
_LISTED = re.compile(r"(?<![\w.$])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*(?:<[^<>(){};=]*(?:<[^<>(){};=]*>[^<>(){};=]*)*>\s*)?\(")
#: What may stand between a list and the body of what it declares.
_BODY = {"java": re.compile(r"\s*(?:throws\s[\w\s,.]+)?\{"), "javascript": re.compile(r"\s*\{"), "typescript": re.compile(r"\s*(?::\s*[\w\[\"'][^{};=]*)?\{")}
_NO_BODY = {"java": re.compile(r"\s*(?:throws\s[\w\s,.]+)?;"), "typescript": re.compile(r"\s*:\s*[\w\[{(]")}
_MODIFIERS = re.compile(r"(?:\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|async|readonly|override|declare|get|set)\s+)*[*#]?\s*$")
_MODIFIED, _SPACE = re.compile(r"^(?:\b(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp)\s+)*"), re.compile(r"\s*")
_FUNCTION = re.compile(r"(?:\bexport\s+(?:default\s+)?)?(?:\basync\s+)?\bfunction\s*\*?\s*$")
_RESULT = re.compile(r"(?:<[\w<>,\s?&]*>\s*)?[\w$][\w$.]*(?:\s*<[\w<>\[\],.\s?&]*>)?(?:\s*\[\s*\])*\s*$")
_ARROW = re.compile(r"(?:\bexport\s+)?\b(?:const|let)\s+([\w$]+)\s*(?::[^=;]+(?:=>[^=;]+)?)?=\s*(?:async\s*)?(?:(?:function\b[\s*]*[\w$]*\s*)?(?:<[^<>(){}]*>\s*)?\(|[\w$]+\s*=>)")
_BRANCH = re.compile(r"\b(?:if|for|while|do|switch|case|catch|throw|assert|await)\b|\?")
_NOT_NAMES = frozenset("if for while switch catch return function new super synchronized do else typeof throw case await yield with assert in of instanceof delete void try import this".split())
_BASH = re.compile(r"^[ \t]*(?:function\s+)?([\w-]+)\s*\(\)\s*\{", re.M)


def _blanked(text: str, lang: str) -> tuple[str, list[tuple[int, int]]]:
    """Comments and strings as blanks of the same length, so that offsets stay, and where block comments are."""
    if lang == "bash":
        return re.sub(r"(?m)(?<!\S)#[^\n]*", lambda m: " " * len(m[0]), text), []
    comments: list[tuple[int, int]] = []

    def blank(m: re.Match) -> str:
        if m[0].startswith("/*"):
            comments.append(m.span())
        return re.sub(r"[^\n]", " ", m[0])

    code = re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", blank, text, flags=re.S)
    return code, comments


def _brackets(code: str) -> dict[int, int]:
    """For each opening bracket where its pair ends. Round ones that don't match are left out; curly ones must."""
    ends: dict[int, int] = {}
    open_: list[int] = []
    for m in re.finditer(r"[(){}]", code):
        if m[0] in "({":
            open_.append(m.start())
            continue
        want = "(" if m[0] == ")" else "{"
        while open_ and code[open_[-1]] == "(" != want:
            open_.pop()
        if open_ and code[open_[-1]] == want:
            ends[open_.pop()] = m.end()
    if any(code[i] == "{" for i in open_):
        raise SyntaxError("unbalanced braces")
    return ends


def _before(code: str, at: int) -> tuple[int, str]:
    """Where the statement or member that reaches `at` begins, as far as its line and the signs `{`, `}`, `;`, `,` tell, and its text up to there."""
    line = code.rfind("\n", 0, at) + 1
    first = max(line, *(code.rfind(c, line, at) + 1 for c in "{};,"))
    return first, code[first:at]


def _expression_end(code: str, at: int, ends: dict[int, int]) -> int:
    """Where the expression that begins at `at` ends: at a semicolon, a closing bracket or the end of a line, outside of brackets."""
    while at < len(code):
        if code[at] in ";)}],\n":
            return at
        at = ends.get(at, at + 1)
    return at


def _declared(code: str, lang: str, ends: dict[int, int]) -> tuple[list[tuple[int, int, str, str]], list[tuple[int, int, str, str]]]:
    """(start, end, kind, name) of declarations, and of calls.

    A name with a list and a body is a declaration, unless it is a keyword: in Java a constructor where no type stands
    before it, else a method (which may lack a body); in JavaScript and TypeScript a function after that word, else a
    method. A constant or variable that is bound to a function is a lexical_declaration of its name.
    """
    spans = []
    for kind, pattern in _TYPE_HEADS[lang]:
        for m in pattern.finditer(code):
            spans.append((m.start(), ends[m.end() - 1], kind, m[1]))
    calls = []
    for m in _LISTED.finditer(code):
        name, close = m[1], ends.get(m.end() - 1)
        if name in _NOT_NAMES or close is None:
            continue
        first, head = _before(code, m.start())
        body = _BODY[lang].match(code, close)
        bare = head.lstrip()
        if lang == "java":
            plain = _MODIFIED.sub("", re.sub(r"@\w+(?:\([^()]*\))?\s*", "", bare))
            typed = bool(_RESULT.fullmatch(plain)) and re.match(r"\w*", plain)[0] not in _NOT_NAMES - {"void", "synchronized"}
            end = body or typed and _NO_BODY["java"].match(code, close)
            if "." not in name and end and (typed or not plain):
                spans.append((first + len(head) - len(bare), ends[end.end() - 1] if body else end.end(), "method_declaration" if typed else "constructor_declaration", name))
                continue
            if re.search(r"\bnew\s+$", head):
                continue
        else:
            if f := _FUNCTION.search(code, max(m.start() - 60, 0), m.start()):
                if body:
                    spans.append((f.start(), ends[body.end() - 1], "function_declaration", name))
                continue
            if "." not in name and _MODIFIERS.fullmatch(bare):
                if body:
                    spans.append((first + len(head) - len(bare), ends[body.end() - 1], "method_definition", name))
                    continue
                if lang == "typescript" and _NO_BODY[lang].match(code, close):
                    continue
            if re.search(r"\bnew\s+$", head):
                continue
        calls.append((m.start(), close, _CALL[lang], name))
    for m in _ARROW.finditer(code) if lang != "java" else ():
        at, last = m.end(), m[0][-1]
        if last == "(":
            if (at := ends.get(m.end() - 1)) is None:
                continue
            if re.search(r"\bfunction\b[\s*]*[\w$]*\s*(?:<[^<>]*>\s*)?\($", m[0]):
                if not (body := _BODY[lang].match(code, at)):
                    continue
                at = body.end() - 1
            elif arrow := re.compile(r"\s*(?::\s*[^={};]+)?=>").match(code, at):
                at = arrow.end()
            else:
                continue
        at = _SPACE.match(code, at).end()
        end = ends[at] if code[at : at + 1] == "{" else _expression_end(code, at, ends)
        spans.append((m.start(), end, "lexical_declaration", m[1]))
    return spans, calls


def parse_braces(text: str, lang: str) -> list[Node]:
    code, comments = _blanked(text, lang)
    ends = _brackets(code)
    if lang == "bash":
        spans = [(m.start() + len(m[0]) - len(m[0].lstrip()), ends[m.end() - 1], "function_definition", m[1]) for m in _BASH.finditer(code)]
    else:
        spans, calls = _declared(code, lang, ends)
        spans = spans + calls
    spans.sort(key=lambda x: (x[0], -x[1]))
    closed = [b for _, b in comments]
    out: list[Node] = []
    open_: list[tuple[int, int]] = []
    for s, e, kind, name in spans:
        while open_ and open_[-1][1] <= s:
            open_.pop()
        last = bisect.bisect_right(closed, s) - 1
        doc = text[comments[last][0] : comments[last][1]] if last >= 0 and not text[closed[last] : s].strip() else None
        is_call = kind in S.CALL_TYPES
        brace = code.find("{", s, e)
        head = text[s : brace if brace >= 0 else e].rstrip(" ;")
        out.append((kind, name, name if is_call else " ".join(head.split()), None if is_call else doc, s, e, open_[-1][0] if open_ else None, len(open_), 1 if is_call else 1 + len(_BRANCH.findall(code, s, e))))
        if not is_call:
            open_.append((len(out) - 1, e))
    return out


PARSERS: dict[str, Callable[[str], list[Node]]] = {"python": parse_python, **{k: (lambda text, k=k: parse_braces(text, k)) for k in (*_TYPE_HEADS, "bash")}}


def nodes_of(path: str, text: str, language: str | None) -> Iterator[tuple]:
    """Rows of schemas.NODES without repo_id and branch."""
    parser = PARSERS.get(language or "")
    if parser is None:
        return
    try:
        found = parser(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    line_of = [0]
    for m in re.finditer("\n", text):
        line_of.append(m.end())
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    byte = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))])
    ids = [f"{path}:{n[0]}:{byte[n[4]]}-{byte[n[5]]}" for n in found]
    for i, (kind, name, signature, doc, start, end, parent, depth, complexity) in enumerate(found):
        a, b = bisect.bisect_right(line_of, start) - 1, bisect.bisect_right(line_of, max(end - 1, start)) - 1
        yield (path, ids[i], kind, name[:512] if name else None, signature, doc, a + 1, start - line_of[a], b + 1, end - line_of[b], start, end, ids[parent] if parent is not None else None, depth, complexity)


def spread(files: DataFrame) -> DataFrame:
    """files dealt over all cores, some tasks for each. Parsing takes far longer than reading, and a small table may be read as one
    split; adaptive execution, which goes by bytes, would join the parts again."""
    spark = files.sparkSession
    return files.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *KEY)


def _source(files: DataFrame, content: str) -> DataFrame:
    source = files.select(*KEY, files[content].alias("content"), language_of("relative_path").alias("language"))
    return spread(source.where("language is not null and content is not null"))


def parse_files(files: DataFrame, content: str = "content", parents: bool = False) -> DataFrame:
    """Rows of schemas.NODES for every file (repo_id, branch, relative_path, content).

    With parents, each row also has parent, the name of the node that parent_id leads to: a node's parent is in its own file, so
    the pass that parses it knows the name, and nodes need not be joined with one another.
    """
    cols = [c.split()[0] for c in S.NODES.split(", ")]
    at = cols.index("parent_id") - 2

    def rows_of(r) -> list[tuple]:
        found = list(nodes_of(r.relative_path, r.content, r.language))
        if not parents:
            return [(r.repo_id, r.branch, *n) for n in found]
        names = {n[1]: n[3] for n in found}
        return [(r.repo_id, r.branch, *n, names.get(n[at])) for n in found]

    def run(batches):
        for pdf in batches:
            for files_ in (pdf[i : i + FILES] for i in range(0, len(pdf), FILES)):
                rows = [x for r in files_.itertuples() for x in rows_of(r)]
                frame = pd.DataFrame(rows, columns=[*cols, "parent"] if parents else cols)
                yield frame.astype({c: "Int64" for c in ("start_line", "start_column", "end_line", "end_column", "start_char", "end_char", "depth", "complexity")}) if rows else frame

    return _source(files, content).mapInPandas(run, f"{S.NODES}, parent string" if parents else S.NODES)


def parse_calls(files: DataFrame, content: str = "content") -> DataFrame:
    """What calls_of gives for parse_files, with owner, the name of the definition that encloses the call.

    A call and what encloses it are in one file, so both are found by the pass that parses it: no node is stored, sorted or joined.
    """

    def run(batches):
        for pdf in batches:
            for files_ in (pdf[i : i + FILES] for i in range(0, len(pdf), FILES)):
                rows = []
                for r in files_.itertuples():
                    found = [(n[10], -n[11], n[2] in S.CALL_TYPES, n[1], n[3]) for n in nodes_of(r.relative_path, r.content, r.language) if n[2] in S.DEFINITION_TYPES or n[2] in S.CALL_TYPES and n[3] is not None]
                    opened: list[tuple[str, str | None, int]] = []
                    for _, end, called, node_id, name in sorted(found, key=lambda n: n[:3]):
                        _enclose(opened, -end)
                        if not called:
                            opened.append((node_id, name, -end))
                        elif opened:
                            rows.append((r.repo_id, r.branch, opened[-1][0], name, opened[-1][1]))
                yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in S.CALLS.split(", ")), "owner"])

    return _source(files, content).mapInPandas(run, f"{S.CALLS}, owner string")


def _enclose(opened: list[tuple], end: int) -> None:
    """Leaves of the definitions that are open those that reach `end`, their last entry."""
    while opened and opened[-1][-1] < end:
        opened.pop()


def calls_of(nodes: DataFrame) -> DataFrame:
    """Rows of schemas.CALLS: the definition that encloses each call, and the called name."""
    from pyspark.sql import functions as F

    called = F.col("node_type").isin(*S.CALL_TYPES)
    some = nodes.where(called & F.col("name").isNotNull() | F.col("node_type").isin(*S.DEFINITION_TYPES))
    some = some.select(*KEY, "node_id", called.alias("called"), "name", "start_char", "end_char")

    def run(batches):
        """Nodes stream by in the order in which they begin; only the definitions that are open are held."""
        now, opened = None, []
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if (where := (r.repo_id, r.branch, r.relative_path)) != now:
                    now, opened = where, []
                _enclose(opened, r.end_char)
                if not r.called:
                    opened.append((r.node_id, r.end_char))
                elif opened:
                    rows.append((r.repo_id, r.branch, opened[-1][0], r.name))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in S.CALLS.split(", ")])

    dealt = some.repartition(*KEY).sortWithinPartitions(*KEY, "start_char", F.desc("end_char"), "called")
    return dealt.mapInPandas(run, S.CALLS)
