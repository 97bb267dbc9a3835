"""A pushdown parser over fences, brackets, quotations, lists, markup and code, to tell whether an answer breaks off."""

from __future__ import annotations

import ast
import re

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "《": "》"}
_CLOSE = {v: k for k, v in _OPEN.items()}
_QUOTES = "\"“”„«»"
_TOKEN = re.compile(r"(?P<fence>^[ \t]*(?:```+|~~~+)|```+)|(?P<face>(?<!\w)[:;=]-?[()\[\]](?!\w))|(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>)|(?P<item>^[ \t]*(?:\d{1,3}[.)]|[-*•])(?=\s))|(?P<bracket>[()\[\]{}（）【】「」《》])|(?P<quote>[\"“”„«»])|(?P<gap>\n[^\S\n]*\n)", re.M)
_IN_CODE = re.compile(r"```+|~~~+|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[()\[\]{}（）【】「」《》]|//[^\n]*")
# Elements of HTML whose end may be left out, and those that need one.
_VOID = frozenset("br hr img input meta link p li td tr th dt dd option tbody thead tfoot".split())
_PAIRED = frozenset("a article aside b blockquote body button code div dl em figure footer form h1 h2 h3 h4 h5 h6 head header html i label main nav ol pre script section select small span strong style sub sup table textarea title u ul".split())
_ITEM = re.compile(r"(?:(?<=\s)|^)(\d{1,3})[.)](?=\s|$)")
_CODE = re.compile(r"^\s*(?:```|~~~|(?:async\s+)?def \w+\s*\(|class \w+|function\s*\w*\s*\(|(?:public|private|static|const|let|var|import|from|#include)\b)")
_PROSE_END = re.compile(r"[.!?…。！？।;:][\s\"'’”“»›)\]}*_`~“]*$")


def _tag(stack: list[str], token: str, counts: frozenset[str] | None = None) -> None:
    if token.endswith("/>"):
        return
    name = re.match(r"</?(\w+)", token)[1].lower()
    if token[1] == "/":
        if name in stack:
            del stack[stack.index(name) :]
    elif name not in _VOID and (counts is None or name in counts):
        stack.append(name)


def _bracket(stack: list[str], token: str) -> None:
    if token in _OPEN:
        stack.append(token)
    elif _CLOSE[token] in stack:
        while stack.pop() != _CLOSE[token]:
            pass


def stack_of(text: str) -> list[str]:
    """What is still open at the end of code: fences, brackets and markup tags; strings and comments inside a line are skipped."""
    stack: list[str] = []
    for m in _IN_CODE.finditer(text):
        t = m[0]
        if t[:3] in ("```", "~~~"):
            if t[:3] in stack:
                del stack[stack.index(t[:3]) :]
            else:
                stack.append(t[:3])
        elif t in _OPEN or t in _CLOSE:
            _bracket(stack, t)
        elif t[0] == "<":
            _tag(stack, t)
    return stack


def open_at_end(text: str) -> list[str]:
    """What is still open at the end of a text that is not code alone, outermost first: fences, brackets, tags, quotations ('"')
    and the list item ('item') it ends in.

    One pass with a stack. Inside a fence only the fence's end counts. A closing bracket, tag or quotation mark closes what stands
    above its partner; without a partner it says nothing. A straight quotation mark opens behind white space, an opening bracket or a
    dash and closes otherwise; any closing mark ends any quotation. A quotation runs on over a blank line only if the next paragraph
    opens with a mark of its own. A list
    marker closes the item before it if nothing else is open inside that item, so a bracket left open stays open. A tag counts if it is
    an HTML element that needs an end, or if the text closes a tag of that name elsewhere or opens with a tag.
    """
    closed = {m[1].lower() for m in re.finditer(r"</(\w+)", text)} if "</" in text else set()
    if re.match(r"\s*<[A-Za-z]", text):
        closed |= {m[1].lower() for m in re.finditer(r"<(\w+)", text)}
    counts = _PAIRED | closed
    stack: list[str] = []
    for m in _TOKEN.finditer(text):
        kind, t = m.lastgroup, m[0]
        if kind == "fence":
            mark = t.strip()[:3]
            if mark in stack:
                del stack[stack.index(mark) :]
            else:
                stack.append(mark)
        elif "```" in stack or "~~~" in stack or kind == "face":
            continue
        elif kind == "tag":
            _tag(stack, t, counts)
        elif kind == "bracket":
            _bracket(stack, t)
        elif kind == "item":
            if stack and stack[-1] == "item":
                stack.pop()
            stack.append("item")
        elif kind == "gap":
            if "\"" in stack and text[m.end() : m.end() + 1] not in _QUOTES:
                stack.remove("\"")
            if stack and stack[-1] == "item":
                stack.pop()
        elif t == "\"":
            before, behind = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
            opens = (not before or before.isspace() or before in "([{（-–—=:>*_'‘" or before in _OPEN) and behind and not behind.isspace()
            if opens and "\"" not in stack:
                stack.append("\"")
            elif "\"" in stack:
                del stack[stack.index("\"") :]
        elif t in "„“«" and "\"" not in stack:
            if text[m.end() : m.end() + 1].strip() or t == "«":
                stack.append("\"")
        elif t in "”»“" and "\"" in stack:
            del stack[stack.index("\"") :]
        elif t == "»" and text[m.end() : m.end() + 1].strip() and (not m.start() or text[m.start() - 1].isspace()):
            stack.append("\"")
    return stack


def unclosed(text: str) -> list[str]:
    """open_at_end without the last list item, whose end is the text's own."""
    return [x for x in open_at_end(text) if x != "item"]


def is_code(text: str) -> bool:
    return bool(_CODE.match(text))


def code_breaks_off(text: str) -> bool:
    """An open fence or bracket at the end, or a Python function that stops while what it worked out is still unused: its last words
    are a bare name, or it sets local names and neither gives anything back nor does anything else."""
    if stack_of(text):
        return True
    body = re.sub(r"^\s*(?:```|~~~)[^\n]*\n|\n?\s*(?:```|~~~)\s*$", "", text)
    if not re.match(r"\s*(?:async\s+)?(?:def|class) ", body):
        return not text.rstrip().endswith(("}", ";", "`", "~", ")")) and bool(re.match(r"\s*(?:function|public|private|static)\b", body))
    try:
        tree = ast.parse(body.strip("\r\n\t "))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return "\n" in body.strip() or body.rstrip().endswith(":") or "(" in body and ")" not in body
    return any(_unused(f) for f in ast.walk(tree) if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)))


def _unused(f: ast.FunctionDef | ast.AsyncFunctionDef) -> bool:
    inside = list(ast.walk(f))
    if any(isinstance(x, (ast.Return, ast.Yield, ast.YieldFrom, ast.Raise)) for x in inside):
        return False
    if isinstance(f.body[-1], ast.Expr) and isinstance(f.body[-1].value, (ast.Name, ast.Attribute)):
        return True
    shared = {n for x in inside if isinstance(x, (ast.Global, ast.Nonlocal)) for n in x.names}
    stores = [x for x in inside if isinstance(getattr(x, "ctx", None), (ast.Store, ast.Del)) and not isinstance(x, (ast.Tuple, ast.List, ast.Starred))]
    local = [x for x in stores if isinstance(x, ast.Name) and x.id not in shared]
    acts = len(local) < len(stores) or any(isinstance(x, ast.Expr) and isinstance(x.value, (ast.Call, ast.Await)) for x in inside)
    return any(isinstance(x, (ast.Assign, ast.AugAssign, ast.AnnAssign)) for x in inside) and not acts


def list_items(text: str) -> list[str] | None:
    """Items of a list numbered 1, 2, 3, ... that opens the text, on lines of their own or not; None for other text."""
    starts, expect = [], 1
    for m in _ITEM.finditer(text):
        if int(m[1]) == expect:
            starts.append(m)
            expect += 1
    if not starts or re.search(r"[^\W_]", text[: starts[0].start()]):
        return None
    ends = [m.start() for m in starts[1:]] + [len(text)]
    return [text[m.end() : e].strip() for m, e in zip(starts, ends)]


def list_breaks_off(items: list[str], asked: int | None) -> bool:
    """The last item is empty, ends in an opening mark, has fewer words than every other one, or items are missing."""
    count = [len(re.findall(r"[^\W_]+", x)) for x in items]
    if not count[-1] or re.search(r"[(,\[{\-–—…]\s*$|(?<!\.)\.\.\.$", items[-1]):
        return True
    if asked and len(items) < asked:
        return True
    if len(items) == 1:
        return count[0] < 3 and not _PROSE_END.search(items[0])
    return count[-1] < min(count[:-1]) and not _PROSE_END.search(items[-1])


def _tail(text: str) -> str:
    """The last letter or digit and all marks behind it: what the end of a text is judged by."""
    end = len(text)
    while end and not (text[end - 1].isalnum()):
        end -= 1
    return text[max(0, end - 1) :]


def prose_breaks_off(text: str) -> bool:
    """Prose that does not end like a sentence, stops at an ellipsis inside one, or leaves a fence, bracket, tag or quotation
    open, wherever it was opened."""
    own = _tail(re.sub(r"(?:\s*</[A-Za-z]\w*>)+$", "", text.rstrip()))
    if re.search(r"[^\s.!?。！？…][\s\"'’”“»)\]*_]*(?:(?<!\.)\.{3}|…)[\s\"'’”“»)\]*_]*$", own):
        return True
    if not _PROSE_END.search(own):
        return True
    if re.search(r":\W*$", own) and not re.search(r"[.!?…。！？]\W*$", own):
        return True
    return bool(unclosed(text))
