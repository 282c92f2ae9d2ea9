"""The language engine: one pass over a source file, whose result all extractors share.

``scan`` gives for each file ``code``, its text with comments blanked and the contents of strings
moved out of ASCII, and ``tokens``, its words, strings and marks with what encloses them. Lines and
offsets stay as they are in the file. A pattern over ``code`` therefore finds nothing in a comment or
a string, and what it captures is put back by ``shown``. Rules about structure are joins and
windows over ``tokens``.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCRIPT, SHARP, MARKUP = r"\.(?:[mc]?[jt]sx?)$", r"\.cs$", r"(?i)\.(?:csproj|props|targets|slnx|html?|xml)$"
#: Strings' characters stand so far from their own place, in a range that no text uses.
_AWAY = 0xE000
_ASCII = "".join(map(chr, [9, *range(32, 127)]))
_MOVED = "".join(chr(_AWAY + ord(c)) for c in _ASCII)
_MOVE = {ord(c): _AWAY + ord(c) for c in _ASCII}
#: What marks a match and cuts its groups, and where these characters themselves stand in a text that has them.
MATCH, CUT = "\ufdd0", "\ufdd1"
_MARKS, _UNMARKED = MATCH + CUT, "\ue100\ue101"

_COMMENT, _GAP, _WORD, _NUMBER = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)", r"\s+", r"[^\W\d][\w$]*|[$@#]\w+", r"\d[\w.]*"
_MARK = r"=>|[!=]==?|<=|>=|&&|\|\||\?\?|\?\.|\.\.\.|[^\s\w]"
_LANGUAGES = {
    "script": re.compile(rf"(?P<g>{_GAP})|(?P<c>{_COMMENT})|(?P<w>{_WORD})|(?P<n>{_NUMBER})|(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<t>`)|(?P<p>{_MARK})"),
    "sharp": re.compile(rf"(?P<g>{_GAP})|(?P<c>{_COMMENT}|(?m:^[ \t]*\#[^\n]*))|(?P<s>\$*\"\"\"[\s\S]*?\"\"\"|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')|(?P<w>{_WORD})|(?P<n>{_NUMBER})|(?P<p>{_MARK})")}
_PATTERN_LITERAL = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: After these marks and words a slash begins a pattern, not a division.
_BEFORE_PATTERN = frozenset("( , = : [ ! & | ? { ; && || => return typeof case".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}
_NO_FUNCTION = frozenset("if for foreach while switch catch using lock with function return".split())
_TOKEN = pa.struct([("kind", pa.string()), ("text", pa.string()), ("line", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("glued", pa.bool_()), ("open", pa.int32()), ("outer", pa.int32()), ("arg", pa.int32()),
                    ("name", pa.string()), ("lead", pa.string()), ("into", pa.string()), ("inside", pa.string()), ("close", pa.int32()), ("then", pa.string())])
#: A token: its kind (w word, n number, s string, t template, r pattern, p mark), place, the marks that open around it and
#: around these, its place among the arguments there, the named function that it stands in; of an opening mark the name before it, what stands
#: before that, and where it closes; of what is assigned the name that it is assigned to.
TOKEN = "kind string, text string, line int, start int, stop int, glued boolean, open int, outer int, arg int, name string, lead string, into string, inside string, close int, then string"


def _template_end(text: str, at: int) -> int:
    """The place after the template that opens at ``at``."""
    i, depth = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "`" and not depth:
            return i + 1
        elif text.startswith("${", i):
            depth, i = depth + 1, i + 1
        elif c == "}" and depth:
            depth -= 1
        i += 1
    return len(text)


def split(text: str, language: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of everything in a text but gaps."""
    pattern, out, at, before = _LANGUAGES[language], [], 0, "("
    while at < len(text):
        m = pattern.match(text, at)
        kind, end = (m.lastgroup, m.end()) if m else ("p", at + 1)
        if kind == "t":
            end = _template_end(text, at)
        elif kind == "p" and text[at] == "/" and language == "script" and before in _BEFORE_PATTERN and (r := _PATTERN_LITERAL.match(text, at)):
            kind, end = "r", r.end()
        elif kind == "s" and text[at] == "'" and language == "script" and at and text[at - 1].isalnum():
            kind, end = "p", at + 1  # an apostrophe in running text
        if kind != "g":
            out.append((kind, at, end))
            if kind != "c":
                before = text[at:end]
        at = end
    return out


def _bounds(raw: str) -> tuple[int, int]:
    """Where a string's content begins and how many marks end it."""
    first = min(i for i in (raw.find('"'), raw.find("'"), raw.find("`")) if i >= 0)
    marks = 3 if raw.startswith('"""', first) and len(raw) >= first + 6 else 1
    return first + marks, marks if len(raw) >= first + 2 * marks else 0


def read(text: str, language: str) -> tuple[str, list[tuple]]:
    """(code, tokens) of one file."""
    code, at, line, counted = [], 0, 1, 0
    kinds, texts, lines, starts, stops, opens, outers, args, names, leads, intos, insides, closes = ([] for _ in range(13))
    stack: list[list] = []  # (place of the opening mark, arguments so far, function's name)
    opened: dict[int, int] = {}  # by closing mark, its opening one
    assigned: dict[int, str] = {}  # by enclosing mark, the name that the last = assigns to

    def before(k: int) -> tuple[str | None, int]:
        """The dotted name that ends with token k, type arguments left out, and the place before it."""
        if k >= 0 and texts[k] == ">":
            depth, j = 0, k
            while j >= 0 and k - j < 40:
                depth += (texts[j] == ">") - (texts[j] == "<")
                j -= 1
                if not depth:
                    break
            k = j if not depth else -1
        end = k
        while k >= 0 and kinds[k] == "w" and k >= 2 and texts[k - 1] in (".", "?.") and (kinds[k - 2] == "w" or texts[k - 2] in (")", "]")):
            k -= 2
        if end < 0 or kinds[end] != "w":
            return None, end
        first = k if kinds[k] == "w" else k + 1
        return "".join("." if texts[j] == "?." else texts[j] for j in range(first, end + 1)), first - 1

    for kind, start, end in split(text, language):
        raw = text[start:end]
        code.append(text[at:start])
        line, counted, at = line + text.count("\n", counted, start), start, end
        if kind == "c":
            code.append(re.sub(r"[^\n]", " ", raw))
            continue
        if kind in "str":
            head, tail = _bounds(raw) if kind != "r" else (1, len(raw) - raw.rindex("/"))
            body = raw[head : len(raw) - tail]
            code.append(raw[:head] + body.translate(_MOVE) + raw[len(raw) - tail :])
            shown = body
        else:
            code.append(raw)
            shown = raw
        i = len(kinds)
        if kind == "p" and raw in _CLOSES:
            while stack and texts[stack[-1][0]] != _CLOSES[raw] and any(texts[s[0]] == _CLOSES[raw] for s in stack):
                stack.pop()
            if stack and texts[stack[-1][0]] == _CLOSES[raw]:
                opened[i] = stack.pop()[0]
                closes[opened[i]] = i
        here = stack[-1] if stack else None
        name = lead = into = None
        if kind == "p" and raw == "=":
            j = i - 1
            while j >= 0 and i - j < 40 and opens[j] == (here[0] if here else -1) and texts[j] not in (":", ";", ",", "="):
                j -= 1
            typed = j > 0 and texts[j] == ":" and kinds[j - 1] in "wp" and texts[j - 1] not in (")",)
            named = texts[j - 1] if typed and kinds[j - 1] == "w" else texts[i - 1] if i and kinds[i - 1] == "w" else None
            assigned[here[0] if here else -1] = named
        if kind == "p" and raw in "([{":
            name, rest = before(i - 1)
            lead = texts[rest] if rest >= 0 else None
            if (lead if name else texts[i - 1] if i else None) == "=" or (lead in ("await", "new", "async") and rest >= 1 and texts[rest - 1] == "="):
                into = assigned.get(here[0] if here else -1)
            elif name == "async" and lead == "=":
                into = assigned.get(here[0] if here else -1)
        elif kind in "st" and i and texts[i - 1] == "=":
            into = assigned.get(here[0] if here else -1)
        kinds.append(kind), texts.append(shown), lines.append(line), starts.append(start), stops.append(end)
        opens.append(here[0] if here else -1), outers.append(opens[here[0]] if here else -1), args.append(here[1] if here else 0)
        names.append(name), leads.append(lead), intos.append(into), insides.append(here[2] if here else None), closes.append(-1)
        if kind == "p" and raw == "," and here:
            here[1] += 1
        if kind == "p" and raw in "([{":
            function = here[2] if here else None
            if raw == "{" and i and texts[i - 1] in (")", "=>"):
                j = i - 1 if texts[i - 1] == ")" else i - 2
                opener = opened.get(j, -1) if j >= 0 and texts[j] == ")" else -1
                if opener >= 0:
                    own = names[opener] if texts[i - 1] == ")" else None
                    own = own.rsplit(".", 1)[-1] if own and own not in _NO_FUNCTION else intos[opener]
                    function = own or function
                elif texts[i - 1] == "=>":
                    function = assigned.get(here[0] if here else -1) or function
            stack.append([i, 0, function])
    code.append(text[at:])
    glued = [k > 0 and starts[k] == stops[k - 1] for k in range(len(kinds))]
    then = [texts[c + 1] if 0 <= c < len(texts) - 1 else None for c in closes]
    return "".join(code), list(zip(kinds, texts, lines, starts, stops, glued, opens, outers, args, names, leads, intos, insides, closes, then))


#: Comments and strings of C# alone; a word or number with what a number takes along.
_OPAQUE = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|(?m:^\#[^\n]*)|(?P<s>\$*\"\"\"[\s\S]*?\"\"\"|(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|\$?\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')")
_WORDS = re.compile(rf"{_NUMBER}|({_WORD})")


def brief(text: str) -> tuple[str, list[str]]:
    """(code, words) of a C# file: the code that ``read`` gives, and each word of its tokens once.

    Only comments and strings are told apart, as no other token can hold what begins one; a mark that
    begins a string's prefix belongs to the word before it, as in ``read``.
    """
    code, plain, at = [], [], 0
    for m in _OPAQUE.finditer(text):
        raw, start = m[0], m.start()
        between = text[at:start]
        code.append(between)
        plain.append(between)
        at = m.end()
        if m.lastgroup != "s":
            code.append(re.sub(r"[^\n]", " ", raw) if "\n" in raw else " " * len(raw))
        else:
            head, tail = _bounds(raw)
            code.append(raw[:head] + raw[head : len(raw) - tail].translate(_MOVE) + raw[len(raw) - tail :])
            plain[-1] += raw[: len(raw) - len(raw.lstrip("$"))]
    code.append(text[at:])
    plain.append(text[at:])
    return "".join(code), list(dict.fromkeys(w for w in _WORDS.findall("\n".join(plain)) if w))


#: Tokens and words that are handed on at once.
TOKENS = 20_000


def _run(batches, briefly: bool = False):
    for batch in batches:
        more = batch.schema.names[2:]
        first, texts, ends, found, marks, words = 0, [], [0], [], [0], []

        def told(first=0):
            columns = zip(*found) if found else [[] for _ in _TOKEN]
            tokens = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOKEN)], fields=list(_TOKEN))
            kept = [batch.column(k).slice(first, len(texts)) for k in (0, *range(2, 2 + len(more)))]
            out = [*kept, pa.array(texts, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)]
            if briefly:
                out.append(pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(words, pa.string())))
            return pa.RecordBatch.from_arrays(out, names=["path", *more, "text", "tokens", *(["words"] if briefly else [])])

        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text, tokens = text or "", []
            language = "script" if re.search(SCRIPT, path or "") else "sharp" if re.search(SHARP, path or "") else None
            if briefly and language == "sharp":
                text, some = brief(text)
                words.extend(some)
            elif language:
                text, tokens = read(text, language)
            elif re.search(MARKUP, path or ""):
                text = re.sub(r"<!--[\s\S]*?(?:-->|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
            texts.append(text)
            found.extend(tokens)
            ends.append(len(found))
            marks.append(len(words))
            if len(found) + len(words) >= TOKENS:
                yield told(first)
                first, texts, ends, found, marks, words = first + len(texts), [], [0], [], [0], []
        if texts:
            yield told(first)


def scan(files: DataFrame, briefly: bool = False) -> DataFrame:
    """(path, text, tokens) of every file: the code and its tokens; other files keep their text, markup less its comments.

    Null texts are empty. What stands in a template's holes is part of the template, and a string
    that does not end on its line is no string. Extractors read the tokens of scripts alone: ``briefly``
    C# files have no tokens, but the different words of these as ``words``.
    """
    kept = [c for c in ("repository", "key") if c in files.columns]
    return files.select("path", "text", *kept).mapInArrow(functools.partial(_run, briefly=briefly), f"path string, {''.join(f'{c} string, ' for c in kept)}text string, tokens array<struct<{TOKEN.replace(' ', ':').replace(',:', ',')}>>{', words array<string>' if briefly else ''}")


def shown(text: Column) -> Column:
    """Captured code with its strings' contents as they were."""
    return F.translate(text, _MOVED + _UNMARKED, _ASCII + _MARKS)


def unmarked(text: Column) -> Column:
    """Code without the characters that mark matches; ``shown`` puts them back."""
    return F.when(text.contains(MATCH) | text.contains(CUT), F.translate(text, _MARKS, _UNMARKED)).otherwise(text)


def moved(text: str) -> str:
    """How a string's content stands in code."""
    return text.translate(_MOVE)


def explode(scanned: DataFrame) -> DataFrame:
    """A row for each token with its place ``i``, the six texts before it (``back``, nearest first) and those after it (``ahead``), six at most; strings begin with a double quote there."""
    said = F.transform("tokens", lambda t: F.when(t["kind"].isin("s", "t"), F.concat(F.lit('"'), t["text"])).otherwise(t["text"]))
    rows = scanned.select("path", "tokens", said.alias("said"))
    each = rows.select("path", "said", F.posexplode("tokens").alias("i", "t"))
    back = F.reverse(F.slice("said", F.greatest(F.col("i") - 5, F.lit(1)), F.least(F.col("i"), F.lit(6))))
    return each.select("path", "i", "t.*", back.alias("back"), F.slice("said", F.col("i") + 2, F.lit(6)).alias("ahead"))


def beside(scanned: DataFrame) -> DataFrame:
    """The rows of ``explode`` to be read at once, without being stored: ``back`` and ``ahead`` have six elements, null where there is none.

    An element is worked out from the neighbouring token only where a rule asks for it.
    """
    def said(k: int) -> Column:
        near = F.get("tokens", F.col("i") + k)
        return F.when(near["kind"].isin("s", "t"), F.concat(F.lit('"'), near["text"])).otherwise(near["text"])

    each = scanned.select("path", "tokens", F.posexplode("tokens").alias("i", "t"))
    return each.select("path", "i", "t.*", F.array(*[said(-k) for k in range(1, 7)]).alias("back"), F.array(*[said(k) for k in range(1, 7)]).alias("ahead"))


def latest(column: Column, by: Window) -> Column:
    """The last value that is there, up to this row."""
    return F.last(column, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
