"""Secret scanning by assignment-aware lexing.

A text is lexed as source code or configuration: names, string literals (triple-quoted and prefixed ones too), operators,
urls and comments of the common languages, plus ``KEY=value`` and ``key: value`` lines.  The insides of comments are
lexed for themselves.  Assignments give name-literal pairs: to names, with or without a type, to subscripts
(``env["KEY"] = ...``), to keys of nested blocks, which take their parent's name along, over continued and parenthesised
lines, in setters and definitions (``set_key(...)``, ``define("KEY", ...)``) and in tags (``<key>...</key>``).  Constants'
names in ``f"{NAME}"`` and ``${NAME}`` stand for their values; names bound to a literal (or to a concatenation of literals and bound names) are constants
and are propagated to later assignments.  A literal is reported if the name it ends up in is
sensitive enough for how random the literal looks; placeholders score low.  A concatenation takes in
constants for as long as it has at most ``MOST_PARTS`` parts and ``MOST_JOINED`` characters; beyond that
it stands for its own literals only, so that texts which double a constant over and over stay linear.

Beside these ``literal`` findings stand three fixed patterns (``assign``, ``access``, ``hex``), whose
matches are always reported: leftmost and non-overlapping for each kind, those that are too short
are dropped after matching.

Defined results: null and empty texts have no finding.  Spans are code points, the end exclusive.
Repeated rows get results of their own; ids (null ones too) and other columns are carried through.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping, MutableMapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts, without

KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# The two below need no filter afterwards: a run that is too short holds no longer one.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")


class Finding(NamedTuple):
    kind: str
    start: int
    end: int
    name: str  # of the target, for literals
    score: float


def base_findings(text: str) -> list[Finding]:
    out = [Finding("access", *m.span(), "", 1.0) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [Finding("hex", *m.span(), "", 1.0) for m in HEX.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [Finding("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    return out


#: Parts of target names, with how strongly they point at a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9, "tokens": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "pin": 0.5, "otp": 0.6, "cookie": 0.5, "session": 0.4, "dsn": 0.5, "webhook": 0.5,
}
#: Pairs of neighbouring parts.
SENSITIVE_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("account", "key"): 0.9, ("auth", "key"): 0.9, ("client", "id"): 0.3}
HARMLESS_PARTS = {"count", "length", "len", "size", "field", "label", "name", "type", "url", "uri", "path", "file", "max", "min", "limit", "ttl", "expiry", "prompt", "policy", "hint", "regex", "pattern", "header", "placeholder", "example"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|none|null|nil|true|false|todo|changeme|change_me|example|sample|dummy|test|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(?\w*\)?s?|\$\w+|env|secret|password|token)$")
MIGHT = re.compile("|".join(["pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer", "signature", "salt", "pin", "otp", "cookie", "session", "dsn", "webhook"]))


def name_parts(name: str) -> list[str]:
    """``dbAPIKey``, ``db.api_key`` and ``DB-API-KEY`` alike: db, api, key."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def name_score(name: str) -> float:
    parts = name_parts(name)
    best = max([SENSITIVE.get(p, 0.0) for p in parts] + [SENSITIVE_PAIRS.get(p, 0.0) for p in zip(parts, parts[1:], strict=False)], default=0.0)
    return best * (0.4 if parts and parts[-1] in HARMLESS_PARTS else 1.0)


def literal_score(value: str) -> float:
    """From 0 (a placeholder, an ordinary phrase) to 1 (looks random)."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    score = min(1.0, entropy / 4) * 0.6 + min(1.0, len(value) / 20) * 0.2 + (classes - 1) / 3 * 0.2
    return score * (0.5 if re.search(r"\s", value) else 1.0)


TOKENS = r"""(?P<url>[A-Za-z][A-Za-z0-9+.-]{0,30}://[^\s"'`<>,;(){}\[\]]*)
      | (?P<path>(?:[\w.~-]*(?:/[\w.-]+){2,}|/[\w.-]+)/\*)
      | COMMENT
      | (?P<prefix>(?:[rbuf]|rb|br|fr|rf)(?=["']))
      | (?P<quote>["'`])
      | (?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_]\w*)*)
      | (?P<op>:=|\?=|=>|==|!=|<=|>=|\+=|[=:+(),;{}\[\]])
      | (?P<line>\n)
      | (?P<bare>[^\s"'`=:+(),;{}\[\]]+)"""
#: Ends of names that say what a block holds by its own name: ``auth: {key: ...}``.
GENERIC = {"key", "value", "secret", "token", "pass", "password", "string"}
SETTER = re.compile(r"(?i)^(?:set|put|define|export|add|setenv|putenv|with|env|config)(?![a-z])|(?:set|put)(?:env|property|item|header|option)?$|^(?:setenv|putenv|define)$")
SETS = re.compile(r"^(?:set|with|use)(?=[_A-Z])_?")
TAGGED = re.compile(r"<([A-Za-z_][\w.-]{0,60})>([^<>\n]{6,4096})</")
PLACED = re.compile(r"\$?\{([A-Za-z_][\w.]*)\}")
LEXER = re.compile(TOKENS.replace("COMMENT", r"(?P<comment>(?<!:)//[^\n]*|\#(?=[\s!])[^\n]*)|(?P<opening>/\*)"), re.VERBOSE | re.DOTALL)
BARE = re.compile(r"""[^\s"'`=:+(),;{}\[\]]+""")
#: Inside a comment its marks only end assignments.
INSIDE = re.compile(TOKENS.replace("COMMENT", r"(?P<mark>//+|/\*+|\*+/)"), re.VERBOSE | re.DOTALL)
#: What a literal holds after its quote; where it ends, the quote follows or the literal is never closed.
INSIDE_QUOTES = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*", re.DOTALL) for q in "\"'"} | {"`": re.compile(r"[^`\n]*")}
MOST_PARTS, MOST_JOINED = 64, 1024
BINDS = {"=", ":=", "?=", ":", "=>", "+="}


class Literal(NamedTuple):
    value: str
    spans: tuple[tuple[int, int], ...]


def tokens(text: str, begin: int, end: int) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end), in one pass.

    Where a literal or a comment is never closed, its opening stands for nothing.  How far that was
    found out is remembered: all quotes up to there are escaped ones, and none of them closes either.
    """
    lexer = INSIDE if begin else LEXER
    at, open_until, no_more_comments = begin, dict.fromkeys(INSIDE_QUOTES, begin), False
    no_more_triples: set[str] = set()
    formatted = False
    while m := lexer.search(text, at, end):
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "prefix":
            formatted = "f" in m[0]
            continue
        if kind == "quote":
            q = text[start]
            if q != "`" and q not in no_more_triples and text.startswith(q * 3, start):
                stop = text.find(q * 3, start + 3, end)
                if stop >= 0:
                    yield "fstring" if formatted else "string", text[start : stop + 3], start, stop + 3
                    at, formatted = stop + 3, False
                    continue
                no_more_triples.add(q)
            if start < open_until[q]:
                continue
            stop = INSIDE_QUOTES[q].match(text, at, end).end()
            if stop >= end or text[stop] != q:
                open_until[q] = stop
                continue
            kind, at = "fstring" if formatted or q == "`" else "string", stop + 1
        elif kind == "opening":
            stop = -1 if no_more_comments else text.find("*/", at, end)
            if stop < 0:
                no_more_comments, kind = True, "bare"
                at = BARE.match(text, start, end).end()
            else:
                kind, at = "comment", stop + 2
        formatted = False
        yield kind, text[start:at], start, at


def inner(token: tuple[str, str, int, int]) -> tuple[str, int]:
    """What stands between a literal's quotes, and how wide these are."""
    s = token[1]
    width = 3 if len(s) >= 6 and s[:3] in ("\"\"\"", "'''") else 1
    return s[width:-width], width


QUOTED = ("string", "fstring")


def lex_assignments(text: str, begin: int, end: int, comments: list[tuple[int, int]]) -> Iterator[tuple[str, str, list[tuple[str, str, int, int]]]]:
    """(name, name with its block's, tokens of the right-hand side) of every assignment; tokens are (kind, text, start, end).

    Comments belong to no assignment; their insides are added to ``comments``.
    """
    name, rhs, previous, binding = None, [], None, ""
    recent: list[tuple[str, str, int, int]] = []  # the last tokens of the line, for subscripts and calls
    blocks: list[str | None] = []  # names of the braces that are open
    indented: list[tuple[int, str]] = []  # names of the lines above that end in a colon, with their indentation
    line_at, fresh, wrapped = begin, True, False

    def full(word: str) -> str:
        parent = blocks[-1] if blocks else indented[-1][1] if indented else None
        parts = name_parts(word)
        return f"{parent}.{word}" if parent and parts and parts[-1] in GENERIC else word

    def called() -> tuple[str, list] | None:
        """A setter's or a definition's name and literal."""
        kinds = [t[0] if t[0] != "op" else t[1] for t in recent[-6:]]
        if kinds[-5:] and len(kinds) >= 5 and kinds[-5] == "name" and kinds[-4] == "(" and kinds[-3] in QUOTED and kinds[-2] == "," and kinds[-1] in QUOTED and SETTER.search(recent[-5][1].rsplit(".", 1)[-1]):
            return inner(recent[-3])[0], [recent[-1]]
        if len(kinds) >= 3 and kinds[-3] == "name" and kinds[-2] == "(" and kinds[-1] in QUOTED:
            word = recent[-3][1].rsplit(".", 1)[-1]
            if m := SETS.match(word):
                return word[m.end() :], [recent[-1]]
        return None

    for kind, s, start, stop in tokens(text, begin, end):
        if kind == "comment":
            width = 1 if s.startswith("#") else 2
            comments.append((start + width, stop - 2 * s.startswith("/*")))
            continue
        if kind in ("url", "path"):
            kind = "bare"
        if fresh and kind not in ("line", "mark"):
            indent, fresh = start - line_at, False
            while indented and indented[-1][0] >= indent:
                indented.pop()
        token = (kind, s, start, stop)
        if s == "=" and kind == "op" and name is not None and binding == ":" and 1 <= len(rhs) <= 2 and all(t[0] in ("name", "bare") for t in rhs):
            rhs, previous, binding = [], None, s  # what stood between was a type
            continue
        if kind == "op" and s in BINDS and previous and previous[0] in ("name", *QUOTED):
            if name is not None and rhs and rhs[-1] is previous:
                rhs.pop()
                if rhs:
                    yield name, full(name), rhs
            word = inner(previous)[0] if previous[0] in QUOTED else previous[1]
            name, rhs, previous, binding = word, [], None, s
            continue
        if kind in ("line", "mark") or kind == "op" and s in ",;{}()[]":
            recent.append(token)
            if kind == "line":
                recent.clear()
                line_at, fresh = stop, True
                if rhs and rhs[-1][1] == "\\":
                    rhs.pop()
                    continue
                if wrapped:
                    continue
                if name is not None and not rhs and binding == ":":
                    indented.append((indent, name))
            if s == "(" and name is not None and not rhs:
                wrapped = True
                continue
            # A line that ends in an open + goes on; everything else ends the assignment.
            if name is not None and not (kind == "line" and rhs and rhs[-1][1] == "+"):
                if rhs:
                    yield name, full(name), rhs
                if s == "{":
                    blocks.append(name if not rhs else None)
                name, rhs, wrapped = None, [], False
            elif s == "{":
                blocks.append(None)
            if s == "}" and blocks:
                blocks.pop()
            previous = None
            if s == ")" and len(recent) > 3:
                recent.pop()
                if found := called():
                    yield found[0], found[0], found[1]
                recent.clear()
            elif s == "]" and len(recent) >= 3 and recent[-2][0] in QUOTED and recent[-3][1] == "[":
                previous = recent[-2]
            del recent[:-6]
            del blocks[:-64]
            del indented[:-64]
            continue
        recent.append(token)
        previous = token
        if name is not None:
            rhs.append(previous)
    if name is not None and rhs:
        yield name, full(name), rhs


def resolve(rhs: list[tuple[str, str, int, int]], known: Mapping[str, Literal]) -> Literal | None:
    """The literal that the right-hand side stands for: a value, a constant's name, or a + of them; literals side by side are one."""
    found: list[Literal] = []
    joined, parts, size, last = True, 0, 0, ""
    for token in rhs:
        kind, s, start, end = token
        if kind == "op":
            joined = s == "+"
            if not joined:
                break
            last = kind
            continue
        if found and not joined and not (kind in QUOTED and last in QUOTED):
            break  # words that follow, as in prose
        joined, last = False, kind
        if kind in QUOTED:
            value, width = inner(token)
            literal = Literal(value, ((start + width, end - width),))
            if kind == "fstring":
                used = [known[m[1]] for m in PLACED.finditer(value) if m[1] in known]
                parts, size = parts + sum(len(x.spans) for x in used), size + sum(len(x.value) for x in used)
                if used and parts <= MOST_PARTS and size <= MOST_JOINED:
                    literal = filled(value, start + width, known)
            found.append(literal)
        elif kind == "name" and s in known:
            parts, size = parts + len(known[s].spans), size + len(known[s].value)
            if parts > MOST_PARTS or size > MOST_JOINED:
                found.append(Literal("", ()))
            else:
                found.append(known[s])
        elif kind == "bare" or len(s) >= 6:
            found.append(Literal(s, ((start, end),)))
        else:
            break
    return Literal("".join(x.value for x in found), tuple(p for x in found for p in x.spans)) if found else None


def filled(value: str, start: int, known: Mapping[str, Literal]) -> Literal:
    """A formatted literal with known constants in their places: its own parts' spans and theirs."""
    out, spans, at = [], [], 0
    for m in PLACED.finditer(value):
        if m[1] in known:
            out += [value[at : m.start()], known[m[1]].value]
            spans += [(start + at, start + m.start()), *known[m[1]].spans]
            at = m.end()
    return Literal("".join([*out, value[at:]]), tuple(p for p in [*spans, (start + at, start + len(value))] if p[0] < p[1]))


def tagged(text: str) -> Iterator[tuple[str, str, list[tuple[str, str, int, int]]]]:
    """Elements that hold nothing but a text, as assignments to their names."""
    for m in TAGGED.finditer(text):
        if text.startswith(f"{m[1]}>", m.end()):
            yield m[1], m[1], [("bare", m[2].strip(), m.start(2) + len(m[2]) - len(m[2].lstrip()), m.end(2) - len(m[2]) + len(m[2].rstrip()))]


def literal_findings(text: str, threshold: float = 0.5) -> list[Finding]:
    if not MIGHT.search(text.lower()):
        return []
    out: dict[tuple[int, int], Finding] = {}
    code: dict[str, Literal] = {}
    todo = [(0, len(text))]
    for begin, end in todo:  # grows by the comments; their constants never stand for the code's
        known = code if begin == 0 else ChainMap({}, code)
        add_findings(lex_assignments(text, begin, end, todo), known, threshold, out)
    if "</" in text:
        add_findings(tagged(text), ChainMap({}, code), threshold, out)
    return list(out.values())


def add_findings(assignments: Iterator[tuple[str, str, list[tuple[str, str, int, int]]]], known: MutableMapping[str, Literal], threshold: float, out: dict[tuple[int, int], Finding]) -> None:
    for name, path, rhs in assignments:
        value = resolve(rhs, known)
        if value is None:
            continue
        if any(kind in QUOTED for kind, *_ in rhs) or len(rhs) == 1:
            known[name] = value
        sensitive = name_score(path)
        score = sensitive * literal_score(value.value) if sensitive else 0.0
        # Unquoted words after a colon are prose more often than not: they must look random.
        if all(kind == "name" for kind, *_ in rhs) and not (len(rhs) == 1 and rhs[0][1] in known) and not re.search(r"\d", value.value):
            score *= 0.5
        if score >= threshold:
            for start, end in value.spans:
                if end > start:
                    old = out.get((start, end))
                    if old is None or old.score < score:
                        out[start, end] = Finding("literal", start, end, path, score)


def find_secrets(text: str | None) -> list[Finding]:
    """All findings of a whole text, by start, then kind as listed in KINDS."""
    if not text:
        return []
    return sorted(base_findings(text) + literal_findings(text), key=lambda f: (f.start, KINDS.index(f.kind), f.end))


def span_text(findings: list[Finding]) -> str:
    return ",".join(f"{f.kind}:{f.start}:{f.end}" for f in findings)


def scan(docs: DataFrame, text: str = "text", column: str = "findings") -> DataFrame:
    """``docs`` with an array of (kind, start, end, name, score) as one more column; one of that name is replaced."""
    docs = without(docs, column)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = [[f._asdict() for f in find_secrets(t)] for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(item))], [*batch.schema.names, column])

    kind = T.StructField(column, T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("name", "string").add("score", "double")))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, kind]))


def redact_text(text: str, findings: list[Finding]) -> str:
    """The text with every maximal run of overlapping findings replaced by ``[kind]`` of its first."""
    out, at, end = [], 0, -1
    for f in findings:
        if f.start < end:
            end = max(end, f.end)
            continue
        if end >= 0:
            at = end
        out += [text[at : f.start], f"[{f.kind}]"]
        end = f.end
    return "".join(out) + text[max(end, 0) :]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the findings of every text replaced; other rows and columns stay as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            new = [t and redact_text(t, find_secrets(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans), derived from the findings in one pass."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            for t in texts(batch, text):
                found = find_secrets(t)
                base = [f for f in found if f.kind != "literal"]
                n = Counter(f.kind for f in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(span_text(base).encode()).hexdigest(), span_text(found)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:]]], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
