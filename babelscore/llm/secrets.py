"""Secret scan: all rules in one deterministic automaton over the bytes of a text.

Each rule's regular expression becomes a Thompson automaton; subset construction over all rules
together and minimisation give one transition array. A slice of texts is cut into equal columns
that step through the array in lockstep (numpy), each byte once; where a column's entry state turns
out different from the assumed one, only that column runs again until it meets its earlier states.
The states in which a rule accepts give the ends of matches; the rule's reversed automaton, run
backwards from an end, gives the leftmost start. Candidates become the leftmost non-overlapping
matches of each rule, as a regular expression engine would find them; a match that fails its rule's
length test is dropped after it has used up its characters.

The pem span is the line that opens a private key; redaction takes the key with it, up to its END
line or, where that is missing, as far as lines and long words of base64 go.

Spans are code points, end exclusive. Null or empty text has no spans. Documents are judged one by
one, whatever their ids; further columns do not matter.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from re import _parser as regex_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, map_texts

# The contract's base rules, then published token formats. ``least`` is the length a
# match must have; for assignments it is the length of the assigned value.
ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
          r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""")


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int
    value_only: bool = False  # ``least`` counts the assigned value, not the match
    run: int = 1  # a match long enough makes the rule accept at this many bytes in a row


RULES = (
    Rule("assign", ASSIGN, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    # Runs are counted to 3 in the automaton and to 24 by the length of the accepting run: a counter
    # to 24 would multiply every other rule's states.
    Rule("hex", r"[0-9a-f]{3,}", 24, run=22),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 27),
)
BASE_KINDS = ("assign", "access", "hex")
_VALUE_START = re.compile(r"[^:=]*[:=]\x20*[\"']?")
END_OF_TEXT = 0xFF  # never a byte of UTF-8
_PEM_MARK = re.compile(r"-----(?:BEGIN |END (?:[A-Z]+ )*PRIVATE KEY-----)")
# A key without an END line: lines may be escaped, quoted, indented or joined by spaces.
_GAP = r"(?:\s|\\[nrt]|[\"'`>#,+|*\\])*"
_PEM_BODY = re.compile(
    rf"(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
    rf"(?:{_GAP}(?:[A-Za-z0-9+/=_-]{{16,}}(?:{_GAP}[A-Za-z0-9+/=]+)?|(?<=[\n\r])[ \t]*[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n]|\Z))))*")


class Thompson:
    """States with byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, backwards: bool) -> tuple[int, int]:
        """A fragment for a parsed expression (its parts in reverse order if ``backwards``)."""
        first = last = self.state()
        for op, arg in (reversed(list(tree)) if backwards else tree):
            begin, end = self.part(str(op), arg, backwards)
            self.empty[last].append(begin)
            last = end
        return first, last

    def part(self, op: str, arg, backwards: bool) -> tuple[int, int]:
        if op == "LITERAL":
            return self.bytes_({arg})
        if op == "IN":
            return self.bytes_(set().union(*(range(a[0], a[1] + 1) if str(k) == "RANGE" else {a} for k, a in arg)))
        if op == "SUBPATTERN":
            return self.add(arg[3], backwards)
        begin, end = self.state(), self.state()
        if op == "BRANCH":
            for option in arg[1]:
                a, b = self.add(option, backwards)
                self.empty[begin].append(a)
                self.empty[b].append(end)
            return begin, end
        if op != "MAX_REPEAT":
            raise ValueError(f"unsupported in a rule: {op}")
        low, high, body = arg
        last = begin
        for _ in range(low):
            a, b = self.add(body, backwards)
            self.empty[last].append(a)
            last = b
        if high == regex_parser.MAXREPEAT:
            a, b = self.add(body, backwards)
            self.empty[last].append(a)
            self.empty[b].append(last)
        else:
            for _ in range(high - low):
                a, b = self.add(body, backwards)
                self.empty[last].extend([a, end])
                last = b
        self.empty[last].append(end)
        return begin, end

    def bytes_(self, codes: set[int]) -> tuple[int, int]:
        if max(codes) > 127:
            raise ValueError("rules are over ASCII characters")
        begin, end = self.state(), self.state()
        self.edges[begin].append((frozenset(codes), end))
        return begin, end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """``step[state * classes + byte_class[byte]]`` is the next state, times ``classes``.
    ``accepts[state]`` has a bit for each rule; state 0 is the start."""

    byte_class: np.ndarray
    classes: int
    step: np.ndarray
    accepts: np.ndarray
    first_accept: int
    dead: int


def build(trees: list, anywhere: bool, backwards: bool = False) -> Automaton:
    """Subset construction and minimisation. ``anywhere``: a match may begin at every byte."""
    n = Thompson()
    parts = [n.add(t, backwards) for t in trees]
    starts = [a for a, _ in parts]
    finals = {b: i for i, (_, b) in enumerate(parts)}
    sets = {codes for edges in n.edges for codes, _ in edges}
    # Bytes that no rule tells apart share a class; bytes of no rule are class 0.
    kinds = {(): 0}
    byte_class = np.zeros(256, dtype=np.int32)
    ordered = sorted(sets, key=sorted)
    for b in range(128):
        member = tuple(i for i, codes in enumerate(ordered) if b in codes)
        byte_class[b] = kinds.setdefault(member, len(kinds))
    example = {int(c): b for b, c in reversed(list(enumerate(byte_class[:128])))}
    classes = len(kinds)

    start = n.closure(starts)
    number, todo, rows = {start: 0}, [start], []
    for now in todo:
        row = [0] * classes
        moves = [(codes, t) for s in now for codes, t in n.edges[s]]
        for c in range(classes):
            b = example.get(c)
            targets = {t for codes, t in moves if b in codes} if c else set()
            nxt = n.closure(targets.union(starts) if anywhere else targets)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row[c] = number[nxt]
        rows.append(row)
    table = np.array(rows, dtype=np.int64)
    accepts = np.array([sum(1 << finals[s] for s in now if s in finals) for now in todo], dtype=np.int64)

    # Minimisation: split classes of states until their successors' classes agree.
    _, group = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    count = int(group.max()) + 1
    member = np.zeros(count, dtype=np.int64)
    member[group[::-1]] = np.arange(len(group))[::-1]
    order = np.argsort(np.where(np.arange(count) == group[0], -1, accepts[member] > 0), kind="stable")
    rank = np.empty(count, dtype=np.int64)
    rank[order] = np.arange(count)  # the start first, accepting states last
    small = rank[group[table[member[order]]]]
    acc = accepts[member[order]]
    stuck = [s for s in range(count) if (small[s] == s).all() and not acc[s]]
    silent = [s for s in range(count) if not acc[s]]
    return Automaton(byte_class, classes, (small * classes).astype(np.intp).reshape(-1), acc,
                     (max(silent, default=-1) + 1) * classes, stuck[0] if stuck and not anywhere else -1)


@functools.lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...]) -> tuple[Automaton, list[Automaton]]:
    """The combined forward automaton and one reversed automaton for each rule."""
    trees = [list(regex_parser.parse(r.pattern)) for r in rules]
    return build(trees, anywhere=True), [build([t], anywhere=False, backwards=True) for t in trees]


def run_columns(a: Automaton, codes: np.ndarray, columns: int = 2048) -> np.ndarray:
    """State (times classes) after every byte, all columns stepping together."""
    n = len(codes)
    high = max(1, -(-n // columns))
    wide = -(-n // high)
    grid = np.zeros(high * wide, dtype=np.intp)
    grid[:n] = codes
    grid = np.ascontiguousarray(grid.reshape(wide, high).T)
    trace = np.empty((high, wide), dtype=np.intp)
    now = np.zeros(wide, dtype=np.intp)
    for i in range(high):
        now = np.take(a.step, now + grid[i], out=trace[i], mode="clip")
    assumed = np.zeros(wide, dtype=np.intp)
    while True:
        entry = np.zeros(wide, dtype=np.intp)
        entry[1:] = trace[-1, :-1]
        wrong = np.flatnonzero(entry != assumed)
        if not len(wrong):
            break
        now = entry[wrong]
        assumed[wrong] = now
        for i in range(high):
            now = a.step[now + grid[i, wrong]]
            same = trace[i, wrong] == now
            trace[i, wrong] = now
            if same.any():
                wrong, now = wrong[~same], now[~same]
                if not len(wrong):
                    break
    return trace.T.reshape(-1)[:n]


def match_ends(data: np.ndarray, off: np.ndarray, a: Automaton, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(document, rule, end) of every longest match, by document and end; ends are byte offsets."""
    n = len(data)
    docs = len(off) - 1
    # An end byte after each document takes the automaton back to its start.
    spaced = np.zeros(n + docs, dtype=np.int32)
    at = np.arange(n) + np.repeat(np.arange(docs), np.diff(off))
    spaced[at] = a.byte_class[data]
    state = run_columns(a, spaced)
    hits = np.flatnonzero(state >= a.first_accept)
    mask = a.accepts[state[hits] // a.classes]
    ends, rule_of = [], []
    for r, rule in enumerate(rules):
        at = hits[(mask >> r & 1).astype(bool)]
        if len(at):  # runs of accepting bytes: each ends at a longest match's last byte
            cut = np.flatnonzero(np.diff(at) != 1)
            first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
            last = at[last[last - first + 1 >= rule.run]]
            ends.append(last)
            rule_of.append(np.full(len(last), r))
    if not ends:
        return []
    last, rule_of = np.concatenate(ends), np.concatenate(rule_of)
    doc = np.searchsorted(off + np.arange(docs + 1), last, side="right") - 1
    order = np.lexsort((rule_of, last))
    return list(zip(doc[order].tolist(), rule_of[order].tolist(), (last - doc + 1)[order].tolist()))


def leftmost_start(a: Automaton, data: bytes, end: int, least: int) -> int | None:
    """Smallest start >= ``least`` from which the reversed rule accepts up to ``end``."""
    state, best = 0, None
    step, classes, kinds, accepts = a.step, a.classes, a.byte_class, a.accepts
    for i in range(end - 1, least - 1, -1):
        state = int(step[state + kinds[data[i]]])
        s = state // classes
        if accepts[s]:
            best = i
        elif s == a.dead:
            break
    return best


def find(text: bytes, ends: list[tuple[int, int]], rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in bytes, by start and rule, from the (rule, end) pairs of one text."""
    reverse = compiled(rules)[1]
    used = [0] * len(rules)
    out = []
    for rule, end in ends:
        start = leftmost_start(reverse[rule], text, end, used[rule])
        if start is None:
            continue
        used[rule] = end
        body = text[start:end].decode()
        size = len(body) - (_VALUE_START.match(body).end() if rules[rule].value_only else 0)
        if size >= rules[rule].least:
            out.append((start, rule, end))
    return sorted(out)


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_column(column, rules: tuple[Rule, ...] = RULES) -> list[list[dict]]:
    """Spans of every text of an Arrow column."""
    forward, _ = compiled(rules)
    texts = Texts(column)
    found: dict[int, list[tuple[int, int]]] = {}
    for d, rule, end in match_ends(texts.data, texts.off, forward, rules):
        found.setdefault(d, []).append((rule, end - int(texts.off[d])))
    out: list[list[dict]] = [[] for _ in range(texts.n)]
    for d, ends in found.items():
        raw = texts.data[texts.off[d]:texts.off[d + 1]].tobytes()
        at = Texts(pa.array([raw], pa.large_binary()).cast(pa.large_string())).chars_before()
        out[d] = [{"kind": rules[r].kind, "start": int(at[s]), "end": int(at[e])}
                  for s, r, e in find(raw, ends, rules)]
    return out


def key_end(text: str, at: int) -> int:
    """End of the private key whose opening line ends at ``at``."""
    mark = _PEM_MARK.search(text, at)
    if mark and mark.group().startswith("-----END"):
        return mark.end()
    return _PEM_BODY.match(text, at, mark.start() if mark else len(text)).end()


def redact(text: str | None, spans: list[dict], mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping spans as one) replaced by a mark; a pem span with its key."""
    if not spans:
        return text
    spans = [s | {"end": key_end(text, s["end"])} if s["kind"] == "pem" else s for s in spans]
    out, at = [], 0
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def secret_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with the spans of all rules, by start and then rule order."""
    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(scan_column(part.column(1), rules), _SPANS)], ["doc_id", "spans"])
    return map_texts(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")),
                     fn, SCHEMA)


def redacted(documents: DataFrame, text: str = "text", n_chars: str = "n_chars",
             rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, all columns and rows, with their secrets replaced and ``n_chars`` counted anew."""
    names = documents.columns

    def fn(part: pa.RecordBatch) -> pa.RecordBatch:
        old = part.column(names.index(text))
        spans = scan_column(old, rules)
        new = [redact(t, s) for t, s in zip(old.to_pylist(), spans)]
        columns = list(part.columns)
        columns[names.index(text)] = pa.array(new, old.type)
        if n_chars in names:
            kept = part.column(names.index(n_chars))
            columns[names.index(n_chars)] = pa.array(
                [len(t) if s else k for t, s, k in zip(new, spans, kept.to_pylist())], kept.type)
        return pa.RecordBatch.from_arrays(columns, names)
    return map_texts(documents, fn, documents.schema, text=text)
