"""Secret scan: all rules compiled into one deterministic automaton, run over the bytes once.

The rule patterns are parsed into one nondeterministic automaton, made deterministic by subset construction over
byte classes, and minimised by partition refinement.  The transition array then runs over many stretches of text in
lockstep: a stretch starts at a document's first byte or after a byte that leads every state back to the start, so
cutting there changes nothing.  The automaton names the rules that occur in a document; only there the spans are
cut out by the rule's own pattern (leftmost, non-overlapping per kind, longest run).

Defined results: null and empty texts have no span; identical or repeated rows each get their own result; overlapping
spans of different kinds are all reported; texts of any length are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelspan.llm import common


@dataclass(frozen=True)
class Rule:
    """``occurs``: pattern of the automaton, found wherever a span is (counts that multiply its states are left to the span);
    ``span``: pattern of the span; ``least``: characters that ``group`` must have."""

    kind: str
    occurs: str
    span: str
    group: int = 0
    least: int = 0


#: The three base rules.
BASE_RULES = (
    Rule("assign",
         r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
         r"""["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{8}""",
         r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12}", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32}", r"[0-9a-f]+", 0, 32),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# -- patterns to automata -----------------------------------------------------------------------------------------

class _Nfa:
    def __init__(self):
        self.steps: list[tuple[frozenset[int], int]] = []   # per state: (bytes, target); target -1: none
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.steps.append((frozenset(), -1))
        self.empty.append([])
        return len(self.steps) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)


class _Parser:
    """Literals, classes, groups, alternatives and the quantifiers ? * + {n}."""

    def __init__(self, nfa: _Nfa, pattern: str):
        self.nfa, self.text, self.at = nfa, pattern, 0

    def alternatives(self, begin: int) -> int:
        ends = [self.sequence(begin)]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            ends.append(self.sequence(begin))
        out = self.nfa.state()
        for e in ends:
            self.nfa.empty[e].append(out)
        return out

    def sequence(self, begin: int) -> int:
        now = self.nfa.state()
        self.nfa.empty[begin].append(now)
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            start = self.at
            end = self.atom(now)
            stop = self.at
            sign = self.text[self.at: self.at + 1]
            if sign in ("?", "*", "+"):
                self.at += 1
                out = self.nfa.state()
                self.nfa.empty[end].append(out)
                if sign in "?*":
                    self.nfa.empty[now].append(out)
                if sign in "*+":
                    self.nfa.empty[end].append(now)
                end = out
            elif sign == "{":
                close = self.text.index("}", self.at)
                for _ in range(int(self.text[self.at + 1: close]) - 1):
                    self.at = start
                    end = self.atom(end)
                    assert self.at == stop
                self.at = close + 1
            now = end
        return now

    def atom(self, begin: int) -> int:
        c = self.text[self.at]
        self.at += 1
        if c == "(":
            end = self.alternatives(begin)
            self.at += 1
            return end
        values = {ord(c)}
        if c == "[":
            values = set()
            while self.text[self.at] != "]":
                low = ord(self.text[self.at])
                if self.text[self.at + 1] == "-" and self.text[self.at + 2] != "]":
                    values |= set(range(low, ord(self.text[self.at + 2]) + 1))
                    self.at += 3
                else:
                    values.add(low)
                    self.at += 1
            self.at += 1
        entry, out = self.nfa.state(), self.nfa.state()
        self.nfa.empty[begin].append(entry)
        self.nfa.steps[entry] = (frozenset(values), out)
        return out


@dataclass(frozen=True)
class Automaton:
    """``classes``: byte to class; ``next``: state * n_classes + class to state; ``found``: state to bit set of rules; ``resets``: bytes after which every state is the start."""

    classes: np.ndarray
    next: np.ndarray
    found: np.ndarray
    resets: np.ndarray

    @property
    def width(self) -> int:
        return len(self.next) // len(self.found)


@functools.lru_cache(maxsize=4)
def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    """The minimal automaton that says, after each byte, which rules have a match ending there."""
    nfa = _Nfa()
    root, accepts = nfa.state(), {}
    for i, rule in enumerate(rules):
        accepts[_Parser(nfa, rule.occurs).alternatives(root)] = 1 << i
    signatures: dict[tuple, int] = {}
    sets = [values for values, target in nfa.steps if target >= 0]
    classes = np.array([signatures.setdefault(tuple(b in v for v in sets), len(signatures)) for b in range(256)], np.uint8)
    examples = [int(np.flatnonzero(classes == k)[0]) for k in range(len(signatures))]
    start = nfa.closure([root])
    numbers, rows, todo = {start: 0}, [], [start]
    while todo:                                                     # subset construction
        rows_of, now = [], todo.pop(0)
        moves = [nfa.steps[s] for s in now if nfa.steps[s][1] >= 0]
        for byte in examples:
            after = nfa.closure([root, *(t for values, t in moves if byte in values)])
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            rows_of.append(numbers[after])
        rows.append(rows_of)
    table = np.array(rows)
    bits = np.array([functools.reduce(lambda x, s: x | accepts.get(s, 0), state, 0) for state in numbers], np.int64)
    block = np.unique(bits, return_inverse=True)[1]
    while True:                                                     # partition refinement
        keys = np.column_stack([block, block[table]])
        refined = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
        if refined.max() == block.max():
            break
        block = refined
    # the start becomes state 0, accepting states come last
    first = np.unique(block, return_index=True)[1]
    order = sorted(range(len(first)), key=lambda b: (bits[first[b]] != 0, b != block[0], b))
    place = np.empty(len(first), np.int64)
    place[order] = np.arange(len(first))
    small = place[block[table[first[order]]]]
    resets = (small == 0).all(axis=0)[classes]
    return Automaton(classes, small.astype(np.int32).ravel(), bits[first[order]], resets)


def scan(automaton: Automaton, data: np.ndarray, offsets: np.ndarray, stretch: int = 512) -> np.ndarray:
    """Bit set of the rules that occur, per text; one pass over the bytes, all stretches in lockstep."""
    base, end, n = int(offsets[0]), int(offsets[-1]), len(offsets) - 1
    found = np.zeros(n, np.int64)
    if end == base:
        return found
    part = data[base:end]
    nominal = np.arange(stretch, end - base, stretch)
    free = np.flatnonzero(automaton.resets[part]) + 1
    at = np.searchsorted(free, nominal)
    inner = free[at[at < len(free)]]
    cuts = np.unique(np.concatenate([offsets[:-1] - base, inner[inner < end - base]]))
    length = np.diff(np.append(cuts, end - base))
    order = np.argsort(-length, kind="stable")
    cuts, length = cuts[order], length[order]
    owner = np.searchsorted(offsets - base, cuts, side="right") - 1
    live = len(cuts) - np.searchsorted(length[::-1], np.arange(int(length[0])), side="right")
    codes = automaton.classes[part].astype(np.int32)
    width, accepting = np.int32(automaton.width), int(np.searchsorted(automaton.found != 0, True))
    state = np.zeros(len(cuts), np.int32)
    for step, count in enumerate(live):
        now = automaton.next[state[:count] * width + codes[cuts[:count] + step]]
        state[:count] = now
        if now.max() >= accepting:
            hit = np.flatnonzero(now >= accepting)
            np.bitwise_or.at(found, owner[hit], automaton.found[now[hit]])
    return found


def spans_of(text: str, rules: tuple[Rule, ...] = RULES, present: int = -1) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then by the order of the rules."""
    out = []
    for i, rule in enumerate(rules):
        if present >> i & 1:
            out += [(m.start(), i, m.end(), rule.kind) for m in re.finditer(rule.span, text) if len(m.group(rule.group)) >= rule.least]
    return [(s, e, kind) for s, _, e, kind in sorted(out)]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, list of spans (start, end, kind) in code points, end exclusive."""
    common.ship(docs.sparkSession)
    automaton = compiled(rules)

    def run(batches):
        for batch in batches:
            offsets, data = common.utf8(batch.column(1))
            for low, high in common.slices(offsets, 4 << 20):
                found = scan(automaton, data, offsets[low: high + 1])
                spans = [[]] * (high - low)
                for i in np.flatnonzero(found):
                    text = data[offsets[low + i]: offsets[low + i + 1]].tobytes().decode("utf-8")
                    spans[i] = [{"start": s, "end": e, "kind": k} for s, e, k in spans_of(text, rules, int(found[i]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(
        run, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def digest(spans: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans as one string."""
    base = "'" + "','".join(r.kind for r in BASE_RULES) + "'"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = '{}')) as long) n_{}"
    return spans.selectExpr(
        "doc_id", *(count.format(r.kind, r.kind) for r in BASE_RULES),
        f"sha2({joined.format(f'filter(spans, s -> s.kind in ({base}))')}, 256) base_sha256",
        f"{joined.format('spans')} spans")
