"""Secret scanning with one deterministic automaton for all rules.

Rules are written in a small regular language (literals, classes, groups, alternatives and repeats), compiled together to
one automaton by subset construction and minimised to arrays. One pass over the bytes of a text tells where each rule ends a
match. A batch of texts is cut into lanes of equal length, which are advanced by one array operation per byte position.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from framewright.llm.common import chunks


KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
VALUE = "[A-Za-z0-9+/_.=-]+"
#: kind: (the rule as the automaton has it, the same with its checked part, if that is not all of it, as a last group, least length of that part).
#: Lengths are checks on a span and not states: counts of different rules would multiply.
RULES = {
    "assign": (KEYWORD + "[\"']? *[:=] *[\"']?" + VALUE, KEYWORD + "[\"']? *[:=] *[\"']?(" + VALUE + ")", 8),
    "access": ("AKIA[A-Z0-9]+", "AKIA[A-Z0-9]+", 16),
    "hex": ("[0-9a-f]+", "[0-9a-f]+", 32),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "hosted_token": ("gh[opsu]_[A-Za-z0-9]+", "gh[opsu]_[A-Za-z0-9]+", 40),
}
BASE = ("assign", "access", "hex")
LANE = 256


class Rules:
    """Thompson construction of several expressions into one set of states."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.text, self.pos = pattern, 0
        return self.choice()

    def peek(self) -> str:
        return self.text[self.pos] if self.pos < len(self.text) else ""

    def choice(self) -> tuple[int, int]:
        parts = [self.row()]
        while self.peek() == "|":
            self.pos += 1
            parts.append(self.row())
        start, end = self.state(), self.state()
        for a, b in parts:
            self.free[start].append(a)
            self.free[b].append(end)
        return start, end

    def row(self) -> tuple[int, int]:
        start = at = self.state()
        while self.peek() not in ("", "|", ")"):
            begin = self.pos
            a, b = self.atom()
            end, sign = self.pos, self.peek()
            if sign == "{":
                self.pos = self.text.index("}", self.pos) + 1
                after, times = self.pos, int(self.text[end + 1 : self.pos - 1])
                for _ in range(times - 1):  # the rest are copies of the same piece
                    self.pos = begin
                    c, d = self.atom()
                    self.free[b].append(c)
                    b = d
                self.pos = after
            elif sign and sign in "?*+":
                self.pos += 1
                if sign != "?":
                    self.free[b].append(a)
                if sign != "+":
                    skip = self.state()
                    self.free[b].append(skip)
                    self.free[a].append(skip) if sign == "?" else self.free[a].append(b)
                    b = skip
            self.free[at].append(a)
            at = b
        return start, at

    def atom(self) -> tuple[int, int]:
        c = self.text[self.pos]
        self.pos += 1
        if c == "(":
            inner = self.choice()
            self.pos += 1
            return inner
        allowed = {ord(c)}
        if c == "[":
            allowed = set()
            while (c := self.text[self.pos]) != "]":
                last = c
                if self.text[self.pos + 1] == "-" and self.text[self.pos + 2] != "]":
                    last = self.text[self.pos + 2]
                    self.pos += 2
                self.pos += 1
                allowed |= set(range(ord(c), ord(last) + 1))
            self.pos += 1
        entry, a, b = self.state(), self.state(), self.state()
        self.free[entry].append(a)
        self.steps[a].append((frozenset(allowed), b))
        return entry, b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if self.steps[s] or s in self.final)

    def reversed(self) -> "Rules":
        """The same states with every step turned round."""
        back = Rules()
        for _ in self.steps:
            back.state()
        for s, (steps, free) in enumerate(zip(self.steps, self.free)):
            for allowed, t in steps:
                back.steps[t].append((allowed, s))
            for t in free:
                back.free[t].append(s)
        return back


def compile_rules(patterns: list[str]) -> dict[str, np.ndarray]:
    """Minimal automaton that finds every pattern anywhere: `next` [states, 256], `accept` bit set per state, `reset` bytes."""
    rules = Rules()
    ends = [rules.add(p) for p in patterns]
    rules.final = {b: 1 << i for i, (_, b) in enumerate(ends)}
    return determinise(rules, [a for a, _ in ends], anywhere=True)


def anchored(pattern: str, backwards: bool = False) -> dict[str, np.ndarray]:
    """Minimal automaton of one pattern from where it is started on, or from its end back to its start."""
    rules = Rules()
    start, end = rules.add(pattern)
    if backwards:
        rules, start, end = rules.reversed(), end, start
    rules.final = {end: 1}
    return determinise(rules, [start], anywhere=False)


def determinise(rules: Rules, starts: list[int], anywhere: bool) -> dict[str, np.ndarray]:
    """Subset construction and minimisation; state 0 is the start, and `dead` the state that nothing leads out of, or -1."""
    kinds: dict[tuple, int] = {}
    every = [allowed for steps in rules.steps for allowed, _ in steps]
    group = np.array([kinds.setdefault(tuple(b in s for s in set(every)), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(group == g)[0]) for g in range(len(kinds))]
    first = rules.closure(starts)
    again = first if anywhere else frozenset()
    ids, todo, table = {first: 0}, [first], []
    while len(table) < len(todo):
        here = todo[len(table)]
        line = []
        for byte in sample:
            there = rules.closure([t for s in here for allowed, t in rules.steps[s] if byte in allowed]) | again
            if there not in ids:
                ids[there] = len(todo)
                todo.append(there)
            line.append(ids[there])
        table.append(line)
    step = np.array(table)
    accept = np.array([sum({rules.final.get(s, 0) for s in sorted(states)}) for states in todo])
    block, count = np.unique(accept, return_inverse=True)[1], 0
    while count != (count := int(block.max()) + 1):  # split states until their successors agree
        block = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].reshape(-1)
    one = np.unique(block, return_index=True)[1]
    order = np.argsort(block[one] != block[0], kind="stable")  # the start state comes first
    name = np.empty(len(one), np.int64)
    name[block[one][order]] = np.arange(len(one))
    dense = name[block[step[one[order]]]][:, group]
    accept = accept[one[order]].astype(np.int64)
    ends = np.flatnonzero((dense == np.arange(len(dense))[:, None]).all(axis=1) & (accept == 0))
    return {"next": dense.astype(np.int32), "accept": accept, "reset": (dense == 0).all(axis=0), "dead": int(ends[0]) if len(ends) else -1}


def states_after(raw: np.ndarray, machine: dict[str, np.ndarray]) -> np.ndarray:
    """The state of the automaton after every byte.

    The bytes are cut into lanes that advance side by side from the start state. A lane whose true state at its
    begin is another one is then gone through again until it meets the states it had, which takes a few bytes as a rule; where it does not
    meet them, the next lane follows.
    """
    n, table = len(raw), machine["next"].reshape(-1)
    lanes = -(-n // LANE)
    columns = np.zeros(lanes * LANE, np.uint8)
    columns[:n] = raw
    columns = np.ascontiguousarray(columns.reshape(lanes, LANE).T)
    out = np.empty((LANE, lanes), np.int32 if len(machine["next"]) > 1 << 15 else np.int16)
    state = np.zeros(lanes, np.int32)
    for i in range(LANE):
        state = table[state * 256 + columns[i]]
        out[i] = state
    begun = np.zeros(lanes, np.int32)
    while lanes:
        true = np.r_[0, out[-1, :-1]].astype(np.int32)
        live = np.flatnonzero(true != begun)
        if not len(live):
            break
        begun, state = true, true[live]
        for i in range(LANE):
            state = table[state * 256 + columns[i, live]]
            other = state != out[i, live]
            live, state = live[other], state[other]
            if not len(live):
                break
            out[i, live] = state
    return out.T.reshape(-1)[:n]


class Scanner:
    """Spans of every kind in whole texts: leftmost, then longest, without overlap within a kind.

    One pass over the bytes tells after which of them a rule has matched. Where a match can go on, the next byte ends a match as well, so
    the last of a run of such places is the end of a match. From there the reversed rule goes back to the
    first place that begins one and is not taken by the match before.
    """

    def __init__(self, machine: dict[str, np.ndarray], rules: dict[str, tuple]) -> None:
        self.machine, self.kinds = machine, list(rules)
        self.least = [least for *_, least in rules.values()]
        self.back = [anchored(pattern, backwards=True) for pattern, *_ in rules.values()]
        # what precedes the checked part, and the shortest run of ends that a match of the least length makes
        heads = [whole[: whole.rindex("(")] if whole != pattern else "" for pattern, whole, _ in rules.values()]
        self.head = [anchored(h) if h else None for h in heads]
        grows = [bool(re.fullmatch(r"(?:[A-Za-z]|\[[^\]]*\])*\[[^\]]*\]\+", pattern)) for pattern, *_ in rules.values()]
        units = [len(re.findall(r"\[[^\]]*\]|[A-Za-z]", pattern)) for pattern, *_ in rules.values()]
        self.run = [max(1, least - unit + 1) if grow else 1 for least, unit, grow in zip(self.least, units, grows)]

    def many(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, end, kind number) by start, then kind. Texts are scanned as one run of bytes, if a line end always leads to the start state."""
        if not self.machine["reset"][10]:
            return [self.together([t])[0] for t in texts]
        return self.together(texts)

    def together(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        data = [(t or "").encode() for t in texts]
        whole = b"\n".join(data)
        raw = np.frombuffer(whole, np.uint8)
        flags = self.machine["accept"].astype(np.uint8 if len(self.kinds) <= 8 else np.int64)[states_after(raw, self.machine)]
        offsets = np.cumsum([0, *[len(d) + 1 for d in data]])
        places = None
        out: list[list] = [[] for _ in texts]
        for kind in range(len(self.kinds)):
            for start, end in self.spans(whole, flags >> kind & 1, kind):
                if places is None:  # code points before every byte
                    places = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                i = int(np.searchsorted(offsets, start, "right")) - 1
                first = places[offsets[i]]
                out[i].append((int(places[start] - first), int(places[end] - first), kind))
        return [sorted(spans) for spans in out]

    def spans(self, data: bytes, ends: np.ndarray, kind: int) -> Iterator[tuple[int, int]]:
        edges = np.diff(np.r_[0, ends.astype(np.int8), 0])
        first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        wanted = np.flatnonzero(last - first >= self.run[kind])
        taken: dict[int, int] = {}  # run: up to where matches reach once it is dealt with
        for run in wanted.tolist():
            # matches that begin before the last run ended depend on what that one took
            chain = [run]
            while chain[-1] > 0 and chain[-1] - 1 not in taken and self.begin(data, int(last[chain[-1]]), 0, kind) < last[chain[-1] - 1]:
                chain.append(chain[-1] - 1)
            for i in chain[::-1]:
                done, end = taken.get(i - 1, int(last[i - 1]) if i else 0), int(last[i])
                start = self.begin(data, end, done, kind)
                taken[i] = done if start < 0 else end
                if i == run and start >= 0 and end - self.checked(data, start, end, kind) >= self.least[kind]:
                    yield start, end

    def begin(self, data: bytes, end: int, done: int, kind: int) -> int:
        """The first place from `done` on at which a match begins that ends at `end`, or -1."""
        machine, state, found = self.back[kind], 0, -1
        step, dead = machine["rows"] if "rows" in machine else self.rows(machine), machine["dead"]
        accept = machine["accept_list"]
        for at in range(end - 1, done - 1, -1):
            state = step[state][data[at]]
            if state == dead:
                break
            if accept[state]:
                found = at
        return found

    def checked(self, data: bytes, start: int, end: int, kind: int) -> int:
        """Where the part of a match begins whose length is checked: after the longest head."""
        machine = self.head[kind]
        if machine is None:
            return start
        step, state, found = machine["rows"] if "rows" in machine else self.rows(machine), 0, start
        for at in range(start, end - 1):
            state = step[state][data[at]]
            if state == machine["dead"]:
                break
            if machine["accept_list"][state]:
                found = at + 1
        return found

    @staticmethod
    def rows(machine: dict) -> list[list[int]]:
        machine["accept_list"], machine["rows"] = machine["accept"].tolist(), machine["next"].tolist()
        return machine["rows"]


def finder(rules: dict[str, tuple] | None = None, batch_chars: int = 1 << 22):
    """UDF: text to an array of (kind, start, end), by start and then kind; offsets are code points, the end is exclusive."""
    rules = rules or RULES
    machine = compile_rules([p for p, *_ in rules.values()])

    @arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(machine, rules)
        for batch in batches:
            out = [spans for part in chunks(batch.to_pylist(), batch_chars) for spans in scanner.many(part)]
            yield pa.array([[{"kind": scanner.kinds[k], "start": s, "end": e} for s, e, k in spans] for spans in out], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return run


def find_secrets(docs: DataFrame, rules: dict[str, tuple] | None = None) -> DataFrame:
    """(doc_id, secrets) for every row of `docs` (doc_id, text); a null or empty text has none.

    Long texts cost one pass over their bytes. Repeated rows give repeated rows, no rows give none; other columns are ignored.
    """
    return docs.select("doc_id", finder(rules)("text").alias("secrets"))


def redactor(rules: dict[str, tuple] | None = None, batch_chars: int = 1 << 22):
    """UDF: text with every secret replaced by its kind in brackets; overlapping spans become one. Null stays null."""
    rules = rules or RULES
    machine = compile_rules([p for p, *_ in rules.values()])

    @arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(machine, rules)
        for batch in batches:
            parts = chunks(batch.to_pylist(), batch_chars)
            yield pa.array([redact(t, spans, scanner.kinds) for part in parts for t, spans in zip(part, scanner.many(part))], pa.string())

    return run


def redact(text: str | None, spans: list[tuple[int, int, int]], kinds: list[str]) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for start, end, kind in spans:
        if start >= done:
            out += [text[done:start], f"[{kinds[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def listed(spans: str = "secrets") -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text, one row per document."""
    base = "filter(secrets, s -> s.kind IN ('assign', 'access', 'hex'))"
    return find_secrets(docs).select(
        "doc_id",
        *[F.expr(f"CAST(size(filter(secrets, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in BASE],
        F.expr(f"sha2({listed(base)}, 256)").alias("base_sha256"),
        F.expr(listed()).alias("spans"),
    )
