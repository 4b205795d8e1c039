"""From words to operations: tokens, an append-only vocabulary, roles, and the operations they ask for."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

# Concepts, their kinds, the words that name them, and the operations they ask for.
CONCEPTS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "SHOW": ("ACTION", ("show", "display", "list", "give", "get", "return"), ("SHOW",)),
    "COUNT": ("ACTION", ("count", "number", "tally", "kitne", "kitna", "how many", "howmany"), ("GROUP", "COUNT")),
    "COMPARE": ("ACTION", ("compare", "versus", "vs", "difference", "diff"), ("COMPARE",)),
    "EXPLAIN": ("ACTION", ("explain", "why", "reason", "justify"), ("EXPLAIN",)),
    "ANALYZE": ("ACTION", ("analyze", "analyse", "analysis", "inspect", "examine"), ("SHOW",)),
    "FIND": ("ACTION", ("find", "search", "locate", "lookup"), ("SEARCH",)),
    "TRACE": ("ACTION", ("trace", "path", "route", "connect", "reach", "reaches"), ("PATH",)),
    "DEPEND": ("ACTION", ("depends", "depend", "dependency", "dependencies", "requires", "needs", "upstream"), ("DEPENDENCY",)),
    "IMPACT": ("ACTION", ("impacts", "impact", "affects", "affect", "downstream"), ("REACHABILITY",)),
    "REVERSE": ("ACTION", ("uses", "used-by", "usedby", "used by", "consumed-by", "consumedby", "consumed by", "consumers", "referenced-by", "referencedby", "referenced by", "points-to", "points to", "depended-on-by", "depended on by"), ("REVERSE",)),
    "EVIDENCE": ("ACTION", ("evidence", "source", "provenance", "cell", "sheet", "row-of", "backing"), ("EVIDENCE",)),
    "WHAT": ("QUESTION", ("what",), ()),
    "WHICH": ("QUESTION", ("which",), ()),
    "WHO": ("QUESTION", ("who", "whom"), ()),
    "WHERE": ("QUESTION", ("where",), ()),
    "HOWMANY": ("QUESTION", ("how-many", "howmany"), ("GROUP", "COUNT")),
    "TOP": ("QUALIFIER", ("top", "most", "highest", "best"), ("SORT_DESC", "LIMIT")),
    "BOTTOM": ("QUALIFIER", ("bottom", "least", "lowest", "worst", "fewest"), ("SORT_ASC", "LIMIT")),
    "FIRST": ("QUALIFIER", ("first", "earliest"), ("LIMIT",)),
    "LAST": ("QUALIFIER", ("last", "latest"), ("LIMIT",)),
    "UNIQUE": ("QUALIFIER", ("unique", "distinct", "different"), ("DISTINCT",)),
    "EQUALS": ("CONSTRAINT", ("equals", "equal", "is", "of"), ("FILTER",)),
    "GREATER": ("CONSTRAINT", ("greater", "more", "above", "over"), ("FILTER",)),
    "LESS": ("CONSTRAINT", ("less", "fewer", "below", "under"), ("FILTER",)),
    "CONTAINS": ("CONSTRAINT", ("contains", "has", "having", "with", "includes"), ("FILTER",)),
    "BETWEEN": ("CONSTRAINT", ("between", "range"), ("FILTER",)),
    "AFTER": ("TIME", ("after", "since", "from"), ("FILTER",)),
    "BEFORE": ("TIME", ("before", "until", "till"), ("FILTER",)),
    "DURING": ("TIME", ("during", "within"), ("FILTER",)),
    "AND": ("LOGIC", ("and", "plus", "also"), ()),
    "OR": ("LOGIC", ("or", "either"), ()),
    "NOT": ("LOGIC", ("not", "without", "except", "excluding"), ()),
    "TOTAL": ("VALUE_MOD", ("total", "sum", "summed"), ("SUM",)),
    "AVERAGE": ("VALUE_MOD", ("average", "avg", "mean"), ("GROUP", "AVG")),
    "MIN": ("VALUE_MOD", ("minimum", "min", "smallest"), ("MIN",)),
    "MAX": ("VALUE_MOD", ("maximum", "max", "largest", "biggest"), ("MAX",)),
}

# Classes of requests, and the words in a request that make it one; the first that fits counts.
REQUESTS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Q-03", ("trace", "depend", "flow", "produce", "consume")),
    ("Q-05", ("which command", "commands that", "commands run", "kaun se command")),
    ("Q-04", ("how does", "execution of", "run karta", "stages")),
    ("Q-07", ("audit", "dead", "orphan", "missing", "validate", "duplicate")),
    ("Q-08", ("why", "incomplete", "gap", "kyu", "adhura")),
    ("Q-02", ("uses", "used by", "who use")),
)


def request_class(text: str, verb: str = "") -> str:
    """The class of a request by its verb and words; Q-01 (a lookup) if no other fits."""
    if verb.upper() == "TRACE":
        return "Q-03"
    low = text.lower()
    return next((q for q, words in REQUESTS if any(w in low for w in words)), "Q-01")


@dataclass(frozen=True)
class Token:
    text: str
    norm: str
    start: int
    end: int


@dataclass(frozen=True)
class Candidate:
    word: str
    canonical: str
    type: str
    owner: str = ""
    confidence: float = 1.0
    version: int = 1
    status: str = "active"
    reason: str = ""


@dataclass
class Vocabulary:
    """Words and what they may mean; entries are added or marked, never changed or removed."""

    entries: dict[str, list[Candidate]] = field(default_factory=dict)

    def add(self, word: str, canonical: str, type: str, owner: str = "", confidence: float = 1.0) -> Candidate:
        w = word.strip().lower()
        held = self.entries.setdefault(w, [])
        c = Candidate(w, canonical, type, owner, confidence, 1 + sum(x.canonical == canonical for x in held))
        held.append(c)
        return c

    def _mark(self, word: str, canonical: str, status: str, reason: str) -> None:
        held = self.entries.get(word.lower(), [])
        for x in [x for x in held if x.canonical == canonical and x.status == "active"]:
            held[held.index(x)] = replace(x, status="superseded")
            held.append(replace(x, version=x.version + 1, status=status, reason=reason))

    def deprecate(self, word: str, canonical: str, reason: str = "") -> None:
        self._mark(word, canonical, "deprecated", reason)

    def reject(self, word: str, canonical: str, reason: str = "") -> None:
        self._mark(word, canonical, "rejected", reason)

    def candidates(self, word: str) -> list[Candidate]:
        """Active meanings, most confident first; on equal confidence the earlier entry."""
        return sorted((x for x in self.entries.get(word.lower(), []) if x.status == "active"), key=lambda x: -x.confidence)

    def history(self, word: str) -> list[Candidate]:
        return list(self.entries.get(word.lower(), []))


def grammar(vocabulary: Vocabulary | None = None) -> Vocabulary:
    v = vocabulary or Vocabulary()
    for concept, (kind, words, _) in CONCEPTS.items():
        for w in words:
            v.add(w, concept, kind, "grammar")
    return v


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\s?]+", text)]


def runs(text: str, longest: int) -> list[str]:
    """Runs of words of a question, as they stand there."""
    words = words_of(text)
    return [text[words[i][1] : words[j - 1][2]] for i in range(len(words)) for j in range(i + 1, min(i + longest, len(words)) + 1)]


def tokenize(text: str, vocabulary: Vocabulary, longest: int = 5, named: Callable[[str], bool] = lambda _: False) -> list[Token]:
    """Words, the longest phrase first that the vocabulary has or that is a name, with their places in the text."""
    words = words_of(text)
    out, i = [], 0
    while i < len(words):
        for n in range(min(longest, len(words) - i), 0, -1):
            norm = " ".join(w[0] for w in words[i : i + n]).lower()
            if n == 1 or vocabulary.candidates(norm) or named(text[words[i][1] : words[i + n - 1][2]]):
                out.append(Token(text[words[i][1] : words[i + n - 1][2]], norm, words[i][1], words[i + n - 1][2]))
                i += n
                break
    return out


@dataclass
class Intent:
    """Roles of a question's words."""

    concepts: list[str] = field(default_factory=list)
    targets: list[Candidate] = field(default_factory=list)
    values: list[int] = field(default_factory=list)
    unresolved: list[str] = field(default_factory=list)


def intent_of(tokens: list[Token], vocabulary: Vocabulary) -> Intent:
    out = Intent()
    for t in tokens:
        if t.norm.isdigit():
            out.values.append(int(t.norm))
            continue
        found = vocabulary.candidates(t.norm)
        if found and found[0].owner == "grammar":
            out.concepts.append(found[0].canonical)
        elif found:
            out.targets.append(found[0])
        else:
            out.unresolved.append(t.text)
    return out


def operations(intent: Intent) -> list[str]:
    """Operations in the order of the words, each once; a target without any is opened."""
    out: list[str] = []
    for c in intent.concepts:
        out += [op for op in CONCEPTS[c][2] if op not in out]
    return out or (["OPEN"] if intent.targets or intent.unresolved else [])
