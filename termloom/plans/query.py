"""Query language: lexer, parser, analysed trees. All of it runs on the driver."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Literal

from termloom.functions.analysis import AnalysisConfig, analyze, runs

Kind = Literal["term", "phrase", "and", "or", "not"]
_SPACES = " \t\n\r\f\v"


class QueryParseError(ValueError):
    """A malformed query: a code, and where in the query it broke."""

    def __init__(self, code: str, position: int, detail: str):
        super().__init__(f"{code} at {position}: {detail}")
        self.code, self.position = code, position


@dataclass(frozen=True)
class Node:
    """A query node; leaves have words (surface form, then terms), others have children."""

    kind: Kind
    words: tuple[str, ...] = ()
    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Lexeme:
    kind: str
    position: int
    words: tuple[str, ...] = ()

    @property
    def starts(self) -> bool:
        return self.kind in ("term", "phrase", "not", "(")


def lex(query: str) -> list[Lexeme]:
    out: list[Lexeme] = []
    at = 0
    while at < len(query):
        c = query[at]
        if c in _SPACES:
            at += 1
        elif c in "()":
            out.append(Lexeme(c, at))
            at += 1
        elif c == '"':
            end = query.find('"', at + 1)
            if end < 0:
                raise QueryParseError("UNBALANCED_QUOTE", at, "the quote is never closed")
            words = tuple(r for r, _, _ in runs(query[at + 1 : end]))
            if not words:
                raise QueryParseError("EMPTY_PHRASE", at, "no words in the phrase")
            out.append(Lexeme("phrase", at, words))
            at = end + 1
        else:
            end = at
            while end < len(query) and query[end] not in _SPACES and query[end] not in '"()':
                end += 1
            chunk = query[at:end]
            if chunk in ("AND", "OR", "NOT"):
                out.append(Lexeme(chunk.lower(), at))
            else:
                out += [Lexeme("term", at + start, (run,)) for run, start, _ in runs(chunk)]
            at = end
    return out


def _check(lexemes: list[Lexeme]) -> None:
    """Raise for the first lexeme that cannot stand between its neighbours."""
    unclosed: list[int] = []
    before = [None, *(t.kind for t in lexemes)]
    for t, left, right in zip(lexemes, before, [*lexemes[1:], None], strict=False):
        if t.kind in ("and", "or") and left not in ("term", "phrase", ")"):
            raise QueryParseError("MISSING_OPERAND", t.position, f"nothing to the left of {t.kind.upper()}")
        if t.kind in ("and", "or", "not") and not (right and right.starts):
            raise QueryParseError("MISSING_OPERAND", t.position, f"nothing to the right of {t.kind.upper()}")
        if t.kind == "(":
            if right and right.kind == ")":
                raise QueryParseError("EMPTY_GROUP", t.position, "nothing in the group")
            unclosed.append(t.position)
        elif t.kind == ")":
            if not unclosed:
                raise QueryParseError("UNBALANCED_PAREN", t.position, "no group to close")
            unclosed.pop()
    if unclosed:
        raise QueryParseError("UNBALANCED_PAREN", unclosed[-1], "the group is never closed")


#: How tightly operators bind; a group's opening holds whatever is inside it.
_BINDING = {"(": 0, "or": 1, "and": 2, "not": 3}


def _tree(lexemes: list[Lexeme], joint: Kind) -> Node:
    """The tree of checked lexemes, by a stack of operators that wait for what binds tighter.

    Side-by-side operands are joined by ``joint`` with the binding of AND."""
    done: list[Node] = []
    waiting: list[tuple[int, str]] = []

    def settle(binding: int) -> None:
        while waiting and waiting[-1][0] >= binding:
            kind = waiting.pop()[1]
            n = 1 if kind == "not" else 2
            done[-n:] = [Node(kind, children=tuple(done[-n:]))]

    after_operand = False
    for t in lexemes:
        if after_operand and t.starts:
            settle(_BINDING["and"])
            waiting.append((_BINDING["and"], joint))
        if t.kind == ")":
            settle(_BINDING["or"])
            waiting.pop()
        elif t.kind in ("and", "or"):
            settle(_BINDING[t.kind])
            waiting.append((_BINDING[t.kind], t.kind))
        elif t.kind in _BINDING:
            waiting.append((_BINDING[t.kind], t.kind))
        else:
            done.append(Node(t.kind, words=t.words))
        after_operand = t.kind in ("term", "phrase", ")")
    settle(_BINDING["or"])
    return done.pop()


def parse(query: str, implicit: str = "and") -> Node:
    """The tree of a query; side-by-side words mean ``implicit`` ('and' or 'or')."""
    lexemes = lex(query)
    if not lexemes:
        raise QueryParseError("EMPTY_QUERY", 0, "no words to search")
    _check(lexemes)
    return _tree(lexemes, "or" if implicit == "or" else "and")


def analyzed(node: Node, config: AnalysisConfig) -> Node:
    """The tree with every leaf's words as index terms; stop-word leaves become empty."""
    if node.children:
        return replace(node, children=tuple(analyzed(c, config) for c in node.children))
    return replace(node, words=tuple(t.term for w in node.words for t in analyze(w, config)))


def leaves(node: Node, positive: bool = False) -> list[Node]:
    """Leaves in order; ``positive`` leaves out everything under NOT."""
    if node.kind == "not" and positive:
        return []
    return [leaf for c in node.children for leaf in leaves(c, positive)] if node.children else [node]


def leaf_terms(node: Node) -> list[str]:
    return list(dict.fromkeys(t for leaf in leaves(node) for t in leaf.words))


def positive_terms(node: Node) -> list[str]:
    return list(dict.fromkeys(t for leaf in leaves(node, True) for t in leaf.words))
