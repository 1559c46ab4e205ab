import pytest

from termloom.plans.query import Node, QueryParseError, lex, parse, positive_terms


def shape(node: Node) -> str:
    if node.kind == "term":
        return node.words[0]
    if node.kind == "phrase":
        return '"' + " ".join(node.words) + '"'
    return f"({node.kind} {' '.join(map(shape, node.children))})"


def test_lexer_positions():
    assert [(t.kind, t.position) for t in lex("foo bar")] == [("term", 0), ("term", 4)]
    assert [t.kind for t in lex("a and b")] == ["term"] * 3
    assert lex('x "Exact Phrase" y')[1].words == ("Exact", "Phrase")


@pytest.mark.parametrize(
    "query, implicit, expected",
    [
        ("a b", "and", "(and a b)"),
        ("a b", "or", "(or a b)"),
        ("a OR b AND c", "and", "(or a (and b c))"),
        ("a b AND c", "or", "(and (or a b) c)"),
        ("NOT NOT a", "and", "(not (not a))"),
        ("(a OR b) c", "and", "(and (or a b) c)"),
        ('"x y" OR NOT z', "and", '(or "x y" (not z))'),
        ("(a b c)", "or", "(or (or a b) c)"),
        ("search-engine", "and", "(and search engine)"),
        ("a OR b OR c", "and", "(or (or a b) c)"),
        ("a NOT b OR c", "and", "(or (and a (not b)) c)"),
        ("a AND b c", "or", "(or (and a b) c)"),
        ("NOT (a OR b) NOT NOT c", "and", "(and (not (or a b)) (not (not c)))"),
        ("((a))", "and", "a"),
    ],
)
def test_trees(query, implicit, expected):
    assert shape(parse(query, implicit)) == expected


@pytest.mark.parametrize(
    "query, code, position",
    [
        ('ok "unclosed', "UNBALANCED_QUOTE", 3),
        ('a "" b', "EMPTY_PHRASE", 2),
        ("", "EMPTY_QUERY", 0),
        ("...", "EMPTY_QUERY", 0),
        ("a )", "UNBALANCED_PAREN", 2),
        ("(a", "UNBALANCED_PAREN", 0),
        ("()", "EMPTY_GROUP", 0),
        ("AND a", "MISSING_OPERAND", 0),
        ("a OR", "MISSING_OPERAND", 2),
        ("NOT", "MISSING_OPERAND", 0),
        ("a AND OR b", "MISSING_OPERAND", 2),
        ("(", "UNBALANCED_PAREN", 0),
        ("((a) b", "UNBALANCED_PAREN", 0),
        ("(a (b", "UNBALANCED_PAREN", 3),
        ("(OR a)", "MISSING_OPERAND", 1),
        ("a AND )", "MISSING_OPERAND", 2),
        ("a NOT )", "MISSING_OPERAND", 2),
        ("a ) OR", "UNBALANCED_PAREN", 2),
        ("a AND NOT", "MISSING_OPERAND", 6),
    ],
)
def test_errors(query, code, position):
    with pytest.raises(QueryParseError) as e:
        parse(query)
    assert (e.value.code, e.value.position) == (code, position)


def test_positive_terms_skip_not():
    assert positive_terms(parse('a "b c" NOT d NOT NOT e a')) == ["a", "b", "c"]
