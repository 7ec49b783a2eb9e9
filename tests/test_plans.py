import pytest
from pyspark.sql import functions as F

from quern.plans.parser import Parser, chips, rewrite_aliases, scan, without_chip
from quern.plans.predicates import UnsupportedFilter, compile_filter, parse_expression
from quern.plans.scopes import ALL, CUSTOM, SELECTED, Scope, analyze, apply_selection, decode


def parse(text, **how):
    return Parser(**how).parse(text)


def test_scan():
    assert scan('a "b c" (d)') == (["a", '"b c"', "(", "d", ")"], False)
    assert scan('x "open') == (["x", '"open'], True)


def test_free_terms_and_filters():
    p = parse('deck:"My Deck" bupropion "heart failure" -sleep')
    assert p.filters == ('deck:"My Deck"',) and p.filter_query == 'deck:"My Deck"'
    assert [(t.normalized, t.quoted, t.negated) for t in p.terms] == [("bupropion", False, False), ("heart failure", True, False), ("sleep", False, True)]
    assert not p.exact_only


@pytest.mark.parametrize("text", ["deck:A OR bupropion", "(a b)", "wild*card", "snake_case", "-(a) b"])
def test_exact_only(text):
    assert parse(text).exact_only


def test_filter_groups_stay():
    p = parse("(deck:A OR tag:b) word")
    assert p.filter_query == "(deck:A OR tag:b)" and not p.exact_only
    assert parse("deck:A AND word").filter_query == "deck:A"


@pytest.mark.parametrize(
    "text, want",
    [
        ("deck:A AND", "deck:A"), ("OR deck:A", "deck:A"), ("deck:A OR AND tag:b", "deck:A OR tag:b"), ("() deck:A", "deck:A"), ("deck:A ) tag:b", "deck:A tag:b"),
        ("(deck:A tag:b", "deck:A tag:b"), ("((deck:A))", "((deck:A))"), ("deck:A AND word AND tag:b", "deck:A tag:b"), ("(deck:A OR tag:b) AND -is:x word", "(deck:A OR tag:b) AND -is:x"), ("word", ""),
    ],
)
def test_filters_alone(text, want):
    assert parse(text).filter_query == want


def test_tokens_and_warnings():
    assert parse('"open').warnings == ("unmatched_quote",) and parse("a OR b").warnings == ("evaluated_exactly",)
    assert scan('a"b c"d\\ ("x\\"y)z") "tail\\') == (['a"b c"d\\', "(", '"x\\"y)z"', ")", '"tail\\'], True)
    assert [(t.text, t.quoted, t.negated) for t in parse('-"two words" -one').terms] == [("two words", True, True), ("one", False, True)]
    assert parse("").terms == () and parse(None).filter_query == ""


def test_fields_as_filters():
    assert parse("Front:x").filters == ()
    assert parse("Front:x", field_names=["Front"]).filters == ("Front:x",)
    assert parse("Fr*:x", field_names=["Front"]).filters == ("Fr*:x",)


def test_unfinished_filters():
    p = Parser()
    assert p.complete("word is:") == ("word", ("is:",))
    assert p.complete('word deck:"Some de') == ("word", ('deck:"Some de',))
    assert p.complete("is: word") == ("is: word", ())
    assert p.complete("deck:") == ("deck:", ())


def test_chips_and_aliases():
    assert chips(parse("deck:A word")) == ("deck:A",) and chips(parse("(deck:A)")) == ()
    assert without_chip("deck:A word", "deck:A") == "word"
    assert rewrite_aliases('notetype:X -notetype:y "notetype:z"') == 'note:X -note:y "notetype:z"'


def test_expression_tree():
    assert parse_expression("a b OR -c") == ("or", [("and", [("atom", "a"), ("atom", "b")]), ("not", ("atom", "c"))])
    for bad in ("(a", "a )", "OR a", "a OR"):
        with pytest.raises(UnsupportedFilter):
            parse_expression(bad)


def test_compiled_filters(spark):
    rows = [
        (1, [("Text", "heart failure and more")], ["Cardio::HF"], ["Step 2::A"], "Cloze", [10], [(1, True, False)]),
        (2, [("Text", "failing hearts")], ["other"], ["Step 2"], "Basic", [20], [(0, False, True)]),
    ]
    df = spark.createDataFrame(rows, "note_id bigint, fields array<struct<name:string,value:string>>, tags array<string>, decks array<string>, note_type string, card_ids array<bigint>, cards array<struct<flag:int,suspended:boolean,buried:boolean>>")
    for text, want in {
        "heart": [1, 2], '"heart failure"': [1], "w:heart": [1], "deck:\"step 2\"": [1, 2], "tag:cardio": [1], "note:cl*": [1], "-note:cloze": [2], "flag:1": [1],
        "is:buried": [2], "is:suspended OR nid:2": [1, 2], "Text:failing*": [2], "re:heart.*more": [1], "cid:20": [2], "(heart -tag:other)": [1], "": [1, 2], "he_rt": [1, 2],
    }.items():
        assert [r.note_id for r in df.where(compile_filter(text)).orderBy("note_id").collect()] == want, text
    with pytest.raises(UnsupportedFilter):
        compile_filter("rated:3")


def test_scopes():
    scope = Scope.of(["Parent", "Other", "Parent::Child B"], ["Parent::Child A"])
    assert scope.roots == ("Parent", "Other")
    names = ["Parent", "Parent::Child A", "Parent::Child A::x", "Parent::Child B", "Other", "Third"]
    assert [n for n in names if scope.state(n) == "in"] == ["Parent", "Parent::Child B", "Other"]
    assert scope.toggled("Parent::Child A") == Scope(("Parent", "Other"))
    assert scope.toggled("Parent") == Scope(("Other",))
    assert scope.toggled("Parent::Child A::x") == scope  # below an exclusion
    assert scope.toggled("Parent::Child B") == Scope(("Parent", "Other"), ("Parent::Child A", "Parent::Child B"))
    with pytest.raises(ValueError):
        Scope.of(["A"], ["B::c"])


def test_scope_column(spark):
    scope = Scope.of(["Parent", "Other"], ["Parent::Child A"])
    df = spark.createDataFrame([(n,) for n in ("Parent", "Parent::Child A", "parent::child b", "Other", "Otherwise")], "n string")
    assert {r.n for r in df.where(scope.column(F.col("n"))).collect()} == {"Parent", "parent::child b", "Other"}


def test_analyze_and_apply():
    assert analyze("word")[0] == ALL
    assert analyze('deck:"A B" word') == (SELECTED, Scope(("A B",)))
    assert analyze("(deck:A OR deck:B) word") == (SELECTED, Scope(("A", "B")))
    assert analyze("(deck:A -deck:A::x) word") == (SELECTED, Scope(("A",), ("A::x",)))
    for q in ("deck:A*", "deck:current", "deck:A OR word", "-deck:A", '"deck:'):
        assert analyze(q)[0] == CUSTOM, q
    assert decode(r'deck:"a\_b"') == "a_b"
    # a tab or a no-break space is part of a word; an ideographic space separates
    assert analyze("deck:A\tword") == (SELECTED, Scope(("A\tword",))) and analyze("deck:A\u00a0b") == (SELECTED, Scope(("A\u00a0b",)))
    assert analyze("deck:A\u3000word") == (SELECTED, Scope(("A",))) and analyze(r"deck:A\ B word") == (SELECTED, Scope(("A B",)))
    assert apply_selection("word", Scope(("A",))) == 'deck:"A" word'
    assert apply_selection("a OR b", Scope(("A",))) == 'deck:"A" (a OR b)'
    assert apply_selection("deck:A word", Scope()) == "word"
    assert apply_selection("(deck:A OR deck:B) AND word", Scope(("C",))) == 'deck:"C" word'
    with pytest.raises(ValueError):
        apply_selection("deck:A*", Scope(("B",)))
    for scope in (Scope(("A",)), Scope(("A", "x_y")), Scope(("A",), ("A::b",))):
        assert analyze(apply_selection("word", scope)) == (SELECTED, scope)
